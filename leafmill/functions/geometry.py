"""Boxes as (x1, y1, x2, y2) columns or arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union is empty."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def area_ratio(b: Column, width: Column, height: Column) -> Column:
    return area(b) / F.greatest(width * height, F.lit(1))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width as a share of the narrower box."""
    shared = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    return shared / F.greatest(F.least(a[2] - a[0], b[2] - b[0]), F.lit(1.0))


def clamp(b: Column, width: Column, height: Column) -> Column:
    x = lambda v: F.least(F.greatest(v, F.lit(0.0)), width.cast("double"))
    y = lambda v: F.least(F.greatest(v, F.lit(0.0)), height.cast("double"))
    return F.array(x(b[0]), y(b[1]), x(b[2]), y(b[3]))


def validity(b: Column, width: Column, height: Column) -> Column:
    """ok, or what is wrong with a box: not four values, not ordered, outside of its image."""
    c = clamp(b, width, height)
    return F.when(b.isNull() | (F.size(b) != 4), "malformed").when((b[2] <= b[0]) | (b[3] <= b[1]), "not_ordered").when((c[2] <= c[0]) | (c[3] <= c[1]), "outside").otherwise("ok")


def from_xywh(b: Column, width: Column, height: Column) -> Column:
    """Corner form of (x, y, w, h), clamped; shares of the image are told by values up to 1.5; null where nothing is left."""
    shares = F.array_max(b) <= 1.5
    scaled = F.when(shares, F.array(b[0] * width, b[1] * height, b[2] * width, b[3] * height)).otherwise(b)
    corner = clamp(F.array(scaled[0], scaled[1], scaled[0] + scaled[2], scaled[1] + scaled[3]), width, height)
    return F.when((F.size(b) == 4) & (corner[2] > corner[0]) & (corner[3] > corner[1]), corner)


def location_tokens(b: Column, width: Column, height: Column, bins: int = 1000) -> Column:
    """A box as four ``<loc_n>`` marks, n from 0 to ``bins - 1``."""
    def mark(v: Column, side: Column) -> Column:
        return F.format_string("<loc_%d>", F.least(F.greatest(F.floor(v / (side / F.lit(float(bins)))), F.lit(0)), F.lit(bins - 1)))

    return F.concat(mark(b[0], width), mark(b[1], height), mark(b[2], width), mark(b[3], height))


def greedy_matches(pairs: Column) -> Column:
    """One-to-one matches from an array of (iou, g, p): the largest first, ties by larger indices; the matched pairs."""
    start = F.struct(F.array().cast("array<int>").alias("g"), F.array().cast("array<int>").alias("p"), F.array().cast("array<struct<iou:double,g:int,p:int>>").alias("m"))

    def take(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["g"], x["g"]) & ~F.array_contains(s["p"], x["p"])
        return F.when(free, F.struct(F.array_append(s["g"], x["g"]).alias("g"), F.array_append(s["p"], x["p"]).alias("p"), F.array_append(s["m"], x).alias("m"))).otherwise(s)

    return F.aggregate(F.sort_array(pairs, asc=False), start, take, lambda s: s["m"])


def from_box(b: Column, width: Column, height: Column, form: str = "auto") -> Column:
    """Corner form, clamped, of a box given as xyxy or xywh, or as what it looks like; shares of the image are told by values up to 1.5; null
    where nothing is left or it hasn't four values."""
    shares = F.array_max(b) <= 1.5
    p = F.when(shares, F.array(b[0] * width, b[1] * height, b[2] * width, b[3] * height)).otherwise(b)
    size = F.array(p[0], p[1], p[0] + p[2], p[1] + p[3])
    if form == "xyxy":
        corner = p
    elif form == "xywh":
        corner = size
    else:
        fits = (p[0] + p[2] <= width * 1.02) & (p[1] + p[3] <= height * 1.02) & (p[2] > 0) & (p[3] > 0)
        ordered = (p[2] > p[0]) & (p[3] > p[1])
        wide = ordered & ((p[2] > width * 0.5) | (p[3] > height * 0.5)) & (p[0] + p[2] > width)
        corner = F.when(fits & ~wide, size).when(ordered, p).otherwise(size)
    c = clamp(corner, width, height)
    return F.when((F.size(b) == 4) & (c[2] > c[0]) & (c[3] > c[1]), c)


def crop_box(b: Column, width: Column, height: Column, obstacles: Column, share: float = 0.05, least: float = 10.0, most: float = 30.0, gap: float = 2.0) -> Column:
    """A box with a rim, drawn in to ``gap`` before each obstacle that reaches into the rim; null where 10 or less is left on a side."""
    zero = F.lit(0.0)
    px, py = (F.least(F.greatest((b[i + 2] - b[i]) * share, F.lit(least)), F.lit(most)) for i in (0, 1))
    start = F.array(F.greatest(b[0] - px, zero), F.greatest(b[1] - py, zero), F.least(b[2] + px, width.cast("double")), F.least(b[3] + py, height.cast("double")))

    def avoid(s: Column, o: Column) -> Column:
        left = F.when((o[2] <= b[0]) & (o[2] > s[0]), F.greatest(o[2] + gap, zero)).otherwise(s[0])
        up = F.when((o[3] <= b[1]) & (o[3] > s[1]), F.greatest(o[3] + gap, zero)).otherwise(s[1])
        right = F.when((o[0] >= b[2]) & (o[0] < s[2]), F.least(o[0] - gap, width.cast("double"))).otherwise(s[2])
        down = F.when((o[1] >= b[3]) & (o[1] < s[3]), F.least(o[1] - gap, height.cast("double"))).otherwise(s[3])
        return F.array(left, up, right, down)

    c = F.aggregate(F.coalesce(obstacles, F.array().cast("array<array<double>>")), start, avoid)
    return F.when((c[2] > c[0] + 10) & (c[3] > c[1] + 10), c)


def search_window(caption: Column, width: Column, height: Column, above: bool, reach: int = 600, sideways: int = 250) -> Column:
    """Where a scan is searched for the figure of a caption, in whole pixels, two per cent away from the rim."""
    rim = lambda side, share: F.floor(side * share).cast("int")
    x1, x2 = F.greatest(rim(width, 0.02), caption[0] - sideways), F.least(rim(width, 0.98), caption[2] + sideways)
    if above:
        y1 = F.greatest(rim(height, 0.02), caption[1] - reach)
        return F.array(x1, y1, x2, F.greatest(y1 + 20, caption[1] - 5))
    return F.array(x1, F.least(height - 20, caption[3] + 5), x2, F.least(rim(height, 0.98), caption[3] + reach))
