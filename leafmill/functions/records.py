"""Functions over single records: page visuals, identities, keys, raw annotation forms."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

#: Buckets of the lexical embedding.
DIM = 512


def page_status(note: Column) -> Column:
    """ok, degraded or failed by the note of the reading engine; the first rule that fits counts."""
    n = F.coalesce(note, F.lit(""))
    return F.when(n.startswith("Tesseract selected"), "degraded").when(n.contains("unavailable") | n.startswith("OCR Error"), "failed").when(n.contains("no readable text"), "degraded").otherwise("ok")


def is_content_image(width: Column, height: Column, deviations: Column) -> Column:
    """Large enough and not of one colour; ``deviations`` are the channels' standard deviations."""
    flat = F.forall(deviations, lambda d: d < 2.0)
    return (width * height >= 5000) & ~flat & (F.aggregate(deviations, F.lit(0.0), lambda s, d: s + d) >= 12.0)


def is_code_image(page: Column, width: Column, height: Column) -> Column:
    """A small square on the first page."""
    return (page == 1) & (width / height).between(0.85, 1.15) & (width < 400) & (height < 400)


def is_full_page(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    return (width >= 0.90 * page_width) & (height >= 0.90 * page_height)


def is_drawing(box: Column, page_width: Column, page_height: Column) -> Column:
    """A drawing on the page that isn't the page itself nor at its upper or lower rim."""
    outside = (box[2] <= 0) | (box[3] <= 0) | (box[0] >= page_width) | (box[1] >= page_height)
    whole = (box[2] - box[0] >= 0.95 * page_width) & (box[3] - box[1] >= 0.95 * page_height)
    return ~outside & ~whole & (box[1] > 15) & (box[3] < page_height - 15)


def is_contour(box: Column, page_width: Column, page_height: Column) -> Column:
    """A region of a scan that can be a figure, by its place, size and shape."""
    w, h = box[2] - box[0], box[3] - box[1]
    inside = (box[1] >= 0.07 * page_height) & (box[3] <= 0.93 * page_height)
    return inside & (w >= 120) & (h >= 90) & (w * h >= 20000) & ~((w > 0.88 * page_width) & (h > 0.88 * page_height)) & (w / h <= 4) & (h / w <= 4)


def box_of_points(points: Column) -> Column:
    """(x, y, width, height) in whole pixels of a polygon, given as an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    low, top = F.array_min(xs).cast("int"), F.array_min(ys).cast("int")
    return F.array(low, top, F.array_max(xs).cast("int") - low, F.array_max(ys).cast("int") - top)


def padded(box: Column, page_width: Column, page_height: Column, share: float = 0.05, least: float = 10.0, most: float = 30.0) -> Column:
    """A box with a rim of a share of its sides, within limits and within the page."""
    px = F.least(F.greatest((box[2] - box[0]) * share, F.lit(least)), F.lit(most))
    py = F.least(F.greatest((box[3] - box[1]) * share, F.lit(least)), F.lit(most))
    return F.array(F.greatest(box[0] - px, F.lit(0.0)), F.greatest(box[1] - py, F.lit(0.0)), F.least(box[2] + px, page_width.cast("double")), F.least(box[3] + py, page_height.cast("double")))


def halves(box: Column, overlap: float = 5.0, wide: float = 1.2) -> Column:
    """The two sub-figures of a box: side by side where it is wide, else one above the other, with a small overlap."""
    w, h = box[2] - box[0], box[3] - box[1]
    mx, my = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    beside = F.array(F.array(box[0], box[1], mx + overlap, box[3]), F.array(mx - overlap, box[1], box[2], box[3]))
    above = F.array(F.array(box[0], box[1], box[2], my + overlap), F.array(box[0], my - overlap, box[2], box[3]))
    return F.when(w > wide * h, beside).otherwise(above)


def subfigures(caption: Column) -> Column:
    """(tag, description) of the parts that a caption lists as (a) ... (b) ...; also (i) to (iv)."""
    pattern = r"(?<![A-Za-z0-9+\-])\(([a-h]|i{1,3}|iv)\)\s*([^()]*)"
    tags, said = (F.regexp_extract_all(caption, F.lit(pattern), F.lit(i)) for i in (1, 2))
    clean = F.transform(said, lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r"(?:[\s,;.]*\band\b)?[\s,;.]*$", ""))
    return F.arrays_zip(tags.alias("tag"), clean.alias("text"))


def nearby_context(text: Column, label: Column, before: int = 250, after: int = 350, without: int = 400) -> Column:
    """What stands around the first mention of a label, or the beginning of the text."""
    at = F.instr(text, label)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at + after - start)).otherwise(F.substring(text, 1, without))


def canonical_id(document: Column, page: Column, kind: str, index: Column) -> Column:
    return F.format_string(f"doc:%s:page:%d:{kind}:%d", document, page, index)


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def metadata(text: Column) -> Column:
    """A JSON object as a map of texts; an empty map for null and for what isn't one."""
    parsed = F.from_json(text, "map<string,string>")
    return F.when(parsed.isNotNull() & text.rlike(r"^\s*\{"), parsed).otherwise(F.create_map().cast("map<string,string>"))


def annotations_of(category_ids: Column, labels: Column, boxes: Column, picture_ids: tuple[int, ...] = (6, 7)) -> Column:
    """Parallel lists of ids or names and boxes as (category, bbox), cut to the shortest and each pair once."""
    n = F.least(F.size(F.coalesce(labels, category_ids.cast("array<string>"))), F.size(boxes))
    picked = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.when((F.try_element_at(labels, i) == "Picture") | F.try_element_at(category_ids, i).isin(*picture_ids), "Picture").otherwise(F.coalesce(F.try_element_at(labels, i), F.lit("Other"))).alias("category"), F.try_element_at(boxes, i).alias("bbox")))
    return F.when(n > 0, F.array_distinct(picked)).otherwise(F.slice(picked, 1, 0))


def kind_of_dataset(dataset: Column) -> Column:
    return F.when(dataset.isin("DocLayNet", "AI2D"), "real").when(dataset == "SyntheticLayout", "derived").otherwise("other")


def progress(done: Column, total: Column) -> Column:
    """Share of a job that is done, within 0 and 1."""
    return F.least(F.greatest(F.round(0.05 + 0.85 * done / F.greatest(total, F.lit(1)), 3), F.lit(0.0)), F.lit(1.0))


def api_owner(key: Column) -> Column:
    """Owner of an API key written as ``key:owner``; a bare key has a name by its hash."""
    parts = F.split(key, ":", 2)
    return F.when(F.size(parts) > 1, parts[1]).otherwise(F.concat(F.lit("key-"), F.substring(F.sha2(parts[0], 256), 1, 12)))


def signed(path: Column, expires: Column, secret: str) -> Column:
    """HMAC-SHA256 of ``path|expires``, 32 hex digits."""

    @F.pandas_udf(StringType())
    def sign(message: pd.Series) -> pd.Series:
        return message.map(lambda m: None if m is None else hmac.new(secret.encode(), m.encode(), hashlib.sha256).hexdigest()[:32])

    return sign(F.concat_ws("|", path, expires.cast("string")))


def is_signed(path: Column, expires: Column, signature: Column, secret: str, now: Column) -> Column:
    """Whether a signature is right and not over."""
    return F.coalesce((expires >= now) & (signature == signed(path, expires, secret)), F.lit(False))


@F.pandas_udf(ArrayType(FloatType()))
def lexical_embedding(tokens: pd.Series) -> pd.Series:
    """Token counts in hashed buckets, of length 1; all zero without tokens."""

    def one(words: np.ndarray | None) -> list[float] | None:
        if words is None:
            return None
        v = np.zeros(DIM, np.float32)
        for w in words:
            v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") % DIM] += 1
        norm = float(np.sqrt((v * v).sum()))
        return (v / norm if norm else v).tolist()

    return tokens.map(one)


def mentions(text: Column) -> Column:
    """Numbers of the figures, tables, activities and charts that a page names, as texts in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:Fig(?:ure)?\.?|Table|Activity|Chart)\s*(\d+(?:\.\d+)?)"), F.lit(1))))
