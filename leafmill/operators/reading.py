"""Words and lines of reading engines: lines from words, captions that go on, figure crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of_words(words: DataFrame) -> DataFrame:
    """``page, line, text, x1, y1, x2, y2, confidence`` from words with page, block, par, line_no, ord, text, confidence and
    (x, y, w, h); lines are numbered by their first word."""
    said = words.where("text is not null and trim(text) <> ''")
    grouped = said.groupBy("page", "block", "par", "line_no").agg(
        F.min("ord").alias("first"),
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"),
        F.min("x").alias("x1"),
        F.min("y").alias("y1"),
        F.max(F.col("x") + F.col("w")).alias("x2"),
        F.max(F.col("y") + F.col("h")).alias("y2"),
        F.avg("confidence").alias("confidence"),
    )
    return grouped.select("page", F.col("first").alias("line"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"), "x1", "y1", "x2", "y2", "confidence")


def kept_detections(detections: DataFrame, least: float = 0.3) -> DataFrame:
    """Detections with a text and a confidence of at least ``least``."""
    return detections.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("confidence") >= least))


def continued_caption(lines: Column, most: int = 3, look: int = 9) -> Column:
    """A caption's text and box with the lines under it that go on: aligned, close, short and without a label of their own.

    ``lines`` is an ordered array of (text, x1, y1, x2, y2), the caption's own line first.
    """
    start = F.struct(lines[0]["text"].alias("text"), *[lines[0][c].alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(s: Column, x: Column) -> Column:
        gap = x["y1"] - s["y2"]
        goes_on = s["open"] & (s["n"] < most) & gap.between(-12, 35) & (F.abs(x["x1"] - s["x1"]) <= 40) & (F.length(x["text"]) < 90) & ~x["text"].rlike(r"(?i)^\s*(?:fig|table|activity)")
        grown = F.struct(F.concat_ws(" ", s["text"], x["text"]).alias("text"), F.least(s["x1"], x["x1"]).alias("x1"), F.least(s["y1"], x["y1"]).alias("y1"), F.greatest(s["x2"], x["x2"]).alias("x2"), F.greatest(s["y2"], x["y2"]).alias("y2"), (s["n"] + 1).alias("n"), s["open"].alias("open"))
        kept = F.struct(*[s[c].alias(c) for c in ("text", "x1", "y1", "x2", "y2", "n", "open")])
        return F.when(goes_on, grown).otherwise(kept)

    return F.aggregate(F.slice(lines, 2, look), start, add)


def placeholder_captions(references: DataFrame, known: DataFrame) -> DataFrame:
    """``page, number, text, confidence`` for figures that a page names and none of its captions has."""
    return references.join(known.select("page", "number"), ["page", "number"], "left_anti").select("page", "number", F.concat(F.lit("Figure "), F.col("number")).alias("text"), F.lit(0.0).alias("confidence"))


def caption_graph(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """``source, target, relation`` edges: captions of figures, and pages' references to their figures."""
    of = captions.join(figures.select("page", "number", F.col("figure").alias("target")), ["page", "number"]).select(F.col("caption").alias("source"), "target", F.lit("caption_of").alias("relation"))
    refs = figures.select(F.col("page").alias("source"), F.col("figure").alias("target"), F.lit("references").alias("relation"))
    return of.union(refs).distinct()


def is_accepted(quality: Column, text: Column, least: float = 0.70) -> Column:
    """Whether a first reading is good enough, or another engine should read."""
    return (quality >= least) & (F.trim(F.coalesce(text, F.lit(""))) != "")


def is_caption_block(text: Column, longest: int = 380) -> Column:
    plain = F.trim(F.coalesce(text, F.lit("")))
    return (plain != "") & (F.length(plain) <= longest)


# Labels of a detector that are figures (fixed values).
DETECTED = ("picture", "diagram", "figure", "image", "chart", "graph")


def kept_boxes(detections: DataFrame, least: int = 4000, share: float = 0.55) -> DataFrame:
    """``page, label, box, area, place`` of detections (page, label, box, width, height) that can be figures, the largest first; no label counts
    as Picture; boxes are cut to whole pixels."""
    label = F.trim(F.coalesce(F.nullif("label", F.lit("")), F.lit("Picture")))
    whole = F.transform("box", lambda v: v.cast("int").cast("bigint"))
    rows = detections.withColumn("label", label).withColumn("box", whole).withColumn("area", (F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1]))
    kept = rows.where(F.lower("label").isin(*DETECTED) & (F.col("area") >= least) & (F.col("area") <= F.col("width") * F.col("height") * share))
    order = Window.partitionBy("page").orderBy(F.desc("area"), "box")
    return kept.select("page", "label", "box", "area").withColumn("place", F.row_number().over(order))


def starts_caption(lines: Column, at: Column) -> Column:
    """Whether the line at ``at`` of ordered lines (text, x1, y1, x2, y2) isn't the rest of the sentence above it: the last aligned line close
    above must have ended."""
    own = F.get(lines, at)
    above = F.filter(F.slice(lines, 1, at), lambda x: (F.abs(x["x1"] - own["x1"]) <= 40) & (own["y1"] - x["y2"]).between(-12, 25))
    last = F.get(above, F.size(above) - 1)["text"]
    return last.isNull() | last.rlike(r"[.!?:)]\s*$")


def subfigure_labels(text: Column) -> Column:
    """The tags in round brackets that a text has, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([a-zA-Z0-9]+)\)"), F.lit(1)), F.lower)


def labelled_parts(parts: DataFrame, labels: DataFrame, reach: float = 60.0) -> DataFrame:
    """Parts (page, figure, tag, bottom) with the first label (page, tag, y, ord, box) of their tag that stands near the figure's lower edge."""
    near = parts.join(labels.select("page", "tag", "y", "ord", F.col("box").alias("label_box")), ["page", "tag"]).where(F.abs(F.col("y") - F.col("bottom")) <= reach)
    first = near.groupBy("page", "figure", "tag").agg(F.min_by("label_box", "ord").alias("label_box"))
    return parts.join(first, ["page", "figure", "tag"], "left")


_READING = "struct<rec_boxes:array<array<double>>,dt_polys:array<array<array<double>>>,rec_texts:array<string>,rec_scores:array<double>>"


def engine_lines(raw: Column) -> Column:
    """(box, text, score) of an engine's JSON result, its lists nested under ``res`` or not, cut to the shortest; polygons become boxes."""
    data = F.coalesce(F.from_json(raw, f"struct<res:{_READING}>")["res"], F.from_json(raw, _READING))
    hull = F.transform(data["dt_polys"], lambda p: F.array(F.array_min(F.transform(p, lambda q: q[0])), F.array_min(F.transform(p, lambda q: q[1])), F.array_max(F.transform(p, lambda q: q[0])), F.array_max(F.transform(p, lambda q: q[1]))))
    boxes = F.when(F.size(data["rec_boxes"]) > 0, data["rec_boxes"]).otherwise(F.coalesce(hull, F.array().cast("array<array<double>>")))
    n = F.least(F.size(boxes), F.coalesce(F.size(data["rec_texts"]), F.lit(0)), F.coalesce(F.size(data["rec_scores"]), F.lit(0)))
    return F.slice(F.transform(boxes, lambda b, i: F.struct(b.alias("box"), F.get(data["rec_texts"], i).alias("text"), F.get(data["rec_scores"], i).alias("score"))), 1, F.greatest(n, F.lit(0)))
