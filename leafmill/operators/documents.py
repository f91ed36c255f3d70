"""Raw pages and figures as one document graph: figures, captions and the edges between them, and its serialised form.

All functions map tables of many books at once; a page's figures are ordered and never more than a page holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import records as M
from leafmill.functions import text as T
from leafmill.operators import figures as V

#: Fields that a later row of a figure fills where the first has none.
FILLED = ("label", "description", "image_path", "context", "surrounding", "source_type")
#: How sure a mention of a figure on its page is.
MENTIONED = 0.85
_PAGE = ("book_id", "page_number")


def merged(figures: DataFrame) -> DataFrame:
    """One row for each page and normalised id, with ``idx`` from 1 in the order of first rows.

    ``figures`` has book_id, page_number, ord, figure_id, label, caption, labels_inside, box, confidence and the fields of ``FILLED``. The first row
    counts; gaps are filled from later ones, labels inside are united in order, captions that say something new are put behind.
    """
    rows = figures.withColumn("number", V.normalized_id(F.col("figure_id"), F.col("label"), F.col("caption"))).where("number is not null")
    kept = F.struct("ord", "figure_id", "caption", "labels_inside", "box", "confidence", *FILLED)
    listed = rows.groupBy(*_PAGE, "number").agg(F.array_sort(F.collect_list(kept)).alias("l"))
    filled = [F.get(F.filter(F.transform(F.col("l")[f], lambda v: F.nullif(v, F.lit(""))), lambda v: v.isNotNull()), F.lit(0)).alias(f) for f in FILLED]
    said = F.filter(F.transform(F.col("l")["caption"], lambda c: F.coalesce(c, F.lit(""))), lambda c: c != "")
    caption = F.aggregate(said, F.lit(""), lambda s, c: F.when(s == "", c).when(F.contains(s, c), s).otherwise(F.trim(F.concat_ws(" ", s, c))))
    inside = F.array_distinct(F.flatten(F.transform(F.col("l")["labels_inside"], lambda a: F.coalesce(a, F.array().cast("array<string>")))))
    first = F.get("l", F.lit(0))
    out = listed.select(*_PAGE, "number", first["ord"].alias("ord"), first["figure_id"].alias("figure_id"), first["box"].alias("box"), F.coalesce(first["confidence"], F.lit(0.0)).alias("confidence"), F.nullif(F.trim(caption), F.lit("")).alias("caption"), inside.alias("labels_inside"), *filled)
    return out.withColumn("idx", F.row_number().over(Window.partitionBy(*_PAGE).orderBy("ord", "number"))).drop("ord")


def graph(figures: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Figures, captions and edges of all pages. ``mentions`` (book_id, page_number, ord, reference) are the figures that pages name.

    Only a real caption is one; a named figure of a page that no caption of it has gets a placeholder of confidence 0. Edges are ``caption_of`` from
    captions and ``references`` from pages, which hold the reference.
    """
    page_id = F.concat(F.lit("doc:"), F.col("book_id"), F.lit(":page:"), F.col("page_number").cast("string"))
    rows = merged(figures).withColumn("page_id", page_id).withColumn("id", M.canonical_id(F.col("book_id"), F.col("page_number"), "figure", F.col("idx")))
    reference = F.coalesce(*[T.explicit_reference(F.col(c)) for c in ("label", "caption", "surrounding")])
    rows = rows.withColumn("reference", reference).withColumn("figure_type", V.figure_type(F.col("label"), F.col("caption"), F.col("source_type")))
    rows = rows.withColumn("extracted_text", F.coalesce("caption", "label")).withColumn("surrounding", F.coalesce("surrounding", "context"))
    rows = rows.withColumn("caption_id", F.when(F.col("caption").isNotNull(), M.canonical_id(F.col("book_id"), F.col("page_number"), "caption", F.col("idx"))))
    real = rows.where("caption is not null").select(*_PAGE, F.col("caption_id").alias("id"), "page_id", F.col("caption").alias("text"), F.col("id").alias("attached_to"), "reference", F.col("confidence").cast("double").alias("confidence"))
    named = mentions.withColumn("page_id", page_id).withColumn("reference", F.coalesce(T.explicit_reference(F.concat(F.lit("Figure "), "reference")), F.trim("reference"))).where("reference <> ''")
    once = named.groupBy(*_PAGE, "page_id", "reference").agg(F.min("ord").alias("ord"))
    missing = once.join(real.where("reference is not null").select(*_PAGE, "reference").distinct(), [*_PAGE, "reference"], "left_anti")
    empty = missing.select(*_PAGE, M.canonical_id(F.col("book_id"), F.col("page_number"), "reference", F.col("ord")).alias("id"), "page_id", F.concat(F.lit("Figure "), "reference").alias("text"), F.lit(None).cast("string").alias("attached_to"), "reference", F.lit(0.0).alias("confidence"))
    of = rows.where("caption is not null").select(F.concat("caption_id", F.lit("->"), "id").alias("id"), F.col("caption_id").alias("source"), F.col("id").alias("target"), F.lit("caption_of").alias("relation"), F.col("confidence").cast("double").alias("confidence"))
    to = rows.where("reference is not null").select(F.concat("page_id", F.lit("->"), "id", F.lit(":ref:"), "reference").alias("id"), F.col("page_id").alias("source"), F.col("id").alias("target"), F.lit("references").alias("relation"), F.lit(MENTIONED).alias("confidence"))
    return rows, real.union(empty), of.union(to)


def visible(figures: DataFrame) -> DataFrame:
    """Figures of :func:`graph` as readers and answers see them: by the number of their caption, or by their place; each id of a page once."""
    ref = F.when(F.col("caption").isNotNull(), F.col("reference"))
    rows = figures.withColumn("figure_id", F.coalesce(ref, F.col("idx").cast("string"))).withColumn("figure_label", F.when(ref.isNotNull(), F.concat(F.lit("Figure "), ref)).otherwise(F.coalesce("extracted_text", "id")))
    order = Window.partitionBy(*_PAGE, "figure_id").orderBy("idx")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def serialised(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """``book_id, page_number, json``: each page (book_id, page_number, page_type, status, text) with its visible figures as one JSON object."""
    shown = F.struct("idx", "figure_id", "figure_label", "caption", "source_type", "labels_inside", "surrounding", "image_path", "box", "confidence", "figure_type")
    listed = visible(figures).groupBy(*_PAGE).agg(F.array_sort(F.collect_list(shown)).alias("figures"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    rows = pages.join(listed, list(_PAGE), "left")
    images = F.filter(F.transform(F.coalesce("figures", F.array().cast(dict(listed.dtypes)["figures"])), lambda f: f["image_path"]), lambda p: p.isNotNull())
    body = F.struct("page_number", F.coalesce("page_type", F.lit("Digital")).alias("page_type"), F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("char_count"), words.alias("word_count"), F.coalesce("figures", F.array().cast(dict(listed.dtypes)["figures"])).alias("figures"), images.alias("images"))
    return rows.select(*_PAGE, F.to_json(body).alias("json"))


def compound(elements: Column, caption: Column, above: Column, below: Column, gap: float = 2.0) -> Column:
    """The box of a figure made of several elements (an array of boxes) and its caption, not beyond what stands above and below."""
    side = lambda i: F.transform(elements, lambda b: b[i])
    top = F.greatest(F.array_min(side(1)), F.coalesce(above + gap, F.lit(float("-inf"))))
    bottom = F.least(F.array_max(side(3)), F.coalesce(below - gap, F.lit(float("inf"))))
    both = F.array(F.least(F.array_min(side(0)), caption[0]), F.least(top, caption[1]), F.greatest(F.array_max(side(2)), caption[2]), F.greatest(bottom, caption[3]))
    return F.when(F.size(elements) > 0, both)


def labels_within(box: Column, caption: Column, blocks: Column, least: int = 2, most: int = 90) -> Column:
    """Texts of the blocks (text, box) that lie wholly in a box and don't cut its caption."""
    def fits(b: Column) -> Column:
        inside = (b["box"][0] >= box[0]) & (b["box"][1] >= box[1]) & (b["box"][2] <= box[2]) & (b["box"][3] <= box[3])
        return inside & (G.intersection(b["box"], caption) <= 0) & F.length(F.trim(b["text"])).between(least, most)

    return F.transform(F.filter(blocks, fits), lambda b: F.trim(b["text"]))


def body_obstacles(blocks: Column, captions: Column, longest: int = 80) -> Column:
    """Boxes of the text blocks (text, box) that are body text: long, and cutting no caption."""
    return F.transform(F.filter(blocks, lambda b: (F.length(F.trim(b["text"])) > longest) & ~F.exists(captions, lambda c: G.intersection(b["box"], c) > 0)), lambda b: b["box"])


def standing_alone(images: Column, claimed: Column) -> Column:
    """Images (an ordered array of boxes) that cut nothing claimed; an image that is taken is claimed for those after it."""
    start = F.struct(claimed.alias("c"), F.array().cast("array<array<double>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        hit = F.exists(s["c"], lambda c: G.intersection(b, c) > 0)
        return F.when(hit, s).otherwise(F.struct(F.array_append(s["c"], b).alias("c"), F.array_append(s["out"], b).alias("out")))

    return F.aggregate(images, start, step, lambda s: s["out"])


# Fonts of marks (fixed values).
SYMBOL_FONT = r"(?i)wingding|symbol|dingbat|webding|zapf|mt ?extra|marlett|bookshelf|monotype ?sorts"
_LABEL_ONLY = r"(?i)^\s*(?:fig(?:ure)?s?\.?|table)\s*\d{1,2}(?:\.\d{1,2}){0,2}\s*[:.]?\s*$"


def block_text(lines: Column, caption: bool = False) -> Column:
    """Text of a block's lines (arrays of spans: text, font, size) without marks in symbol fonts; of a caption up to the first line in another
    font or size than the first that isn't a label alone."""
    clean = F.transform(lines, lambda spans: F.filter(spans, lambda s: ~F.coalesce(s["font"], F.lit("")).rlike(SYMBOL_FONT)))

    def style(spans: Column) -> Column:
        main = F.aggregate(spans, F.get(spans, F.lit(0)), lambda s, x: F.when(F.length(x["text"]) > F.length(s["text"]), x).otherwise(s))
        return F.struct(F.trim(F.array_join(F.transform(spans, lambda s: s["text"]), "")).alias("t"), main["font"].alias("font"), F.round(main["size"], 1).alias("size"))

    said = F.filter(F.transform(clean, style), lambda x: x["t"] != "")
    if not caption:
        return F.array_join(F.transform(said, lambda x: x["t"]), "\n")
    none = F.lit(None)
    start = F.struct(F.array().cast("array<string>").alias("out"), none.cast("string").alias("font"), none.cast("double").alias("size"), F.lit(True).alias("open"), F.lit(False).alias("set"))

    def step(s: Column, x: Column) -> Column:
        label = x["t"].rlike(_LABEL_ONLY)
        other = s["set"] & ~label & (~x["font"].eqNullSafe(s["font"]) | (F.abs(x["size"] - s["size"]) > 0.6))
        sets = ~s["set"] & ~label
        grown = F.struct(F.array_append(s["out"], x["t"]).alias("out"), F.when(sets, x["font"]).otherwise(s["font"]).alias("font"), F.when(sets, x["size"]).otherwise(s["size"]).alias("size"), s["open"].alias("open"), (s["set"] | sets).alias("set"))
        closed = F.struct(s["out"].alias("out"), s["font"].alias("font"), s["size"].alias("size"), F.lit(False).alias("open"), s["set"].alias("set"))
        return F.when(~s["open"], s).when(other, closed).otherwise(grown)

    return F.aggregate(said, start, step, lambda s: F.array_join(s["out"], "\n"))


def caption_precision(emitted: DataFrame, labelled: DataFrame) -> DataFrame:
    """``emitted, right, precision``: captions (book, page, label, caption) that begin as one labelled for them (book, page, label, prefix) does."""
    rows = emitted.where("caption <> ''").withColumn("row", F.monotonically_increasing_id())
    right = rows.join(labelled.select("book", "page", "label", "prefix").distinct(), ["book", "page", "label"]).where(F.startswith("caption", "prefix")).select("row").distinct()
    counts = rows.agg(F.count("*").alias("emitted")).join(right.agg(F.count("*").alias("right")))  # two single rows
    return counts.withColumn("precision", F.round(F.col("right") / F.greatest("emitted", F.lit(1)), 6))
