"""Figures and captions: matching by geometry, normalising, ranking for a query."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from leafmill.durable import cut
from leafmill.functions import geometry as G
from leafmill.functions import text as T
from leafmill.operators import answering as A
from leafmill.operators import retrieval as R

#: Characters on both sides of a mention of a figure.
AROUND = 150
#: Figures and questions of a book that meet at once; larger books are cut into blocks.
BLOCK, ASKED = 2_048, 2_048

# What makes a visual a figure or table, and what asks for a process or a structure (fixed values).
FIGURE_WORDS = (
    "figure fig table image diagram map graph chart picture sketch photo illustration roots leaves skeleton symbol emblem flag circuit "
    "organ cycle tree seed snake ant atm temple craft model experiment joint bone venation flower fruit solar mosquito animal thumb "
    "hand rule magnetic field conductor wire current electric needle compass solenoid apparatus reaction beaker motor generator "
    "physics science"
).split()
PROCESS_WORDS = ("transport", "exchange", "mechanism", "cycle", "pathway", "movement", "reaction", "flow", "transpiration", "circulation", "transfer", "enter", "enters")
STRUCTURE_WORDS = ("structure", "system", "anatomy", "cross-section", "sectional", "diagram", "parts", "internal", "view")
CROPS = ("vector_region", "scanned_crop", "florence_crop", "embedded_image")
WEIGHTS = {"semantic": 0.40, "caption": 0.25, "citation": 0.20, "context": 0.10, "type": 0.05}


def is_figure_or_table(label: Column, caption: Column, figure_id: Column, more: Column, source_type: Column, labels_inside: Column) -> Column:
    """Whether a visual is a figure, table or the like; activities and pictures of oceans are not."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    sign = F.concat_ws(" ", low(label), low(caption), low(figure_id), low(more), low(source_type))
    named = sign.rlike("|".join(FIGURE_WORDS)) | (F.coalesce(F.size(labels_inside), F.lit(0)) > 0) | low(source_type).isin(*CROPS)
    return ~low(label).rlike(r"^\s*activity\s+\d") & ~low(caption).rlike(r"^\s*activity\s+\d") & ~sign.contains("ocean") & named


def caption_gap(figure: Column, caption: Column, least_overlap: float = 0.3) -> Column:
    """Distance of a caption above or below a figure, 0 inside; null where they don't stand above each other."""
    gap = F.when(caption[1] >= figure[3], caption[1] - figure[3]).when(caption[3] <= figure[1], figure[1] - caption[3]).otherwise(0.0)
    return F.when(G.horizontal_overlap(figure, caption) >= least_overlap, gap)


def nearest_captions(figures: DataFrame, captions: DataFrame, max_gap: float = 90.0) -> DataFrame:
    """``page, figure, caption, gap``: the nearest caption of each figure of a page within ``max_gap``, null without one.

    ``figures`` has page, figure and box, ``captions`` page, caption and box; the first caption counts on ties.
    """
    pairs = figures.join(captions.select("page", "caption", F.col("box").alias("c")), "page").withColumn("gap", caption_gap(F.col("box"), F.col("c")))
    best = pairs.where(F.col("gap") <= max_gap).groupBy("page", "figure").agg(F.min(F.struct("gap", "caption")).alias("b"))
    return figures.select("page", "figure").join(best, ["page", "figure"], "left").select("page", "figure", F.col("b.caption").alias("caption"), F.col("b.gap").alias("gap"))


def nearby_visuals(captions: DataFrame, visuals: DataFrame, reach: float = 220.0, sideways: float = 350.0) -> DataFrame:
    """``page, caption, box, visuals``: the union of what stands within reach of a caption, not beyond the next caption."""
    c = captions.select("page", "caption", F.col("box").alias("c"))
    other = captions.select("page", F.col("box").alias("o"))
    stops = c.join(other, "page").groupBy("page", "caption").agg(F.first("c").alias("c"), F.max(F.when(F.col("o")[3] < F.col("c")[1], F.col("o")[3])).alias("above"), F.min(F.when(F.col("o")[1] > F.col("c")[3], F.col("o")[1])).alias("below"))
    v, cb = F.col("box"), F.col("c")
    near = F.abs(v[0] - cb[0]) <= sideways
    up = (v[3] <= cb[1]) & (cb[1] - v[3] <= reach) & (F.col("above").isNull() | (v[1] >= F.col("above")))
    down = (v[1] >= cb[3]) & (v[1] - cb[3] <= reach) & (F.col("below").isNull() | (v[3] <= F.col("below")))
    pairs = stops.join(visuals.select("page", "box"), "page").where(near & (up | down))
    return pairs.groupBy("page", "caption").agg(F.min(v[0]).alias("x1"), F.min(v[1]).alias("y1"), F.max(v[2]).alias("x2"), F.max(v[3]).alias("y2"), F.count("*").alias("visuals"))


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """``page, outer, n``: how many inner boxes lie wholly in each outer box."""
    o, i = F.col("o"), F.col("i")
    pairs = outer.select("page", "outer", F.col("box").alias("o")).join(inner.select("page", "inner", F.col("box").alias("i")), "page")
    return pairs.where((i[0] >= o[0]) & (i[1] >= o[1]) & (i[2] <= o[2]) & (i[3] <= o[3])).groupBy("page", "outer").agg(F.count("*").alias("n"))


def unclaimed(images: DataFrame, claimed: DataFrame) -> DataFrame:
    """Images of a page that cut none of its claimed boxes."""
    i, c = F.col("i.box"), F.col("c.box")
    return images.alias("i").join(claimed.alias("c"), (F.col("i.page") == F.col("c.page")) & (G.intersection(i, c) > 0), "left_anti")


def suppress_overlaps(boxes: Column, share: float = 0.35) -> Column:
    """Boxes in order, without those that share more than ``share`` of the smaller area with one kept before."""
    def add(kept: Column, b: Column) -> Column:
        hit = F.exists(kept, lambda k: G.intersection(k, b) > share * F.least(G.area(k), G.area(b)))
        return F.when(hit, kept).otherwise(F.array_append(kept, b))

    return F.aggregate(boxes, F.array().cast("array<array<double>>"), add)


def normalized_id(figure_id: Column, label: Column, caption: Column) -> Column:
    """The number of a figure by its id, its label or its caption; null for activities and for ids that begin with a point."""
    low = lambda c: F.trim(F.coalesce(c, F.lit("")))
    number = r"(\d+(?:\.\d+)?(?:\.[a-zA-Z])?)"
    both = F.lower(F.concat_ws(" ", low(label), low(caption)))
    activity = both.contains("activity") & ~both.rlike(r"\b(?:figure|fig\.?|table)\s+\d")

    def of(c: Column) -> Column:
        bare = F.trim(F.regexp_replace(low(c), r"(?i)^(?:Figure|Fig\.?|Table|Activity)\s*", ""))
        return F.when(~low(c).startswith(".") & ~bare.startswith("."), F.nullif(F.regexp_extract(bare, number, 1), F.lit("")))

    by_caption = F.when(T.explicit_reference(caption).isNotNull(), of(caption))
    return F.when(~low(figure_id).startswith(".") & ~low(label).rlike(r"(?i)\b(?:Figure|Fig\.?)\s+\.") & ~activity, F.coalesce(of(figure_id), of(label), by_caption))


def figure_type(label: Column, caption: Column, source_type: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(caption, F.lit("")), F.coalesce(source_type, F.lit(""))))
    return F.when(text.contains("table"), "table").when(text.contains("formula") | text.contains("equation"), "formula").otherwise("figure")


def merged(figures: DataFrame) -> DataFrame:
    """One row for each page and normalised id: the first row's fields, gaps filled from later rows, captions said once."""
    order = Window.partitionBy("page", "number").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = lambda c: F.first(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(order)
    rows = figures.where("number is not null")
    filled = rows.select("page", "number", "ord", *[fill(c).alias(c) for c in ("label", "source_type")], F.col("caption"))
    listed = filled.groupBy("page", "number").agg(F.min("ord").alias("ord"), F.first("label").alias("label"), F.first("source_type").alias("source_type"), F.array_sort(F.collect_list(F.struct("ord", "caption"))).alias("l"))
    captions = F.aggregate(F.filter(F.transform("l", lambda x: F.coalesce(x["caption"], F.lit(""))), lambda c: c != ""), F.lit(""), lambda s, c: F.when(s == "", c).when(s.contains(c), s).otherwise(F.concat_ws(" ", s, c)))
    return listed.select("page", "number", "ord", "label", "source_type", captions.alias("caption"))


@F.pandas_udf(ArrayType(StringType()))
def mention_windows(page_text: pd.Series, figure_id: pd.Series) -> pd.Series:
    """What stands around each mention of a figure on its page, in lower case, one window for each mention; windows may overlap."""
    out = []
    for text, own in zip(page_text, figure_id, strict=True):
        number = ".".join(str(own).split(".")[:2]) if isinstance(own, str) else ""
        found = re.finditer(rf"Fig(?:ure|\.)?\s*{re.escape(number)}", text, re.IGNORECASE) if number and isinstance(text, str) else ()
        out.append([text[max(0, m.start() - AROUND) : m.end() + AROUND].lower() for m in found])
    return pd.Series(out)


def relevance(query: Column, caption: Column, label: Column, figure_id: Column, keywords: Column, labels_inside: Column, context: Column, page_text: Column, windows: Column | None = None) -> Column:
    """``score`` from 0 to 100 and its parts: concepts, caption, citation nearby, context and kind of visual.

    ``windows`` are those of :func:`mention_windows`, which may be made once for many queries; without them they come from the page's text.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    terms = T.terms(query)
    n = F.greatest(F.size(terms), F.lit(1))
    pool = F.array_union(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), F.lower), F.flatten(F.transform(F.coalesce(labels_inside, F.array().cast("array<string>")), T.terms)))
    concept = F.size(F.filter(terms, lambda t: F.exists(pool, lambda k: k.contains(t))))
    cap = F.size(F.filter(terms, lambda t: low(caption).contains(t) | low(label).contains(t) | (t == low(figure_id))))
    phrase = (F.length(query) > 6) & F.contains(low(caption), F.lower(query))
    s_caption = F.least(F.lit(1.0), cap / n + F.when(phrase, 0.4).otherwise(0.0))
    windows = mention_windows(page_text, figure_id) if windows is None else windows
    cited = F.aggregate(windows, F.lit(0), lambda s, w: s + F.size(F.filter(terms, lambda t: w.contains(t))))
    s_citation = F.least(F.lit(1.0), cited / n)
    s_context = F.size(F.filter(terms, lambda t: low(context).contains(t))) / n
    shown = F.concat_ws(" ", low(caption), low(label), F.array_join(labels_inside, " "))
    asks = lambda words: F.lower(query).rlike("|".join(words))
    shows = lambda words: shown.rlike("|".join(words))
    s_type = F.when((asks(PROCESS_WORDS) & shows(PROCESS_WORDS)) | (asks(STRUCTURE_WORDS) & shows(STRUCTURE_WORDS)), 1.0).when(asks(PROCESS_WORDS) & shows(STRUCTURE_WORDS) & ~shows(PROCESS_WORDS), 0.0).otherwise(0.5)
    parts = {"semantic": concept / n, "caption": s_caption, "citation": s_citation, "context": s_context, "type": s_type}
    total = F.round(100 * sum(WEIGHTS[k] * v for k, v in parts.items()), 2)
    nothing = (F.size(terms) == 0) | ((concept == 0) & (cap == 0) & (cited == 0))
    return F.struct(F.when(nothing, 0.0).otherwise(total).alias("score"), *[F.round(v, 2).alias(k) for k, v in parts.items()])


def relevant(figures: DataFrame, asked: DataFrame, k: int = 4) -> DataFrame:
    """``query_id, figure, score`` by :func:`relevance` of at least the ``k`` best figures of each query's book, ties by figure.

    ``figures`` has book_id, figure, caption, label, number, keywords, labels_inside, context and windows, ``asked`` query_id, book_id and
    question. Whole books meet their questions in bins, larger ones in blocks of both; there, each term is looked up once in each figure
    and questions add up what their terms have found, so no pair of question and figure is a row.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    none = F.array().cast("array<string>")
    pool = F.array_union(F.transform(F.coalesce("keywords", none), F.lower), F.flatten(F.transform(F.coalesce("labels_inside", none), T.terms)))
    shown = F.concat_ws(" ", low("caption"), low("label"), F.array_join("labels_inside", " "))
    has = lambda c, words: F.coalesce(c.rlike("|".join(words)), F.lit(False))
    drawn = figures.where("book_id is not null").select("book_id", "figure", F.array_join(pool, " ").alias("pool"), low("caption").alias("caption"), F.concat_ws(" ", low("caption"), low("label")).alias("said"), low("number").alias("number"), low("context").alias("context"), F.coalesce("windows", none).alias("windows"), has(shown, PROCESS_WORDS).alias("process"), has(shown, STRUCTURE_WORDS).alias("structure"))
    drawn, _ = cut(drawn, "figures")
    lower = F.lower("question")
    wanted = asked.where("book_id is not null and question is not null").select("query_id", "book_id", T.terms(F.col("question")).alias("terms"), F.when(F.length("question") > 6, lower).alias("phrase"), has(lower, PROCESS_WORDS).alias("process"), has(lower, STRUCTURE_WORDS).alias("structure")).where(F.size("terms") > 0)
    sizes = drawn.groupBy("book_id").agg(F.count("*").alias("n")).join(wanted.groupBy("book_id").agg(F.count("*").alias("asked")), "book_id")
    sizes, _ = cut(sizes, "sizes")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).first()
    bins = max(1, -(-(total.n or 0) // BLOCK), -(-(total.asked or 0) // ASKED))
    first, rows = bins, []
    for r in sizes.where((F.col("n") > BLOCK) | (F.col("asked") > ASKED)).orderBy("book_id").collect():  # at most one for each block of the whole
        blocks, parts = -(-r.n // BLOCK), -(-r.asked // ASKED)
        rows.append((r.book_id, blocks, parts, first))
        first += blocks * parts
    large = F.broadcast(figures.sparkSession.createDataFrame(rows, f"book_id {dict(drawn.dtypes)['book_id']}, blocks int, parts int, first int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine, own = F.pmod(F.xxhash64("figure"), F.col("blocks")), F.pmod(F.xxhash64("query_id"), F.col("parts"))
    small = F.array(F.pmod(F.xxhash64("book_id"), F.lit(bins)))
    place = lambda many: F.explode(F.when(F.col("first").isNull(), small).otherwise(many)).alias("g")
    left = drawn.join(large, "book_id", "left").select(*drawn.columns, place(F.transform(each("parts"), lambda p: F.col("first") + mine * F.col("parts") + p)))
    right = wanted.join(large, "book_id", "left").select(*wanted.columns, place(F.transform(each("blocks"), lambda x: F.col("first") + x * F.col("parts") + own)))
    schema = f"query_id {dict(asked.dtypes)['query_id']}, figure string, score double"
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_relevant(k), schema)


@cache
def _cents(x: float) -> float:
    """Two decimal places, halves up, as SQL rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _relevant(k: int):
    """The scores of :func:`relevance` for the figures and questions of some books."""

    def run(figures: pa.Table, asked: pa.Table) -> pa.Table:
        figures = figures.filter(pc.is_in(figures["book_id"], value_set=pc.unique(asked["book_id"])))
        figures = figures.take(pc.sort_indices(figures, [("book_id", "ascending"), ("figure", "ascending")]))
        asked = asked.take(pc.sort_indices(asked, [("book_id", "ascending")]))
        f, q = ({c: t[c].to_pylist() for c in t.column_names} for t in (figures, asked))
        shows = {c: np.array(f[c], bool) for c in ("process", "structure")}
        spans: dict = {}
        for i, book in enumerate(f["book_id"]):
            spans[book] = (spans.get(book, (i,))[0], i + 1)
        out: list[tuple] = []
        known, here = None, {}
        for i, book in enumerate(q["book_id"]):
            if book not in spans:
                continue
            if book != known:
                known, here = book, {}
                start, end = spans[book]
                texts = list(zip(*(f[c][start:end] for c in ("pool", "said", "number", "context", "windows")), strict=True))
                captions, process, structure = f["caption"][start:end], shows["process"][start:end], shows["structure"][start:end]
            for term in q["terms"][i]:
                if term not in here:
                    here[term] = np.array([(term in pool, term in said or term == number, term in context, sum(term in w for w in windows)) for pool, said, number, context, windows in texts], np.int32).T
            concept, cap, context, cited = sum(here[term] for term in q["terms"][i])
            hit = np.flatnonzero((concept > 0) | (cap > 0) | (cited > 0))
            if not len(hit):
                continue
            n, phrase = len(q["terms"][i]), q["phrase"][i]
            again = 0.0 if phrase is None else np.array([0.4 if phrase in captions[j] else 0.0 for j in hit])
            kind = np.full(len(hit), 0.5)
            if q["process"][i]:
                kind[structure[hit] & ~process[hit]] = 0.0
                kind[process[hit]] = 1.0
            if q["structure"][i]:
                kind[structure[hit]] = 1.0
            parts = {"semantic": concept[hit] / n, "caption": np.minimum(1.0, cap[hit] / n + again), "citation": np.minimum(1.0, cited[hit] / n), "context": context[hit] / n, "type": kind}
            score = 100 * sum(WEIGHTS[part] * v for part, v in parts.items())
            different, at = np.unique(score, return_inverse=True)
            score = np.array([_cents(float(x)) for x in different])[at]
            if len(hit) > k:
                near = R._best(score, k)
                hit, score = hit[near], score[near]
            out.append((np.full(len(hit), i), start + hit, score))
        i, j, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        whole = lambda t, c, at: pa.chunked_array(t[c].chunks, t[c].type).take(pa.array(at))
        return pa.table([whole(asked, "query_id", i), whole(figures, "figure", j), pa.array(score)], ["query_id", "figure", "score"])

    return run


def top_figures(scored: DataFrame, least: float = 10.0, share: float = 0.45, k: int = 3) -> DataFrame:
    """The best figures of each query with ``place`` and ``margin`` to the next one; ``ambiguous`` where the first two are close."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "figure")
    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = scored.where("score > 0").withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).withColumn("best", best)
    margin = F.when(F.col("next").isNull(), 100.0).otherwise(F.col("score") - F.col("next"))
    kept = rows.where((F.col("place") <= k) & (F.col("score") >= F.greatest(F.lit(least), share * F.col("best"))))
    return kept.select("query_id", "figure", "score", "place", F.round(margin, 2).alias("margin"), ((F.col("place") == 1) & F.col("next").isNotNull() & (margin < 15) & (F.col("score") >= 30)).alias("ambiguous"))


def explicit_matches(questions: DataFrame, figures: DataFrame) -> DataFrame:
    """``question_id`` with the figures of its book that it names by number: by id, or by the number in label or caption; each id once, the
    first page's. ``figures`` has book_id, page_number, number, label and caption."""
    named = questions.select("question_id", "book_id", F.coalesce(*[F.nullif(F.regexp_extract("question", p, 1), F.lit("")) for p in T.NAMED_FIGURES]).alias("target")).where("target is not null")
    keys = F.array_distinct(F.filter(F.array("number", T.explicit_reference(F.col("label")), T.explicit_reference(F.col("caption"))), lambda k: k.isNotNull()))
    held = figures.select("book_id", "page_number", "number", "label", "caption", F.explode(keys).alias("target"))
    order = Window.partitionBy("question_id", "number").orderBy("page_number")
    return named.join(held, ["book_id", "target"]).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "target")


def chosen_figures(questions: DataFrame, figures: DataFrame, evidence: DataFrame) -> DataFrame:
    """``question_id, page_number, number, label, caption, place, margin, ambiguous, named`` of the figures that go with each question.

    Figures that the question names come first and alone. A question that asks for something to see gets up to three of the six most relevant
    by caption, concepts and score that share words with a caption, or the most relevant alone where it stands out; where there is none, the best
    figure of the first two evidence pages (question_id, book_id, page_number, ord, text) that share two words with it.
    """
    exact, _ = cut(explicit_matches(questions, figures), "named")
    named = exact.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("page_number", "number")))
    named = named.select("question_id", "page_number", "number", "label", "caption", "place", F.lit(100.0).alias("margin"), F.lit(False).alias("ambiguous"), F.lit(True).alias("named"))
    visual = questions.where(F.col("question").rlike(T.VISUAL_WISH) | T.explicit_reference(F.col("question")).isNotNull()).join(exact.select("question_id").distinct(), "question_id", "left_anti")
    fit = figures.where(is_figure_or_table(F.col("label"), F.col("caption"), F.col("number"), F.lit(None), F.lit(None), F.col("labels_inside")))
    score = relevance(F.col("question"), F.col("caption"), F.col("label"), F.col("number"), F.col("keywords"), F.col("labels_inside"), F.col("context"), F.lit(None), F.col("windows"))
    scored = fit.join(visual.where(F.size(T.terms(F.col("question"))) > 0), "book_id").withColumn("r", score)
    scored = scored.select("question_id", "page_number", "number", "label", "caption", F.col("r.score").alias("score"), F.col("r.caption").alias("s_caption"), F.col("r.semantic").alias("s_semantic"))
    by_score = Window.partitionBy("question_id").orderBy(F.desc("score"), "page_number", "number")
    ranked = scored.withColumn("next", F.lead("score").over(by_score)).withColumn("rn", F.row_number().over(by_score)).where("rn <= 6")
    top = Window.partitionBy("question_id")
    ranked = ranked.withColumn("best", F.max("score").over(top)).withColumn("margin", F.max(F.when(F.col("rn") == 1, F.coalesce(F.col("score") - F.col("next"), F.lit(100.0)))).over(top)).where(F.col("score") >= 0.45 * F.col("best"))
    order = Window.partitionBy("question_id").orderBy(F.desc("s_caption"), F.desc("s_semantic"), F.desc("score"), "page_number", "number")
    ranked, _ = cut(ranked.withColumn("order", F.row_number().over(order)), "ranked")
    head = ranked.where("order = 1").select("question_id", ((F.col("margin") >= 10) & (F.col("score") >= 25)).alias("clear"))
    first = ranked.where("s_caption >= 0.2").withColumn("dup", F.row_number().over(Window.partitionBy("question_id", "number").orderBy("order"))).where("dup = 1")
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("order"))).where("place <= 3").join(head, "question_id").where("not clear").drop("clear")
    clear = ranked.where("order = 1").join(head.where("clear").select("question_id"), "question_id", "left_semi").withColumn("place", F.lit(1))
    columns = ["question_id", "page_number", "number", "label", "caption", "place", F.round("margin", 2).alias("margin"), ((F.col("margin") < 15) & (F.col("best") >= 30)).alias("ambiguous"), F.lit(False).alias("named")]
    shown, _ = cut(first.select(*columns).union(clear.select(*columns)), "shown")
    bare = visual.join(shown.select("question_id").distinct(), "question_id", "left_anti").withColumn("terms", F.array_distinct(T.terms(F.col("question"))))
    near = bare.join(evidence.where("ord <= 2").select("question_id", "page_number", "ord", "text"), "question_id").where(F.size(F.array_intersect("terms", T.terms(F.col("text")))) >= 2)
    said = F.lower(F.concat_ws(" ", "label", "caption", "context"))
    hits = near.select("question_id", "book_id", "page_number", "ord", "terms").join(fit, ["book_id", "page_number"]).withColumn("hits", F.size(F.filter("terms", lambda t: said.contains(t))))
    page_best = hits.withColumn("rn", F.row_number().over(Window.partitionBy("question_id", "ord").orderBy(F.desc("hits"), "number"))).where("rn = 1 and hits > 0")
    fallback = page_best.withColumn("first", F.row_number().over(Window.partitionBy("question_id").orderBy("ord"))).where("first = 1")
    fallback = fallback.select("question_id", "page_number", "number", "label", "caption", F.lit(1).alias("place"), F.lit(0.0).alias("margin"), F.lit(False).alias("ambiguous"), F.lit(False).alias("named"))
    return named.unionByName(shown).unionByName(fallback)


def responses(chunks: DataFrame, questions: DataFrame, figures: DataFrame, pages: DataFrame, most_pages: int = 5) -> DataFrame:
    """``question_id, answer, sufficient, confidence, mode, source_pages, figures, margin, ambiguous``: the answers with their pages and figures.

    A question that names a figure of its book is answered with it and its pages, by the figure's label and caption where the text doesn't
    suffice; any other insufficient answer has neither pages nor figures. ``pages`` has book_id, page_number and text.
    """
    known = figures.groupBy("book_id", "page_number").agg(F.collect_set("number").alias("figures"))
    out, cites = A.decisions(chunks, questions, known_figures=known)
    cites, _ = cut(cites.join(questions.select("question_id", "book_id"), "question_id"), "cites")
    ordered = cites.groupBy("question_id", "book_id", "page_number").agg(F.min("ord").alias("ord"))
    ordered = ordered.withColumn("ord", F.row_number().over(Window.partitionBy("question_id").orderBy("ord")))
    chosen, _ = cut(chosen_figures(questions, figures, ordered.join(pages, ["book_id", "page_number"])), "figures")
    lists = chosen.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "page_number", "number", "label", "caption"))).alias("f"), F.max("margin").alias("margin"), F.max("ambiguous").alias("ambiguous"), F.max("named").alias("named"))
    cited_pages = ordered.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "page_number"))), lambda x: x["page_number"]).alias("pages"))
    rows = out.join(lists, "question_id", "left").join(cited_pages, "question_id", "left")
    named = F.coalesce("named", F.lit(False))
    enough = F.col("sufficient") | named
    caption = F.get(F.filter(F.transform("f", lambda x: F.coalesce(x["caption"], F.lit(""))), lambda c: c != ""), F.lit(0))
    label = F.coalesce(F.nullif(F.get("f", F.lit(0))["label"], F.lit("")), F.concat(F.lit("Figure "), F.get("f", F.lit(0))["number"]))
    clean = T.without_heading_marks(T.without_citations(F.col("answer")))
    answer = F.when(F.col("sufficient"), clean).when(named, F.when(caption.isNotNull(), F.concat(label, F.lit(": "), caption)).otherwise(label)).otherwise(F.col("answer"))
    shown = F.when(named, F.array_distinct(F.transform("f", lambda x: x["page_number"]))).otherwise(F.col("pages"))
    listed = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("question_id", answer.alias("answer"), enough.alias("sufficient"), "confidence", "mode", F.when(enough, listed(F.slice(F.coalesce(shown, F.array().cast("array<int>")), 1, most_pages))).otherwise("").alias("source_pages"), F.when(enough, listed(F.transform(F.coalesce("f", F.array().cast("array<struct<place:int,page_number:int,number:string,label:string,caption:string>>")), lambda x: x["number"]))).otherwise("").alias("figures"), F.coalesce("margin", F.lit(0.0)).alias("margin"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
