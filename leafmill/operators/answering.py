"""From retrieved chunks to answers: rerank, span, sufficiency, sentences, citations, grounding.

The lexical backend is built-in expressions; a model backend only has to give the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from leafmill.durable import cut
from leafmill.functions import text as T
from leafmill.functions.records import lexical_embedding
from leafmill.operators import retrieval as R

RERANK_FLOOR, STRONG, MARGIN, SENTENCE_FLOOR, EXERCISE_PENALTY = -2.5, 3.0, 0.0, -3.0, 3.0
NULL_SCORE, COVERAGE, CONTEXTS, CITED, SENTENCES = 5.0, 0.8, 3, 3, 3
#: Places of a ranking that a comparison takes, passages a generator sees, passages shown as evidence, and characters of a last resort.
PER_LIST, SEEN, EVIDENCE, LAST_RESORT = 4, 8, 5, 300
NOT_COVERED = "The book does not cover this question."
NOT_STATED = "The book does not state an answer to this question."
NO_QUESTION = "Please ask a question."


class Backend(Protocol):
    """What scores texts; each method maps columns to a column. ``embed`` gives vectors for retrieval."""

    def embed(self, text: Column) -> Column: ...

    def rerank(self, question: Column, text: Column) -> Column: ...

    def span(self, question: Column, sentence: Column) -> Column: ...

    def entailment(self, premise: Column, sentence: Column) -> Column: ...


class Provider(NamedTuple):
    """An answer generator. ``generate`` maps question and evidence (an array of page, section and text) to a struct of text, in_scope and
    model, null where it gives none in time; it should be an Arrow UDF that ends its own calls."""

    name: str
    generate: Callable[[Column, Column], Column]


class LexicalBackend:
    """Shared tokens only. Where they are counted already, no text is needed: ``rerank_shared``, ``span_shared`` and ``entailment_shared`` give
    the same as ``rerank``, ``span`` and ``entailment`` from the numbers of shared and of all different tokens; a backend without them
    reads texts."""

    def embed(self, text: Column) -> Column:
        return lexical_embedding(T.tokens(text))

    def _share(self, question: Column, text: Column) -> Column:
        q = F.array_distinct(T.tokens(question))
        return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(text))) / F.size(q))

    def rerank(self, question: Column, text: Column) -> Column:
        return F.round(F.coalesce(-10 + 18 * self._share(question, text), F.lit(-10.0)), 6)

    def rerank_shared(self, shared: Column, asked: Column) -> Column:
        return F.round(F.coalesce(-10 + 18 * F.when(asked > 0, shared / asked), F.lit(-10.0)), 6)

    def span(self, question: Column, sentence: Column) -> Column:
        return F.round(F.coalesce(10 * self._share(question, sentence), F.lit(0.0)), 6)

    def span_shared(self, shared: Column, asked: Column) -> Column:
        return F.round(F.coalesce(10 * F.when(asked > 0, shared / asked), F.lit(0.0)), 6)

    def entailment(self, premise: Column, sentence: Column) -> Column:
        share = F.coalesce(self._share(sentence, premise), F.lit(0.0))
        return F.when(share >= COVERAGE, 1.0).otherwise(share / 2)

    def entailment_shared(self, shared: Column, said: Column) -> Column:
        share = F.when(said > 0, shared / said).otherwise(0.0)
        return F.when(share >= COVERAGE, 1.0).otherwise(share / 2)


LEXICAL = LexicalBackend()


def reranked(candidates: DataFrame, index: R.Index, questions: DataFrame, backend: Backend = LEXICAL) -> DataFrame:
    """``question_id, question, chunk_id, text, section, page_number, figure_refs, score, place``: candidates by score, exercises put back;
    place from 1."""
    placed = _placed(candidates, index, questions, backend)
    docs = index.docs.select("chunk_id", "text", "section", "page_number", "figure_refs")
    return placed.join(docs, "chunk_id").join(questions.select("question_id", "question"), "question_id")


def _placed(candidates: DataFrame, index: R.Index, questions: DataFrame, backend: Backend, keep: tuple[str, ...] = ()) -> DataFrame:
    """``question_id, chunk_id, score, place`` and the columns to ``keep`` of the candidates; texts go no further than their score, and aren't read where the backend
    takes counted tokens, which stand for the text of a question as long as its id has only one."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "fused")
    back = lambda exercise: F.when(exercise, EXERCISE_PENALTY).otherwise(0.0)
    if hasattr(backend, "rerank_shared") and (questions.where("question_id is not null").groupBy("question_id").count().agg(F.max("count")).first()[0] or 1) == 1:
        asked = questions.select("question_id", F.size(F.array_distinct(T.tokens(F.col("question")))).alias("asked"))
        score = backend.rerank_shared(F.col("shared"), F.col("asked")) - back(F.col("exercise"))
        rows = candidates.join(asked, "question_id").select("question_id", "chunk_id", *keep, F.col("rank").alias("fused"), score.alias("score"))
        return rows.select("question_id", "chunk_id", "score", *keep, F.row_number().over(order).alias("place"))
    asked = candidates.select("question_id", "chunk_id", *keep, F.col("rank").alias("fused")).join(questions.select("question_id", "question"), "question_id")
    score = backend.rerank(F.col("question"), F.col("said")) - back(F.lower("kind") == "exercise")
    rows = asked.join(index.docs.select("chunk_id", "said", "kind"), "chunk_id").select("question_id", "chunk_id", *keep, "fused", score.alias("score"))
    return rows.select("question_id", "chunk_id", "score", *keep, F.row_number().over(order).alias("place"))


def places(index: R.Index, questions: DataFrame, backend: Backend = LEXICAL, keep: tuple[str, ...] = ()) -> DataFrame:
    """``question_id, chunk_id, score, place`` of the reranked chunks of every question; ``keep`` names columns of the index that come along."""
    scored = R.scores(index, questions, R.POOL, own=R.OWN + keep)
    return _placed(R.fused(scored, index, questions, keep=keep), index, questions, backend, keep)


def ranking(index: R.Index, questions: DataFrame, backend: Backend = LEXICAL) -> DataFrame:
    """The reranked chunks of every question with the columns of :func:`reranked`; places are a table, texts come in where they are read."""
    return told(cut(places(index, questions, backend), "ranking")[0], index, questions)


def told(placed: DataFrame, index: R.Index, questions: DataFrame) -> DataFrame:
    """Places with the texts of chunks and questions."""
    docs = index.docs.select("chunk_id", "text", "section", "page_number", "figure_refs")
    return placed.join(docs, "chunk_id").join(questions.select("question_id", "question"), "question_id")


def spans(ranking: DataFrame, backend: Backend = LEXICAL) -> DataFrame:
    """``question_id, span, margin``: the sentence of the first contexts with the best score; the first one on ties."""
    sentences = F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "sentence")
    first = ranking.where(F.col("place") <= CONTEXTS)
    if hasattr(backend, "span_shared"):  # a question's tokens are found once for each context, those of sentences by batches
        asked = first.withColumn("q", F.array_distinct(T.tokens(F.col("question"))))
        told = asked.select("question_id", "q", "place", sentences).withColumn("w", T.joined_tokens(F.col("sentence"))["terms"])
        scored = told.withColumn("s", backend.span_shared(F.size(F.array_intersect("q", F.split("w", " "))), F.size("q")))
    else:
        scored = first.select("question_id", "question", "place", sentences).withColumn("s", backend.span(F.col("question"), F.col("sentence")))
    best = scored.where("s > 0").groupBy("question_id").agg(F.max_by("sentence", F.struct("s", -F.col("place"), -F.col("pos"))).alias("span"), F.max("s").alias("s"))
    return best.select("question_id", "span", (F.col("s") - NULL_SCORE).alias("margin"))


def decided(ranking: DataFrame, best: DataFrame, questions: DataFrame) -> DataFrame:
    """``question_id, top, margin, sufficient, confidence`` of every question, also of those without candidates."""
    top = ranking.where("place = 1").select("question_id", F.col("score").alias("top"))
    rows = questions.select("question_id").join(top, "question_id", "left").join(best, "question_id", "left")
    enough = (F.col("top") >= RERANK_FLOOR) & ((F.coalesce("margin", F.lit(float("-inf"))) >= MARGIN) | (F.col("top") >= STRONG))
    sure = T.sigmoid(F.col("top") / 2) * F.when(F.col("margin").isNull(), 0.5).otherwise(T.sigmoid(F.col("margin") / 2))
    return rows.select("question_id", "top", "margin", "span", F.coalesce(enough, F.lit(False)).alias("sufficient"), F.round(F.coalesce(sure, F.lit(0.0)), 4).alias("confidence"))


def composed(ranked: DataFrame, best: DataFrame, backend: Backend = LEXICAL) -> DataFrame:
    """``question_id, answer, used``: up to three sentences of the first contexts, in reading order, the span's sentence always among them,
    and the places they come from."""
    said = ranked.where(F.col("place") <= CONTEXTS).select("question_id", "question", "place", "page_number", F.posexplode(T.sentences(F.col("text"))).alias("pos", "raw"))
    fit = said.withColumn("sentence", T.clean_sentence(F.col("raw"))).where(T.is_answer_sentence(F.col("sentence"), F.col("question")))
    key = F.array_join(T.tokens(F.col("sentence")), " ")
    once = fit.withColumn("rn", F.row_number().over(Window.partitionBy("question_id", key).orderBy("place", "pos"))).where("rn = 1").drop("rn")
    holds = F.coalesce((F.col("span") != "") & F.col("sentence").contains(F.col("span")), F.lit(False))
    marked = once.join(best.select("question_id", "span"), "question_id", "left").withColumn("s", backend.rerank(F.col("question"), F.col("sentence"))).withColumn("holds", holds)
    order = [F.desc("s"), "place", "pos"]
    each = Window.partitionBy("question_id")
    # Of several sentences that hold the span the best one counts; it comes in where the best three don't have it.
    own = F.col("holds") & (F.row_number().over(Window.partitionBy("question_id", "holds").orderBy(*order)) == 1)
    limit = F.greatest(F.lit(SENTENCE_FLOOR), F.max("s").over(each) - 3)
    kept = marked.withColumn("limit", limit).withColumn("own", own).where("own or s >= limit")
    first = kept.withColumn("rn", F.row_number().over(each.orderBy(F.desc("own"), *order))).where(F.col("rn") <= SENTENCES)
    listed = first.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "place", "pos", "sentence"))).alias("l"))
    return listed.select("question_id", F.array_join(F.transform("l", lambda x: x["sentence"]), " ").alias("answer"), F.array_distinct(F.transform("l", lambda x: x["place"])).alias("used"))


def citations(ranked: DataFrame, known_figures: DataFrame | None = None) -> DataFrame:
    """``question_id, place, chunk_id, page_number, section, snippet, figures`` of the first chunks.

    ``figures`` are the figures that a chunk names; where ``known_figures`` (book_id, page_number, figures) has some for its page, only those.
    """
    first = ranked.where(F.col("place") <= CITED)
    return cited(first, known_figures).select("question_id", "place", "chunk_id", "page_number", "section", "snippet", "figures")


def cited(rows: DataFrame, known_figures: DataFrame | None = None) -> DataFrame:
    """The rows with ``snippet`` and ``figures``."""
    rows = rows.withColumn("snippet", T.snippet(F.col("text"))).withColumn("figures", F.coalesce("figure_refs", F.array().cast("array<string>")))
    if known_figures is None:
        return rows
    known = known_figures.select("book_id", "page_number", F.col("figures").alias("known"))
    held = rows.join(known, ["book_id", "page_number"], "left")
    return held.withColumn("figures", F.when(F.coalesce(F.size("known"), F.lit(0)) <= 0, F.col("figures")).otherwise(F.filter("figures", lambda f: F.array_contains("known", f)))).drop("known")


def asked(questions: DataFrame) -> DataFrame:
    """``ask_id, question_id, book_id, part, concept, question``: each question that says something, and of a comparison both parts,
    each with a question of its own; part 0 is the whole."""
    plain = F.trim("question")
    pair = T.split_comparison(plain)
    parts = F.when(pair.isNotNull(), F.array(*[F.struct(F.lit(i + 1).alias("part"), pair[i].alias("concept"), F.format_string("What is %s?", pair[i]).alias("ask")) for i in (0, 1)])).otherwise(F.array().cast("array<struct<part:int,concept:string,ask:string>>"))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(None).cast("string").alias("concept"), plain.alias("ask")))
    rows = questions.where(F.length(plain) > 0).select("question_id", "book_id", F.explode(F.concat(whole, parts)).alias("a"))
    return rows.select(F.concat_ws("#", "question_id", F.col("a.part").cast("string")).alias("ask_id"), "question_id", "book_id", "a.part", "a.concept", F.col("a.ask").alias("question"))


def decisions(chunks: DataFrame, questions: DataFrame, backend: Backend = LEXICAL, provider: Provider | None = None, known_figures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The answers of all questions in one program, and what they cite.

    Answers: ``question_id, answer, extractive, sufficient, confidence, mode, reason, parts``; ``reason`` says why there is none. Cited: ``question_id,
    ord, chunk_id, page_number, section, snippet, figures``.

    A comparison is answered for each concept: both must be covered, its top score and margin are the lower ones, both answers stand one
    after the other, and one more passage is cited. What a provider generates replaces the answer as far as passages support its
    sentences; where it gives none, the composed answer stays. A blank question gets no answer.
    """
    index = R.build(chunks)
    asks, _ = cut(asked(questions), "asks")
    own = asks.select(F.col("ask_id").alias("question_id"), "book_id", "question")
    ranks = ranking(index, own, backend)
    head = asks.select("ask_id", F.col("question_id").alias("id"), "book_id", "part", "concept")
    placed = ranks.withColumnRenamed("question_id", "ask_id").join(head, "ask_id")
    n_parts = asks.groupBy(F.col("question_id").alias("id")).agg(F.max("part").alias("parts"))
    best, _ = cut(spans(ranks, backend), "spans")
    each = decided(ranks, best, own).withColumnRenamed("question_id", "ask_id").join(head, "ask_id").join(n_parts, "id").where("(parts = 0) = (part = 0)")
    low = F.lit(float("-inf"))
    joint = each.groupBy("id").agg(F.min(F.coalesce("top", low)).alias("top"), F.min(F.coalesce("margin", low)).alias("margin"), F.bool_and("sufficient").alias("sufficient"), F.max("parts").alias("parts"), F.first("span").alias("span"), F.first("book_id").alias("book_id"))
    sure = T.sigmoid(F.col("top") / 2) * F.when(F.col("margin") == low, 0.5).otherwise(T.sigmoid(F.col("margin") / 2))
    joint = joint.withColumn("confidence", F.round(F.when(F.col("top") == low, 0.0).otherwise(sure), 4))

    # Rankings of a comparison one place of each at a time; a simple question's ranking as it is.
    positions = placed.join(n_parts, "id")
    mixed = positions.where((F.col("parts") > 0) & (F.col("place") <= PER_LIST)).groupBy("id", "chunk_id").agg(F.min(F.struct("place", F.when(F.col("part") == 0, 9).otherwise(F.col("part")).alias("list"))).alias("at"))
    mixed = mixed.select("id", "chunk_id", F.row_number().over(Window.partitionBy("id").orderBy("at.place", "at.list")).alias("ord"))
    merged = mixed.union(positions.where("parts = 0").select("id", "chunk_id", F.col("place").alias("ord")))

    made = composed(ranks, best, backend).withColumnRenamed("question_id", "ask_id")
    per_part = each.select("ask_id", "id", "part", "concept", "parts", "span").join(made, "ask_id", "left").withColumn("text", F.coalesce(F.nullif("answer", F.lit("")), "span", F.lit("")))
    titled = F.concat(F.upper(F.substring("concept", 1, 1)), F.expr("substring(concept, 2)"), F.lit(": "), F.col("text"))
    blocks = per_part.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("part", F.when(F.col("parts") > 0, titled).otherwise(F.col("text")).alias("t"))))).alias("l"))
    offline = blocks.select("id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("composed"))
    places = per_part.select("ask_id", "id", "part", F.posexplode(F.coalesce("used", F.array(F.lit(1)))).alias("pos", "place"))
    used = places.join(ranks.select(F.col("question_id").alias("ask_id"), "place", "chunk_id"), ["ask_id", "place"]).groupBy("id", "chunk_id").agg(F.min(F.struct("part", "pos")).alias("at"))
    used = used.select("id", "chunk_id", F.row_number().over(Window.partitionBy("id").orderBy("at.part", "at.pos")).alias("ord"))

    top = merged.where("ord = 1").join(index.docs.select("chunk_id", "text"), "chunk_id").select("id", F.substring("text", 1, LAST_RESORT).alias("beginning"))
    rows = questions.select(F.col("question_id").alias("id"), F.trim("question").alias("q")).join(joint, "id", "left").join(offline, "id", "left").join(top, "id", "left")
    extractive = F.when((F.col("parts") == 0) & (F.col("margin") >= MARGIN), F.col("span"))
    rows = rows.withColumn("extractive", F.when(F.col("sufficient"), extractive)).withColumn("own", F.coalesce(F.nullif("composed", F.lit("")), "extractive", "beginning"))
    if provider is None:
        rows = rows.select("*", F.lit(None).cast("string").alias("said"), F.lit(None).cast("boolean").alias("in_scope"), F.lit(None).cast("string").alias("supported"))
    else:
        rows, used = _generated(rows, merged, index, used, provider, backend)
    blank = F.coalesce(F.length("q"), F.lit(0)) == 0
    enough = F.coalesce("sufficient", F.lit(False))
    gave = F.col("said").isNotNull() & enough
    reason = F.when(blank, "no_question").when(F.coalesce((F.col("top") == low) & (F.col("parts") == 0), F.lit(True)), "no_candidates").when(~enough, "below_threshold").when(gave & ~F.col("in_scope"), "self_check").when(gave & (F.col("supported") == ""), "not_supported")
    rows = rows.withColumn("reason", reason)
    text = F.when(blank, NO_QUESTION).when(F.col("reason") == "not_supported", NOT_STATED).when(F.col("reason").isNotNull(), NOT_COVERED).when(gave, F.col("supported")).otherwise(F.col("own"))
    name = F.lit(provider.name if provider else "offline")
    out = rows.select(F.col("id").alias("question_id"), text.alias("answer"), F.when(F.col("reason").isNull(), F.col("extractive")).alias("extractive"), F.col("reason").isNull().alias("sufficient"), F.when(blank, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.when(gave, name).otherwise("offline").alias("mode"), "reason", F.coalesce("parts", F.lit(0)).alias("parts"))
    out, _ = cut(out, "decisions")
    limit = F.lit(CITED) + F.when(F.col("parts") > 0, 1).otherwise(0)
    kept = used.join(out.where("sufficient").select(F.col("question_id").alias("id"), "parts"), "id").where(F.col("ord") <= limit)
    full = kept.join(index.docs.select("chunk_id", "book_id", "text", "page_number", "section", "figure_refs"), "chunk_id")
    return out, cited(full, known_figures).select(F.col("id").alias("question_id"), "ord", "chunk_id", "page_number", "section", "snippet", "figures")


def _generated(rows: DataFrame, merged: DataFrame, index: R.Index, used: DataFrame, provider: Provider, backend: Backend) -> tuple[DataFrame, DataFrame]:
    """The rows with what a provider said, whether in scope, and the sentences that passages support; and the passages then cited."""
    seen, _ = cut(merged.where(F.col("ord") <= SEEN).join(index.docs.select("chunk_id", "page_number", "section", "text"), "chunk_id"), "evidence")
    listed = seen.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "page_number", "section", "text"))), lambda x: F.struct(x["page_number"].alias("page_number"), x["section"].alias("section"), x["text"].alias("text"))).alias("evidence"))  # at most eight
    called, _ = cut(rows.join(listed, "id", "left").withColumn("g", F.when(F.col("sufficient"), provider.generate(F.col("q"), F.col("evidence")))).drop("evidence"), "generated")
    sentences = called.where("g.in_scope").select(F.col("id").alias("question_id"), F.posexplode(T.sentences(T.squeeze(F.col("g.text")))).alias("sentence_no", "sentence"))
    passages = seen.select(F.col("id").alias("question_id"), F.col("ord").alias("place"), "text")
    claims, _ = cut(sentences, "claims")
    told = grounded(claims, passages, backend=backend).where("kept").join(claims, ["question_id", "sentence_no"])
    kept = told.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))).alias("l")).select("id", F.array_join(F.transform("l", lambda x: x["sentence"]), " ").alias("kept_text"))
    out = called.join(kept, "id", "left").select("*", F.col("g.text").alias("said"), F.col("g.in_scope").alias("in_scope"), F.coalesce("kept_text", F.lit("")).alias("supported")).drop("g", "kept_text")
    instead = out.where("said is not null").select("id")
    return out, used.join(instead, "id", "left_anti").union(seen.select("id", "chunk_id", "ord").join(instead, "id", "left_semi"))


def answers(chunks: DataFrame, questions: DataFrame, backend: Backend = LEXICAL, provider: Provider | None = None) -> DataFrame:
    """``question_id, answer, sufficient, confidence, pages``: :func:`decisions` with the cited pages, each once in order."""
    out, cites = decisions(chunks, questions, backend, provider)
    pages = cites.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ord", "page_number"))).alias("l")).select("question_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x["page_number"].cast("string"))), ",").alias("pages"))
    return out.join(pages, "question_id", "left").select("question_id", "answer", "sufficient", "confidence", "pages")


def grounded(claims: DataFrame, passages: DataFrame, threshold: float = 0.5, candidates: int = 2, backend: Backend = LEXICAL) -> DataFrame:
    """The columns of ``claims`` but the sentence, ``score, kept``: each sentence against the passages that share most tokens, singly and
    then joined.

    ``claims`` has question_id, sentence and what tells its rows apart, such as answer_id and sentence_no; ``passages`` has question_id,
    place and text. A sentence that several answers to a question say is scored once. Very short
    sentences need every part of their formula somewhere in the whole texts of the first eight places. With a backend that takes counted
    tokens, sentences stream past the passages of their question (:func:`_counted`) and no pair is a row.
    """
    if hasattr(backend, "entailment_shared"):
        first, second, both = (backend.entailment_shared(F.col(c), F.col("said")) for c in ("first", "second", "both"))
        single = F.greatest(first, F.when(F.col("second").isNotNull(), second))
        joint = F.when((single < threshold) & F.col("second").isNotNull(), both).otherwise(0.0)
        score = F.when(F.col("short"), F.when(F.col("formula"), 1.0).otherwise(0.0)).otherwise(F.greatest(single, joint))
        own = [c for c in claims.columns if c != "sentence"]
        return _counted(claims, passages, candidates).select(*own, F.round(score, 6).alias("score"), (score >= threshold).alias("kept"))
    pairs = claims.select("question_id", "sentence").distinct().join(passages.where("place <= 8"), "question_id", "left")
    shared = F.size(F.array_intersect(T.tokens(F.col("sentence")), T.tokens(F.col("text"))))
    order = Window.partitionBy("question_id", "sentence").orderBy(F.desc("shared"), "place")
    ranked = pairs.withColumn("shared", F.coalesce(shared, F.lit(0))).withColumn("rn", F.row_number().over(order))
    near, short = F.col("rn") <= candidates, F.size(T.tokens(F.col("sentence"))) < 4
    parts = lambda name: F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    premise = F.array_join(F.slice(T.words(F.coalesce("text", F.lit(""))), 1, 320), " ")
    said = ranked.withColumn("premise", F.when(near & ~short, premise)).withColumn("seen", F.when(short, F.array_intersect(parts("sentence"), parts("text"))))
    listed = said.groupBy("question_id", "sentence").agg(F.max(F.when(near & ~short, backend.entailment(F.col("premise"), F.col("sentence")))).alias("single"), F.array_sort(F.collect_list(F.when(near & ~short, F.struct("rn", "premise")))).alias("l"), F.flatten(F.collect_list("seen")).alias("seen"))
    joined = F.array_join(F.transform("l", lambda x: x["premise"]), " ")
    second = F.when((F.col("single") < threshold) & (F.size("l") > 1), backend.entailment(joined, F.col("sentence")))
    formula = (F.size(parts("sentence")) > 0) & (F.size(F.array_except(parts("sentence"), F.col("seen"))) == 0)
    score = F.when(short, F.when(formula, 1.0).otherwise(0.0)).otherwise(F.greatest("single", F.coalesce(second, F.lit(0.0))))
    scored = listed.select(F.col("question_id").alias("q"), F.col("sentence").alias("s"), F.round(score, 6).alias("score"), (score >= threshold).alias("kept"))
    same = F.col("question_id").eqNullSafe(F.col("q")) & (F.col("sentence") == F.col("s"))
    return claims.join(scored, same).drop("q", "s", "sentence")


def _counted(claims: DataFrame, passages: DataFrame, candidates: int) -> DataFrame:
    """The columns of ``claims`` but the sentence, and how many different tokens each has (``said``), how many of them the beginnings of the
    two nearest passages have (``first``, ``second``, null where there is none) and both together; whether it is ``short``, and whether the
    passages then have all of its ``formula``.

    Passages and sentences of a question come one after the other in sorted partitions; only a question's passages, at most eight, are held.
    """
    if candidates != 2:
        raise ValueError("two nearest passages are counted")
    told = passages.where("place <= 8 and question_id is not null and text is not null")
    premise = F.when(F.length("text") >= 639, F.array_join(F.slice(T.words(F.col("text")), 1, 320), " "))  # shorter texts have no more than 320 words
    told = told.select("question_id", "place", F.col("text").alias("sentence"), T.joined_tokens(F.col("text"))["terms"].alias("terms"), T.joined_tokens(premise)["terms"].alias("premise"))
    spoken = T.joined_tokens(F.col("sentence"))
    rows = claims.where("sentence is not null").withColumn("w", spoken).select(*claims.columns, F.col("w.terms").alias("terms"), F.col("w.dl").alias("many"))
    held = rows.unionByName(told.withColumnRenamed("place", "_place"), allowMissingColumns=True)
    own = [f for f in claims.schema.fields if f.name != "sentence"]
    names = [f.name for f in own]
    whole = lambda name: StructField(name, IntegerType())
    schema = StructType([*own, whole("said"), whole("first"), whole("second"), whole("both"), StructField("short", BooleanType()), StructField("formula", BooleanType())])
    find = re.compile("[A-Za-z0-9]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, near, seen, known = None, [], None, {}
        for batch in batches:
            took, out = [], []
            columns = (batch.column(c).to_pylist() for c in ("question_id", "_place", "sentence", "terms", "premise", "many"))
            for i, (question, place, sentence, terms, premise, many) in enumerate(zip(*columns, strict=True)):
                if question != asked:
                    asked, near, seen, known = question, [], None, {}
                if place is not None:
                    tokens = frozenset(terms.split())
                    near.append((place, sentence, tokens, tokens if premise is None else frozenset(premise.split())))
                    continue
                took.append(i)
                if sentence not in known:
                    if len(known) > 4096:
                        known = {}
                    said, short, formula = frozenset(terms.split()), many < 4, None
                    best = sorted(((-len(said & p[2]), p[0], j) for j, p in enumerate(near)))[:2]
                    counts = [len(said & near[j][3]) for _, _, j in best]
                    both = len(said & (near[best[0][2]][3] | near[best[1][2]][3])) if len(best) > 1 else None
                    if short:
                        if seen is None:
                            seen = {part for p in near for part in find(p[1])}
                        parts = find(sentence)
                        formula = bool(parts) and seen.issuperset(parts)
                    known[sentence] = (len(said), counts[0] if counts else 0, counts[1] if len(counts) > 1 else None, both, short, formula)
                out.append(known[sentence])
            if took:
                made = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), [pa.int32()] * 4 + [pa.bool_()] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(took)) for c in names), *made], schema.names)

    placed = held.repartition("question_id").sortWithinPartitions("question_id", F.col("_place").asc_nulls_last())
    return placed.mapInArrow(run, schema)
