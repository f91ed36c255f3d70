"""Rankings whose books and questions are cut into blocks, against SQL and against the whole."""

import math
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from leafmill.functions import text as T
from leafmill.operators import answering as A
from leafmill.operators import figures as V
from leafmill.operators import retrieval as R
from leafmill.plans import layout_queries as L
from leafmill.plans import registry_queries as W
from tests.test_retrieval import frames

TABLES = "/root/testdata/sf0.001"
#: Queries that read rankings; with few chunks and questions to a block, each book is cut.
RANKED = ["bm25_topk", "rrf_fusion", "win_margin", "lexical_rerank", "agg_eval_metrics", "citations", "grounding_verify", "lexical_span", "prompt_build", "sufficiency"]


def rows(found):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", RANKED)
def test_blocks_as_sql(spark, monkeypatch, name):
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "ASKED", 3)
    con = duckdb.connect()
    for table in ("chunks", "qa_golden", "answer_results"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    got = __spark_entry__.queries()[name](spark, TABLES)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert rows(map(tuple, got.select(*names).collect())) == rows(want.fetchall())


def test_only_the_best_go_on(spark, monkeypatch):
    chunks, q = frames(spark)
    index = R.build(chunks)
    whole = R.scores(index, q).collect()
    for block, asked in ((16_384, 4_096), (2, 1)):
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R, "ASKED", asked)
        assert sorted(map(tuple, R.scores(index, q).collect())) == sorted(map(tuple, whole))
        few = R.scores(index, q, 1)
        assert len(few.collect()) < len(whole)
        for score in ("bm25", "cosine"):
            best = {(r.question_id, r.chunk_id) for r in R.ranked(few, score, 1).collect()}
            assert best == {(r.question_id, r.chunk_id) for r in R.ranked(R.scores(index, q), score, 1).collect()}


def test_places_are_kept_without_texts(spark, monkeypatch):
    chunks, q = frames(spark)
    kept, cut = {}, A.cut
    monkeypatch.setattr(A, "cut", lambda df, tag: (kept.setdefault(tag, df.columns), cut(df, tag))[1])
    index = R.build(chunks)
    got = A.ranking(index, q)
    assert kept["ranking"] == ["question_id", "chunk_id", "score", "place"]
    whole = A.reranked(R.fused(R.scores(index, q), index, q), index, q)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*got.columns).collect()))


def test_places_need_no_texts(spark, monkeypatch):
    chunks, q = frames(spark)
    index = R.build(chunks)
    read = type("Read", (), {"rerank": lambda self, question, text: A.LEXICAL.rerank(question, text)})()
    want = sorted(map(str, A.places(index, q, read).collect()))
    said = A.places(index, q.union(q.where("question_id = 'q1'"))).collect()  # an id that comes twice is decided by its texts
    monkeypatch.setattr(A.LexicalBackend, "rerank", None)
    assert sorted(map(str, A.places(index, q).collect())) == want
    assert {(r.chunk_id, r.score) for r in said} == {(r.chunk_id, r.score) for r in A.places(index, q).collect()}


def test_joined_tokens_are_tokens(spark):
    texts = ["", "a", "the", "ab", "of ab", "ab of", "Describe x9-descriptor\u00e9 THE \u0130st \u212aelvin", "\u0939\u093f ab\n cd", None, "x" * 40, "2 H2 + O2 (g)", "a + B (", "x = 1", "a->b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = rows.select(T.joined_tokens(F.col("t")).alias("j"), F.array_join(T.tokens(F.col("t")), " ").alias("a"), F.size(T.tokens(F.col("t"))).alias("n"), T.has_equation(F.col("t")).alias("e"), F.col("t").rlike(T.EQUATION).alias("f")).collect()
    assert all((r.j and r.j.terms) == r.a and (r.a is None or r.j.dl == r.n) and r.e == r.f for r in got)


def test_claims_stream_past_passages(spark):
    """Sentences of one question that meet passages of all lengths score as pairs do, and no pair of both is a row."""
    texts = ["iron rusts in moist air", "copper wire heats the salt water " * 3, "word " * 319 + "magnesium burns", "word " * 330 + "zinc melts", "2MgO and zinc", "", "acid salt", "base salt", "iron zinc acid base"]
    said = ["Iron rusts slowly in moist air.", "Zinc melts near acid base salt.", "Magnesium burns with copper wire.", "2MgO", "3KCl", "", "the", "Iron rusts while zinc melts with acid.", "Nothing like that was ever said."]
    claims = spark.createDataFrame([(a, q, i, x) for a, q in ((1, "q"), (2, "q"), (3, "none"), (4, None)) for i, x in enumerate(said)], "answer_id long, question_id string, sentence_no int, sentence string")
    passages = spark.createDataFrame([("q", i, t) for i, t in enumerate(texts, 1)], "question_id string, place int, text string")
    read = type("Read", (), {"entailment": lambda self, premise, sentence: A.LEXICAL.entailment(premise, sentence)})()
    want, got = A.grounded(claims, passages, backend=read), A.grounded(claims, passages)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_relevant_figures_as_pairs(spark, monkeypatch):
    """The best figures by looked up terms are those of all pairs, whole books or blocks."""
    d = "/root/testdata/sf0.001"
    asked = spark.read.parquet(f"{d}/qa_golden.parquet").selectExpr("id query_id", "book book_id", "question")
    figures = L._figures(spark, d).withColumn("figure", F.concat_ws("-", "page", "number")).cache()
    more = figures.select("book_id", F.substring(F.lower("caption"), 1, 30).alias("question")).union(figures.select("book_id", F.lit("Which structure shows the cycle of flow, cycle and tin in zinc?")))
    asked = asked.union(more.select(F.concat(F.lit("m"), F.monotonically_increasing_id()).alias("query_id"), "book_id", "question")).cache()
    pairs = figures.join(asked.where("question is not null"), "book_id").withColumn("r", V.relevance(F.col("question"), F.col("caption"), F.col("label"), F.col("number"), F.col("keywords"), F.col("labels_inside"), F.col("context"), F.lit(None), F.col("windows")))
    want = sorted(map(str, V.top_figures(pairs.select("query_id", "figure", F.col("r.score").alias("score"))).collect()))
    assert len(want) > 50
    for block, many in ((2048, 2048), (3, 2)):
        monkeypatch.setattr(V, "BLOCK", block)
        monkeypatch.setattr(V, "ASKED", many)
        got = V.relevant(figures, asked)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
        assert sorted(map(str, V.top_figures(got).collect())) == want


def test_spans_from_counted_tokens(spark, monkeypatch):
    chunks, q = frames(spark)
    ranks = A.ranking(R.build(chunks), q)
    read = type("Read", (), {"span": lambda self, question, sentence: A.LEXICAL.span(question, sentence)})()
    want = sorted(map(str, A.spans(ranks, read).collect()))
    monkeypatch.setattr(A.LexicalBackend, "span", None)
    assert want and sorted(map(str, A.spans(ranks).collect())) == want
    none = A.decided(ranks, A.spans(ranks.limit(0)), q)
    assert none.count() == q.count() and none.where("margin is not null").count() == 0


def test_single_chunks_stay(spark, monkeypatch):
    """Texts of chunks that come once aren't written again; repeated ones are merged as before, broadcast or not."""
    chunks, _ = frames(spark)
    again = chunks.limit(2).withColumn("text", F.lit("zz iron")).union(chunks.limit(1))
    chunks = chunks.union(again).cache()
    kept, cut = {}, R.cut
    monkeypatch.setattr(R, "cut", lambda df, tag: (kept.setdefault(tag, df.columns), cut(df, tag))[1])
    once = R._once(chunks)
    want = sorted(map(str, once.withColumn("said", R.said(once)).collect()))
    index = R.build(chunks)
    assert "text" not in kept["terms"] and "documents" not in kept
    assert sorted(map(str, index.docs.collect())) == want
    terms = sorted(map(str, index.terms.collect()))
    monkeypatch.setattr(R, "REPEATED", 0)
    index = R.build(chunks)
    assert "documents" in kept and sorted(map(str, index.docs.collect())) == want and sorted(map(str, index.terms.collect())) == terms


def test_equal_questions_are_scored_once(monkeypatch):
    """A block's best by columns of frequent tokens and by lists of rare ones are those of plain sums; what is asked twice is summed once."""
    said = [["iron"] * (1 + i % 3) + ["salt"] * (i % 2) + [f"w{i % 7}"] + (["zinc"] if i == 8 else []) for i in range(40)]
    chunks = pa.table({"book_id": ["b"] * 40, "chunk_id": [f"c{i:02}" for i in range(40)], "terms": [" ".join(w) for w in said], "equation": [False] * 40, "exercise": [False] * 40})
    asks = {"q1": "iron zinc w3 iron", "q2": "salt none", "q3": "iron zinc w3 iron", "q4": "none"}
    lengths = [6**0.5, 2**0.5, 6**0.5, 1.0]
    asked = pa.table({"question_id": list(asks), "book_id": ["b"] * 4, "words": list(asks.values()), "length": lengths, "df": pa.nulls(4, pa.int64()), "n": pa.nulls(4, pa.int64()), "avgdl": pa.nulls(4, pa.float64())})
    calls, rounded = [], R._rounded
    monkeypatch.setattr(R, "_rounded", lambda x: (calls.append(1), rounded(x))[1])
    want = {}
    for (q, text), length in zip(asks.items(), lengths, strict=True):
        for i, w in enumerate(said):
            hits = [t for t in set(text.split()) if t in w]
            if hits:
                df = {t: sum(t in x for x in said) for t in hits}
                mean = sum(map(len, said)) / 40
                bm25 = sum(text.split().count(t) * math.log(1 + (40 - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in hits)
                norm = sum(w.count(t) ** 2 for t in set(w)) ** 0.5
                want[q, f"c{i:02}"] = round(bm25, 8), round(sum(text.split().count(t) * w.count(t) for t in hits) / norm / length, 8), len(hits)
    for k in (None, 5):
        calls.clear()
        got = {(r["question_id"], r["chunk_id"]): (r["bm25"], r["cosine"], r["shared"]) for r in R._block(k, R.K1, R.B)(chunks, asked).to_pylist()}
        assert len(calls) == 4 and all(got[x] == pytest.approx(want[x], abs=2e-8) for x in got)
        best = lambda rows, at, q: sorted((-v[at], x[1]) for x, v in rows.items() if x[0] == q)[: k or 99]
        assert all([c for _, c in best(got, at, q)] == [c for _, c in best(want, at, q)] for q in asks for at in (0, 1))
        assert k is None and len(got) == len(want) or k and len(got) < len(want)


def test_sufficiency_decides_without_texts(spark, monkeypatch):
    seen, decided = [], A.decided
    monkeypatch.setattr(A, "decided", lambda ranking, best, q: (seen.append(ranking.columns), decided(ranking, best, q))[1])
    assert __spark_entry__.queries()["sufficiency"](spark, TABLES).columns and seen == [["question_id", "chunk_id", "score", "place"]]


def test_metrics_read_places_once(spark, monkeypatch):
    """Pages come along with the places, and what is measured is a table: neither is a ranking written nor do places meet chunks again."""
    kept, cut = {}, A.cut
    for module in (A, L):
        monkeypatch.setattr(module, "cut", lambda df, tag: (kept.setdefault(tag, df), cut(df, tag))[1], raising=False)
    got = __spark_entry__.queries()["agg_eval_metrics"](spark, TABLES)
    assert set(kept) == {"results"} and "cited" in kept["results"].columns
    plan = kept["results"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "chunk_id" not in "".join(x for x in plan.splitlines() if "Join " in x) and len(got.collect()) == 1


def test_prompts_read_eight_places(spark, monkeypatch):
    kept, cut = {}, R.cut
    monkeypatch.setattr(W, "cut", lambda df, tag: (kept.setdefault(tag, cut(df, tag)[0]), "")[:2])
    assert __spark_entry__.queries()["prompt_build"](spark, TABLES).columns == ["question_id", "chars", "hash"]
    assert kept["ranking"].agg(F.max("place")).first()[0] == 8


def test_rough_sums_lose_no_chunk(monkeypatch):
    """Of many chunks the best by rough sums, and questions summed together, are those of exact sums of each question by itself."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    said = [" ".join(draw.choice(words[: draw.choice((3, 30))]) for _ in range(draw.choice((1, 4, 40)))) for _ in range(2000)]
    table = lambda book, texts: {"book_id": [book] * len(texts), "chunk_id": [f"{book}{i:04}" for i in range(len(texts))], "terms": texts, "equation": [i % 2 == 0 for i in range(len(texts))], "exercise": [False] * len(texts)}
    chunks = pa.concat_tables([pa.table(table("a", said)), pa.table(table("b", said[:40]))])
    asks = [(f"q{i:03}", "ab"[i % 2], " ".join(draw.choice(words) for _ in range(draw.choice((1, 5))))) for i in range(700)]
    asked = pa.table({"question_id": [x[0] for x in asks], "book_id": [x[1] for x in asks], "words": [x[2] for x in asks], "length": [sum(x[2].split().count(t) ** 2 for t in set(x[2].split())) ** 0.5 for x in asks], "df": pa.nulls(700, pa.int64()), "n": pa.nulls(700, pa.int64()), "avgdl": pa.nulls(700, pa.float64())})
    calls, rounded = [], R._rounded
    monkeypatch.setattr(R, "_rounded", lambda x: (calls.append(len(x)), rounded(x))[1])
    found = lambda k: sorted(map(str, R._block(k, R.K1, R.B)(chunks, asked).to_pylist()))
    whole, few = found(None), found(5)
    assert len(calls) < 4 * 700 and len(few) < len(whole) / 20
    monkeypatch.setattr(R, "FEW", 0)
    monkeypatch.setattr(R, "WIDE", 0)
    assert found(None) == whole and found(5) == few
    best = {}
    for r in map(eval, whole):
        for at in ("bm25", "cosine"):
            best.setdefault((r["question_id"], at), []).append((-r[at], r["chunk_id"]))
    want = {(q, c) for (q, _), rows in best.items() for _, c in sorted(rows)[:5]}
    assert {(r["question_id"], r["chunk_id"]) for r in map(eval, few)} == want
