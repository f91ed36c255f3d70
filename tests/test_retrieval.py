import math

from pyspark.sql import functions as F

from leafmill.operators import answering as A
from leafmill.operators import retrieval as R
from leafmill.plans.text_queries import grounding_verify

CHUNKS = [
    ("c1", "b", "Corrosion eats iron when air and moisture reach the surface of the metal.", None, "body", 1),
    ("c2", "b", "Silver turns black in air because of sulphur compounds in the air.", "1.1 Corrosion", "body", 2),
    ("c3", "b", "Name the metals. Why does iron rust? What is corrosion?", None, "exercise", 3),
    ("c4", "b", "The reaction is 2Mg + O2 → 2MgO and it gives a bright light.", None, None, 4),
    ("c5", "other", "Corrosion of iron in another book of the shelf.", None, "body", 1),
    ("c6", "b", None, None, "body", 1),
]
QUESTIONS = [("q1", "b", "What is corrosion of iron?"), ("q2", "b", "Which reaction gives light?"), ("q3", "b", "Zebra habitat?"), ("q4", "none", "Corrosion?")]


def frames(spark):
    chunks = spark.createDataFrame(CHUNKS + CHUNKS[:1], "chunk_id string, book_id string, text string, section string, kind string, page_number int")
    return chunks, spark.createDataFrame(QUESTIONS, "question_id string, book_id string, question string")


def test_bm25_by_hand(spark):
    chunks, q = frames(spark)
    docs = R.build(chunks)
    words = {r.chunk_id: list(r.words) for r in R.documents(chunks).where("book_id = 'b'").collect()}
    avg = sum(map(len, words.values())) / len(words)
    got = {(r.question_id, r.chunk_id): r.bm25 for r in R.scores(docs, q).collect()}
    for c, w in words.items():
        want = 0.0
        for t in ("corrosion", "iron"):
            df = sum(t in x for x in words.values())
            tf = w.count(t)
            want += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
        assert abs(got.get(("q1", c), 0.0) - want) < 1e-7
    assert not any(c == "c5" or k in ("q3", "q4") for k, c in got)


def test_fusion_and_boost(spark):
    chunks, q = frames(spark)
    docs = R.build(chunks)
    fused = {(r.question_id, r.chunk_id): (r.rrf, r["rank"]) for r in R.fused(R.scores(docs, q), docs, q).collect()}
    assert fused["q2", "c4"] == (round(2 / 61 + 0.5 / 60, 8), 0) and max(r for r, _ in fused.values()) < 0.05


def test_answers(spark):
    chunks, q = frames(spark)
    got = {r.question_id: r for r in A.answers(chunks, q).collect()}
    assert set(got) == {"q1", "q2", "q3", "q4"}
    assert got["q1"].sufficient and "Corrosion eats iron" in got["q1"].answer and got["q1"].pages.startswith("1")
    for k in ("q3", "q4"):
        assert not got[k].sufficient and got[k].answer == A.NOT_COVERED and got[k].pages is None and got[k].confidence == 0
    assert A.answers(chunks.limit(0), q).where("sufficient").count() == 0


def test_exercise_penalty_and_entailment(spark):
    chunks, q = frames(spark)
    docs = R.build(chunks)
    ranking = {r.chunk_id: r.score for r in A.reranked(R.fused(R.scores(docs, q), docs, q), docs, q).where("question_id = 'q1'").collect()}
    assert ranking["c1"] == 8.0 and ranking["c3"] == 5.0
    claims = spark.createDataFrame([("q1", 0, "Corrosion eats iron in moisture and air."), ("q1", 1, "Zebras live on the open grass plains."), ("q1", 2, "2MgO"), ("q1", 3, "3KCl")], "question_id string, sentence_no int, sentence string")
    passages = docs.docs.select(F.lit("q1").alias("question_id"), F.row_number().over(R.Window.orderBy("chunk_id")).alias("place"), "text")
    assert [r.kept for r in A.grounded(claims, passages).orderBy("sentence_no").collect()] == [True, False, True, False]


def test_formulas_in_all_passages(spark):
    claims = spark.createDataFrame([("q", 0, "2MgO"), ("q", 1, "3KCl"), ("q", 2, "जब नमक"), ("q", 3, "H2O 9Zn"), ("none", 0, "2MgO")], "question_id string, sentence_no int, sentence string")
    texts = ["word " * 400 + "2MgO", "a", "b", "H2O c", "9Zn", "e", "f", "3 KCl", "3KCl"]
    passages = spark.createDataFrame([("q", i, t) for i, t in enumerate(texts, 1)], "question_id string, place int, text string")
    got = {(r.question_id, r.sentence_no): r.kept for r in A.grounded(claims, passages).collect()}
    assert got == {("q", 0): True, ("q", 1): False, ("q", 2): False, ("q", 3): True, ("none", 0): False}


def test_every_answer_is_grounded(spark, tmp_path):
    chunks, q = frames(spark)
    chunks.write.parquet(f"{tmp_path}/chunks.parquet")
    q.withColumnsRenamed({"question_id": "id", "book_id": "book"}).write.parquet(f"{tmp_path}/qa_golden.parquet")
    true, wrong = "Corrosion eats iron in moisture and air.", "Zebras live on the open grass plains."
    given = [(1, "q1", true), (2, "q1", wrong), (3, "q1", f"{wrong} {true}"), (3, "q1", f"{wrong} {true}"), (4, "q3", true), (5, "q1", None), (6, None, wrong), (7, "q1", true)]
    spark.createDataFrame(given, "answer_id long, question_id string, answer string").write.parquet(f"{tmp_path}/answer_results.parquet")
    got = sorted((r.answer_id, r.sentence_no, r.kept) for r in grounding_verify(spark, str(tmp_path)).collect())
    assert got == [(1, 0, True), (2, 0, False), (3, 0, False), (3, 1, True), (4, 0, False), (6, 0, False), (7, 0, True)]


def test_nearest(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id int, embedding array<float>")
    got = [(r["query"], r.vec_id) for r in R.nearest(v, v.where("vec_id = 2"), 2).orderBy("rank").collect()]
    assert got == [(2, 5), (2, 4)]


COMPARED = [
    ("k1", "b", "Displacement reaction means that one metal takes the place of another metal in its salt.", "Reactions", "body", 1), ("k2", "b", "Decomposition reaction means that one substance breaks down into two simpler ones when heated.", "Reactions", "body", 2),
    ("k3", "b", "Every reaction needs energy before the first bonds of it can break apart.", None, "body", 3), ("k4", "b", "The garden is watered in the evening by the older pupils of the class.", None, "body", 4),
]


def compared(spark):
    chunks = spark.createDataFrame(COMPARED, "chunk_id string, book_id string, text string, section string, kind string, page_number int")
    asked = [("c", "b", "Compare displacement reaction and decomposition reaction."), ("h", "b", "Compare displacement reaction and zebra habitat."), ("s", "b", "What does displacement reaction mean?"), ("e", "b", "  "), ("n", "b", None), ("z", "b", "zebra zebra")]
    return chunks, spark.createDataFrame(asked, "question_id string, book_id string, question string")


def test_decisions(spark):
    chunks, q = compared(spark)
    known = spark.createDataFrame([("b", 1, ["9.9"])], "book_id string, page_number int, figures array<string>")
    out, cites = A.decisions(chunks, q, known_figures=known)
    got = {r.question_id: r for r in out.collect()}
    assert got["c"].parts == 2 and got["c"].sufficient and got["c"].extractive is None and got["c"].answer.startswith("Displacement reaction: Displacement reaction means") and "\n\nDecomposition reaction: Decomposition" in got["c"].answer
    assert [got[k].reason for k in ("h", "e", "n", "z")] == ["below_threshold", "no_question", "no_question", "no_candidates"]
    assert got["e"].answer == A.NO_QUESTION and got["h"].answer == A.NOT_COVERED and got["s"].reason is None and got["s"].parts == 0
    pages = {}
    for r in sorted(cites.collect(), key=lambda r: r.ord):
        pages.setdefault(r.question_id, []).append(r.chunk_id)
    assert set(pages) == {"c", "s"} and pages["c"][:2] == ["k1", "k2"] and len(pages["c"]) <= 4


def test_provider(spark):
    chunks, q = compared(spark)
    true, wrong = "Displacement reaction means that one metal takes the place of another metal.", "Zebras live on open grass plains in the south."

    def said(text, scope=True):
        answer = F.struct(F.lit(text).alias("text"), F.lit(scope).alias("in_scope"), F.lit("m").alias("model"))
        return A.Provider("model", lambda question, evidence: F.when(question.contains("mean") & (F.size(evidence) > 0), answer))

    want = {(true + " " + wrong, True): (true, True, "model", None), (wrong, True): (A.NOT_STATED, False, "model", "not_supported"), (true, False): (A.NOT_COVERED, False, "model", "self_check")}
    for (text, scope), expected in want.items():
        out, cites = A.decisions(chunks, q, provider=said(text, scope))
        got = {r.question_id: (r.answer, r.sufficient, r["mode"], r.reason) for r in out.collect()}
        assert got["s"] == expected and got["c"][2] == "offline" and got["z"][3] == "no_candidates"
        assert {r.question_id for r in cites.collect()} == ({"c", "s"} if expected[1] else {"c"})


def test_index_is_kept(spark, tmp_path):
    chunks, q = frames(spark)
    index = R.build(chunks)
    R.save(index, str(tmp_path))
    kept = R.load(spark, str(tmp_path))
    assert sorted(map(tuple, R.scores(kept, q).collect())) == sorted(map(tuple, R.scores(index, q).collect()))
    first = {r.book_id: r.fingerprint for r in R.fingerprint(R.documents(chunks)).collect()}
    assert set(first) == {"b", "other"} and first == {r.book_id: r.fingerprint for r in R.fingerprint(kept.docs).collect()}


def test_citations_name_known_figures(spark):
    rows = spark.createDataFrame([("q", 1, "c1", "b", 1, "See Figure 1.1 and Figure 2.2.", ["1.1", "2.2"]), ("q", 2, "c2", "b", 2, "See Figure 3.3.", ["3.3"]), ("q", 3, "c3", "b", 3, "None.", None)], "question_id string, place int, chunk_id string, book_id string, page_number int, text string, figure_refs array<string>")
    known = spark.createDataFrame([("b", 1, ["2.2"]), ("b", 2, [])], "book_id string, page_number int, figures array<string>")
    assert {r.chunk_id: r.figures for r in A.cited(rows, known).collect()} == {"c1": ["2.2"], "c2": ["3.3"], "c3": []}
