import datetime

from pyspark.sql import functions as F

from leafmill.functions import display as D
from leafmill.functions import geometry as G
from leafmill.operators import curation as C
from leafmill.operators import figures as V
from leafmill.operators import reading as W
from leafmill.operators import registry as E

T0 = datetime.datetime(2026, 1, 1)
at = lambda minutes: T0 + datetime.timedelta(minutes=minutes)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_uploads(spark):
    books = spark.createDataFrame([("b1", "o", "x", "ready", at(0)), ("b2", "o", "y", "failed", at(0)), ("b3", "o", "z", "ready", at(0))], "id string, owner_id string, sha256 string, status string, created_at timestamp")
    jobs = spark.createDataFrame([("j1", "b1", "o", "succeeded", at(1)), ("j2", "b1", "o", "queued", at(2)), ("j3", "b2", "o", "failed", at(1))], "id string, book_id string, owner_id string, status string, created_at timestamp")
    uploads = spark.createDataFrame([("o", s) for s in "xxyzn"] + [("p", "x")], "owner_id string, sha256 string")
    got = {(r.owner_id, r.sha256): (r.uploads, r.outcome, r.book_id, r.job_id) for r in E.upload_outcomes(uploads, books, jobs).collect()}
    assert got == {("o", "x"): (2, "returned", "b1", "j2"), ("o", "y"): (1, "queued_again", "b2", None), ("o", "z"): (1, "queued_again", "b3", None), ("o", "n"): (1, "created", None, None), ("p", "x"): (1, "created", None, None)}
    assert [r.id for r in E.pending(jobs).collect()] == ["j2"] and E.owned(books, "p").count() == 0 and E.owned(books, "o").count() == 3
    assert {r.id: (r.status, r.message) for r in E.resumed(jobs).collect()}["j2"] == ("queued", "Re-queued after restart")
    assert E.upload_outcomes(uploads.limit(0), books, jobs).count() == 0


def test_job_states(spark):
    events = [("a", at(0), "queued", 0.0, None), ("a", at(1), "running", 0.5, "half"), ("a", at(2), "running", 0.2, "back"), ("a", at(3), "succeeded", None, "Ready"), ("a", at(4), "running", 0.1, "late"), ("b", at(0), "queued", None, None), ("b", at(1), "succeeded", None, None), ("c", at(0), "failed", None, "bad"), ("c", at(1), "queued", None, None), ("c", at(2), "running", 9.0, None)]
    got = {r.job_id: (r.status, r.progress, r.message, r.ignored) for r in E.job_states(spark.createDataFrame(events, "job_id string, at timestamp, status string, progress double, message string")).collect()}
    assert got == {"a": ("succeeded", 1.0, "Ready", 1), "b": ("queued", 0.0, None, 1), "c": ("running", 1.0, None, 0)}


def test_figures_by_key(spark):
    pages = spark.createDataFrame([("b", 3, [("1.1", "", " a "), ("", "Fig", None), ("1.1", "F", "c")]), ("b", 4, None)], "book_id string, page_number int, figures array<struct<figure_id:string,figure_label:string,caption:string>>")
    index = E.figure_index(pages)
    assert sorted((r.figure_key, r.figure_id, r.label, r.caption) for r in index.collect()) == [("p3-1", "1.1", "Figure 1.1", "a"), ("p3-2", "p3-2", "Fig", None), ("p3-3", "1.1", "F", "c")]
    picked = spark.createDataFrame([("b", 3, "1.1"), ("b", 3, "9.9")], "book_id string, page_number int, figure_id string")
    assert [r.figure_key for r in E.keyed_figures(picked, index).collect()] == ["p3-3"]


def test_texts_for_readers(spark):
    L = F.lit
    row = one(spark, D.shorten(L("a  b " * 99)), D.shorten(L(" a \n b ")), D.counted(L(1), "page"), D.counted(L(2), "box", "boxes"), D.page_label(L(7)), D.page_label(L(123)), D.percent(L(0.345)), D.percent(L(1.7)), D.figure_alt(L(" "), L("cap"), L(4)), D.figure_label(L(""), L("2.1")), D.document_folder(L("a b/c.pdf")), D.in_scope(L("so: not_in_book.")), D.rate_key(L(""), L(None)), D.rate_key(L("k"), L("1.2.3.4")), D.bar(L(1), L(3)), D.bar(L(0), L(0)))
    assert len(row[0]) == 180 and row[0].endswith("…") and list(row)[1:12] == ["a b", "1 page", "2 boxes", "07", "123", 35, 100, "Figure on page 4: cap", "Figure 2.1", "a_b_c_pdf", False]
    assert row[12] == "ip:unknown" and row[13].startswith("cred:") and len(row[13]) == 21 and row[14] == "█" * 10 + "░" * 20 + " 1/3 (33%)" and row[15].endswith(" 0/0 (0%)")
    evidence = F.array(F.struct(L(2).alias("page_number"), L("S").alias("section"), L("t").alias("text")), F.struct(L(3).alias("page_number"), L(None).cast("string").alias("section"), L("u").alias("text")))
    assert one(spark, D.excerpts(evidence))[0] == "[page 2 | S]\nt\n\n[page 3]\nu"


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    w, h = F.lit(100), F.lit(200)
    row = one(spark, G.from_box(box(10, 10, 30, 40), w, h), G.from_box(box(60, 10, 90, 40), w, h), G.from_box(box(0.1, 0.1, 0.5, 0.5), w, h, "xyxy"), G.from_box(box(50, 50, 10, 10), w, h, "xyxy"), G.from_box(box(50, 50, 10, 10), w, h, "xywh"), G.from_box(box(1, 2, 3), w, h))
    assert list(row) == [[10.0, 10.0, 40.0, 50.0], [60.0, 10.0, 90.0, 40.0], [10.0, 20.0, 50.0, 100.0], None, [50.0, 50.0, 60.0, 60.0], None]
    obstacles = F.array(box(0, 0, 100, 45), box(0, 95, 100, 120), box(0, 52, 18, 60))
    row = one(spark, G.crop_box(box(20, 50, 80, 90), w, h, obstacles), G.crop_box(box(20, 50, 80, 90), w, h, F.lit(None).cast("array<array<double>>")), G.search_window(F.array(*[F.lit(x) for x in (300, 700, 400, 720)]), F.lit(1000), F.lit(2000), True))
    assert list(row) == [[20.0, 47.0, 90.0, 93.0], [10.0, 40.0, 90.0, 100.0], [50, 100, 650, 695]]


def test_reading(spark):
    line = lambda t, x, y1, y2: F.struct(F.lit(t).alias("text"), F.lit(x).alias("x1"), F.lit(y1).alias("y1"), F.lit(x + 50).alias("x2"), F.lit(y2).alias("y2"))
    lines = F.array(line("as shown in", 10, 0, 10), line("Fig. 12.2. Why", 12, 20, 30), line("It ends.", 10, 40, 50), line("Fig. 3", 10, 60, 70), line("far", 400, 75, 80), line("Fig. 4", 10, 200, 210))
    assert list(one(spark, *[W.starts_caption(lines, F.lit(i)) for i in (0, 1, 3, 5)])) == [True, False, True, True]
    assert list(one(spark, W.subfigure_labels(F.lit("(a) x (B) y (iv)")), W.is_accepted(F.lit(0.7), F.lit("x")), W.is_accepted(F.lit(0.9), F.lit(" ")), W.is_caption_block(F.lit("x" * 381)))) == [["a", "b", "iv"], True, False, False]
    raw = '{"res": {"rec_boxes": [[1, 2, 3, 4], [5, 6, 7, 8]], "rec_texts": ["a", "b", "c"], "rec_scores": [0.5]}}'
    poly = '{"dt_polys": [[[5, 9], [1, 2]]], "rec_texts": ["a"], "rec_scores": [0.5]}'
    got = spark.createDataFrame([(raw,), (poly,), ("{}",), ("no",)], "r string").select(W.engine_lines(F.col("r")).alias("l")).collect()
    assert [[(list(x.box), x.text, x.score) for x in r.l or []] for r in got] == [[([1.0, 2.0, 3.0, 4.0], "a", 0.5)], [([1.0, 2.0, 5.0, 9.0], "a", 0.5)], [], []]
    found = spark.createDataFrame([("p", "Chart ", [0.0, 0.0, 100.9, 50.0], 1000, 1000), ("p", "", [0.0, 0.0, 200.0, 50.0], 1000, 1000), ("p", "text", [0.0, 0.0, 200.0, 50.0], 1000, 1000), ("p", "Figure", [0.0, 0.0, 900.0, 900.0], 1000, 1000), ("p", "map", None, 10, 10)], "page string, label string, box array<double>, width int, height int")
    assert [(r.label, r.area) for r in W.kept_boxes(found).orderBy("place").collect()] == [("Picture", 10000), ("Chart", 5000)]
    parts = spark.createDataFrame([("p", 1, "a", 100.0), ("p", 1, "b", 100.0)], "page string, figure int, tag string, bottom double")
    labels = spark.createDataFrame([("p", "a", 150.0, 2, [1.0]), ("p", "a", 110.0, 1, [2.0]), ("p", "b", 170.0, 3, [3.0])], "page string, tag string, y double, ord int, box array<double>")
    assert {r.tag: r.label_box for r in W.labelled_parts(parts, labels).collect()} == {"a": [2.0], "b": None}


def test_raw_records(spark):
    kind = "category_id array<int>, bboxes array<array<double>>, categories array<string>, bboxes_block array<array<double>>, objects array<struct<label:string,category:string,category_id:int,bbox:array<double>>>, annotations array<struct<label:string,category:string,category_id:int,bbox:array<double>>>"
    b = [10.0, 10.0, 50.0, 60.0]
    rows = [([6, 9], [b, b], None, None, None, None), ([9], [b], ["Picture", "picture", "Text"], [b, b, b], None, None), (None, None, None, None, [(None, "Picture", None, b), ("Text", None, None, b)], None), (None, None, None, None, None, [(None, None, 7, b), ("Picture", None, None, None)]), (None,) * 6]
    df = spark.createDataFrame(rows, kind)
    got = [r.v for r in df.select(C.picture_boxes(F.struct(*df.columns), F.lit(100), F.lit(100)).alias("v")).collect()]
    assert got == [[b], [[10.0, 10.0, 60.0, 70.0]], [b], [[10.0, 10.0, 60.0, 70.0]], []]
    ids = [r.id for r in C.numbered(spark.createDataFrame([("x", "d"), (None, "d"), ("", None), (None, "d")], "id string, dataset string")).collect()]
    assert ids[0] == "x" and len(set(ids)) == 4 and [i.rsplit("_", 1)[0] for i in ids[1:]] == ["d", "record", "d"] and all(len(i.rsplit("_", 1)[1]) >= 6 for i in ids[1:])
    passed = one(spark, *[C.overfit_passed(*[F.lit(v).cast("double") for v in x]) for x in ((0.75, 0, 0, None), (0.5, 0.7, 0.7, 0.5), (0.5, 0.7, 0.7, 0.6), (0.5, 0.7, 0.7, None))])
    assert list(passed) == [True, True, False, False]


def test_responses(spark):
    text = "Corrosion eats iron when air and moisture reach the surface of the metal."
    chunks = spark.createDataFrame([("b:p1:c0", "b", text, None, "body", 1), ("b:p2:c1", "b", "The garden is watered by pupils in the evening of each day.", None, "body", 2)], "chunk_id string, book_id string, text string, section string, kind string, page_number int")
    asked = [("named", "b", "What is in Figure 2.2?"), ("text", "b", "What eats iron when moisture reach the surface?"), ("none", "b", "Zebra habitat?"), ("look", "b", "Show a diagram of corrosion of iron by moisture and air on the metal surface")]
    q = spark.createDataFrame(asked, "question_id string, book_id string, question string")
    rows = [("b", 1, "1.1", "Figure 1.1", "Corrosion of iron by moisture", ["fig 1.1 corrosion"], "context", ["corrosion", "iron"], ["moisture"]), ("b", 2, "2.2", "Figure 2.2", "A garden", [], "", [], [])]
    figures = spark.createDataFrame(rows, "book_id string, page_number int, number string, label string, caption string, windows array<string>, context string, keywords array<string>, labels_inside array<string>")
    pages = spark.createDataFrame([("b", 1, text), ("b", 2, "garden")], "book_id string, page_number int, text string")
    got = {r.question_id: r for r in V.responses(chunks, q, figures, pages).collect()}
    assert (got["named"].answer, got["named"].source_pages, got["named"].figures, got["named"].margin) == ("Figure 2.2: A garden", "2", "2.2", 100.0)
    assert got["text"].sufficient and got["text"].source_pages.startswith("1") and got["text"].figures == ""
    assert not got["none"].sufficient and got["none"].source_pages == "" and got["none"].figures == ""
    assert got["look"].sufficient and got["look"].figures.split(",")[0] == "1.1"
