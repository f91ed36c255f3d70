import hashlib
import hmac

from pyspark.sql import functions as F

from leafmill.functions import records as P
from leafmill.operators import reading


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_visuals(spark):
    w, h = F.lit(100), F.lit(100)
    assert one(spark, P.is_content_image(w, h, arr(5, 5, 5))) and not one(spark, P.is_content_image(w, h, arr(1, 1, 1))) and not one(spark, P.is_content_image(F.lit(10), h, arr(9, 9, 9)))
    assert one(spark, P.is_code_image(F.lit(1), w, h)) and not one(spark, P.is_code_image(F.lit(2), w, h))
    assert one(spark, P.is_full_page(F.lit(95), F.lit(95), w, h))
    page = F.lit(600), F.lit(800)
    assert one(spark, P.is_drawing(arr(10, 50, 90, 90), *page)) and not one(spark, P.is_drawing(arr(10, 5, 90, 90), *page))
    assert one(spark, P.is_contour(arr(100, 100, 400, 300), *page)) and not one(spark, P.is_contour(arr(100, 100, 180, 300), *page))
    assert one(spark, P.box_of_points(F.array(arr(1.9, 2), arr(5.5, 9.9)))) == [1, 2, 4, 7]
    assert one(spark, P.padded(arr(5, 100, 105, 300), *page)) == [0.0, 90.0, 115.0, 310.0]
    assert one(spark, P.halves(arr(0, 0, 100, 50))) == [[0.0, 0.0, 55.0, 50.0], [45.0, 0.0, 100.0, 50.0]]


def test_texts_and_keys(spark):
    assert [tuple(x) for x in one(spark, P.subfigures(F.lit("Cells: (a) a leaf,  and (b) a root.")))] == [("a", "a leaf"), ("b", "a root")]
    assert one(spark, P.nearby_context(F.lit("x" * 300 + "Figure 1" + "y" * 400), F.lit("Figure 1"))) == "x" * 250 + ("Figure 1" + "y" * 400)[:350]
    assert one(spark, P.nearby_context(F.lit("z" * 500), F.lit("Figure 1"))) == "z" * 400
    assert one(spark, P.first_given(F.lit(None), F.lit(""), F.lit("a"))) == "a"
    assert one(spark, P.metadata(F.lit('{"a": "1"}'))) == {"a": "1"} and one(spark, P.metadata(F.lit("no"))) == {} and one(spark, P.metadata(F.lit(None).cast("string"))) == {}
    assert one(spark, P.mentions(F.lit("Fig. 10.1, figure 2.1, Activity 3 and Fig 2.1"))) == ["10.1", "2.1", "3"]
    assert one(spark, P.canonical_id(F.lit("d"), F.lit(3), "figure", F.lit(1))) == "doc:d:page:3:figure:1"
    assert one(spark, P.api_owner(F.lit("k:ann"))) == "ann" and one(spark, P.api_owner(F.lit("k"))).startswith("key-")
    assert one(spark, P.progress(F.lit(5), F.lit(10))) == 0.475
    assert [one(spark, P.page_status(F.lit(x))) for x in ("Tesseract selected", "OCR Error: x", "found no readable text", None)] == ["degraded", "failed", "degraded", "ok"]


def test_annotations(spark):
    ids, none = F.array(F.lit(7), F.lit(1)), F.lit(None).cast("array<string>")
    boxes = F.array(arr(0, 0, 1, 1), arr(0, 0, 1, 1), arr(2, 2, 3, 3))
    assert [(a.category, a.bbox) for a in one(spark, P.annotations_of(ids, none, boxes))] == [("Picture", [0.0, 0.0, 1.0, 1.0]), ("Other", [0.0, 0.0, 1.0, 1.0])]


def test_signatures_and_embeddings(spark):
    want = hmac.new(b"s", b"/a|5", hashlib.sha256).hexdigest()[:32]
    assert one(spark, P.signed(F.lit("/a"), F.lit(5), "s")) == want
    assert one(spark, P.is_signed(F.lit("/a"), F.lit(5), F.lit(want), "s", F.lit(4))) and not one(spark, P.is_signed(F.lit("/a"), F.lit(5), F.lit(want), "s", F.lit(6)))
    v = one(spark, P.lexical_embedding(F.array(F.lit("iron"), F.lit("iron"), F.lit("rust"))))
    assert len(v) == 512 and abs(sum(x * x for x in v) - 1) < 1e-5 and sum(x > 0 for x in v) == 2


def test_reading(spark):
    words = spark.createDataFrame([("p", 1, 1, 1, 2, "world", 0.5, 60, 12, 40, 10), ("p", 1, 1, 1, 1, "Hello", 0.9, 10, 10, 40, 10), ("p", 1, 1, 2, 3, "x", 0.9, 10, 30, 5, 5), ("p", 1, 1, 2, 4, " ", 0.9, 0, 0, 0, 0)], "page string, block int, par int, line_no int, ord int, text string, confidence double, x int, y int, w int, h int")
    got = [tuple(r)[:7] for r in reading.lines_of_words(words).orderBy("line").collect()]
    assert got == [("p", 1, "Hello world", 10, 10, 100, 22), ("p", 3, "x", 10, 30, 15, 35)]
    lines = spark.createDataFrame([([("Figure 1 A", 10.0, 10.0, 90.0, 20.0), ("cell of", 12.0, 25.0, 90.0, 35.0), ("Figure 2", 12.0, 40.0, 90.0, 50.0), ("a leaf", 11.0, 45.0, 95.0, 55.0), ("far away", 11.0, 300.0, 95.0, 310.0)],)], "l array<struct<text:string,x1:double,y1:double,x2:double,y2:double>>")
    c = lines.select(reading.continued_caption(F.col("l")).alias("c")).first().c
    assert (c.text, c.y2, c.n) == ("Figure 1 A cell of a leaf", 55.0, 2)
    refs = spark.createDataFrame([("p", "1"), ("p", "2")], "page string, number string")
    assert [r.text for r in reading.placeholder_captions(refs, refs.limit(1)).collect()] == ["Figure 2"]
    figs = spark.createDataFrame([("p", "1", "f1")], "page string, number string, figure string")
    caps = spark.createDataFrame([("p", "1", "c1")], "page string, number string, caption string")
    assert {tuple(r) for r in reading.caption_graph(figs, caps).collect()} == {("c1", "f1", "caption_of"), ("p", "f1", "references")}
