import json

from pyspark.sql import functions as F

from leafmill.operators import documents as D

RAW = "book_id string, page_number int, ord int, figure_id string, label string, caption string, labels_inside array<string>, box array<double>, confidence double, description string, image_path string, context string, surrounding string, source_type string"


def frames(spark):
    box = [1.0, 2.0, 3.0, 4.0]
    rows = [
        ("b", 1, 0, "2.1", "Figure 2.1", "Valve", ["x"], box, 0.9, None, None, "ctx", "", "vector_region"), ("b", 1, 1, None, "Fig. 2.1", "Valve of the heart", ["y", "x"], box, 0.1, "d", "i.png", "other", "around", "scan"),
        ("b", 1, 2, None, "Table 3", "", None, box, None, None, None, None, "see Figure 9.9", None), ("b", 1, 3, None, "Activity 4", "Do it", None, box, 0.5, None, None, None, None, None), ("b", 2, 0, None, None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, RAW), spark.createDataFrame([("b", 1, 1, "2.1"), ("b", 1, 2, "7.7"), ("b", 1, 3, "7.7"), ("c", 5, 1, " 8 ")], "book_id string, page_number int, ord int, reference string")


def test_graph(spark):
    figures, captions, edges = D.graph(*frames(spark))
    got = {r.id: r for r in figures.collect()}
    assert set(got) == {"doc:b:page:1:figure:1", "doc:b:page:1:figure:2"}
    valve = got["doc:b:page:1:figure:1"]
    assert (valve.caption, valve.labels_inside, valve.image_path, valve.description, valve.context, valve.surrounding, valve.confidence, valve.source_type) == ("Valve Valve of the heart", ["x", "y"], "i.png", "d", "ctx", "around", 0.9, "vector_region")
    table = got["doc:b:page:1:figure:2"]
    assert (table.figure_type, table.caption_id, table.reference, table.extracted_text) == ("table", None, "3", "Table 3")
    assert {(r.text, r.attached_to, r.reference, r.confidence) for r in captions.collect()} == {("Valve Valve of the heart", "doc:b:page:1:figure:1", "2.1", 0.9), ("Figure 7.7", None, "7.7", 0.0), ("Figure 8", None, "8", 0.0)}
    assert {(r.source, r.target, r.relation, r.confidence) for r in edges.collect()} == {("doc:b:page:1:caption:1", "doc:b:page:1:figure:1", "caption_of", 0.9), ("doc:b:page:1", "doc:b:page:1:figure:1", "references", 0.85), ("doc:b:page:1", "doc:b:page:1:figure:2", "references", 0.85)}
    pages = spark.createDataFrame([("b", 1, None, None, "two words"), ("b", 3, "Scanned", "degraded", None)], "book_id string, page_number int, page_type string, status string, text string")
    out = {r.page_number: json.loads(r.json) for r in D.serialised(pages, figures).collect()}
    assert [(f["figure_id"], f["figure_label"]) for f in out[1]["figures"]] == [("2.1", "Figure 2.1"), ("2", "Table 3")] and out[1]["images"] == ["i.png"] and (out[1]["word_count"], out[1]["page_type"]) == (2, "Digital")
    assert out[3]["figures"] == [] and out[3]["text"] == "" and out[3]["status"] == "degraded"
    assert all(x.count() == 0 for x in D.graph(*(f.limit(0) for f in frames(spark))))


def test_geometry(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    block = lambda t, *v: F.struct(F.lit(t).alias("text"), box(*v).alias("box"))
    blocks = F.array(block(" label ", 10, 10, 20, 20), block("x", 10, 10, 20, 20), block("in caption", 10, 52, 20, 58), block("out", 90, 10, 120, 20), block("b" * 81, 0, 70, 90, 90), block("c" * 81, 0, 45, 90, 60))
    caption = box(5, 50, 60, 60)
    row = spark.range(1).select(
        D.compound(F.array(box(10, 0, 40, 30), box(20, 5, 50, 48)), caption, F.lit(4.0), F.lit(40.0)).alias("c"), D.compound(F.array().cast("array<array<double>>"), caption, F.lit(None).cast("double"), F.lit(None).cast("double")).alias("n"),
        D.labels_within(box(0, 0, 80, 60), caption, blocks).alias("l"), D.body_obstacles(blocks, F.array(caption)).alias("o"), D.standing_alone(F.array(box(0, 0, 10, 10), box(5, 5, 20, 20), box(30, 30, 40, 40)), F.array(box(35, 35, 36, 36))).alias("s"),
    ).first()
    assert (row.c, row.n, row.l) == ([5.0, 6.0, 60.0, 60.0], None, ["label"]) and row.o == [[0.0, 70.0, 90.0, 90.0]] and row.s == [[0.0, 0.0, 10.0, 10.0]]


def test_block_text(spark):
    lines = [[("n ", "Wingdings", 9.0), ("Fig. 2.1", "Bold", 9.0)], [("A valve", "Ital", 8.0)], [("of the heart", "Ital", 8.4), (" x", "Other", 3.0)], [("  ", "Ital", 8.0)], [("Body text", "Roman", 10.0)], [("more", "Ital", 8.0)]]
    df = spark.createDataFrame([(lines,), ([],)], "l array<array<struct<text:string,font:string,size:double>>>")
    got = [(r.a, r.b) for r in df.select(D.block_text(F.col("l")).alias("a"), D.block_text(F.col("l"), True).alias("b")).collect()]
    assert got == [("Fig. 2.1\nA valve\nof the heart x\nBody text\nmore", "Fig. 2.1\nA valve\nof the heart x"), ("", "")]


def test_caption_precision(spark):
    said = spark.createDataFrame([("b", 1, "Figure 1", "The valve opens"), ("b", 1, "Figure 1", "Other"), ("b", 2, "Figure 2", ""), ("b", 3, "Figure 3", "Sun")], "book string, page int, label string, caption string")
    wanted = spark.createDataFrame([("b", 1, "Figure 1", "The valve"), ("b", 1, "Figure 1", "The"), ("b", 3, "Figure 3", "Moon")], "book string, page int, label string, prefix string")
    assert tuple(D.caption_precision(said, wanted).first()) == (3, 1, 0.333333)
