import json

from pyspark.sql import functions as F

from leafmill.sources import files, sinks
from leafmill.streaming import ingest


def test_json_sources(spark, tmp_path):
    book = {"filename": "x.pdf", "cache_key": "k", "pages": [{"page_number": 1, "text": "old"}], "normalized_document": {"filename": "x.pdf", "pages": [{"page_number": 1, "raw_text": "", "text": "new", "figures": [{"figure_id": "1.1"}]}, {"page_number": 2, "captions": [{"text": "Figure 1"}]}]}}
    (tmp_path / "a.json").write_text(json.dumps(book, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"filename": "y.pdf", "cache_key": "other", "pages": [{"page_number": 3, "text": "legacy"}]}))
    got = {(r.page_number, r.text, r.status) for r in files.pages(files.books(spark, str(tmp_path))).collect()}
    assert got == {(1, "new", "ok"), (2, "Figure 1", "ok"), (3, "legacy", "ok")}
    assert files.books(spark, str(tmp_path), "k").count() == 1


def test_binary_sources(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.4 hello"), ("b.pdf", b"plain"), ("c.pdf", b"")):
        (tmp_path / name).write_bytes(content)
    assert {r.path.rsplit("/", 1)[1]: r.verdict for r in files.uploads(spark, str(tmp_path)).collect()} == {"a.pdf": "ok", "b.pdf": "not_pdf"}

    def extract(content):
        if not content.startswith(b"%PDF-"):
            raise ValueError("no document")
        yield 1, "x" * 50
        yield 2, "short"

    got = sorted((r.path.rsplit("/", 1)[1], r.page_type, r.status) for r in files.extracted_pages(spark, str(tmp_path), extract).collect())
    assert got == [("a.pdf", "digital", "ok"), ("a.pdf", "scanned", "ok"), ("b.pdf", "unknown", "failed")]
    assert {r.status for r in files.extracted_pages(spark, str(tmp_path)).collect()} == {"failed"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        sinks.append_new(rows, path, "k")
    sinks.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    target = str(tmp_path / "m.json")
    for n in (1, 2, 3):
        sinks.replace_json(rows.limit(n), target)
    assert spark.read.json(target).count() == 2 and spark.read.json(target + ".bak").count() == 1
    sinks.history_csv([spark.createDataFrame([(1, 0.5)], "step int, loss double"), spark.createDataFrame([(2, 0.1)], "epoch int, loss double")], str(tmp_path / "h"))
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).columns == ["epoch", "loss", "step"]
    table = sinks.metric_table(spark.createDataFrame([(0.9, 0.2)], "recall double, echo double"), {"recall": 0.9, "echo": 0.0}, {"echo"})
    assert {r.metric: r.passed for r in table.collect()} == {"recall": True, "echo": False}
    assert sinks.unreferenced_files(spark, target, rows.select(F.lit("x").alias("image_filename"))).count() > 0


def test_stream_takes_pages_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame([("p1", "b", "2031-01-01 00:00:00"), ("p2", "b", "2031-01-02 00:00:00"), ("p1", "b", "2031-01-03 00:00:00")], "page_id string, book_id string, t string")
    rows = rows.select("page_id", "book_id", F.col("t").cast("timestamp_ntz").alias("ingested_at"), F.array().cast("array<string>").alias("errors"))
    for part in (rows, rows.limit(2)):
        part.write.mode("append").parquet(source)
        ingest.run_available(ingest.latest_pages(ingest.page_stream(spark, source)), out, state)
    assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == ["p1", "p2"]
