import json

from leafmill.sources import files, sinks


def test_uploads_are_kept_by_content(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for name, data in {"a.pdf": b"%PDF-one", "b.pdf": b"%PDF-one", "c.pdf": b"%PDF-two", "d.pdf": b"plain", "e.pdf": b"%PDF-" + b"x" * 100}.items():
        (source / name).write_bytes(data)
    first = {r.path.rsplit("/", 1)[1]: (r.verdict, r.known) for r in sinks.store_uploads(spark, str(source), store, 50).collect()}
    assert first == {"a.pdf": ("ok", False), "b.pdf": ("ok", False), "c.pdf": ("ok", False), "d.pdf": ("not_pdf", False), "e.pdf": ("too_large", False)}
    again = {r.path.rsplit("/", 1)[1]: r.known for r in sinks.store_uploads(spark, str(source), store, 50).collect()}
    assert again == {"a.pdf": True, "b.pdf": True, "c.pdf": True, "d.pdf": False, "e.pdf": False}
    assert sorted(bytes(r.content) for r in spark.read.parquet(store).collect()) == [b"%PDF-one", b"%PDF-two"]


def test_embeddings_by_fingerprint(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = [("b", "f1", "c1", [1.0]), ("b", "f1", "c2", [2.0]), ("d", "f2", "c3", [3.0])]
    vectors = spark.createDataFrame(rows, "book_id string, fingerprint string, chunk_id string, embedding array<float>")
    wanted = spark.createDataFrame([("b", "f1", 2), ("d", "f2", 9), ("e", "f3", 1)], "book_id string, fingerprint string, chunks long")
    assert sinks.kept_embeddings(spark, path, wanted).count() == 0
    sinks.keep_embeddings(vectors, path)
    sinks.keep_embeddings(vectors, path)
    assert sorted((r.book_id, r.chunk_id) for r in sinks.kept_embeddings(spark, path, wanted).collect()) == [("b", "c1"), ("b", "c2")]


def test_other_forms(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    (tmp_path / "img").mkdir()
    for name in ("p1", "p2"):
        (tmp_path / "ann" / f"{name}.json").write_text(json.dumps({"categories": ["Picture"], "bboxes_block": [[1, 2, 3, 4]]}))
    for name in ("p2", "p3"):
        (tmp_path / "img" / f"{name}.png").write_bytes(b"x")
    assert [(r.stem, r.categories) for r in files.paired_layouts(spark, str(tmp_path / "ann"), str(tmp_path / "img")).collect()] == [("p2", ["Picture"])]
    figure = {"book": "b", "page": 3, "label": "Figure 1", "caption_prefix": "The", "pages_subset": [1, 2]}
    for i, data in enumerate(([figure], {"figures": [figure]})):
        (tmp_path / f"caps{i}.json").write_text(json.dumps(data))
        assert [tuple(r) for r in files.labelled_captions(spark, str(tmp_path / f"caps{i}.json")).collect()] == [("b", 3, "Figure 1", "The", [1, 2])]
    (tmp_path / "state.json").write_text(json.dumps({"phases": [{"name": "one", "tasks": [{"name": "t", "done": True}, {"name": "u", "done": False}]}, {"name": "two", "tasks": []}]}))
    assert [(r.phase, r.done, r.total, r.bar[30:]) for r in files.phases(spark, str(tmp_path / "state.json")).collect()] == [("one", 1, 2, " 1/2 (50%)"), ("two", 0, 0, " 0/0 (0%)")]
    spark.createDataFrame([([6], [[1.0, 2.0, 3.0, 4.0]])], "category_id array<int>, bboxes array<array<double>>").write.parquet(str(tmp_path / "raw" / "validation"))
    spark.createDataFrame([([6], [[1.0, 2.0, 3.0, 4.0]])], "category_id array<int>, bboxes array<array<double>>").write.parquet(str(tmp_path / "raw" / "train"))
    assert sorted(r.split for r in files.layouts(spark, str(tmp_path / "raw" / "*")).collect()) == ["train", "val"]


def test_extraction_in_order_with_retries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-5")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-x")

    def extract(content):
        for n in range(1, int(content[5:]) + 1):
            yield n, f"page {n} " + "word " * 9, [{"text": "t", "x1": 0.0, "y1": 1.0, "x2": 2.0, "y2": 3.0, "font": "F", "size": 9.0}]

    rows = files.extracted_pages(spark, str(tmp_path / "in"), extract, at_once=2).collect()
    assert [r.page_number for r in rows if r.path.endswith("a.pdf")] == [1, 2, 3, 4, 5] and rows[0].blocks is not None
    assert [(r.status, r.page_type) for r in rows if r.path.endswith("b.pdf")] == [("failed", "unknown")]

    seen = []

    def flaky(content):
        yield 1, "one"
        seen.append(1)
        if len(seen) % 2:
            raise ValueError("broken")
        yield 2, "two"

    rows = files.extracted_pages(spark, str(tmp_path / "in" / "a.pdf"), flaky).collect()
    assert [(r.page_number, r.status) for r in rows] == [(1, "ok"), (2, "ok")]
    rows = files.extracted_pages(spark, str(tmp_path / "in" / "a.pdf"), flaky, retries=0).collect()
    assert [(r.page_number, r.status) for r in rows] == [(1, "ok"), (None, "failed")]


def test_engines(spark):
    images = spark.createDataFrame([("p1", b"good"), ("p2", b"bad"), ("p3", b"none")], "page string, content binary")

    def first(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return [("a", [1, 2, 3, 4], 0.9), ("b", [5, 6, 7, 8], 0.5)] if content == b"good" else []

    got = [(r.page, r.ord, r.text, r.engine, r.error) for r in files.read_images(images, first, lambda c: [("c", [0, 0, 1, 1], 0.1)] if c == b"bad" else []).collect()]
    assert got == [("p1", 0, "a", "first", None), ("p1", 1, "b", "first", None), ("p2", 0, "c", "fallback", None)]
    assert [r.error for r in files.read_images(images).collect()] == ["no engine is configured"] * 3
