"""Readers of JSON lines, extracted books, uploads and pages of binary documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "id string, dataset string, split string, source_id string, doc_category string, image_filename string, image_path string, width int, height int, annotations array<struct<category:string,bbox:array<double>>>"
GOLDEN = "id string, book string, question string, answerable boolean, expected_pages array<int>"
_FIGURE = "struct<figure_id:string,figure_label:string,caption:string,source_type:string,bounding_box:array<double>,confidence:double,labels_inside:array<string>,associated_keywords:array<string>,surrounding_context:string,context:string>"
_PAGE = f"struct<page_number:int,page_type:string,raw_text:string,text:string,status:string,figures:array<{_FIGURE}>,captions:array<struct<text:string,explicit_reference:string>>>"
BOOK = f"filename string, total_pages int, digital_pages int, scanned_pages int, pipeline_version string, cache_key string, pages array<{_PAGE}>, normalized_document struct<filename:string,pages:array<{_PAGE}>>"
PAGE = "path string, sha256 string, page_number int, page_type string, text string, status string, error string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Layout records, one JSON object a line; blank lines are skipped, a broken one fails."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions with the pages that answer them."""
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)


def books(spark: SparkSession, path: str, cache_key: str | None = None) -> DataFrame:
    """Extracted books, one JSON file each, with their path; those of another cache key are left out where one is given."""
    rows = spark.read.schema(BOOK).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return rows if cache_key is None else rows.where(F.col("cache_key") == cache_key)


def pages(extracted: DataFrame) -> DataFrame:
    """``path, page_number, page_type, text, status, figures``: normalised pages where a book has them, else the older form; a page's
    text is its raw text, its text or its captions, whichever isn't empty first."""
    own = F.when(F.size("normalized_document.pages") > 0, F.col("normalized_document.pages")).otherwise(F.col("pages"))
    page = extracted.select("path", F.explode(own).alias("p")).select("path", "p.*")
    said = F.array_join(F.transform("captions", lambda c: c["text"]), "\n")
    text = F.coalesce(F.nullif("raw_text", F.lit("")), F.nullif("text", F.lit("")), said)
    return page.select("path", "page_number", "page_type", text.alias("text"), F.coalesce("status", F.lit("ok")).alias("status"), "figures")


def uploads(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """``path, sha256, size_bytes, verdict`` of binary files: ok, or why a file isn't taken; contents are not carried on.

    Spark's scan passes over files of no bytes, so an empty upload has no row and is not taken.
    """
    raw = spark.read.format("binaryFile").load(path)
    verdict = F.when(F.col("length") > most_bytes, "too_large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not_pdf").otherwise("ok")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), verdict.alias("verdict"))


def extracted_pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterator[tuple]] | None = None, retries: int = 1, most_bytes: int = 50 << 20, at_once: int = 64) -> DataFrame:
    """Pages of binary documents by a pluggable ``extract`` (bytes to page numbers and texts, and, as a third part, blocks of text, x1, y1, x2, y2, font
    and size), which runs on the executors.

    Pages come in the order of their numbers within a document, ``at_once`` to a batch. A document that can't be read is tried ``retries`` times
    more; then, from the page on that failed, it gives one row with status failed and the reason. Without an extractor every one does. Larger documents
    are not read.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), _BLOCKS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "sha256", "page_number", "page_type", "text", "status", "error", "blocks"])

    def pages(name: str, digest: str, content: bytes) -> Iterator[tuple]:
        done = 0
        for attempt in range(retries + 1):
            try:
                if extract is None:
                    raise RuntimeError("no extractor is configured")
                for i, (n, text, *blocks) in enumerate(extract(content)):
                    if i >= done:
                        yield name, digest, n, None, text, "ok", None, blocks[0] if blocks else None
                        done = i + 1
                return
            except Exception as e:
                if attempt == retries:
                    yield name, digest, None, None, None, "failed", str(e), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held: list[tuple] = []
                for page in pages(*row):
                    held.append(page)
                    if len(held) == at_once:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    raw = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    read = raw.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(run, f"{PAGE}, blocks array<struct<text:string,x1:double,y1:double,x2:double,y2:double,font:string,size:double>>")
    kind = F.when(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) >= 40, "digital").otherwise("scanned")
    return read.withColumn("page_type", F.when(F.col("status") == "ok", kind).otherwise("unknown"))


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x1", "y1", "x2", "y2")), ("font", pa.string()), ("size", pa.float64())]))


def read_images(images: DataFrame, engine: Callable[[bytes], list[tuple[str, list[float], float]]] | None = None, fallback: Callable[[bytes], list[tuple[str, list[float], float]]] | None = None) -> DataFrame:
    """``page, ord, text, box, confidence, engine, error`` of images (page, content): what an engine finds, each text or label with its box; the other
    engine where the first fails or finds nothing. An image that none can read gives one row with the reason. Also for detectors, whose texts are labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, error, used = [], "no engine is configured", None
                for name, call in (("first", engine), ("fallback", fallback)):
                    if call is None or rows:
                        continue
                    try:
                        rows, error, used = call(content), None, name
                    except Exception as e:
                        error = str(e)
                out = [(page, i, t, [float(v) for v in b], float(c), used, None) for i, (t, b, c) in enumerate(rows)] or ([(page, None, None, None, None, None, error)] if error else [])
                if out:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page", "ord", "text", "box", "confidence", "engine", "error"])

    return images.select("page", "content").mapInArrow(run, "page string, ord int, text string, box array<double>, confidence double, engine string, error string")


_OBJECT = "struct<label:string,category:string,category_id:int,bbox:array<double>>"
LAYOUT = f"category_id array<int>, bboxes array<array<double>>, categories array<string>, bboxes_block array<array<double>>, objects array<{_OBJECT}>, annotations array<{_OBJECT}>, image_width int, image_height int, doc_category string, original_filename string, page_no int"


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """Raw layout records as Parquet, of all splits under ``path``, with their split by the name of their folder or file; columns that a form
    doesn't have are null."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    name = F.regexp_extract(F.lower(F.col("_metadata.file_path")), r"([^/]*/[^/]*)$", 1)
    split = F.when(name.rlike(r"(?:^|[/_-])val(?:idation)?(?=[/_.-])"), "val").when(name.rlike(r"(?:^|[/_-])test(?=[/_.-])"), "test").otherwise("train")
    return rows.withColumn("split", split)


def paired_layouts(spark: SparkSession, annotations: str, images: str) -> DataFrame:
    """Annotation files (JSON, one a page) with the image of the same stem; one without the other is left out. Images are named, not read."""
    stem = lambda path: F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = spark.read.schema(LAYOUT).option("multiLine", True).json(annotations).withColumn("stem", stem(F.col("_metadata.file_path")))
    pictures = spark.read.format("binaryFile").load(images).select(F.col("path").alias("image_path"), stem(F.col("path")).alias("stem"))
    return rows.join(pictures, "stem")


def labelled_captions(spark: SparkSession, path: str) -> DataFrame:
    """``book, page, label, prefix, pages``: figures whose captions are known, one row each."""
    one = "array<struct<book:string,page:int,label:string,caption_prefix:string,pages_subset:array<int>>>"
    raw = spark.read.option("wholetext", True).text(path)
    each = raw.select(F.explode(F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", one)).otherwise(F.from_json("value", f"struct<figures:{one}>")["figures"])).alias("f"))
    return each.select("f.book", "f.page", "f.label", F.col("f.caption_prefix").alias("prefix"), F.col("f.pages_subset").alias("pages"))


def phases(spark: SparkSession, path: str) -> DataFrame:
    """``phase, done, total, bar`` of a state of nested phases and tasks, in their order."""
    from leafmill.functions.display import bar

    state = spark.read.schema("phases array<struct<name:string,tasks:array<struct<name:string,done:boolean>>>>").option("multiLine", True).json(path)
    each = state.select(F.posexplode("phases").alias("at", "p")).select("at", F.col("p.name").alias("phase"), F.size(F.filter("p.tasks", lambda t: t["done"])).alias("done"), F.size("p.tasks").alias("total"))
    return each.orderBy("at").select("phase", "done", "total", bar(F.col("done"), F.col("total")).alias("bar"))
