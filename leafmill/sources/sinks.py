"""Writers that can be run again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from leafmill.durable import cut


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the Parquet table at ``path`` doesn't have; running it again changes nothing."""
    fresh = rows.dropDuplicates([key])
    try:
        known = rows.sparkSession.read.parquet(path).select(key)
    except AnalysisException:
        known = None
    (fresh if known is None else fresh.join(known, key, "left_anti")).write.mode("append").parquet(path)


def replace_json(rows: DataFrame, path: str, backup: bool = True) -> None:
    """Write JSON lines beside ``path`` and then put them in its place; the first version is kept as ``path.bak``.

    The version before stands at ``path.before`` until the new one is in place, so :func:`current` always finds a whole one.
    """
    spark = rows.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    rows.write.json(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, new, old, before = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged, f"{path}.bak", f"{path}.before"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        if backup and not fs.exists(old):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, fs, old, False, conf)
        fs.delete(before, True)
        fs.rename(target, before)
    fs.rename(new, target)
    fs.delete(before, True)


def current(spark: SparkSession, path: str) -> str:
    """Where the version of a table of :func:`replace_json` stands that is in force, also after a crash between its two renames."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else f"{path}.before"


def history_csv(parts: list[DataFrame], path: str) -> None:
    """Step rows and epoch rows as one CSV whose columns are the sorted union of theirs."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    whole.select(*sorted(whole.columns)).write.mode("overwrite").option("header", True).csv(path)


def metric_table(metrics: DataFrame, targets: dict[str, float], at_most: set[str]) -> DataFrame:
    """``metric, value, target, passed`` of a one-row table; the metrics of ``at_most`` must not exceed their target."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(t)).alias("target"), F.lit(k in at_most).alias("low")) for k, t in targets.items()])).alias("r")
    rows = metrics.select(pairs).select("r.*")
    return rows.select("metric", "value", "target", F.when(F.col("low"), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target")).alias("passed"))


def unreferenced_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files of a folder that no record of the manifest names; nothing is deleted."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.substring_index("path", "/", -1).alias("image_filename"))
    return listed.join(manifest.select("image_filename").distinct(), "image_filename", "left_anti").select("path")


def store_uploads(spark: SparkSession, source: str, store: str, most_bytes: int = 50 << 20) -> DataFrame:
    """Keep new uploads by content: a table of ``sha256, content, size_bytes`` that has each file once. Returns the verdicts (path, sha256, size_bytes,
    verdict, known); contents larger than the limit are not read."""
    from leafmill.sources.files import uploads

    verdicts = uploads(spark, source, most_bytes)
    try:
        known = spark.read.parquet(store).select("sha256", F.lit(True).alias("known"))
    except AnalysisException:
        known = spark.createDataFrame([], "sha256 string, known boolean")
    out = verdicts.join(known, "sha256", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    out, _ = cut(out, "uploads")
    fresh = out.where("verdict = 'ok' and not known").groupBy("sha256").agg(F.min("path").alias("path"), F.first("size_bytes").alias("size_bytes"))
    content = spark.read.format("binaryFile").load(source).where(F.col("length") <= most_bytes).select("path", "content")
    content.join(F.broadcast(fresh) if fresh.limit(10_001).count() <= 10_000 else fresh, "path").select("sha256", "content", "size_bytes").write.mode("append").parquet(store)
    return out


def keep_embeddings(vectors: DataFrame, path: str) -> None:
    """Vectors (book_id, fingerprint, chunk_id, embedding) as a table by fingerprint; those of a fingerprint that is there are not written again."""
    try:
        known = vectors.sparkSession.read.parquet(path).select("fingerprint").distinct()
    except AnalysisException:
        known = None
    fresh = vectors if known is None else vectors.join(known, "fingerprint", "left_anti")
    fresh.write.mode("append").partitionBy("fingerprint").parquet(path)


def kept_embeddings(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The kept vectors of the books in ``wanted`` (book_id, fingerprint, chunks) whose number is right; a book with another number has none."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException:
        held = spark.createDataFrame([], "book_id string, chunk_id string, embedding array<float>, fingerprint string")
    rows = held.join(wanted.select("book_id", "fingerprint", "chunks"), ["book_id", "fingerprint"])
    counts = rows.groupBy("book_id", "fingerprint", "chunks").agg(F.count("*").alias("n")).where("n = chunks").select("book_id", "fingerprint")
    return rows.drop("chunks").join(counts, ["book_id", "fingerprint"], "left_semi")
