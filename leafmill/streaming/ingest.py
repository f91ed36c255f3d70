"""Incremental ingestion of pages as they are delivered, as a Structured Streaming query over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """New page files of a folder (or one file), with the schema of what is there; ``ingested_at`` is read as UTC."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    rows = reader.parquet(path)
    return rows.withColumn("ingested_at", F.expr("cast(convert_timezone('UTC', current_timezone(), cast(ingested_at as timestamp_ntz)) as timestamp)"))


def latest_pages(pages: DataFrame, delay: str = "60 days") -> DataFrame:
    """Each page once within the time that late deliveries take; state older than ``delay`` is dropped."""
    return pages.where("page_id is not null and ingested_at is not null").withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["page_id"])


def daily_counts(pages: DataFrame, delay: str = "60 days") -> DataFrame:
    """Pages and pages with errors by day of ingestion; days are final once ``delay`` is over."""
    day = F.window("ingested_at", "1 day")
    counts = pages.withWatermark("ingested_at", delay).groupBy(day.alias("day")).agg(F.count("*").alias("pages"), F.count_if(F.size("errors") > 0).alias("with_errors"))
    return counts.select(F.expr("date_format(convert_timezone(current_timezone(), 'UTC', cast(day.start as timestamp_ntz)), 'yyyy-MM-dd')").alias("day"), "pages", "with_errors")


def run_available(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what has arrived and stop. In complete mode each batch replaces the table."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", out).start()
    else:
        query = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
