"""Queries that run as streams over what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.durable import work_path
from leafmill.streaming import ingest

SQL: dict[str, str] = {}


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ingested pages by day, worked off as a stream."""
    work = work_path(spark, "stream")
    ingest.run_available(ingest.daily_counts(ingest.page_stream(spark, f"{d}/book_pages.parquet")), f"{work}/out", f"{work}/checkpoint", "complete")
    return spark.read.parquet(f"{work}/out")


SQL["stream_daily_counts"] = "SELECT ingested_at::DATE::VARCHAR AS day, count(*) AS pages, count(*) FILTER (len(errors) > 0) AS with_errors FROM book_pages WHERE ingested_at IS NOT NULL GROUP BY 1"


def stream_pages_once(spark: SparkSession, d: str) -> DataFrame:
    """Pages delivered again are taken once."""
    work = work_path(spark, "stream")
    ingest.run_available(ingest.latest_pages(ingest.page_stream(spark, f"{d}/book_pages.parquet")).select("page_id", "book_id"), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out").groupBy("book_id").count().withColumnRenamed("count", "pages")


SQL["stream_pages_once"] = "SELECT book_id, count(DISTINCT page_id) AS pages FROM book_pages WHERE page_id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1"

QUERIES = [stream_daily_counts, stream_pages_once]
