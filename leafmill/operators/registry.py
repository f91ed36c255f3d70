"""The registry of books and jobs: owners, uploads, states, views. Tables, not sessions: each function maps tables to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import display as D

PENDING, FINAL = ("queued", "running"), ("succeeded", "failed")
#: Which state may follow which; a job that was pending when its worker went is queued again.
FOLLOWS = {"queued": ("running", "queued", "failed"), "running": ("running", "succeeded", "failed", "queued"), "succeeded": (), "failed": ("queued",)}


def owned(rows: DataFrame, owner: str) -> DataFrame:
    """The rows of an owner, newest first; what others own can't be told from what isn't there."""
    return rows.where(F.col("owner_id") == owner).orderBy(F.desc("created_at"), "id")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each book (book_id, id, created_at and others); ties by id."""
    order = Window.partitionBy("book_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*PENDING))


def is_final(status: Column) -> Column:
    return status.isin(*FINAL)


def resumed(jobs: DataFrame) -> DataFrame:
    """All jobs, those left pending queued again."""
    left = F.col("status").isin(*PENDING)
    message = F.when(left, "Re-queued after restart").otherwise(F.col("message")) if "message" in jobs.columns else F.when(left, "Re-queued after restart")
    return jobs.withColumn("message", message).withColumn("status", F.when(left, "queued").otherwise(F.col("status")))


def job_states(events: DataFrame) -> DataFrame:
    """``job_id, status, progress, message, ignored`` after all events (job_id, at, status, progress, message) in order of time.

    An event whose state can't follow the job's is ignored and counted; progress stays within 0 and 1 and never goes back within a run.
    """
    listed = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "status", "progress", "message"))).alias("l"))  # a job has few events
    start = F.struct(F.lit("queued").alias("status"), F.lit(0.0).alias("progress"), F.lit(None).cast("string").alias("message"), F.lit(0).alias("ignored"))
    allowed = F.create_map(*[x for k, v in FOLLOWS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])

    def step(s: Column, e: Column) -> Column:
        ok = F.array_contains(allowed[s["status"]], e["status"])
        given = F.least(F.greatest(F.coalesce(e["progress"], s["progress"]), F.lit(0.0)), F.lit(1.0))
        progress = F.when(e["status"] == "queued", 0.0).when(e["status"] == "succeeded", 1.0).otherwise(F.greatest(given, s["progress"]))
        return F.when(ok, F.struct(e["status"].alias("status"), progress.alias("progress"), e["message"].alias("message"), s["ignored"].alias("ignored"))).otherwise(F.struct(s["status"].alias("status"), s["progress"].alias("progress"), s["message"].alias("message"), (s["ignored"] + 1).alias("ignored")))

    return listed.select("job_id", F.aggregate("l", start, step).alias("s")).select("job_id", "s.*")


def upload_outcomes(uploads: DataFrame, books: DataFrame, jobs: DataFrame) -> DataFrame:
    """``owner_id, sha256, uploads, outcome, book_id, job_id``: what uploads of a file by an owner lead to.

    A book that is there and hasn't failed is returned with its newest job, a failed one or one without job is queued again, an unknown file makes
    a new book; however often it is uploaded at once, an owner's file is one row.
    """
    once = uploads.groupBy("owner_id", "sha256").agg(F.count("*").alias("uploads"))
    known = books.groupBy("owner_id", "sha256").agg(F.min_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("b")).select("owner_id", "sha256", F.col("b.id").alias("book_id"), "b.status")
    last = latest_jobs(jobs).select("book_id", F.col("id").alias("job_id"))
    rows = once.join(known, ["owner_id", "sha256"], "left").join(last, "book_id", "left")
    kept = F.col("book_id").isNotNull() & (F.col("status") != "failed") & F.col("job_id").isNotNull()
    outcome = F.when(F.col("book_id").isNull(), "created").when(kept, "returned").otherwise("queued_again")
    return rows.select("owner_id", "sha256", "uploads", outcome.alias("outcome"), "book_id", F.when(kept, F.col("job_id")).alias("job_id"))


def figure_index(pages: DataFrame) -> DataFrame:
    """``book_id, page_number, figure_key, figure_id, label, caption`` of pages with ``figures`` (an array of figure_id, figure_label and caption)."""
    each = pages.select("book_id", "page_number", F.posexplode("figures").alias("at", "f")).withColumn("figure_key", D.figure_key(F.col("page_number"), F.col("at") + 1))
    figure_id = F.coalesce(F.nullif("f.figure_id", F.lit("")), "figure_key")
    return each.withColumn("figure_id", figure_id).select("book_id", "page_number", "figure_key", "figure_id", D.figure_label(F.col("f.figure_label"), F.col("figure_id")).alias("label"), F.nullif(F.trim("f.caption"), F.lit("")).alias("caption"))


def keyed_figures(selected: DataFrame, index: DataFrame) -> DataFrame:
    """Selected figures (book_id, page_number, figure_id) with their keys; of several with one id on a page the last counts, others are dropped."""
    last = index.groupBy("book_id", "page_number", "figure_id").agg(F.max_by("figure_key", F.element_at(F.split("figure_key", "-"), -1).cast("int")).alias("figure_key"))
    return selected.join(last, ["book_id", "page_number", "figure_id"])


def detail(books: DataFrame, pages: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """One row for each page of a book as the reader's view has it: ``book_id, filename, status, page_number, page_type, page_status, text, words, errors,
    figures``. The view is the ordered rows of a book; it is never one row, as a book may be large."""
    text = F.coalesce(F.nullif("text", F.lit("")), F.nullif("raw_text", F.lit("")), F.lit(""))
    once = pages.groupBy("book_id", "page_number").agg(F.max_by(F.struct(text.alias("text"), F.coalesce("page_type", F.lit("Digital")).alias("page_type"), F.coalesce("status", F.lit("ok")).alias("page_status"), F.coalesce(F.size("errors"), F.lit(0)).alias("errors")), F.struct("ingested_at", text)).alias("p")).select("book_id", "page_number", "p.*")
    rows = books.select(F.col("id").alias("book_id"), "filename", "status").join(once, "book_id")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = rows.withColumn("words", words).withColumn("errors", F.greatest("errors", F.lit(0)))
    if figures is None:
        return rows.withColumn("figures", F.array().cast("array<string>"))
    held = figures.groupBy("book_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at(F.split("figure_key", "-"), -1).cast("int").alias("n"), "figure_key"))), lambda x: x["figure_key"]).alias("figures"))
    return rows.join(held, ["book_id", "page_number"], "left").withColumn("figures", F.coalesce("figures", F.array().cast("array<string>")))
