"""Pages into section-aware chunks.

Segments (what stands between page starts and headings) are independent, so packing is parallel over them. A section holds for
two pages after its heading, so a page needs the last headings of two pages before it and no window over the whole book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.durable import cut
from leafmill.functions import text as T

TARGET_WORDS, MAX_WORDS, SECTION_PAGES = 110, 180, 2


def page_texts(pages: DataFrame) -> DataFrame:
    """``book_id, page_number, text``, once for each text of a page; raw text counts before text. Texts are told apart by their hashes, so
    only one of equal ones is shuffled, and no key is a text."""
    text = F.coalesce(F.nullif("raw_text", F.lit("")), F.col("text"))
    rows = pages.select("book_id", "page_number", text.alias("text")).where("book_id is not null and page_number is not null")
    return rows.groupBy("book_id", "page_number", F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text")).drop("h")


def _lines(texts: DataFrame) -> DataFrame:
    each = texts.select("book_id", "page_number", F.posexplode(T.lines(F.col("text"))).alias("line_no", "raw"))
    return each.withColumn("raw", F.trim("raw")).where("raw <> ''")


def page_lines(pages: DataFrame) -> DataFrame:
    """``book_id, page_number, line_no, raw``: the stripped lines that aren't blank."""
    return _lines(page_texts(pages))


def boilerplate(pages: DataFrame, share: float = 0.3, least: int = 3, min_pages: int = 4, longest: int = 60) -> DataFrame:
    """``book_id, line, pages``: lines (lower case) that stand on many pages of their book."""
    return _boilerplate(cut(page_texts(pages), "page_texts")[0], share, least, min_pages, longest)


def _boilerplate(texts: DataFrame, share: float, least: int = 3, min_pages: int = 4, longest: int = 60) -> DataFrame:
    sizes = texts.groupBy("book_id").agg(F.count_distinct("page_number").alias("n"))
    seen = _lines(texts).where(F.length("raw") <= longest).select("book_id", "page_number", F.lower("raw").alias("line")).distinct()
    counts = seen.groupBy("book_id", "line").agg(F.count("*").alias("pages"))
    return counts.join(sizes, "book_id").where((F.col("n") >= min_pages) & (F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("n") * share)))).select("book_id", "line", "pages")


def kept_lines(pages: DataFrame, share: float = 0.3) -> DataFrame:
    """``book_id, page_number, line_no, line, heading``: cleaned lines without boilerplate, spaced letters and a heading said again
    on its page."""
    texts, _ = cut(page_texts(pages), "page_texts")
    clean = _lines(texts).withColumn("line", T.clean_line(F.col("raw"))).where("line <> ''").where(~T.is_spaced_letters(F.col("line")))
    gone = _boilerplate(texts, share).select("book_id", F.col("line").alias("low"))
    rest = clean.withColumn("low", F.lower("line")).join(gone, ["book_id", "low"], "left_anti")
    marked = rest.select("book_id", "page_number", "line_no", "line", T.is_heading(F.col("line")).alias("heading"))
    order = Window.partitionBy("book_id", "page_number").orderBy("line_no")
    before = F.last(F.when(F.col("heading"), F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("before", before).where(~F.col("heading") | F.col("before").isNull() | (F.col("before") != F.col("line"))).drop("before")


def sections(lines: DataFrame, pages_back: int = SECTION_PAGES) -> DataFrame:
    """The lines with ``segment`` and ``section``: the last heading, of this page or of one at most ``pages_back`` before."""
    order = Window.partitionBy("book_id", "page_number").orderBy("line_no")
    heading = F.when(F.col("heading"), F.col("line"))
    own = lines.withColumn("segment", F.count(heading).over(order)).withColumn("own", F.last(heading, ignorenulls=True).over(order))
    last = lines.where("heading").groupBy("book_id", "page_number").agg(F.max_by("line", "line_no").alias("h"))
    ahead = last.select("book_id", F.col("page_number").alias("from"), "h", F.explode(F.sequence(F.col("page_number") + 1, F.col("page_number") + pages_back)).alias("page_number"))
    carried = ahead.groupBy("book_id", "page_number").agg(F.max_by("h", "from").alias("carried"))
    return own.join(carried, ["book_id", "page_number"], "left").withColumn("section", F.coalesce("own", "carried")).drop("own", "carried")


def pack(lines: Column) -> Column:
    """Lines of a segment as texts of about 110 words: closed at a sentence end from 110 words on, and at 180 in any case."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def add(s: Column, line: Column) -> Column:
        text = F.when(s["text"] == "", line).otherwise(F.concat_ws(" ", s["text"], line))
        n = s["n"] + T.word_count(line)
        full = ((n >= TARGET_WORDS) & line.rlike(r"[.!?]$")) | (n >= MAX_WORDS)
        return F.when(full, F.struct(F.array_append(s["done"], text).alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))).otherwise(F.struct(s["done"].alias("done"), text.alias("text"), n.alias("n")))

    return F.aggregate(lines, start, add, lambda s: F.when(s["text"] == "", s["done"]).otherwise(F.array_append(s["done"], s["text"])))


def chunk_pages(pages: DataFrame, share: float = 0.3) -> DataFrame:
    """``chunk_id, book_id, page_number, section, kind, text, figure_refs``; chunks under three words are dropped and not counted."""
    kept, _ = cut(kept_lines(pages, share), "lines")  # read for headings and for bodies
    lines = sections(kept)
    body = lines.where("not heading").groupBy("book_id", "page_number", "segment").agg(F.first("section").alias("section"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    packed = body.select("book_id", "page_number", "segment", "section", F.posexplode(pack(F.transform("l", lambda x: x["line"]))).alias("pos", "text")).where(T.word_count(F.col("text")) >= 3)
    within = F.row_number().over(Window.partitionBy("book_id", "page_number").orderBy("segment", "pos"))
    numbered = packed.withColumn("k", within)
    per_page = numbered.groupBy("book_id", "page_number").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("book_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = numbered.join(per_page.withColumn("before", before), ["book_id", "page_number"])
    name = F.format_string("%s:p%d:c%d", F.substring(F.regexp_replace("book_id", "[^A-Za-z0-9_-]", "_"), 1, 40), F.col("page_number"), F.col("before") + F.col("k") - 1)
    kind = F.when(T.is_exercise(T.sentences(F.col("text"))), "exercise").otherwise("body")
    return out.select(name.alias("chunk_id"), "book_id", "page_number", "section", kind.alias("kind"), "text", T.figure_refs(F.col("text")).alias("figure_refs"))


def adjacent_distinct(text: Column) -> Column:
    """Lines without blanks and without a line that the one before says already, joined by blanks."""
    stripped = F.filter(F.transform(T.lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.filter(stripped, lambda x, i: (i == 0) | (F.get(stripped, i - 1) != x)), " ")


def paragraphs(text: Column) -> Column:
    """Display text: lines as paragraphs, headings on their own; lone ``n`` and a line said twice in a row are left out."""
    kept = F.filter(F.transform(T.lines(text), lambda x: F.trim(x)), lambda x: (x != "") & (x != "n"))
    fresh = F.filter(kept, lambda x, i: (i == 0) | (F.get(kept, i - 1) != x))
    head = lambda x: (F.length(x) < 70) & (x.rlike(T.NUMBERED_HEADING) | x.rlike(r"^[A-Z][A-Z\s]{4,}$"))
    return F.aggregate(fresh, F.struct(F.lit("").alias("t"), F.lit(True).alias("h")), lambda s, x: F.struct(F.when(s["t"] == "", x).otherwise(F.concat(s["t"], F.when(s["h"] | head(x), "\n\n").otherwise(" "), x)).alias("t"), head(x).alias("h")), lambda s: s["t"])


def display_text(text: Column) -> Column:
    """Extracted text for readers: lines as paragraphs and headings between blank lines; lone ``n`` and a line that repeats the last
    heading, paragraph or line are left out. Empty for null."""
    kept = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "n"))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("").alias("out"), none.alias("block"), F.lit("").alias("open"), none.alias("line"))
    add = lambda out, block: F.when(block == "", out).when(out == "", block).otherwise(F.concat(out, F.lit("\n\n"), block))

    def step(s: Column, x: Column) -> Column:
        head = (F.length(x) < 70) & F.exists(F.array(*[F.lit(p) for p in T.DISPLAY_HEADINGS]), lambda p: F.regexp_like(x, p))
        again = F.coalesce(x == s["block"], F.lit(False)) | F.coalesce(x == s["line"], F.lit(False))
        heading = F.struct(add(add(s["out"], s["open"]), x).alias("out"), x.alias("block"), F.lit("").alias("open"), none.alias("line"))
        body = F.struct(s["out"].alias("out"), s["block"].alias("block"), F.when(s["open"] == "", x).otherwise(F.concat_ws(" ", s["open"], x)).alias("open"), x.alias("line"))
        return F.when(again, s).when(head, heading).otherwise(body)

    return F.aggregate(kept, start, step, lambda s: add(s["out"], s["open"]))
