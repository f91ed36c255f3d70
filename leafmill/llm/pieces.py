"""Problem 5: cutting oversized texts into pieces at natural boundaries.

A recursive hierarchy of separators (section, paragraph, sentence, word, character) takes a text apart into atoms, each
level only where the level above left something that is too long; the atoms are then packed greedily into pieces up to the
limit, each piece opening with the last ``overlap`` characters of the one before. Python only computes offsets, of the
oversized rows alone; the pieces themselves are cut by ``substring`` in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the levels, coarse to fine. A match's end is a place to cut.
LEVELS = ("section", "paragraph", "sentence", "word", "character")
_ENDS = (
    re.compile(r"\n(?:[ \t]*\n){2,}|\f|\n(?=(?:#{1,6} |\d+(?:\.\d+)+ [A-Z]|[A-Z][A-Z0-9 ,:&'()–-]{5,80}\n))"),
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"(?:(?<=[.!?।…])|(?<=[.!?।…][\"'”’)\]]))\s+(?=[^a-z\s])|\n+"),
    re.compile(r"\s+"),
)
#: Points after which a sentence goes on (fixed values).
_ABBREVIATIONS = re.compile(r"(?:\b(?:Dr|Mr|Mrs|Ms|St|Prof|Fig|No|no|vs|cf|approx|etc|al|e\.g|i\.e|a\.m|p\.m|pp|Vol|Ch|Sec|Eq)|\b[A-Z])\.\s+$")


def _cuts(text: str, start: int, end: int, level: int) -> list[int]:
    """Ends of the parts of ``text[start:end]`` by the separators of ``level``; the last one is ``end``."""
    found = [m.end() for m in _ENDS[level].finditer(text, start, end)]
    if level == 2:
        found = [p for p in found if text[p - 1] == "\n" or not _ABBREVIATIONS.search(text, max(start, p - 14), p)]
    return [p for p in found if start < p < end] + [end]


def _atoms(text: str, start: int, end: int, room: int, level: int, out: list[tuple[int, int]]) -> None:
    """Append (end, level) of parts of at most ``room`` characters, or of any length where nothing separates them."""
    if end - start <= room:
        out.append((end, level))
        return
    if level == len(_ENDS):
        out.append((end, level))  # may be cut anywhere
        return
    for cut in _cuts(text, start, end, level):
        if cut - start <= room:
            out.append((cut, level))
        else:
            _atoms(text, start, cut, room, level + 1, out)
            if out[-1][1] < len(_ENDS):
                out[-1] = (cut, level)
        start = cut


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut at its end) of each piece; one piece where the text is within the limit.

    Lengths are code points. Every piece is at most ``limit`` long, a piece starts ``overlap`` before the end of the one
    before, and without the overlaps the pieces give the text again. Overlap is reduced to ``limit - 1`` where it is larger.
    """
    n = len(text)
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n, "end")] if n else []
    atoms: list[tuple[int, int]] = []
    _atoms(text, 0, n, limit - overlap, 0, atoms)
    pieces, start, last = [], 0, (0, 0)
    for end, level in atoms:
        if end - start > limit and last[0] > start + (overlap if pieces else 0):
            pieces.append((start, last[0], LEVELS[last[1]]))
            start = max(0, last[0] - overlap)
        while end - start > limit:  # one long run without any place to cut
            pieces.append((start, start + limit, "character"))
            start += limit - overlap
        last = (end, level)
    pieces.append((start, n, "end"))
    return pieces


def _limit_columns(limits: DataFrame, most: int) -> tuple[Column, Column]:
    """Limit and overlap by kind as literal maps; the table is fixed in size, which is checked."""
    rows = limits.select("kind", "max_chars", "overlap_chars").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} kinds of limits")
    kind = F.coalesce(F.nullif(F.lower(F.trim(F.col("kind"))), F.lit("")), F.lit("body"))
    both = [F.create_map(*[F.lit(x) for r in rows if r[1] is not None for x in (r[0].strip().lower(), r[i])]) if rows else F.lit(None).cast("map<string,int>") for i in (1, 2)]
    return F.try_element_at(both[0], kind), F.try_element_at(both[1], kind)


def oversized(chunks: DataFrame, limits: DataFrame, most_kinds: int = 1000) -> DataFrame:
    """Rows of ``chunks`` whose text is longer than its kind's limit, with ``max_chars`` and ``overlap_chars``.

    A null or blank kind counts as body; a kind without limit, a null and an empty text are never oversized.
    """
    limit, overlap = _limit_columns(limits, most_kinds)
    kept = chunks.drop("max_chars", "overlap_chars").withColumn("max_chars", limit).withColumn("overlap_chars", F.coalesce(overlap, F.lit(0)))
    return kept.where(F.length("text") > F.col("max_chars"))


def offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of each oversized row and ``cuts``, its pieces as (start, end, level). A text among the keys goes to Python and back once."""
    sent = [c for c in keys if c != "text"] + ["text", "max_chars", "overlap_chars"]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keys) + ", cuts array<struct<start:int,end:int,level:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("level", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, limit, overlap = (batch.column(i).to_pylist() for i in range(len(sent) - 3, len(sent)))
            cuts = [[dict(zip(("start", "end", "level"), piece, strict=True)) for piece in cut_text(*row)] for row in zip(text, limit, overlap, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(sent.index(c)) for c in keys), pa.array(cuts, kind)], [*keys, "cuts"])

    return rows.select(*sent).mapInArrow(run, schema)


def found(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``(chunk_id)`` of every chunk that was cut into two or more pieces, once. Rows with a null chunk_id name nothing."""
    cut = offsets(oversized(chunks.select("chunk_id", "kind", "text"), limits).where("chunk_id is not null"), ["chunk_id"])
    return cut.where(F.size("cuts") > 1).select("chunk_id").distinct()


def pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every oversized chunk: ``chunk_id, piece, page_number, section, kind, start, end, cut_at, text``.

    Of a chunk_id delivered again the latest row counts (``created_at``, then its text); ``piece`` counts from 0.
    """
    rows = oversized(chunks, limits).where("chunk_id is not null")
    latest = Window.partitionBy("chunk_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("text"))
    rows = rows.withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    cut = offsets(rows, ["chunk_id", "page_number", "section", "kind", "text"])
    out = cut.select("*", F.posexplode("cuts").alias("piece", "c"))
    return out.select("chunk_id", "piece", "page_number", "section", "kind", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.level").alias("cut_at"), F.expr("substring(text, c.start + 1, c.end - c.start)").alias("text"))
