"""Problem 8: passages of evaluation items in corpus documents.

Words are unbroken runs of letters and digits, in lower case. A document holds a passage where some window of
``min_words`` words of the item occurs in it with at most ``errors`` word edits. By the pigeonhole principle such a window
keeps at least one of the item's aligned blocks of ``(min_words + 1) // (errors + 2)`` words unchanged, so one pass of an
Aho-Corasick automaton over each document finds every candidate; Myers' bit-parallel distance, with words as symbols,
decides about the windows around each hit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the items held by one automaton; more are worked off in blocks of as many, a longer item is a block of its own.
BLOCK_CHARS = 4 << 20
_WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> str:
    """Words in lower case between single blanks, with a blank at both ends."""
    return f" {' '.join(_WORDS(text))} ".lower() if text else "  "


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """Least edit distance of ``pattern`` to a part of ``text`` ending at each of its words (Myers 1999, any length)."""
    m = len(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        at[word] |= 1 << i
    plus, minus, score, out = full, 0, m, []
    for word in text:
        eq = at.get(word, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp, hm = minus | (full & ~(d | plus)), plus & d
        score += bool(hp & last) - bool(hm & last)
        hp, hm = (hp << 1) & full, (hm << 1) & full  # a match may begin anywhere in the text
        plus, minus = hm | (full & ~(d | hp)), hp & d
        out.append(score)
    return out


class Matcher:
    """Finds the items' passages in documents."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, errors: int) -> None:
        import ahocorasick

        self.min_words, self.errors = min_words, errors
        self.block = (min_words + 1) // (errors + 2)
        if self.block < 1:
            raise ValueError("too many errors for windows of this size")
        self.items = {}
        # Equal windows are one, so items that share a passage are looked at once: an item's words, the place in it, and all (item, place).
        self.windows: list[tuple[list[str], int, list[tuple[int, int]]]] = []
        known: dict[bytes, int] = {}
        where: dict[str, dict[tuple[int, int], None]] = defaultdict(dict)
        for item_id, text in items:
            words = words_of(text).split()
            if len(words) >= min_words:
                self.items[item_id] = words
                own = []
                for s in range(len(words) - min_words + 1):
                    at = known.setdefault(blake2b(" ".join(words[s : s + min_words]).encode(), digest_size=16).digest(), len(self.windows))
                    if at == len(self.windows):
                        self.windows.append((words, s, []))
                    self.windows[at][2].append((item_id, s))
                    own.append(at)
                for p in range(0, len(words) - self.block + 1, self.block):
                    behind = where[f" {' '.join(words[p : p + self.block])} "]
                    for s in range(max(0, p + self.block - min_words), min(p, len(words) - min_words) + 1):
                        behind[own[s], p - s] = None
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), list(places)))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, matched words of the item, words of the item) for each item of which the document holds a passage."""
        if not text or not self.items:
            return []
        line = words_of(text)
        hits = list(self.automaton.iter(line))
        if not hits:
            return []
        words = line.split()
        starts, at = [], 1
        for word in words:
            starts.append(at)
            at += len(word) + 1
        width, errors = self.min_words, self.errors
        held: dict[int, set[int]] = defaultdict(set)
        done: set[int] = set()
        for end, (length, places) in hits:
            d = bisect_right(starts, end - length + 2) - 1
            near: dict[int, tuple[list[str], set[str]]] = {}
            for at, before in places:
                if at in done:
                    continue
                if before not in near:
                    part = words[max(0, d - before - errors) : d + width - before + errors]
                    near[before] = part, set(part)
                part, said = near[before]
                own, s, places_of = self.windows[at]
                window = own[s : s + width]
                # Each kind of word that isn't there costs an edit.
                if len(set(window) - said) <= errors and (window == part if not errors else min(myers(window, part), default=width) <= errors):
                    done.add(at)
                    for item_id, place in places_of:
                        held[item_id].add(place)
        out = []
        for item_id, windows in held.items():
            if windows:
                covered = {w for s in windows for w in range(s, s + width)}
                out.append((item_id, len(covered), len(self.items[item_id])))
        return sorted(out)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded number of characters."""
    block: list[tuple[int, str]] = []
    chars = 0
    for row in items.where("item_id is not null and item_text is not null").select("item_id", "item_text").distinct().toLocalIterator():
        if block and chars + len(row[1]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, errors: int = 0) -> DataFrame:
    """``(doc_id, item_id, matched_words, item_words)`` of every document and item of which it holds a passage.

    Null and empty texts and items, and items shorter than ``min_words``, match nothing. A repeated doc_id gives its pair once,
    with the most matched words. Other columns are not read. The items are a stated set that is matched in blocks; the
    documents are read once for each block and are not shuffled, only the few pairs are.
    """
    context = documents.sparkSession.sparkContext
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, item_id bigint, matched_words int, item_words int"
    out = documents.sparkSession.createDataFrame([], schema)
    for i, block in enumerate(_blocks(items)):
        held = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, min_words, errors)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                rows = [(k, *m) for k, text in enumerate(texts) for m in matcher.matches(text)]
                if rows:
                    k, item, matched, total = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(item, pa.int64()), pa.array(matched, pa.int32()), pa.array(total, pa.int32())], ["doc_id", "item_id", "matched_words", "item_words"])

        part = documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, schema)
        out = part if i == 0 else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: the document holds 12 or more consecutive words of the item."""
    return leaks(documents, items).select("doc_id", "item_id")


def by_item(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each leaked item: in how many documents it stands, in how many wholly, and its best coverage."""
    pairs = leaks(documents, items)
    return pairs.groupBy("item_id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("matched_words") == F.col("item_words")).alias("whole"),
        F.round(F.max(F.col("matched_words") / F.col("item_words")), 6).alias("best_share"),
    )


def near(documents: DataFrame, items: DataFrame, errors: int = 2) -> DataFrame:
    """The columns of :func:`leaks` for passages of 12 words with up to ``errors`` words changed, left out or put in."""
    return leaks(documents, items, errors=errors)
