"""Problem 7: token ids of a whole corpus by a byte-level BPE vocabulary.

The merges of one pre-token run on a linked list of its symbols. Waiting merges stand in buckets, one for each rank; a
three-level bitmap over the ranks says by two find-first-set steps a level which bucket is next. A merge changes its
neighbours' pairs, so entries go stale; they are recognised by their pair's rank and skipped. Each symbol enters the queue a
bounded number of times, so a pre-token of n bytes takes O(n log n) at worst, however long it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The published pre-token pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank that more white space follows, or nothing.
LOOSE_BLANK = re.compile(r" (?:\s|$)").search
#: Pre-tokens and words kept with their ids by each Python worker, and the longest that is kept. Neither changes a result.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


class RankQueue:
    """A priority queue over (rank, position) for ranks below ``size``, as buckets under a bitmap of three levels."""

    def __init__(self, size: int) -> None:
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        j = (i << 6) + (word & -word).bit_length() - 1
        word = self.low[j]
        rank = (j << 6) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[j] &= self.low[j] - 1
            if not self.low[j]:
                self.mid[i] &= self.mid[i] - 1
                if not self.mid[i]:
                    self.top &= self.top - 1
        return rank, position


class ByteBPE:
    """Encoder over the lines ``base64(token) rank`` of a rank file; a token's id is its rank."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN) -> None:
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.bytes_of) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.cache, self.words = _Cache(self), _Words(self)

    def pair_rank(self, a: int, b: int) -> int:
        """Rank of the merge of two ids, -1 where there is none."""
        rank = self.pairs.get((a, b))
        if rank is None:
            rank = self.pairs[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs = {}
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        ids = [self.single[b] for b in piece]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue, pair_rank = self.queue, self.pair_rank
        for i in range(n - 1):
            rank = pair_rank(ids[i], ids[i + 1])
            if rank >= 0:
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            j = after[i]
            if ids[i] < 0 or j < 0 or pair_rank(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                new = pair_rank(rank, ids[k])
                if new >= 0:
                    queue.push(new, i)
            h = before[i]
            if h >= 0:
                new = pair_rank(ids[h], rank)
                if new >= 0:
                    queue.push(new, h)
        return [x for x in ids if x >= 0]

    def pretokens(self, text: str) -> list[int]:
        """Ids of a text, pre-token by pre-token."""
        return list(chain.from_iterable(map(self.cache.__getitem__, self.find(text))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts give an empty list.

        By the pattern a blank before a mark that is not white space always begins a pre-token, so such a text is the
        concatenation of its blank-separated words, and words that come again needn't be taken apart again.
        """
        if not text:
            return []
        if LOOSE_BLANK(text):
            out = self.pretokens(text)
        else:
            first, *rest = text.split(" ")
            out = self.pretokens(first)
            out.extend(chain.from_iterable(map(self.words.__getitem__, rest)))
        for cache in (self.cache, self.words):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        return out


class _Cache(dict):
    """Ids of pre-tokens."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.bpe.merge(piece.encode("utf-8", "replace")))
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class _Words(_Cache):
    """Ids of blank-separated words, each with the blank before it."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.bpe.pretokens(" " + piece))
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


_WORKER: dict[int, ByteBPE] = {}


def _encoder(rank_file: bytes) -> ByteBPE:
    """One encoder for each Python worker; a reused worker keeps it with its cache."""
    key = hash(rank_file)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = ByteBPE(rank_file)
    return _WORKER[key]


def encode_corpus(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)`` for every row: the ids of its text by the rank file ``vocabulary``, without special tokens.

    Null and empty texts give an empty list; rows with repeated ids come out as often as they go in; other columns, whatever
    their names, are not read; strings that look like special tokens are ordinary text. The vocabulary file is read on the
    driver (its size is checked) and broadcast. There is no shuffle: each row is encoded where it is read.
    """
    with open(vocabulary, "rb") as f:
        rank_file = f.read(64 << 20)
        if f.read(1):
            raise ValueError("the vocabulary file is larger than 64 MB")
    held = documents.sparkSession.sparkContext.broadcast(rank_file)
    kind = dict(documents.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(held.value)
        for batch in batches:
            flat = [bpe.encode(text) for text in batch.column(1).to_pylist()]
            ends = np.zeros(len(flat) + 1, np.int32)
            np.cumsum([len(x) for x in flat], out=ends[1:])
            values = np.fromiter(chain.from_iterable(flat), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["k", "ids"])

    return documents.select(documents[id_col].alias("k"), documents[text_col].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)
