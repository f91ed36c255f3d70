"""Problem 1: the most similar vectors of every vector, by NN-descent.

A first graph comes from blocks: a bounded sample of the vectors serves as pivots, every vector joins the blocks of its nearest
pivots, and within a block all are compared. NN-descent then joins, for every vector, its neighbours in both directions with each
other and keeps what is better than before, until hardly anything changes. A round sends each vector once to each
block whose members have it as a neighbour, not once for each edge. Vectors travel as 16-bit fixed point numbers (cosines are
exact to about 1e-5); pairs nearer to a limit than that are decided with the stored numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.durable import cut, drop

#: Vectors for each pivot, pivots at the top and the most pivots in all (their vectors are all that the driver holds and sends out,
#: 67 MB at 64 numbers each), blocks of a vector, largest block.
PER_PIVOT, TOP_PIVOTS, MOST_PIVOTS, NEAREST, BLOCK = 300, 2048, 1 << 18, 3, 4000
#: Edges kept for a vector, and neighbours joined at a vector in a round.
DEGREE, JOINED = 10, 30
_SCALE, _NEAR = 32767.0, 5e-5


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector, and these vectors with length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten()
    values = np.asarray(flat.fill_null(float("nan")), dtype=np.float64).reshape(len(rows), dim)
    norms = np.sqrt((values * values).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], (values[good] / norms[good, None]).astype(np.float32)


def _packed(vectors: np.ndarray) -> pa.Array:
    raw = np.rint(vectors * _SCALE).astype(np.int16)
    width = raw.shape[1] * 2
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.int16).reshape(-1, dim).astype(np.float32) / np.float32(_SCALE)


class Pivots:
    """Pivots in one level, or in two where they are many: a vector is compared with those that lie nearest to its nearest top pivots."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.count = len(vectors)
        flat = len(vectors) <= 2 * TOP_PIVOTS
        self.top = vectors if flat else vectors[:TOP_PIVOTS]
        self.groups: list[tuple[np.ndarray, np.ndarray]] | None = None
        if not flat:
            own = np.concatenate([(vectors[a : a + 4096] @ self.top.T).argmax(axis=1) for a in range(0, len(vectors), 4096)])
            self.groups = [(rows, vectors[rows]) for rows in (np.flatnonzero(own == t) for t in range(len(self.top)))]

    @staticmethod
    def _best(s: np.ndarray, m: int) -> np.ndarray:
        near, at = np.empty((len(s), m), np.int32), np.arange(len(s))
        for j in range(m):
            near[:, j] = s.argmax(axis=1)
            s[at, near[:, j]] = -2
        return near

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The ``m`` nearest pivots of each vector, nearest first."""
        if self.groups is None:
            return self._best(x @ self.top.T, m)
        tops = self._best(x @ self.top.T, min(4, len(self.top)))
        ids = np.full((len(x), tops.shape[1] * m), -1, np.int32)
        sims = np.full(ids.shape, -2, np.float32)
        for t in np.unique(tops):
            rows, column = np.nonzero(tops == t)
            own, vectors = self.groups[t]
            k = min(m, len(own))
            s = x[rows] @ vectors.T
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            at = column[:, None] * m + np.arange(k)
            ids[rows[:, None], at] = own[best]
            sims[rows[:, None], at] = np.take_along_axis(s, best, axis=1)
        return np.take_along_axis(ids, np.argsort(-sims, axis=1, kind="stable")[:, :m], axis=1)


def _assigned(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """``id, near, q``: the nearest pivots of each usable vector, and the vector in fixed point."""
    held = vectors.sparkSession.sparkContext.broadcast(Pivots(pivots))
    m = min(NEAREST, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column(1), dim)
            near = np.concatenate([held.value.nearest(x[a : a + 4096], m) for a in range(0, len(x), 4096)]) if len(x) else np.empty((0, m), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists, _packed(x) if len(x) else pa.array([], pa.binary())], ["id", "near", "q"])

    return vectors.mapInArrow(run, "id bigint, near array<int>, q binary")


def _sampled(vectors: DataFrame, wanted: int, total: int, dim: int) -> np.ndarray:
    """About ``wanted`` different vectors (columns id, e), chosen by the hashes of their ids; all of few."""
    share = min(1.0, (1.1 * wanted + 50) / max(1, total))
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("id", "e").toArrow()
    _, found_here = _matrix(chosen["e"], dim)
    pivots = np.unique(found_here, axis=0)
    return pivots[np.random.default_rng(0).permutation(len(pivots))[:wanted]]


def _edges(v: np.ndarray, u: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"v": pa.array(v, pa.int64()), "u": pa.array(u, pa.int64()), "sim": pa.array(sim, pa.float32())})


def _within(dim: int, degree: int, least: float):
    """All vectors of a block against each other."""

    def run(table: pa.Table) -> pa.Table:
        ids, first = np.unique(np.asarray(table["id"]), return_index=True)
        x = _unpacked(table["q"], dim)[first]
        vs, us, sims = [], [], []
        for a in range(0, len(x), 512):
            s = x[a : a + 512] @ x.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            rows = np.flatnonzero(s.max(axis=1, initial=-2) >= least)
            if not len(rows):
                continue
            s = s[rows]
            top = np.argpartition(-s, degree - 1, axis=1)[:, :degree] if s.shape[1] > degree else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            value = np.take_along_axis(s, top, axis=1)
            i, j = np.nonzero((value >= least) & (value > -1.5))
            vs.append(ids[rows[i] + a])
            us.append(ids[top[i, j]])
            sims.append(value[i, j])
        return _edges(*(np.concatenate(x) if x else np.array([]) for x in (vs, us, sims)))

    return run


def _local_join(dim: int):
    """Neighbours of each hub of a block against each other; only pairs with a new edge are looked at, and only what is better than
    the ``bar`` of its vector comes out."""

    def run(members: pa.Table, vectors: pa.Table) -> pa.Table:
        if not members.num_rows or not vectors.num_rows:
            return _edges([], [], [])
        order = np.argsort(np.asarray(vectors["id"]), kind="stable")
        ids = np.asarray(vectors["id"])[order]
        x = _unpacked(vectors["q"], dim)[order]
        bar = np.asarray(vectors["bar"])[order]
        hub, w, new = (np.asarray(members[c]) for c in ("hub", "w", "new"))
        order = np.argsort(hub, kind="stable")
        hub, at, new = hub[order], np.searchsorted(ids, w[order]), new[order].astype(bool)
        starts = np.flatnonzero(np.r_[True, hub[1:] != hub[:-1]])
        pairs, sims = [], []
        for a, z in zip(starts, np.r_[starts[1:], len(hub)], strict=True):
            if z - a < 2 or not new[a:z].any():
                continue
            own = at[a:z]
            s = x[own] @ x[own].T
            i, j = np.nonzero(np.triu((s >= np.minimum(bar[own, None], bar[None, own])) & (new[a:z, None] | new[None, a:z]), 1))
            pairs.append(np.minimum(own[i], own[j]) * len(ids) + np.maximum(own[i], own[j]))
            sims.append(s[i, j])
        if not pairs:
            return _edges([], [], [])
        pair, first = np.unique(np.concatenate(pairs), return_index=True)
        sim = np.concatenate(sims)[first]
        a, b = pair // len(ids), pair % len(ids)
        to_a, to_b = (a != b) & (sim >= bar[a]), (a != b) & (sim >= bar[b])
        return _edges(np.r_[ids[a[to_a]], ids[b[to_b]]], np.r_[ids[b[to_a]], ids[a[to_b]]], np.r_[sim[to_a], sim[to_b]])

    return run


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best edges of each vector; an edge seen in an earlier round isn't new."""
    once = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= degree)


def graph(index: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, least: float = -1.0, rounds: int = 6, settled: float = 0.001, degree: int = DEGREE, joined: int = JOINED) -> DataFrame:
    """``v, u, sim, rank``: up to ``degree`` most similar other vectors of every vector, of those with cosine ``least`` or more.

    Null vectors, vectors with null or non-finite parts, of another length than ``dim`` or all zero take no part; a repeated id
    counts once (its rows are the same vector); null ids are left out. Exact copies are neighbours like any others; of more
    equally similar ones those with the smaller ids are kept. Pivots are a sample fixed by the ids' hashes, at most ``MOST_PIVOTS``, which
    keeps blocks small up to 78 million vectors; every vector is indexed. A block beyond ``BLOCK`` vectors is split by hash and its parts find each other through the joins of neighbours. The
    rounds end when fewer than ``settled`` of all edges are new.
    """
    spark = index.sparkSession
    vectors = index.where(f"{id_col} is not null").select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("e")).where(F.size("e") == dim)
    total = vectors.count()
    empty = spark.createDataFrame([], "v bigint, u bigint, sim float, rank int")
    if not total:
        return empty
    wanted = min(MOST_PIVOTS, max(1, math.ceil(total / PER_PIVOT)))
    pivots = _sampled(vectors, wanted, total, dim)
    if not len(pivots):
        return empty
    placed, placed_path = cut(_assigned(vectors, pivots, dim), "vectors")
    sizes = placed.select(F.explode("near").alias("near")).groupBy("near").count()
    split = sizes.where(F.col("count") > BLOCK).select("near", F.ceil(F.col("count") / BLOCK).alias("parts"))

    def blocks(rows: DataFrame) -> DataFrame:
        """``rows`` (id, near and others) with their block b; the parts of a large block have other companions for each pivot."""
        part = F.pmod(F.xxhash64("id", "near"), F.coalesce("parts", F.lit(1)))
        return rows.join(split, "near", "left").select((F.col("near").cast("bigint") * (1 << 20) + part).alias("b"), *[c for c in rows.columns if c != "near"])

    schema = "v bigint, u bigint, sim float"
    apart = blocks(placed.select("id", "q", F.explode("near").alias("near")))
    first = apart.groupBy("b").applyInArrow(_within(dim, degree, least), schema)
    edges, path = cut(_best(first.withColumn("new", F.lit(True)), degree), "graph")
    home, home_path = cut(blocks(placed.select("id", F.element_at("near", 1).alias("near")).dropDuplicates(["id"])), "home")
    for _ in range(rounds):
        both = edges.select(F.col("v").alias("hub"), F.col("u").alias("w"), "new", "sim").union(edges.select("u", "v", "new", "sim"))
        members = both.groupBy("hub", "w").agg(F.max("new").alias("new"), F.max("sim").alias("sim"))
        order = Window.partitionBy("hub").orderBy(F.desc("sim"), F.xxhash64("w"))
        members = members.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= joined)
        members = members.withColumn("any", F.max("new").over(Window.partitionBy("hub"))).where("any").select("hub", "w", "new")
        bars = edges.groupBy(F.col("v").alias("id")).agg(F.when(F.count("*") >= degree, F.min("sim")).alias("bar"))
        members, members_path = cut(members.join(home.withColumnRenamed("id", "hub"), "hub").select("b", "hub", "w", "new"), "members")
        needed = members.select("b", F.col("w").alias("id")).distinct().join(placed.select("id", "q"), "id").join(bars, "id", "left").select((F.col("b") + 0).alias("b"), "id", "q", F.coalesce("bar", F.lit(least)).cast("float").alias("bar"))
        pairs = members.groupBy("b").cogroup(needed.groupBy("b")).applyInArrow(_local_join(dim), schema)
        old = edges.select("v", "u", "sim", F.lit(False).alias("new"))
        better, new_path = cut(_best(old.union(pairs.withColumn("new", F.lit(True))), degree), "graph")
        drop(spark, path)
        drop(spark, members_path)
        edges, path = better, new_path
        counts = edges.agg(F.count("*"), F.count_if("new")).first()
        if counts[1] <= settled * counts[0]:
            break
    drop(spark, placed_path)
    drop(spark, home_path)
    return edges.select("v", "u", "sim", "rank")


def _similar(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_unpacked(pa.chunked_array([batch.column(i)]), dim) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a * b).sum(axis=1), pa.float32())], ["q", "u", "sim"])

    return run


def search(index: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 5, beam: int = 16, entries: int = 16, most_rounds: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64) -> DataFrame:
    """``q, u, sim, rank``: the ``k`` most similar indexed vectors of each query vector, other than itself, by greedy search of a graph.

    ``edges`` (v, u, sim) come from :func:`graph` without a limit. A search starts from ``entries`` vectors of the query's nearest
    pivots and in each round goes to the neighbours of its ``beam`` best vectors that it hasn't left yet, until all of these
    have been left. Queries are a stated set with ids of their own; unusable ones have no result.
    """
    spark = index.sparkSession
    take = lambda df: df.where(f"{id_col} is not null").select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("e")).where(F.size("e") == dim)
    pivots = _sampled(take(index), 256, take(index).count(), dim)
    empty = spark.createDataFrame([], "q bigint, u bigint, sim float, rank int")
    if not len(pivots):
        return empty
    placed, placed_path = cut(_assigned(take(index), pivots, dim), "vectors")
    asked, asked_path = cut(_assigned(take(queries), pivots, dim).dropDuplicates(["id"]), "queries")
    back = edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim").withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("rn") <= JOINED)
    hops, hops_path = cut(edges.select("v", "u").union(back.select("v", "u")).distinct(), "hops")
    spread = placed.select("id", F.element_at("near", 1).alias("b"))
    doors = spread.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("id")))).where(F.col("rn") <= entries).select("b", F.col("id").alias("u"))
    fresh = asked.select(F.col("id").alias("q"), F.explode("near").alias("b")).join(doors, "b").select("q", "u").distinct()
    best, path = None, None
    for _ in range(most_rounds):
        vectors = fresh.where("q <> u").join(placed.select(F.col("id").alias("u"), F.col("q").alias("y")).dropDuplicates(["u"]), "u").join(asked.select(F.col("id").alias("q"), F.col("q").alias("x")), "q")
        scored = vectors.select("q", "u", "x", "y").mapInArrow(_similar(dim), "q bigint, u bigint, sim float").withColumn("left", F.lit(False))
        known = scored if best is None else best.withColumn("left", F.lit(True)).unionByName(scored)
        order = Window.partitionBy("q").orderBy(F.desc("sim"), "u")
        state, new_path = cut(known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 4 * beam), "beam")
        drop(spark, path)
        path = new_path
        best = state.select("q", "u", "sim")
        ahead = state.where((F.col("rank") <= beam) & ~F.col("left")).select("q", F.col("u").alias("v"))
        fresh = ahead.join(hops, "v").select("q", "u").distinct().join(best.select("q", "u"), ["q", "u"], "left_anti")
        if ahead.isEmpty():
            break
    for over in (placed_path, asked_path, hops_path):
        drop(spark, over)
    return state.where(F.col("rank") <= k).select("q", "u", "sim", "rank")


def found(index: DataFrame, least: float = 0.90, k: int = 5, dim: int = 64) -> DataFrame:
    """``(vec_a, vec_b)``, vec_a < vec_b: pairs of cosine ``least`` or more of which one is among the ``k`` most similar of the other.

    The graph has no limit of similarity, so descent leads to the pairs from any first graph; it has fewer edges than one for search.
    Pairs within the error of the fixed point numbers are decided with the stored vectors.
    """
    edges = graph(index, dim=dim, degree=k + 1, joined=16, rounds=8, settled=0.01).where((F.col("rank") <= k) & (F.col("sim") >= least - _NEAR))
    pairs = edges.groupBy(F.least("v", "u").alias("vec_a"), F.greatest("v", "u").alias("vec_b")).agg(F.max("sim").alias("sim"))
    sure = pairs.where(F.col("sim") >= least + _NEAR).select("vec_a", "vec_b")
    vectors = index.where(F.size("embedding") == dim).select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    near = pairs.where(F.col("sim") < least + _NEAR).select("vec_a", "vec_b")
    for side in ("a", "b"):
        near = near.join(vectors.select(F.col("id").alias(f"vec_{side}"), F.col("e").alias(side)), f"vec_{side}")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    checked = near.where(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")) >= least).select("vec_a", "vec_b").distinct()
    return sure.union(checked)


def searched(index: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """``vec_id, neighbour, score, rank``: the ``k`` most similar other vectors of each vector whose id is divisible by 50.

    The graph has no limit of similarity. Scores are cosines of the fixed point numbers, exact to about 1e-5; unusable vectors have no
    result, fewer than ``k`` other vectors give fewer rows.
    """
    edges = graph(index, dim=dim)
    out = search(index, edges, index.where("vec_id % 50 = 0"), k, dim=dim)
    return out.select(F.col("q").alias("vec_id"), F.col("u").alias("neighbour"), F.col("sim").alias("score"), "rank")
