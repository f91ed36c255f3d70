"""Problem 6: splits that keep related records together.

Sources that are linked, directly or through others, make one component. Hash-to-min finds them: each node tells its
smallest known neighbour about all it knows, and all it knows about that smallest one, until nothing changes; clusters are
rows, never lists, so that no component must fit into a task. Weighted rendezvous hashing then puts each component into
a split, the same one in every run and, for most components, also after a change of the proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.durable import cut, drop
from leafmill.llm.overlap import split_of

PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}
_MARK = "\x1f"


def _node(dataset: str, source: str) -> Column:
    """Dataset and source in one text, trimmed and in lower case; null unless both are given."""
    d, s = (F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in (dataset, source))
    return F.concat(d, F.lit(_MARK), s)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b): the root is the component's smallest node.

    Null ends are left out; self links and repeats change nothing. A chain of n nodes takes O(log n) rounds.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null").select("a", "b")
    both = e.union(e.select("b", "a")).union(e.select("a", F.col("a").alias("b"))).union(e.select("b", F.col("b").alias("b2")))
    known, path = cut(both.toDF("v", "u").distinct(), "components")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    state = sign(known)
    for _ in range(most_rounds):
        least = known.groupBy("v").agg(F.min("u").alias("m"))
        told = known.join(least, "v")
        step = told.select(F.col("m").alias("v"), "u").union(told.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        known, new_path = cut(step, "components")
        drop(spark, path)
        path, before, state = new_path, state, sign(known)
        if state == before:  # the last table is read by the result
            return known.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    raise RuntimeError(f"components not stable after {most_rounds} rounds")


def grouped(manifest: DataFrame, links: DataFrame) -> DataFrame:
    """The manifest with ``node`` and ``root``; both null where a record has no source."""
    edges = links.select(_node("dataset_a", "source_a").alias("a"), _node("dataset_b", "source_b").alias("b"))
    rows = manifest.drop("node", "root").withColumn("node", _node("dataset", "source_id"))
    return rows.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def found(manifest: DataFrame, links: DataFrame) -> DataFrame:
    """``(dataset, source_id)`` of every source with records whose group stands in more than one split, once."""
    rows = manifest.select("dataset", "source_id", split_of(F.col("split")).alias("split")).distinct()
    sources = grouped(rows, links).where("node is not null").select("node", "root", "split").distinct()
    mixed = sources.groupBy("root").agg(F.size(F.collect_set("split")).alias("splits")).where("splits > 1")
    nodes = sources.join(mixed, "root", "left_semi").select("node").distinct()
    return nodes.select(F.split("node", _MARK)[0].alias("dataset"), F.split("node", _MARK)[1].alias("source_id"))


def assigned(key: Column, proportions: dict[str, float], seed: int = 0) -> Column:
    """The split of a key by weighted rendezvous hashing: the largest ``-weight / ln(u)``, u in (0, 1) by key and split."""
    scores = []
    for name, weight in sorted(proportions.items()):
        if weight > 0:
            bits = F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 53)).cast("double")
            scores.append(F.struct((-F.lit(float(weight)) / F.ln((bits + 0.5) / F.lit(float(1 << 53)))).alias("s"), F.lit(name).alias("n")))
    return F.greatest(*scores)["n"] if len(scores) > 1 else scores[0]["n"]


def assign(manifest: DataFrame, links: DataFrame, proportions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """``id, dataset, source_id, assigned`` for every record, once for each row of the manifest.

    Records of one component share a split; a record without source is a component of its own. The proportions hold in
    expectation over components: a component with a tenth of the records is never torn apart to meet them better.
    """
    rows = grouped(manifest.select("id", "dataset", "source_id"), links)
    key = F.coalesce("root", F.concat(F.lit(_MARK), F.coalesce("id", F.lit(""))))
    return rows.select("id", F.lower(F.trim("dataset")).alias("dataset"), F.lower(F.trim("source_id")).alias("source_id"), assigned(key, proportions or PROPORTIONS, seed).alias("assigned"))


def balance(manifest: DataFrame, links: DataFrame, proportions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """``dataset, split, records, share, wanted, given, given_share, largest`` of every dataset and wanted split.

    ``given`` counts the records with that split in the manifest, ``share`` is what the assignment gives and ``largest`` the share of the
    dataset's largest group of linked sources, below which the shares can't be brought nearer. Null datasets count as one.
    """
    wanted = proportions or PROPORTIONS
    grouped_rows = grouped(manifest.select("id", "dataset", "source_id", "split"), links)
    key = F.coalesce("root", F.concat(F.lit(_MARK), F.coalesce("id", F.lit(""))))
    rows = grouped_rows.select(F.lower(F.trim("dataset")).alias("dataset"), "root", split_of(F.col("split")).alias("given"), assigned(key, wanted, seed).alias("to"))
    counts = rows.groupBy("dataset", "root", "given", "to").agg(F.count("*").alias("n"))
    counts, _ = cut(counts, "balance")
    largest = counts.where("root is not null").groupBy("dataset", "root").agg(F.sum("n").alias("n")).groupBy("dataset").agg(F.max("n").alias("largest"))
    sums = [F.sum(F.when(F.col(c) == s, F.col("n")).otherwise(0)).alias(f"{c}_{s}") for c in ("to", "given") for s in wanted]
    per = counts.groupBy("dataset").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("given").isNotNull(), F.col("n")).otherwise(0)).alias("all_given"), *sums)
    flat = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"to_{s}").alias("records"), F.lit(float(w)).alias("wanted"), F.col(f"given_{s}").alias("given")) for s, w in sorted(wanted.items())])).alias("r")
    known = per.join(largest, per["dataset"].eqNullSafe(largest["dataset"]), "left").select(per["dataset"], "all", "all_given", F.coalesce("largest", F.lit(0)).alias("largest"), flat)
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return known.select("dataset", "r.split", "r.records", share("r.records", "all").alias("share"), F.round("r.wanted", 6).alias("wanted"), "r.given", share("r.given", "all_given").alias("given_share"), share("largest", "all").alias("largest"))
