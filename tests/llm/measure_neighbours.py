"""Measures the neighbour graph and the search of it against brute force, also with the limits of pivots and blocks in force.

python tests/llm/measure_neighbours.py [directory of tables]
"""

import sys
import time

import numpy as np
from pyspark.sql import SparkSession

from leafmill.llm import neighbours as N


def main() -> None:
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    index = spark.read.parquet(f"{directory}/book_index.parquet")
    held = index.dropDuplicates(["vec_id"]).orderBy("vec_id").select("vec_id", "embedding").toArrow()
    rows, x = N._matrix(held["embedding"], 64)
    ids = np.asarray(held["vec_id"])[rows]
    rng = np.random.default_rng(1)
    some = np.arange(len(ids)) if len(ids) <= 20_000 else np.sort(rng.choice(len(ids), 2000, replace=False))
    best = {}
    for a in range(0, len(some), 500):
        s = x[some[a : a + 500]] @ x.T
        s[np.arange(len(s)), some[a : a + 500]] = -2
        for i, row in zip(some[a : a + 500], s, strict=True):
            top = np.argsort(-row)[:5]
            best[int(ids[i])] = [(int(ids[j]), float(row[j])) for j in top]
    near = {(v, u) for v, l in best.items() for u, s in l if s >= 0.9}

    def recall(edges, want) -> float:
        got = {(r.v, r.u) for r in edges.where("rank <= 5").select("v", "u").collect()}
        return sum(p in got for p in want) / max(1, len(want))

    every = {(v, u) for v, l in best.items() for u, _ in l}
    settings = {"as it is": {}, "blocks of 60": {"BLOCK": 60}, "two levels of pivots": {"TOP_PIVOTS": 40, "PER_PIVOT": 40}, "40 pivots, blocks of 60": {"PER_PIVOT": max(1, len(ids) // 40), "BLOCK": 60}}
    for name, limits in settings.items():
        kept = {k: getattr(N, k) for k in limits}
        for k, v in limits.items():
            setattr(N, k, v)
        for rounds in (0, 6):
            began = time.time()
            close = recall(N.graph(index, least=0.75, rounds=rounds), near)
            print(f"{name}, {rounds} rounds: pairs of 0.9 or more {close:.4f} of {len(near)}, five most similar without a limit {recall(N.graph(index, rounds=rounds), every):.4f}, {time.time() - began:.0f} s", flush=True)
        for k, v in kept.items():
            setattr(N, k, v)
    got = {(r.vec_id, r.neighbour) for r in N.searched(index).collect()}
    want = {(v, u) for v, u in every if v % 50 == 0}
    print(f"search: {len(want & got) / max(1, len(want)):.4f} of {len(want)}")


if __name__ == "__main__":
    main()
