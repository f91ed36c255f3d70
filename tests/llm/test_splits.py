import random

from leafmill.llm.splits import assign, balance, components, found


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 80):03}", f"n{rng.randint(0, 80):03}") for _ in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"h{i}") for i in range(50)] + [("s", "s"), (None, "q")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_found_and_assign(spark):
    rows = [("1", "D", "train", "a"), ("2", "d ", "Val", "B"), ("3", "d", "test", "c"), ("4", "e", None, "lone"), ("5", "d", "train", None), ("6", "e", "train", "x"), ("6", "e", "train", "x"), ("7", "e", "validation", " X")]
    m = spark.createDataFrame([(*r, 1) for r in rows], "id string, dataset string, split string, source_id string, node int")
    links = spark.createDataFrame([("D", "A", "q", "gone"), ("q", "GONE ", "d", "b"), (None, "a", "d", "c"), ("d", "c", "d", "c")], "dataset_a string, source_a string, dataset_b string, source_b string")
    assert sorted(tuple(r) for r in found(m, links).collect()) == [("d", "a"), ("d", "b"), ("e", "x")]
    out = assign(m, links).collect()
    by = {r.id: r.assigned for r in out}
    assert len(out) == 8 and by["1"] == by["2"] and by["6"] == by["7"] and set(by.values()) <= {"train", "val", "test"}
    assert found(m.limit(0), links).count() == 0 and found(m, links.limit(0)).count() == 1


def test_proportions(spark):
    m = spark.range(6000).selectExpr("cast(id as string) id", "'d' dataset", "'train' split", "concat('s', id % 3000) source_id")
    links = spark.createDataFrame([], "dataset_a string, source_a string, dataset_b string, source_b string")
    share = {r.assigned: r["count"] / 6000 for r in assign(m, links).groupBy("assigned").count().collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["val"] - 0.1) < 0.02
    assert assign(m, links).groupBy("source_id").agg({"assigned": "approx_count_distinct"}).where("`approx_count_distinct(assigned)` > 1").count() == 0


def test_balance(spark):
    rows = [(str(i), "D", "train" if i % 4 else "val", f"s{i % 10}") for i in range(100)] + [(f"n{i}", None, None, None) for i in range(5)] + [(f"b{i}", "d ", "test", "big") for i in range(60)]
    m = spark.createDataFrame(rows, "id string, dataset string, split string, source_id string")
    links = spark.createDataFrame([("d", "s1", "d", "s2")], "dataset_a string, source_a string, dataset_b string, source_b string")
    got = {(r.dataset, r.split): r for r in balance(m, links).collect()}
    to = {r.id: r.assigned for r in assign(m, links).collect()}
    for name in ("train", "val", "test"):
        own = [i for i, d, _, _ in rows if (d or "").strip().lower() == "d" and to[i] == name]
        r = got["d", name]
        assert (r.records, r.share, r.largest) == (len(own), round(len(own) / 160, 6), 0.375)
        assert r.given == {"train": 75, "val": 25, "test": 60}[name] and got[None, name].given == 0
    assert sum(r.records for (d, _), r in got.items() if d is None) == 5
    assert balance(m.limit(0), links).count() == 0
