import hashlib
import random

from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import curation as C
from leafmill.operators import figures as V


def boxes(spark, rows, names="page string, figure int, box array<double>"):
    return spark.createDataFrame(rows, names)


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 15.0, 15.0]), ([0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]), ([1.0, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.v, 6) for r in df.select(G.iou(F.col("a"), F.col("b")).alias("v")).collect()] == [round(25 / 175, 6), 0.0, 0.0]
    df = spark.createDataFrame([(None,), ([1.0, 2.0],), ([5.0, 5.0, 1.0, 9.0],), ([200.0, 5.0, 300.0, 9.0],), ([-5.0, 5.0, 50.0, 9.0],)], "b array<double>")
    assert [r.v for r in df.select(G.validity(F.col("b"), F.lit(100), F.lit(100)).alias("v")).collect()] == ["malformed", "malformed", "not_ordered", "outside", "ok"]
    df = spark.createDataFrame([([0.0, 50.0, 100.0, 100.5],)], "b array<double>")
    assert df.select(G.location_tokens(F.col("b"), F.lit(100), F.lit(100)).alias("v")).first().v == "<loc_0><loc_500><loc_999><loc_999>"


def test_greedy_matches(spark):
    rng = random.Random(3)
    pairs = [(rng.choice((0.5, 0.7, 0.9)), rng.randrange(5), rng.randrange(5)) for _ in range(30)]
    want, g, p = [], set(), set()
    for x in sorted(set(pairs), reverse=True):
        if x[1] not in g and x[2] not in p:
            want.append(x)
            g.add(x[1])
            p.add(x[2])
    df = spark.createDataFrame([(pairs,)], "l array<struct<iou:double,g:int,p:int>>")
    assert [tuple(x) for x in df.select(G.greedy_matches(F.col("l")).alias("m")).first().m] == want


def test_captions_and_visuals(spark):
    figures = boxes(spark, [("p", 0, [0.0, 0.0, 100.0, 50.0]), ("p", 1, [200.0, 0.0, 300.0, 50.0]), ("q", 0, [0.0, 0.0, 9.0, 9.0])])
    captions = boxes(spark, [("p", 5, [0.0, 60.0, 100.0, 70.0]), ("p", 6, [10.0, 60.0, 90.0, 70.0]), ("p", 7, [200.0, 300.0, 300.0, 310.0])], "page string, caption int, box array<double>")
    got = {(r.page, r.figure): (r.caption, r.gap) for r in V.nearest_captions(figures, captions).collect()}
    assert got == {("p", 0): (5, 10.0), ("p", 1): (None, None), ("q", 0): (None, None)}
    near = {r.caption: r.visuals for r in V.nearby_visuals(captions, figures).collect()}
    assert near == {5: 2, 6: 2}
    assert V.unclaimed(figures, boxes(spark, [("p", 9, [90.0, 40.0, 95.0, 45.0])])).count() == 2
    kept = spark.createDataFrame([([[0.0, 0.0, 10.0, 10.0], [1.0, 1.0, 9.0, 9.0], [8.0, 8.0, 20.0, 20.0]],)], "l array<array<double>>").select(V.suppress_overlaps(F.col("l")).alias("k")).first().k
    assert kept == [[0.0, 0.0, 10.0, 10.0], [8.0, 8.0, 20.0, 20.0]]


def test_figure_ids(spark):
    rows = [("5.2", "Figure 5.2", "A", "5.2"), (".1 can be described as", "", "", None), (".1", None, "Activity 5.1", None), ("", "Fig. 3.4", None, "3.4"), (None, None, "Table 7 Metals", "7"), (None, None, "7 metals", None)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, id string, label string, caption string")
    assert [r.v for r in df.select("i", V.normalized_id(F.col("id"), F.col("label"), F.col("caption")).alias("v")).orderBy("i").collect()] == [r[3] for r in rows]
    figs = spark.createDataFrame([("p", "1", 0, "Figure 1", "a", "A cell"), ("p", "1", 1, "", "b", "A cell"), ("p", "1", 2, "x", "b", "and its wall"), ("p", None, 3, "x", "b", "y")], "page string, number string, ord int, label string, source_type string, caption string")
    assert [tuple(r) for r in V.merged(figs).collect()] == [("p", "1", 0, "Figure 1", "a", "A cell and its wall")]


def test_relevance(spark):
    none = F.lit(None).cast("array<string>")
    df = spark.createDataFrame([("heart valve", "Valve of the heart", "Figure 2.1", "2.1", "As Fig 2.1 shows, the heart valve closes."), ("zebra", "Valve", "Figure 2.1", "2.1", "zebra " * 9)], "q string, c string, l string, id string, t string")
    got = [r.v for r in df.select(V.relevance(F.col("q"), F.col("c"), F.col("l"), F.col("id"), none, none, F.lit("heart"), F.col("t")).alias("v")).collect()]
    assert got[0].score == round(100 * (0.25 + 0.20 + 0.10 * 0.5 + 0.05 * 0.5), 2) and got[1].score == 0.0


def manifest(spark):
    pic = lambda *b: [("Picture", [float(x) for x in b])]
    rows = [("1", "D", "train", "s1", "a.png", pic(0, 0, 50, 50)), ("2", "d ", "Val", "S1", "b.png", pic(0, 0, 500, 50)), ("3", "d", "test", "s2", "a.png", [("Table", [1.0, 1.0, 5.0, 5.0])]), ("4", "e", None, None, None, None), ("1", "D", "train", "s1", "a.png", pic(0, 0, 50, 50)), ("5", "d", "validation", "s3", "c.png", pic(9, 9, 1, 1))]
    return spark.createDataFrame([(i, d, s, src, None, None, p, 100, 100, a) for i, d, s, src, p, a in rows], "id string, dataset string, split string, source_id string, doc_category string, image_filename string, image_path string, width int, height int, annotations array<struct<category:string,bbox:array<double>>>")


def test_curation(spark):
    rows = C.records(manifest(spark))
    assert rows.count() == 5
    assert sorted(r.id for r in C.trainable(rows).collect()) == ["1", "2", "3", "4"]
    assert tuple(C.source_overlap(rows).first()) == (1, 0, 0)
    report = C.report(rows).first()
    assert (report.verdict, report.repeated_paths, report.shared_sources, report.invalid_boxes) == ("FAIL", 1, 1, 1)
    assert {r.id: r.split for r in C.repaired_leaks(rows).collect()} == {"1": "train", "2": "train", "3": "test", "4": "train", "5": "val"}
    assert C.report(rows.limit(0)).count() == 1


def test_filled_split(spark):
    rng = random.Random(5)
    rows = [(f"r{i:04d}", f"s{min(rng.randrange(60), rng.randrange(60))}") for i in range(500)] + [("x", None)] + [(f"t{i}", "hot") for i in range(120)]
    df = spark.createDataFrame(rows, "id string, source_id string")
    for train_cap, val_cap in ((1000, 1000), (200, 50), (50, 200), (30, 20), (400, 20), (610, 5)):
        want, used, caps = {}, {"train": 0, "val": 0}, {"train": train_cap, "val": val_cap}
        for source in sorted({s for _, s in rows if s}, key=lambda s: hashlib.sha1(s.encode()).hexdigest()):
            to = "val" if int(hashlib.sha1(source.encode()).hexdigest()[:8], 16) % 100 < 30 else "train"
            if used[to] >= caps[to]:
                to = "train" if to == "val" else "val"
            for i in sorted(i for i, s in rows if s == source)[: caps[to] - used[to]]:
                want[i] = to
                used[to] += 1
        got = [(r.id, r.to) for r in C.filled_split(df, 0.3, train_cap, val_cap).collect()]
        assert len(got) == len(set(got)) and dict(got) == want
    assert C.filled_split(df).count() == 620 and C.filled_split(df.limit(0)).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 2)] + [("b", 3.0)], "k string, v double")
    assert {r.k: (r.least, r.middle, r.most) for r in C.upper_median(df, ["k"], "v").collect()} == {"a": (1.0, 4.0, 5.0), "b": (3.0, 3.0, 3.0)}
    assert [round(x, 6) for x in spark.createDataFrame([([1.0, 2.0, 0.0],)], "l array<double>").select(C.ema(F.col("l")).alias("e")).first().e] == [1.0, 1.1, 0.99]
    assert spark.createDataFrame([("doc-a",)], "s string").select(C.bucket(F.col("s")).alias("b")).first().b == 72
    q = spark.createDataFrame([("train",)] * 50 + [("val",)] * 30 + [("test",)] * 20, "split string")
    assert {r.split: r.quota for r in C.quotas(q, 15).collect()} == {"test": 3, "train": 8, "val": 4}
    steps = spark.createDataFrame([("r", i, v) for i, v in enumerate((3.0, 3.0, 2.0, 5.0, 1.0))], "k string, i int, v double")
    assert [r.i for r in C.running_best(steps, ["k"], "i", "v").orderBy("i").collect()] == [0, 2, 4]


def test_windows_of_mentions(spark):
    text = "See Fig 2.1 and Figure 2.1, then fig. 2.1. " + "x" * 200 + " Figure 2.10"
    got = [r.w for r in spark.createDataFrame([(text, "2.1"), (text, "2.1.a"), (text, ""), (text, None), (None, "2.1")], "t string, n string").select(V.mention_windows("t", "n").alias("w")).collect()]
    assert [len(w) for w in got] == [4, 4, 0, 0, 0] and all(len(w) <= 320 for w in got[0]) and got[0][0].startswith("see fig 2.1")


def test_overfit_falls_back(spark):
    rows = [(i, ("doclaynet", "ai2d", None)[i % 3], 100, 100, [("Picture", [0.0, 0.0, 100.0, float(h)])]) for i, h in enumerate((1, 20, 25, 40, 95, 99))]
    df = spark.createDataFrame(rows, "id int, dataset string, width int, height int, annotations array<struct<category:string,bbox:array<double>>>")
    assert [r.id for r in C.overfit_candidates(df, 3).collect()] == [3, 2, 1]
    assert [r.id for r in C.overfit_candidates(df, 5).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert C.overfit_candidates(df.limit(0), 3).count() == 0


def test_places_in_sorted_values(spark):
    values = [5.0, 1.0, 1.0, 3.0, 9.0, None, 3.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = C.picked(df, [], "v", {"p50": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).first()
    assert (row.least, row.most, row.n, row.p50, row["last"]) == (1.0, 9.0, 7, 3.0, 9.0)


def test_first_pages_and_metrics(spark):
    ranking = spark.createDataFrame([("q", p, i) for i, p in enumerate((4, 4, 2, 9, 4, 1, 7, 8, 3))], "question_id string, page_number int, place int")
    assert sorted(C.first_pages(ranking).first().pages) == [1, 2, 4, 7, 9]
    rows = [(True, True, [1], [1, 2], [2], False, 10), (True, False, [3], [4], [], False, 30), (False, False, [], [1], [1], False, None), (True, True, [5], [5], [5], True, 20)]
    m = C.eval_metrics(spark.createDataFrame(rows, "answerable boolean, sufficient boolean, expected array<int>, retrieved array<int>, cited array<int>, echo boolean, latency long")).first()
    assert (m.questions, m.recall, m.unanswerable, m.false_refusals, m.echoes, m.cited, m.citation_precision, m.p50, m.p95) == (4, 0.666667, 1.0, 0.333333, 1, 1.0, 0.5, 20, 20)
