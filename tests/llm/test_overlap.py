import random

from leafmill.llm import overlap
from leafmill.llm.overlap import _match_boxes, _prefix, coverage, found, shared_spans

SCHEMA = "id string, dataset string, split string, source_id string, doc_category string, image_filename string, image_path string, width int, height int, annotations array<struct<category:string,bbox:array<double>>>, side string"


def frame(spark, rows):
    return spark.createDataFrame([(i, d, s, src, None, None, path, 1000, 500, None if boxes is None else [("Picture", b) for b in boxes], "x") for i, d, s, src, path, boxes in rows], SCHEMA)


def test_same_file(spark):
    same = ["data/a_b/page_0001.png", "./data//a_b/page_0001.jpg", "DATA\\A_B\\Page_0001.PNG", "data/a%5Fb/page_0001 (1).png", "data/a_b/../a_b/page_0001_copy.png", "data/a_b/page_0001.png"]
    other = ["data/c/page_0001.png", "data/a_b/page_0002.png", "page_0001.png", None, "", "data/a_b/page_00011.png"]
    rows = [("t0", "d", " Train", None, same[0], None)] + [(f"v{i}", "d", ("VAL", "test", "validation")[i % 3], None, p, None) for i, p in enumerate(same)] + [(f"w{i}", "d", "test", None, p, None) for i, p in enumerate(other)]
    rows += [("n", "d", None, None, same[0], None), (None, "d", "val", None, same[0], None), rows[1]]
    assert sorted(tuple(r) for r in found(frame(spark, rows)).collect()) == [("t0", f"v{i}") for i in range(6)]


def test_layouts_against_brute_force(spark):
    rng = random.Random(3)
    rows, boxes = [], {}
    base = [[[rng.uniform(0, 900), rng.uniform(0, 450), rng.uniform(0, 900), rng.uniform(0, 450)] for _ in range(rng.randint(2, 5))] for _ in range(12)]
    for i in range(160):
        b = [[x + rng.uniform(-1, 1) * (9.9 if k % 2 == 0 else 4.9) * rng.choice((0.5, 1, 1.1)) for k, x in enumerate(box)] for box in rng.choice(base)]
        rng.shuffle(b)
        boxes[f"r{i:03}"] = b
        rows.append((f"r{i:03}", "D" if i % 2 else "d ", "train" if i % 3 else "test", "s", f"p{i}.png", b))
    rows += [("z1", "d", "train", "s", None, None), ("z2", None, "test", "s", None, base[0]), ("z3", "d", "test", None, None, base[0]), ("z4", "d", "test", "s", None, [[1.0], None, [1.0, 2.0, 3.0, None], [1.0, 2.0, 3.0, 4.0]])]
    share = lambda b: [[x[0] / 1000, x[1] / 500, x[2] / 1000, x[3] / 500] for x in b]
    want = {tuple(sorted((a[0], b[0]))) for a in rows[:160] for b in rows[:160] if a[2] == "train" and b[2] == "test" and len(a[5]) >= 3 and _match_boxes(share(a[5]), share(b[5]))}
    assert want and {tuple(r) for r in found(frame(spark, rows)).collect()} == want


def test_spans_against_brute_force(spark):
    rng = random.Random(5)
    texts = [("|".join(rng.choice(("aaaaaaaaaaaaaa", "aaaaaaaaaaaaab", "bbbbbbb", "ccccccccccccccccc")) for _ in range(rng.randint(2, 6))) + "$" * 24, rng.choice(("train", "eval"))) for _ in range(60)]
    got = {(r.text, r["at"]): r.shared for r in shared_spans(spark.createDataFrame(texts, "text string, side string")).collect()}
    sides = {}
    for t, s in texts:
        sides.setdefault(t, set()).add(s)
    suffixes = [(t, at, t[at:]) for t in sides for at in [0, *(i + 1 for i, c in enumerate(t) if c == "|")]]
    want = {}
    for t, at, s in suffixes:
        shared = max((_prefix(s, s2) for t2, _, s2 in suffixes if len(sides[t] | sides[t2]) > 1), default=0)
        if shared >= 24:
            want[t, at] = shared
    assert got == want


def test_borders_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SUFFIXES", 5)
    test_spans_against_brute_force(spark)
    test_same_file(spark)
    test_layouts_against_brute_force(spark)
    rows = [("t", "d", "train", "s", "one/folder/page_000001.png", None)] + [(f"v{i:02}", "d", "val", "s", f"one/folder/page_000001 ({i}).png", None) for i in range(40)]
    rows += [(f"w{i:02}", "d", "val", "s", f"one/folder/page_00000{i}.png", None) for i in range(10, 40)]
    assert sorted(tuple(r) for r in found(frame(spark, rows)).collect()) == [("t", f"v{i:02}") for i in range(40)]


def test_coverage_and_empty(spark):
    rows = [("t", "d", "train", "s", "x/y/page_0000000000000001.png", None), ("v", "d", "val", "s2", "x/y/page_0000000000000001.png", None), ("u", "d", "val", "s3", "q", None)]
    got = {(r.split, r.source_id): (r.records, r.overlapping, r.covered) for r in coverage(frame(spark, rows)).collect()}
    assert got == {("train", "s"): (1, 1, 1.0), ("val", "s2"): (1, 1, 1.0), ("val", "s3"): (1, 0, 0.0)}
    assert found(frame(spark, rows).limit(0)).count() == 0
