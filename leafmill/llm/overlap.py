"""Problem 4: the same or nearly the same record on both sides of a split.

Each record is written as one or more texts: its image path (names of the file and its folders, then how the name was written)
and, where it has boxes enough, the grid cell of its layout. The texts' suffixes at word starts make a suffix array, sorted in range
partitions. The longest prefix that a suffix shares with one of the other side comes from its sorted neighbours; what stands at
the borders of partitions goes to all as a few suffixes a partition, so no prefix, however common, must fit into one task.

Spans so shared are merged into the coverage of each text. Texts that follow one another in the array and share all that tells
a page make a run; the records of a run that are covered so far are candidates, and an exact check of the boxes decides about layouts.

Equal texts are one entry of the array however many records have them, so hot files and copies don't grow it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.durable import cut, drop

#: Shortest shared span, in characters; shorter texts are filled up with end marks. Least share of a candidate's text that spans cover.
MIN_SPAN, COVERED = 24, 0.9
#: Suffixes of a partition of the array, which is sorted and looked through as one, and most partitions (their borders are broadcast).
SUFFIXES, MOST_PARTITIONS = 200_000, 20_000
#: Most by which a coordinate may differ, as a share of width or height, and the edge of a grid cell.
TOLERANCE, CELL = 0.01, 0.04
_END = "$"
_IMAGE = r"(?:\.(?:png|jpe?g|jp2|tiff?|webp|bmp|gif|ppm|pgm|heic|avif|pdf))+$"
_COPY = r"(?:[ _.\-]*\(\d+\)|[ _.\-]+\(?(?:copy|kopie|copie|copia|duplicate)\)?(?:[ _\-]*\(?\d{1,3}\)?)?)+$"


def canonical_path(path: Column) -> Column:
    """The path as a list of names in lower case, without dots, copy marks and image type; null where nothing is left."""
    decoded = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    plain = F.lower(F.trim(F.replace(decoded, F.lit("\\"), F.lit("/"))))
    plain = F.regexp_replace(plain, r"^(?:file:/{2,3}|[a-z]:/)", "")

    def step(done: Column, name: Column) -> Column:
        return F.when(name == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, name))

    names = F.filter(F.split(plain, "/"), lambda name: ~name.isin("", "."))
    names = F.when(F.array_contains(names, ".."), F.aggregate(names, F.array().cast("array<string>"), step)).otherwise(names)
    stem = F.try_element_at(names, F.lit(-1))
    for _ in range(2):
        stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, _IMAGE, ""), _COPY, ""), r"^copy[ _]of[ _]", "")
    return F.when(F.size(names) > 0, F.array_append(F.slice(names, 1, F.size(names) - 1), stem))


def split_of(split: Column) -> Column:
    """train, val or test; null for anything else."""
    name = F.lower(F.trim(split))
    return F.when(name == "validation", "val").when(name.isin("train", "val", "test"), name)


def _key(column: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def records(manifest: DataFrame) -> DataFrame:
    """``id, split, side, dataset, source_id, path, written, boxes``: boxes as shares of width and height, null unless three or more."""
    boxes = F.filter(F.transform("annotations", lambda a: a["bbox"]), lambda b: b.isNotNull() & (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull() | F.isnan(x)))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    shares = F.transform(boxes, lambda b: F.array(b[0] / w, b[1] / h, b[2] / w, b[3] / h))
    rows = manifest.select("id", split_of(F.col("split")).alias("split"), _key("dataset").alias("dataset"), _key("source_id").alias("source_id"), canonical_path(F.col("image_path")).alias("path"), F.substring_index(F.replace("image_path", F.lit("\\"), F.lit("/")), "/", -1).alias("written"), F.when((w > 0) & (h > 0) & (F.size(boxes) >= 3), shares).alias("boxes"))
    rows = rows.where("id is not null and split is not null")
    return rows.withColumn("boxes", F.when(F.col("dataset").isNotNull() & F.col("source_id").isNotNull(), F.col("boxes"))).withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval"))


def _each(marks: Column, options: Column) -> Column:
    """Every mark followed by every option."""
    return F.flatten(F.transform(marks, lambda m: F.transform(options, lambda x: F.concat_ws(":", m, x.cast("string")))))


def texts(rows: DataFrame) -> DataFrame:
    """``id, side, kind, text, need, boxes``; the first ``need`` characters of a text are what tells a page.

    Nearly equal layouts have means that differ by the tolerance at most, so a layout of the evaluation side is written once for each
    cell that its partner's means can lie in.
    """
    need = F.greatest(F.length("t") + 1, F.lit(MIN_SPAN))
    path = rows.where("path is not null").select("id", "side", F.lit("path").alias("kind"), F.array_join(F.reverse("path"), "|").alias("t"), F.lower("written").alias("rest"), F.lit(None).cast("array<array<double>>").alias("boxes"))
    n, reach = F.size("boxes"), TOLERANCE * 1.001
    sums = F.aggregate("boxes", F.array(*[F.lit(0.0)] * 4), lambda s, b: F.zip_with(s, b, lambda x, y: x + y))
    marks = F.array(F.concat_ws(":", F.lit("layout"), *(F.replace(F.col(c), F.lit("|"), F.lit("/")) for c in ("dataset", "source_id")), n))
    for i in range(4):
        low, high = (F.floor((F.get("means", F.lit(i)) + d) / CELL) for d in (-reach, reach))
        options = F.when(F.col("side") == "train", F.array(F.floor(F.get("means", F.lit(i)) / CELL))).otherwise(F.sequence(low, high))
        marks = _each(marks, options)
    cells = rows.where("boxes is not null").withColumn("means", F.transform(sums, lambda x: x / n))
    layout = cells.select("id", "side", F.lit("layout").alias("kind"), F.explode(marks).alias("t"), F.lit("").alias("rest"), "boxes")
    return path.unionByName(layout).select("id", "side", "kind", F.concat(F.rpad("t", need, _END), "rest").alias("text"), need.alias("need"), "boxes")


def _prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def _looked_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the sorted suffixes of a partition: the longest prefix shared with a suffix of the other side within it, in both
    directions, and the first suffix of its run (null for its own). Borders come as rows of their own, with ``edge``."""
    suffix, need, train, evals = [], [], [], []
    for batch in batches:
        for own, column in zip((suffix, need, train, evals), batch.columns, strict=True):
            own += column.to_pylist()
    n = len(suffix)
    if not n:
        return
    shared = [0] + [_prefix(a, b) for a, b in zip(suffix, suffix[1:])] + [0]  # with the suffix before
    best = [len(s) if t and e else 0 for s, t, e in zip(suffix, train, evals, strict=True)]
    run: list[int] = []
    for order, step in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        t = e = 0
        for i in order:
            t, e = min(t, shared[i + step]), min(e, shared[i + step])
            best[i] = max(best[i], e if train[i] else 0, t if evals[i] else 0)
            t, e = len(suffix[i]) if train[i] else t, len(suffix[i]) if evals[i] else e
    start, reach = None, 0  # the first suffix of the run, and how much this one shares with it
    for i in range(n):
        reach = min(reach, shared[i])
        if need[i] and (start is None or reach < need[i]):
            start, reach = i, len(suffix[i])
        run.append(start if need[i] else i)
    first = lambda own, order: next((suffix[i] for i in order if own[i]), None)
    edges = {"first_t": first(train, range(n)), "first_e": first(evals, range(n)), "last_t": first(train, range(n - 1, -1, -1)), "last_e": first(evals, range(n - 1, -1, -1)), "run": None if start is None else suffix[start]}
    held = [i for i in range(n) if best[i] >= MIN_SPAN or shared[i] >= MIN_SPAN or shared[i + 1] >= MIN_SPAN or i in (0, n - 1)]
    sides = [2 * bool(train[i]) + bool(evals[i]) for i in held]
    names = ["suffix", "need", "sides", "shared", "run", "edge"]
    yield pa.RecordBatch.from_arrays([pa.array([suffix[i] for i in held]), pa.array([need[i] for i in held], pa.int32()), pa.array(sides, pa.int32()), pa.array([best[i] for i in held], pa.int32()), pa.array([suffix[run[i]] if run[i] != i else None for i in held], pa.string()), pa.nulls(len(held), pa.string())], names)
    known = {k: v for k, v in edges.items() if v is not None}
    needs = pa.array([need[start] if k == "run" else None for k in known], pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(list(known.values())), needs, *(pa.nulls(len(known), pa.int32()) for _ in range(2)), pa.nulls(len(known), pa.string()), pa.array(list(known))], names)


def _carried(edges: dict[int, dict[str, tuple[str, int]]]) -> dict[int, tuple[list[str | None], list[str | None], str | None]]:
    """For each partition the nearest suffixes (train, eval) before and behind it, and the first suffix of the run that may go on in it."""
    before: list[str | None] = [None, None]
    run, out = None, {}
    at = lambda e, name, otherwise: e[name][0] if name in e else otherwise
    for p in sorted(edges):
        e = edges[p]
        out[p] = (before, [None, None], run)
        before = [at(e, "last_t", before[0]), at(e, "last_e", before[1])]
        if "run" in e and (run is None or _prefix(run, e["run"][0]) < e["run"][1]):
            run = e["run"][0]
    behind: list[str | None] = [None, None]
    for p in sorted(edges, reverse=True):
        out[p][1][:] = behind
        behind = [at(edges[p], "first_t", behind[0]), at(edges[p], "first_e", behind[1])]
    return out


def _with_need(all_texts: DataFrame) -> DataFrame:
    return all_texts if "need" in all_texts.columns else all_texts.withColumn("need", F.length("text"))


def suffix_array(all_texts: DataFrame) -> tuple[DataFrame, list[str]]:
    """``suffix, shared, run`` of the distinct suffixes at word starts that share ``MIN_SPAN`` characters with one of the other side, and the
    tables that hold them.

    ``run`` is the first of the suffixes that follow one another and share their first ``need`` characters; it is given for whole texts only.
    """
    spark = all_texts.sparkSession
    all_texts = _with_need(all_texts)
    has = lambda side: F.max(F.col("side") == side)
    distinct = all_texts.groupBy("text").agg(has("train").alias("train"), has("eval").alias("eval"), F.max("need").alias("need"))
    array = distinct.select("train", "eval", "need", "text", F.explode(_starts()).alias("at")).select("train", "eval", F.when(F.col("at") == 0, F.col("need")).otherwise(0).alias("need"), F.expr(_SUFFIX))
    merged, merged_path = cut(array.groupBy("suffix").agg(F.max("need").alias("need"), F.max("train").alias("train"), F.max("eval").alias("eval")), "suffixes")
    parts = max(1, math.ceil(merged.count() / SUFFIXES))
    if parts > MOST_PARTITIONS:
        raise ValueError("too many partitions for their borders to be broadcast; raise SUFFIXES")
    sorted_in_range = merged.repartitionByRange(parts, "suffix").sortWithinPartitions("suffix").select("suffix", "need", "train", "eval")
    looked, looked_path = cut(sorted_in_range.mapInArrow(_looked_through, "suffix string, need int, sides int, shared int, run string, edge string").withColumn("p", F.spark_partition_id()), "array")
    edges: dict[int, dict[str, tuple[str, int]]] = {}
    for p, edge, suffix, need in looked.where("edge is not null").select("p", "edge", "suffix", "need").collect():  # five rows a partition
        edges.setdefault(p, {})[edge] = suffix, need
    held = spark.sparkContext.broadcast(_carried(edges))

    def over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for suffix, need, sides, shared, run, _, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, behind, open_run = held.value[p]
                for near in (before, behind):
                    for side, mine in ((0, 1), (1, 2)):  # sides: 2 for train and 1 for eval; the other side counts
                        if sides & mine and near[side] is not None:
                            shared = max(shared, _prefix(near[side], suffix))
                if shared >= MIN_SPAN:
                    first = open_run if open_run is not None and _prefix(open_run, suffix) >= need else run or suffix
                    out.append((suffix, shared, first if need else None))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["suffix", "shared", "run"])

    return looked.where("edge is null").mapInArrow(over_borders, "suffix string, shared int, run string"), [merged_path, looked_path]


# How a name was written belongs to the whole text only, so the folders of many files are one suffix.
_SUFFIX = "if(at = 0, text, substring(text, at + 1, need - at)) as suffix"


def _starts() -> Column:
    """Where the names of ``text`` start of which enough is left."""
    names = F.split(F.substring(F.col("text"), F.lit(1), F.col("need")), r"\|")
    places = F.transform(names, lambda w, i: F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice(names, 1, i), "|")) + 1))
    return F.filter(places, lambda p: F.col("need") - p >= MIN_SPAN)


def shared_spans(all_texts: DataFrame, array: DataFrame | None = None) -> DataFrame:
    """``text, need, at, shared, run``: spans of each distinct text, from its words' starts on, that a text of the other side has too."""
    array = suffix_array(all_texts)[0] if array is None else array
    distinct = _with_need(all_texts).groupBy("text").agg(F.max("need").alias("need"))
    placed = distinct.select("text", "need", F.explode(_starts()).alias("at")).select("*", F.expr(_SUFFIX))
    return placed.join(array, "suffix").select("text", "need", "at", "shared", "run")


def covered(spans: DataFrame) -> DataFrame:
    """``text, share, run``: how much of what tells a text's page lies in spans shared with the other side, overlaps counted once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("z"))

    def add(sofar: Column, span: Column) -> Column:
        end = F.least(span["at"] + span["shared"], span["need"])
        fresh = F.greatest(end - F.greatest(span["at"], sofar["z"]), F.lit(0))
        return F.struct((sofar["n"] + fresh).alias("n"), F.greatest(sofar["z"], end).alias("z"))

    lists = spans.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("at", "shared", "need"))).alias("spans"), F.max("need").alias("need"), F.max("run").alias("run"))  # one for each name of a path
    return lists.select("text", (F.aggregate("spans", start, add)["n"] / F.col("need")).alias("share"), "run")


def _match_boxes(a: list[list[float]], b: list[list[float]]) -> bool:
    """Whether each box of ``a`` has its own partner in ``b``, all coordinates within the tolerance."""
    if len(a) != len(b):
        return False
    near = [[j for j, y in enumerate(b) if all(abs(p - q) <= TOLERANCE + 1e-9 for p, q in zip(x, y, strict=True))] for x in a]
    partner = [-1] * len(b)

    def place(i: int, seen: set[int]) -> bool:
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if partner[j] < 0 or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(a)))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        yield batch.filter(pa.array([_match_boxes(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())).select([0, 1])


def _candidates(rows: DataFrame, all_texts: bool) -> tuple[DataFrame, DataFrame]:
    """The texts of the records and their coverage, of all texts or of those that are in a run."""
    every, _ = cut(texts(rows), "texts")  # read by several steps
    array, paths = suffix_array(every)
    looked = every if all_texts else every.join(array.where("run is not null").select(F.col("suffix").alias("text")), "text", "left_semi")
    share, _ = cut(covered(shared_spans(looked, array)), "coverage")
    for path in paths:
        drop(rows.sparkSession, path)
    return every, share


def _pairs(every: DataFrame, share: DataFrame) -> DataFrame:
    held = every.join(share.where(F.col("share") >= COVERED).select("text", "run"), "text")
    train, evals = (held.where(F.col("side") == side).groupBy("run", "kind", "id").agg(F.collect_set("boxes").alias(boxes)).withColumnRenamed("id", name) for side, name, boxes in (("train", "t", "tb"), ("eval", "e", "eb")))
    pairs = train.join(evals, ["run", "kind"]).where("t <> e")
    same_file = pairs.where("kind = 'path'").select("t", "e")
    same_layout = pairs.where("kind = 'layout'").select("t", "e", F.explode("tb").alias("tb"), "eb").select("t", "e", "tb", F.explode("eb").alias("eb")).mapInArrow(_check, "t string, e string")
    return same_file.union(same_layout).select(F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b")).distinct()


def found(manifest: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: a train record and a val or test record of the same page, by file or by layout, id_a < id_b.

    Null ids and splits take no part; a null path, null or too few boxes, or null dataset or source only rule out their own
    way; repeated rows give a pair once.
    """
    every, share = _candidates(records(manifest), all_texts=False)
    return _pairs(every, share)


def coverage(manifest: DataFrame) -> DataFrame:
    """Per split, dataset and source: records, those found on the other side, and how much of their texts is shared.

    ``covered`` is the mean over the records of the share of the characters of path or layout, whichever is greater, that lie in
    spans shared with the other side.
    """
    rows = records(manifest)
    every, share = _candidates(rows, all_texts=True)
    by_id = every.select("id", "text").join(share, "text").groupBy("id").agg(F.max("share").alias("share"))
    pairs = _pairs(every, share)
    hit = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).distinct().withColumn("hit", F.lit(1))
    distinct = rows.select("id", "split", "dataset", "source_id").distinct()
    out = distinct.join(by_id, "id", "left").join(hit, "id", "left")
    return out.groupBy("split", "dataset", "source_id").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"), F.round(F.avg(F.coalesce("share", F.lit(0.0))), 4).alias("covered"))
