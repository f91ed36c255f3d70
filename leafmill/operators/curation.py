"""Layout manifests: records, validation, leakage, sampling; and metrics of detection and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as G

SPLITS = ("train", "val", "test")
#: Upper limits of the grid on which thresholds are chosen are small integers, so the grid stays a few thousand rows.
GRID_ROWS = 10_000


def split_name(split: Column) -> Column:
    """val, test, else train."""
    name = F.lower(F.trim(split))
    return F.when(name.isin("val", "validation"), "val").when(name == "test", "test").otherwise("train")


def records(manifest: DataFrame) -> DataFrame:
    """Each record once by id: ``id, dataset, split, source_id, image_path, width, height, annotations`` with names made equal."""
    key = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    rows = manifest.where("id is not null").select("id", key("dataset").alias("dataset"), split_name(F.col("split")).alias("split"), key("source_id").alias("source_id"), "image_path", "width", "height", F.coalesce("annotations", F.array().cast(dict(manifest.dtypes)["annotations"])).alias("annotations"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("image_path", F.lit("")), "split"))
    return rows.withColumn("rn", first).where("rn = 1").drop("rn")


def has_picture(annotations: Column) -> Column:
    return F.exists(annotations, lambda a: F.coalesce(a["category"] == "Picture", F.lit(False)))


def boxes(rows: DataFrame) -> DataFrame:
    """``id, split, category, box, width, height, state`` of every annotation; state says what is wrong with it, or ok."""
    each = rows.select("id", "dataset", "split", "width", "height", F.posexplode("annotations").alias("ord", "a")).select("id", "dataset", "split", "width", "height", "ord", F.col("a.category").alias("category"), F.col("a.bbox").alias("box"))
    return each.withColumn("state", G.validity(F.col("box"), F.col("width"), F.col("height")))


def trainable(rows: DataFrame, allow_empty: bool = True) -> DataFrame:
    """Records with a picture whose boxes are all valid; records without picture if ``allow_empty``."""
    fine = F.forall("annotations", lambda a: G.validity(a["bbox"], F.col("width"), F.col("height")) == "ok")
    picture = has_picture(F.col("annotations"))
    return rows.where((picture & fine) | (~picture & F.lit(allow_empty)))


def counts(rows: DataFrame) -> DataFrame:
    """Records, records without picture and invalid boxes per dataset and split."""
    bad = F.size(F.filter("annotations", lambda a: G.validity(a["bbox"], F.col("width"), F.col("height")) != "ok"))
    return rows.groupBy("dataset", "split").agg(F.count("*").alias("records"), F.count_if(~has_picture(F.col("annotations"))).alias("no_picture"), F.sum(bad).cast("bigint").alias("invalid_boxes"))


def source_overlap(rows: DataFrame) -> DataFrame:
    """``a, b, sources``: sources that stand in both of two splits, for each pair of splits."""
    splits = rows.where("source_id is not null").groupBy("source_id").agg(F.collect_set("split").alias("s"))
    return splits.select(*[F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))])


def picked(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """``keys``, their least and greatest value, n, and the sorted values at the places (from 0, as columns of n) named.

    Equal values are counted first, so only distinct values are ordered; ``keys`` may be empty.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    total = F.sum("c").over(Window.partitionBy(*keys))
    placed = counts.withColumn("n", total).withColumn("end", F.sum("c").over(order)).withColumn("begin", F.col("end") - F.col("c"))
    at = [F.max(F.when((place >= F.col("begin")) & (place < F.col("end")), F.col(value))).alias(name) for name, place in places.items()]
    return placed.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.max("n").alias("n"), *at)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, least, middle, most``: the middle is the sorted value at index n // 2, never between two."""
    return picked(df, keys, value, {"middle": F.floor(F.col("n") / 2)}).select(*keys, "least", "middle", "most")


def report(rows: DataFrame) -> DataFrame:
    """One row: records, invalid boxes, paths used twice, sources in two splits, missing splits, PASS or FAIL."""
    total = counts(rows).agg(F.sum("records").alias("records"), F.sum("invalid_boxes").alias("invalid_boxes"), F.count_distinct("split").alias("splits"))
    twice = rows.where("image_path is not null").groupBy("image_path").count().where("count > 1").agg(F.count("*").alias("repeated_paths"))
    shared = source_overlap(rows).select((F.col("train_val") + F.col("train_test") + F.col("val_test")).alias("shared_sources"))
    one = total.join(twice).join(shared)  # three single rows
    return one.withColumn("verdict", F.when((F.col("shared_sources") > 0) | (F.col("splits") < 3), "FAIL").otherwise("PASS"))


def repaired_leaks(rows: DataFrame) -> DataFrame:
    """The rows with validation records of sources in several splits moved to train; test is left as it is."""
    leaky = rows.where("source_id is not null").groupBy("source_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("source_id", F.lit(True).alias("leaky"))
    return rows.join(leaky, "source_id", "left").withColumn("split", F.when(F.col("leaky") & (F.col("split") == "val"), "train").otherwise(F.col("split"))).drop("leaky")


def bucket(key: Column, buckets: int = 100) -> Column:
    """A stable bucket by the first eight hex digits of SHA-1."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint") % buckets


def quotas(rows: DataFrame, target: int) -> DataFrame:
    """``split, n, quota``: a target shared out in proportion, half to even; the last split in order takes the remainder."""
    n = rows.groupBy("split").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row for each split
    share = n.withColumn("q", F.bround(F.lit(float(target)) * F.col("n") / F.col("total"), 0).cast("bigint"))
    order = Window.partitionBy().orderBy("split")
    before = F.coalesce(F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(Window.partitionBy().orderBy(F.desc("split"))) == 1
    return share.withColumn("before", before).select("split", "n", F.least(F.when(last, target - F.col("before")).otherwise(F.col("q")), F.col("n")).alias("quota"))


def fewer_negatives(rows: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """All records with a picture, and of those without one a fixed sample by hash, each split by its quota.

    Only hashes up to the quota's share, a sixteenth and 64 records more, are put in order; that so few of n hashes fall below it
    has a chance of one in millions.
    """
    negative = rows.where(~has_picture(F.col("annotations"))).withColumn("h", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)))
    limits = quotas(negative, target).withColumn("most", F.ceil((F.col("quota") / F.greatest("n", F.lit(1)) * 17 / 16 + 64 / F.greatest("n", F.lit(1))) * (1 << 40)))
    near = negative.join(F.broadcast(limits.select("split", "quota", "most")), "split").where("h < most")  # one row for each split
    order = Window.partitionBy("split").orderBy("h", "id")
    kept = near.withColumn("rn", F.row_number().over(order)).where("rn <= quota").drop("rn", "quota", "h", "most")
    return rows.where(has_picture(F.col("annotations"))).unionByName(kept)


def capped_split(rows: DataFrame, share: float = 0.3, train_cap: int = 30_000, val_cap: int = 10_000) -> DataFrame:
    """``id, source_id, to``: whole sources by hash into val or train, as many records as the caps allow.

    Sources go in order of their hash until a side is full; a source is never torn apart. Only one row for each source is ordered.
    """
    sources = rows.where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n"))
    side = sources.withColumn("to", F.when(bucket(F.col("source_id")) < int(share * 100), "val").otherwise("train")).withColumn("h", F.sha1("source_id"))
    running = F.sum("n").over(Window.partitionBy("to").orderBy("h", "source_id"))
    kept = side.withColumn("upto", running).where(F.col("upto") <= F.when(F.col("to") == "val", val_cap).otherwise(train_cap))
    return rows.select("id", "source_id").join(kept.select("source_id", "to"), "source_id").select("id", "source_id", "to")


def filled_split(rows: DataFrame, share: float = 0.3, train_cap: int = 30_000, val_cap: int = 10_000) -> DataFrame:
    """``id, source_id, to``: each source by hash into val or train, both sides filled to their caps while there are records.

    Sources go in order of their hash. From the source that fills one side on, the others go to the other side; of the source
    that fills a side the first records by id are kept and none goes elsewhere. Only one row for each source is ordered, and of
    those two sources the rows up to the cap.
    """
    cap = F.when(F.col("to") == "val", val_cap).otherwise(train_cap)
    running = F.sum("n").over(Window.partitionBy("to").orderBy("h", "source_id"))
    sources = rows.where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n")).withColumn("h", F.sha1("source_id"))
    side = sources.withColumn("to", F.when(bucket(F.col("source_id")) < int(share * 100), "val").otherwise("train"))
    place = F.struct("h", "source_id")
    full = side.withColumn("upto", running).where(F.col("upto") >= cap).agg(F.min(place).alias("since"), F.min_by("to", place).alias("full"))
    other = F.when(F.coalesce(place > F.col("since"), F.lit(False)), F.when(F.col("full") == "val", "train").otherwise("val")).otherwise(F.col("to"))
    room = (cap - F.col("upto") + F.col("n")).alias("room")
    kept = side.crossJoin(F.broadcast(full)).withColumn("to", other).withColumn("upto", running).select("source_id", "n", "to", room).where("room > 0")  # full is one row
    own = rows.select("id", "source_id").join(kept, "source_id")
    order = Window.partitionBy("source_id").orderBy("id")
    first = own.where("n > room").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max(train_cap, val_cap)).where("rn <= room")
    return own.where("n <= room").select("id", "source_id", "to").union(first.select("id", "source_id", "to"))


def first_picture(annotations: Column) -> Column:
    return F.get(F.filter(annotations, lambda a: F.coalesce(a["category"] == "Picture", F.lit(False))), F.lit(0))["bbox"]


def overfit_candidates(rows: DataFrame, n: int, low: float = 0.02, high: float = 0.80) -> DataFrame:
    """The ``n`` records whose first picture covers nearest to a quarter of the page, of those within the range and DocLayNet's first;
    where fewer than ``n`` are within it, of all records with a picture, whatever their dataset."""
    ratio = F.round(G.area_ratio(first_picture(F.col("annotations")), F.col("width"), F.col("height")), 6)
    sized = rows.where(has_picture(F.col("annotations"))).select("id", "dataset", ratio.alias("ratio")).where("ratio is not null").withColumn("far", F.abs(F.col("ratio") - 0.25))
    fits = sized.where((F.col("ratio") > low) & (F.col("ratio") < high)).withColumn("other", (~F.col("dataset").eqNullSafe(F.lit("doclaynet"))).cast("int"))
    first = fits.orderBy("other", "far", "id").limit(n).withColumn("list", F.lit(0))
    second = sized.orderBy("far", "id").limit(n).withColumn("other", F.lit(0)).withColumn("list", F.lit(1))
    both = first.unionByName(second)  # at most 2 n rows
    enough = F.sum((F.col("list") == 0).cast("int")).over(Window.partitionBy()) >= n
    return both.withColumn("enough", enough).where("(list = 0) = enough").select("id", "dataset", "ratio")


def od_target(annotations: Column, width: Column, height: Column) -> Column:
    """Pictures from top to bottom, left to right, each with its location marks; empty without pictures."""
    pictures = F.filter(annotations, lambda a: F.coalesce(a["category"] == "Picture", F.lit(False)) & (G.validity(a["bbox"], width, height) == "ok"))
    ordered = F.array_sort(F.transform(pictures, lambda a: F.struct(a["bbox"][1].alias("y"), a["bbox"][0].alias("x"), a["bbox"].alias("b"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat(F.lit("Picture"), G.location_tokens(s["b"], width, height))), "")


def detection(truth: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``image, truths, predictions, matched, iou_sum, best``: greedy one-to-one matches per image and the mean best overlap.

    Both sides have image, ord and box. Without truths the mean is 1, without predictions 0.
    """
    pairs = truth.select("image", F.col("ord").alias("g"), F.col("box").alias("t")).join(predicted.select("image", F.col("ord").alias("p"), F.col("box").alias("q")), "image").withColumn("iou", G.iou(F.col("t"), F.col("q")))
    listed = pairs.where(F.col("iou") >= threshold).groupBy("image").agg(F.collect_list(F.struct("iou", "g", "p")).alias("l")).withColumn("m", G.greedy_matches(F.col("l")))
    best = pairs.groupBy("image", "g").agg(F.max("iou").alias("b")).groupBy("image").agg(F.sum("b").alias("b"))
    sides = truth.groupBy("image").agg(F.count("*").alias("truths")).join(predicted.groupBy("image").agg(F.count("*").alias("predictions")), "image", "full").na.fill(0)
    out = sides.join(listed, "image", "left").join(best, "image", "left")
    matched = F.coalesce(F.size("m"), F.lit(0))
    mean = F.when(F.col("truths") == 0, 1.0).otherwise(F.coalesce("b", F.lit(0.0)) / F.col("truths"))
    return out.select("image", "truths", "predictions", matched.alias("matched"), F.coalesce(F.aggregate("m", F.lit(0.0), lambda s, x: s + x["iou"]), F.lit(0.0)).alias("iou_sum"), mean.alias("best"))


def detection_summary(per_image: DataFrame) -> DataFrame:
    """Micro precision, recall and F1, mean matched overlap, mean best overlap and the share of images with 0.8 or more."""
    s = per_image.agg(F.sum("matched").alias("tp"), F.sum("predictions").alias("p"), F.sum("truths").alias("t"), F.sum("iou_sum").alias("i"), F.avg("best").alias("best"), F.avg((F.col("best") >= 0.8).cast("int")).alias("good"))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    precision, recall = ratio("tp", "p"), ratio("tp", "t")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return s.select(F.col("tp").cast("bigint").alias("matched"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(ratio("i", "tp"), 6).alias("mean_iou"), F.round("best", 6).alias("mean_best"), F.round("good", 6).alias("share_good"))


def ema(losses: Column, weight: float = 0.1) -> Column:
    """Exponential mean of an ordered array, begun with its first value; an array as long."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))

    def add(s: Column, x: Column) -> Column:
        new = F.when(s["last"].isNull(), x).otherwise(weight * x + (1 - weight) * s["last"])
        return F.struct(F.array_append(s["out"], new).alias("out"), new.alias("last"))

    return F.aggregate(losses, start, add, lambda s: s["out"])


def quality_of_reading(lines: DataFrame) -> DataFrame:
    """``page, quality`` of lines with text and confidence: confidence, share of sure lines and share of letters and digits, 0 to 1."""
    letters = F.length(F.regexp_replace(F.array_join(F.collect_list("text"), ""), r"[^\p{L}\p{N}]", ""))
    n = F.sum(F.length("text"))
    value = 0.65 * F.avg("confidence") + 0.20 * (1 - F.avg((F.col("confidence") < 0.55).cast("int"))) + 0.15 * F.least(F.lit(1.0), letters / F.greatest(F.lit(1.0), 0.55 * n))
    return lines.where("text is not null and trim(text) <> ''").groupBy("page").agg(F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 6).alias("quality"))


def first_pages(ranking: DataFrame, k: int = 5) -> DataFrame:
    """``question_id, pages``: the first ``k`` different pages in the order of a ranking (question_id, page_number, place)."""
    best = ranking.groupBy("question_id", "page_number").agg(F.min("place").alias("place"))
    placed = best.withColumn("rn", F.row_number().over(Window.partitionBy("question_id").orderBy("place"))).where(F.col("rn") <= k)
    return placed.groupBy("question_id").agg(F.collect_set("page_number").alias("pages"))


def eval_metrics(results: DataFrame) -> DataFrame:
    """One row of shares over ``answerable, sufficient, expected, retrieved, cited, echo, latency``; denominators are at least 1.

    ``p50`` and ``p95`` are the sorted latencies at n // 2 and at 95 n // 100 - 1 of the questions that have one.
    """
    share = lambda hit, of: F.round(F.count_if(hit) / F.greatest(F.count_if(of), F.lit(1)), 6)
    a, s = F.col("answerable"), F.col("sufficient")
    shares = results.agg(
        F.count("*").alias("questions"),
        share(a & F.arrays_overlap("expected", "retrieved"), a).alias("recall"),
        share(~a & ~s, ~a).alias("unanswerable"),
        share(a & ~s, a).alias("false_refusals"),
        F.count_if(s & F.col("echo")).alias("echoes"),
        share(s & (F.size("cited") > 0), s).alias("cited"),
        share(a & s & F.arrays_overlap("expected", "cited"), a & s).alias("citation_precision"),
    )
    times = picked(results, [], "latency", {"p50": F.floor(F.col("n") / 2), "p95": F.greatest(F.floor(F.col("n") * 95 / 100) - 1, F.lit(0))}).select("p50", "p95")
    return shares.join(times)  # two single rows


def calibrated(results: DataFrame, grid: DataFrame) -> DataFrame:
    """The thresholds of a small grid (rerank, margin, strong) that tell answerable questions best; lower ones on ties.

    ``results`` are reduced to counts of equal scores first, so the grid meets distinct scores only; the grid's size is checked.
    """
    if grid.limit(GRID_ROWS + 1).count() > GRID_ROWS:
        raise ValueError("the grid of thresholds is too large")
    bins = results.groupBy(F.round("top", 1).alias("top"), F.round("margin", 1).alias("margin_s"), "answerable").agg(F.count("*").alias("n"))
    said = (F.col("top") >= F.col("rerank")) & ((F.coalesce("margin_s", F.lit(float("-inf"))) >= F.col("margin")) | (F.col("top") >= F.col("strong")))
    pairs = bins.crossJoin(F.broadcast(grid.where("strong >= rerank")))
    scored = pairs.groupBy("rerank", "margin", "strong").agg(F.sum(F.when(F.coalesce(said, F.lit(False)) == F.col("answerable"), F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("n"))
    return scored.orderBy(F.desc("right"), "rerank", "margin", "strong").limit(1).select("rerank", "margin", "strong", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))


def newest(df: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key; ties by all other columns."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(F.col(time), F.struct(*sorted(c for c in df.columns if c not in (key, time))))).alias("r")).select(key, "r.*")


def running_best(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows that are strictly below all rows before them."""
    before = F.min(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).where(F.col("before").isNull() | (F.col(value) < F.col("before"))).drop("before")


def interleaved(lists: DataFrame, per_list: int = 4) -> DataFrame:
    """``query, item, place``: ranked lists merged by position, then by list; an item counts where it comes first."""
    first = lists.where(F.col("position") < per_list).groupBy("query", "item").agg(F.min(F.struct("position", "list")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("at.position", "at.list", "item"))).select("query", "item", "place")


def overfit_passed(share_good: Column, mean_iou: Column, recall: Column, baseline_iou: Column, least: float = 0.75) -> Column:
    """Whether a model has learned its few records by heart: enough images with good boxes, or much better ones than before and most found.
    ``baseline_iou`` is null where none was measured."""
    better = F.coalesce((mean_iou > baseline_iou + 0.15) & (mean_iou >= 0.50), F.lit(False))
    return (share_good >= least) | (better & (recall >= 0.70))


def picture_boxes(item: Column, width: Column, height: Column, picture_ids: tuple[int, ...] = (6, 7)) -> Column:
    """The pictures of a raw record, whatever its form: parallel ids and corner boxes, parallel names and (x, y, w, h) boxes, objects, or
    annotations whose boxes are what they look like. The first form that has a picture counts; the named form's repeats count once."""
    def pairs(names: Column, boxes: Column, form: str) -> Column:
        both = F.arrays_zip(names.alias("n"), boxes.alias("b"))
        hits = F.filter(both, lambda x: F.coalesce(x["n"], F.lit(False)) & x["b"].isNotNull())
        return F.filter(F.transform(hits, lambda x: G.from_box(x["b"], width, height, form)), lambda b: b.isNotNull())

    named = lambda c: F.lower(F.coalesce(c, F.lit(""))) == "picture"
    by_id = pairs(F.transform(item["category_id"], lambda c: c.isin(*picture_ids)), item["bboxes"], "xyxy")
    by_name = F.array_distinct(pairs(F.transform(item["categories"], named), item["bboxes_block"], "xywh"))
    whole = lambda c: F.transform(c, lambda o: F.when(named(F.coalesce(o["label"], o["category"])) | F.coalesce(o["category_id"].isin(*picture_ids), F.lit(False)), True).otherwise(False))
    objects = pairs(whole(item["objects"]), F.transform(item["objects"], lambda o: o["bbox"]), "xyxy")
    other = pairs(whole(item["annotations"]), F.transform(item["annotations"], lambda o: o["bbox"]), "auto")
    some = [F.when(F.size(c) > 0, c) for c in (by_id, by_name, objects, other)]
    return F.coalesce(*some, F.array().cast("array<array<double>>"))


def numbered(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Records whose missing ids are made of dataset and place; the place is that of the row in the table as it is read."""
    place = F.monotonically_increasing_id()
    made = F.concat(F.coalesce(F.nullif(dataset, F.lit("")), F.lit("record")), F.lit("_"), F.lpad(place.cast("string"), 6, "0"))
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.when(F.length(place.cast("string")) > 6, F.concat(F.coalesce(F.nullif(dataset, F.lit("")), F.lit("record")), F.lit("_"), place.cast("string"))).otherwise(made)))


def collected(rows: DataFrame, cap: int, pictures_only: bool = True) -> DataFrame:
    """Of each split up to ``cap`` records, by a stable hash, numbered from 0; those with a picture, or all."""
    fit = rows.where(has_picture(F.col("annotations"))) if pictures_only else rows
    order = Window.partitionBy("split").orderBy(F.xxhash64("id"), "id")
    return fit.withColumn("number", F.row_number().over(order) - 1).where(F.col("number") < cap)


def detection_report(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 at overlaps of 0.5 and 0.75, overlaps of :func:`detection_summary` at 0.5, and boxes for each image."""
    half = detection(truth, predicted, 0.5)
    low = detection_summary(half).select(*[F.col(c).alias(f"{c}_50") for c in ("precision", "recall", "f1")], "mean_iou", "mean_best", "share_good")
    high = detection_summary(detection(truth, predicted, 0.75)).select(*[F.col(c).alias(f"{c}_75") for c in ("precision", "recall", "f1")])
    sizes = half.agg(F.count("*").alias("images"), F.round(F.avg("truths"), 6).alias("truths"), F.round(F.avg("predictions"), 6).alias("predictions"))
    return low.join(high).join(sizes)  # three single rows


def inspection(rows: DataFrame) -> DataFrame:
    """``dataset, measure, least, middle, most`` of the images' width and height and of the share of the page of valid pictures, middles being upper
    medians, with ``pictures``, ``full`` (over 0.95 of the page) and ``partial`` (over 0.05) ones and ``sources`` in every row."""
    named = rows.withColumn("dataset", F.coalesce("dataset", F.lit("none")))
    valid = boxes(named).where("category = 'Picture' and state = 'ok'").select("dataset", F.round(G.area_ratio(F.col("box"), F.col("width"), F.col("height")), 6).alias("share"))
    share = F.col("share")
    counts = valid.groupBy("dataset").agg(F.count("*").alias("pictures"), F.count_if(share > 0.95).alias("full"), F.count_if((share > 0.05) & (share <= 0.95)).alias("partial"))
    sources = named.groupBy("dataset").agg(F.count_distinct("source_id").alias("sources"))
    sides = named.select("dataset", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in ("width", "height")])).alias("m")).select("dataset", "m.*")
    measured = upper_median(sides.union(valid.select("dataset", F.lit("share"), "share")), ["dataset", "measure"], "v")
    return measured.join(sources, "dataset").join(counts, "dataset", "left").na.fill(0, ["pictures", "full", "partial"])
