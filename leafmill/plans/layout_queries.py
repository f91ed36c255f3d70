"""Queries over layouts, manifests, registries and results, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.durable import cut
from leafmill.functions import geometry as G
from leafmill.functions import records
from leafmill.functions import text as T
from leafmill.operators import curation as C
from leafmill.operators import figures as V
from leafmill.operators import retrieval as R
from leafmill.plans import text_queries as Q
from leafmill.sources.tables import table

SQL: dict[str, str] = {}
_REC = """rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(image_path, ''), split) AS rn FROM (SELECT id, nullif(lower(trim(dataset)), '') AS dataset,
    CASE WHEN lower(trim(split)) IN ('val', 'validation') THEN 'val' WHEN lower(trim(split)) = 'test' THEN 'test' ELSE 'train' END AS split, nullif(lower(trim(source_id)), '') AS source_id,
    image_path, width, height, coalesce(annotations, []) AS annotations FROM dataset_manifest WHERE id IS NOT NULL)) WHERE rn = 1)"""
_BOX = f"""{_REC}, b0 AS (SELECT id, dataset, split, width AS w, height AS h, a.category AS category, a.bbox AS b, i FROM (SELECT id, dataset, split, width, height, unnest(annotations) AS a, generate_subscripts(annotations, 1) - 1 AS i FROM rec)),
    box AS (SELECT *, CASE WHEN b IS NULL OR len(b) <> 4 THEN 'malformed' WHEN b[3] <= b[1] OR b[4] <= b[2] THEN 'not_ordered'
        WHEN least(greatest(b[3], 0), w) <= least(greatest(b[1], 0), w) OR least(greatest(b[4], 0), h) <= least(greatest(b[2], 0), h) THEN 'outside' ELSE 'ok' END AS state FROM b0)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return C.records(table(spark, d, "dataset_manifest"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return C.boxes(_records(spark, d))


def _of(spark: SparkSession, d: str, category: str, name: str) -> DataFrame:
    rows = _boxes(spark, d).where((F.col("category") == category) & (F.col("state") == "ok"))
    return rows.select(F.col("id").alias("page"), F.col("ord").alias(name), "box")


def flt_bbox_validate(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by what is wrong with them."""
    return _boxes(spark, d).groupBy("dataset", F.coalesce("category", F.lit("none")).alias("category"), "state").agg(F.count("*").alias("boxes"))


SQL["flt_bbox_validate"] = f"WITH {_BOX} SELECT dataset, coalesce(category, 'none') AS category, state, count(*) AS boxes FROM box GROUP BY 1, 2, 3"


def flt_trainable(spark: SparkSession, d: str) -> DataFrame:
    """Records that can be trained on."""
    return C.trainable(_records(spark, d)).select("id", "split")


SQL["flt_trainable"] = f"""WITH {_BOX}, s AS (SELECT id, bool_or(coalesce(category = 'Picture', false)) AS pic, bool_and(state = 'ok') AS fine FROM box GROUP BY 1)
    SELECT rec.id, split FROM rec LEFT JOIN s USING (id) WHERE NOT coalesce(pic, false) OR fine"""


def agg_validation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records per dataset and split."""
    return C.counts(_records(spark, d))


SQL["agg_validation_counts"] = f"""WITH {_BOX}, s AS (SELECT id, bool_or(coalesce(category = 'Picture', false)) AS pic, count(*) FILTER (state <> 'ok') AS bad FROM box GROUP BY 1)
    SELECT dataset, split, count(*) AS records, count(*) FILTER (NOT coalesce(pic, false)) AS no_picture, coalesce(sum(bad), 0)::BIGINT AS invalid_boxes FROM rec LEFT JOIN s USING (id) GROUP BY 1, 2"""


def agg_source_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Sources in two splits."""
    return C.source_overlap(_records(spark, d))


SQL["agg_source_overlap"] = f"""WITH {_REC}, s AS (SELECT source_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM rec WHERE source_id IS NOT NULL GROUP BY 1)
    SELECT count(*) FILTER (a AND b) AS train_val, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS val_test FROM s"""


def agg_upper_median(spark: SparkSession, d: str) -> DataFrame:
    """Least, upper median and largest share of the page that boxes cover, by category."""
    rows = _boxes(spark, d).where("state = 'ok'").select("category", F.round(G.area_ratio(F.col("box"), F.col("width"), F.col("height")), 6).alias("ratio"))
    return C.upper_median(rows.where("category is not null"), ["category"], "ratio")


SQL["agg_upper_median"] = f"""WITH {_BOX}, r AS (SELECT category, round((b[3] - b[1]) * (b[4] - b[2]) / greatest(w * h, 1), 6) AS ratio FROM box WHERE state = 'ok' AND category IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ratio) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM r)
    SELECT category, min(ratio) AS least, max(CASE WHEN i = n // 2 THEN ratio END) AS middle, max(ratio) AS most FROM p GROUP BY 1"""


def agg_dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's validation in one row."""
    return C.report(_records(spark, d))


SQL["agg_dataset_report"] = f"""WITH {_BOX}, s AS (SELECT source_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM rec WHERE source_id IS NOT NULL GROUP BY 1),
    x AS (SELECT (SELECT count(*) FROM rec) AS records, (SELECT count(*) FILTER (state <> 'ok') FROM box) AS invalid_boxes, (SELECT count(DISTINCT split) FROM rec) AS splits,
        (SELECT count(*) FROM (SELECT image_path FROM rec WHERE image_path IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated_paths, (SELECT count(*) FILTER (a AND b) + count(*) FILTER (a AND c) + count(*) FILTER (b AND c) FROM s) AS shared_sources)
    SELECT *, CASE WHEN shared_sources > 0 OR splits < 3 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM x"""


def agg_quota(spark: SparkSession, d: str) -> DataFrame:
    """How many records without picture each split may keep of 100."""
    rows = _records(spark, d)
    return C.quotas(rows.where(~C.has_picture(F.col("annotations"))), 100)


SQL["agg_quota"] = f"""WITH {_REC}, n AS (SELECT split, count(*) AS n FROM rec WHERE len(list_filter(annotations, lambda a: a.category = 'Picture')) = 0 GROUP BY 1),
    q AS (SELECT split, n, round_even(100.0::DOUBLE * n / sum(n) OVER (), 0)::BIGINT AS q, row_number() OVER (ORDER BY split DESC) = 1 AS l FROM n),
    r AS (SELECT *, coalesce(sum(q) OVER (ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
    SELECT split, n, least(CASE WHEN l THEN 100 - before ELSE q END, n)::BIGINT AS quota FROM r"""


def downsample_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Records per split and kind after thinning those without a picture to 100."""
    kept = C.fewer_negatives(_records(spark, d), 100)
    return kept.groupBy("split", C.has_picture(F.col("annotations")).alias("picture")).agg(F.count("*").alias("records"))


SQL["downsample_negatives"] = f"""WITH {_REC}, k AS (SELECT split, len(list_filter(annotations, lambda a: a.category = 'Picture')) > 0 AS picture FROM rec), n AS (SELECT split, count(*) AS n FROM k WHERE NOT picture GROUP BY 1),
    q AS (SELECT split, n, round_even(100.0::DOUBLE * n / sum(n) OVER (), 0)::BIGINT AS q, row_number() OVER (ORDER BY split DESC) = 1 AS l FROM n),
    r AS (SELECT *, coalesce(sum(q) OVER (ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
    SELECT split, true AS picture, count(*) AS records FROM k WHERE picture GROUP BY 1 UNION ALL SELECT split, false, least(CASE WHEN l THEN 100 - before ELSE q END, n)::BIGINT FROM r"""


def split_hash(spark: SparkSession, d: str) -> DataFrame:
    """A side for each source by a stable hash."""
    s = _records(spark, d).where("source_id is not null").select("source_id").distinct()
    return s.select("source_id", F.when(C.bucket(F.col("source_id")) < 30, "val").otherwise("train").alias("to"))


SQL["split_hash"] = f"""WITH {_REC} SELECT DISTINCT source_id, CASE WHEN ('0x' || substr(sha1(source_id), 1, 8))::BIGINT % 100 < 30 THEN 'val' ELSE 'train' END AS "to" FROM rec WHERE source_id IS NOT NULL"""


def split_capped(spark: SparkSession, d: str) -> DataFrame:
    """Whole sources to either side as far as the caps allow."""
    return C.capped_split(_records(spark, d), train_cap=400, val_cap=200).select("id", "to")


SQL["split_capped"] = f"""WITH {_REC}, s AS (SELECT source_id, count(*) AS n, CASE WHEN ('0x' || substr(sha1(source_id), 1, 8))::BIGINT % 100 < 30 THEN 'val' ELSE 'train' END AS t FROM rec WHERE source_id IS NOT NULL GROUP BY 1),
    k AS (SELECT *, sum(n) OVER (PARTITION BY t ORDER BY sha1(source_id), source_id) AS upto FROM s) SELECT id, t AS "to" FROM rec JOIN k USING (source_id) WHERE upto <= CASE WHEN t = 'val' THEN 200 ELSE 400 END"""


def split_filled(spark: SparkSession, d: str) -> DataFrame:
    """Both sides filled up to the caps of production, overflow to the other side."""
    return C.filled_split(_records(spark, d)).select("id", "to")


def split_leak_fix(spark: SparkSession, d: str) -> DataFrame:
    """Splits after moving validation records of leaking sources to train."""
    return C.repaired_leaks(_records(spark, d)).select("id", "split")


SQL["split_leak_fix"] = f"""WITH {_REC}, l AS (SELECT source_id FROM rec WHERE source_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1) SELECT id, CASE WHEN split = 'val' AND source_id IN (SELECT source_id FROM l) THEN 'train' ELSE split END AS split FROM rec"""


def top_overfit(spark: SparkSession, d: str) -> DataFrame:
    """Twenty records fit for an overfitting test."""
    return C.overfit_candidates(_records(spark, d), 20)


SQL["top_overfit"] = f"""WITH {_BOX}, f AS (SELECT * FROM (SELECT id, dataset, b, w, h, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM box WHERE category = 'Picture') WHERE rn = 1),
    z AS (SELECT id, dataset, round(greatest(b[3] - b[1], 0) * greatest(b[4] - b[2], 0) / greatest(w * h, 1), 6) AS ratio FROM f), k AS (SELECT * FROM z WHERE ratio IS NOT NULL),
    a AS (SELECT * FROM k WHERE ratio > 0.02 AND ratio < 0.8 ORDER BY dataset IS DISTINCT FROM 'doclaynet', abs(ratio - 0.25), id LIMIT 20), o AS (SELECT * FROM k ORDER BY abs(ratio - 0.25), id LIMIT 20)
    SELECT id, dataset, ratio FROM a WHERE (SELECT count(*) FROM a) >= 20 UNION ALL SELECT id, dataset, ratio FROM o WHERE (SELECT count(*) FROM a) < 20"""


def geo_florence_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as location marks."""
    rows = _boxes(spark, d).where("state = 'ok'")
    return rows.select("id", "ord", G.location_tokens(F.col("box"), F.col("width"), F.col("height")).alias("marks"))


_LOC = lambda i, s: f"'<loc_' || least(greatest(floor(b[{i}] / ({s} / 1000.0::DOUBLE)), 0), 999)::BIGINT || '>'"
SQL["geo_florence_tokens"] = f"WITH {_BOX} SELECT id, i::INT AS ord, {_LOC(1, 'w')} || {_LOC(2, 'h')} || {_LOC(3, 'w')} || {_LOC(4, 'h')} AS marks FROM box WHERE state = 'ok'"


def geo_od_target(spark: SparkSession, d: str) -> DataFrame:
    """Training targets of the records."""
    return _records(spark, d).select("id", C.od_target(F.col("annotations"), F.col("width"), F.col("height")).alias("target"))


SQL["geo_od_target"] = f"""WITH {_BOX}, t AS (SELECT id, string_agg('Picture' || {_LOC(1, 'w')} || {_LOC(2, 'h')} || {_LOC(3, 'w')} || {_LOC(4, 'h')}, '' ORDER BY b[2], b[1], b[3], b[4]) AS target FROM box WHERE state = 'ok' AND category = 'Picture' GROUP BY 1)
    SELECT rec.id, coalesce(target, '') AS target FROM rec LEFT JOIN t USING (id)"""


def geo_box_convert(spark: SparkSession, d: str) -> DataFrame:
    """Boxes read as corner, width and height, in corner form."""
    rows = _boxes(spark, d).where("box is not null").withColumn("c", G.from_xywh(F.col("box"), F.col("width"), F.col("height"))).where("c is not null")
    return rows.select("id", "ord", *[F.round(F.col("c")[i], 4).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


SQL["geo_box_convert"] = f"""WITH {_BOX}, s AS (SELECT id, i, w, h, CASE WHEN list_max(b) <= 1.5 THEN [b[1] * w, b[2] * h, b[3] * w, b[4] * h] ELSE b END AS s FROM box WHERE b IS NOT NULL AND len(b) = 4),
    c AS (SELECT id, i::INT AS ord, least(greatest(s[1], 0), w) AS x1, least(greatest(s[2], 0), h) AS y1, least(greatest(s[1] + s[3], 0), w) AS x2, least(greatest(s[2] + s[4], 0), h) AS y2 FROM s)
    SELECT id, ord, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM c WHERE x2 > x1 AND y2 > y1"""


def geo_iou(spark: SparkSession, d: str) -> DataFrame:
    """Pictures and tables of a page that overlap."""
    pairs = _of(spark, d, "Picture", "picture").join(_of(spark, d, "Table", "tab").withColumnRenamed("box", "t"), "page")
    return pairs.withColumn("iou", F.round(G.iou(F.col("box"), F.col("t")), 6)).where("iou > 0").select("page", "picture", "tab", "iou")


_ISECT = "greatest(least(p.b[3], t.b[3]) - greatest(p.b[1], t.b[1]), 0) * greatest(least(p.b[4], t.b[4]) - greatest(p.b[2], t.b[2]), 0)"
_AREA = lambda a: f"({a}.b[3] - {a}.b[1]) * ({a}.b[4] - {a}.b[2])"
SQL["geo_iou"] = f"""WITH {_BOX}, x AS (SELECT p.id AS page, p.i::INT AS picture, t.i::INT AS tab, round({_ISECT} / ({_AREA('p')} + {_AREA('t')} - {_ISECT}), 6) AS iou FROM box p JOIN box t ON p.id = t.id AND p.category = 'Picture' AND t.category = 'Table' AND p.state = 'ok' AND t.state = 'ok')
    SELECT * FROM x WHERE iou > 0"""


def join_nearest_caption(spark: SparkSession, d: str) -> DataFrame:
    """The nearest caption of every picture, -1 without one."""
    out = V.nearest_captions(_of(spark, d, "Picture", "figure"), _of(spark, d, "Caption", "caption"))
    return out.select("page", "figure", F.coalesce("caption", F.lit(-1)).alias("caption"), F.coalesce(F.round("gap", 4), F.lit(-1.0)).alias("gap"))


_OVER = "greatest(least(f.b[3], c.b[3]) - greatest(f.b[1], c.b[1]), 0) / greatest(least(f.b[3] - f.b[1], c.b[3] - c.b[1]), 1)"
SQL["join_nearest_caption"] = f"""WITH {_BOX}, f AS (SELECT * FROM box WHERE category = 'Picture' AND state = 'ok'), c AS (SELECT * FROM box WHERE category = 'Caption' AND state = 'ok'),
    g AS (SELECT f.id, f.i AS figure, c.i AS caption, CASE WHEN c.b[2] >= f.b[4] THEN c.b[2] - f.b[4] WHEN c.b[4] <= f.b[2] THEN f.b[2] - c.b[4] ELSE 0 END AS gap FROM f JOIN c ON f.id = c.id AND {_OVER} >= 0.3),
    n AS (SELECT *, row_number() OVER (PARTITION BY id, figure ORDER BY gap, caption) AS rn FROM g WHERE gap <= 90)
    SELECT f.id AS page, f.i::INT AS figure, coalesce(caption, -1)::INT AS caption, coalesce(round(gap, 4), -1.0)::DOUBLE AS gap FROM f LEFT JOIN n ON n.id = f.id AND n.figure = f.i AND rn = 1"""


def join_nearby_visuals(spark: SparkSession, d: str) -> DataFrame:
    """What stands near each caption, not beyond the next one."""
    pictures = _of(spark, d, "Picture", "figure").union(_of(spark, d, "Table", "figure"))
    return V.nearby_visuals(_of(spark, d, "Caption", "caption"), pictures)


SQL["join_nearby_visuals"] = f"""WITH {_BOX}, c AS (SELECT id, i, b FROM box WHERE category = 'Caption' AND state = 'ok'), v AS (SELECT id, b FROM box WHERE category IN ('Picture', 'Table') AND state = 'ok'),
    s AS (SELECT c.id, c.i, any_value(c.b) AS b, max(CASE WHEN o.b[4] < c.b[2] THEN o.b[4] END) AS above, min(CASE WHEN o.b[2] > c.b[4] THEN o.b[2] END) AS below FROM c JOIN c o ON o.id = c.id GROUP BY 1, 2)
    SELECT s.id AS page, s.i::INT AS caption, min(v.b[1]) AS x1, min(v.b[2]) AS y1, max(v.b[3]) AS x2, max(v.b[4]) AS y2, count(*) AS visuals FROM s JOIN v ON v.id = s.id AND abs(v.b[1] - s.b[1]) <= 350 AND
    ((v.b[4] <= s.b[2] AND s.b[2] - v.b[4] <= 220 AND (above IS NULL OR v.b[2] >= above)) OR (v.b[2] >= s.b[4] AND v.b[2] - s.b[4] <= 220 AND (below IS NULL OR v.b[4] <= below))) GROUP BY 1, 2"""


def join_containment(spark: SparkSession, d: str) -> DataFrame:
    """Captions that lie wholly in a table or picture."""
    outer = _of(spark, d, "Table", "outer").union(_of(spark, d, "Picture", "outer"))
    return V.contained(outer, _of(spark, d, "Caption", "inner"))


SQL["join_containment"] = f"""WITH {_BOX} SELECT o.id AS page, o.i::INT AS "outer", count(*) AS n FROM box o JOIN box c ON o.id = c.id AND o.category IN ('Table', 'Picture') AND c.category = 'Caption' AND o.state = 'ok' AND c.state = 'ok'
    AND c.b[1] >= o.b[1] AND c.b[2] >= o.b[2] AND c.b[3] <= o.b[3] AND c.b[4] <= o.b[4] GROUP BY 1, 2"""


def join_anti_claimed(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that cut no table."""
    return V.unclaimed(_of(spark, d, "Picture", "figure"), _of(spark, d, "Table", "tab")).select("page", "figure")


SQL["join_anti_claimed"] = f"""WITH {_BOX} SELECT p.id AS page, p.i::INT AS figure FROM box p WHERE category = 'Picture' AND state = 'ok' AND NOT EXISTS (SELECT 1 FROM box t WHERE t.id = p.id AND t.category = 'Table' AND t.state = 'ok' AND {_ISECT} > 0)"""


def flt_overlap_suppression(spark: SparkSession, d: str) -> DataFrame:
    """How many boxes of a page are left when those that overlap earlier ones too much are dropped."""
    boxes = _boxes(spark, d).where("state = 'ok'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "box"))).alias("l"))
    return boxes.select("id", F.size("l").alias("boxes"), F.size(V.suppress_overlaps(F.transform("l", lambda x: x["box"]))).alias("kept"))


SQL["flt_overlap_suppression"] = f"""WITH {_BOX}, l AS (SELECT id, list(b ORDER BY i) AS l FROM box WHERE state = 'ok' GROUP BY 1),
    k AS (SELECT id, len(l) AS n, list_reduce(list_transform(l, lambda x: [x]), lambda s, e: CASE WHEN len(list_filter(s, lambda k: greatest(least(k[3], e[1][3]) - greatest(k[1], e[1][1]), 0) * greatest(least(k[4], e[1][4]) - greatest(k[2], e[1][2]), 0)
        > 0.35 * least((k[3] - k[1]) * (k[4] - k[2]), (e[1][3] - e[1][1]) * (e[1][4] - e[1][2])))) > 0 THEN s ELSE list_append(s, e[1]) END) AS kept FROM l)
    SELECT id, n::INT AS boxes, len(kept)::INT AS kept FROM k"""


def agg_detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Pictures as truths against tables as predictions, in one row."""
    truth, said = (_of(spark, d, c, "ord").withColumnRenamed("page", "image") for c in ("Picture", "Table"))
    return C.detection_summary(C.detection(truth, said, 0.1))


def _detection_sql(limit: float, name: str = "z") -> str:
    text = f"""p AS (SELECT * FROM box WHERE category = 'Picture' AND state = 'ok'), t AS (SELECT * FROM box WHERE category = 'Table' AND state = 'ok'),
    x AS (SELECT p.id, p.i AS g, t.i AS q, CASE WHEN {_AREA('p')} + {_AREA('t')} - {_ISECT} > 0 THEN {_ISECT} / ({_AREA('p')} + {_AREA('t')} - {_ISECT}) ELSE 0 END AS iou FROM p JOIN t ON p.id = t.id),
    m AS (SELECT id, list_reduce(list({{'iou': iou, 'g': g, 'q': q, 'gs': []::BIGINT[], 'qs': []::BIGINT[], 's': 0.0::DOUBLE}} ORDER BY iou DESC, g DESC, q DESC), lambda s, e: CASE WHEN list_contains(s.gs, e.g) OR list_contains(s.qs, e.q) THEN s
        ELSE {{'iou': 0.0::DOUBLE, 'g': s.g, 'q': s.q, 'gs': list_append(s.gs, e.g), 'qs': list_append(s.qs, e.q), 's': s.s + e.iou}} END, {{'iou': 0.0::DOUBLE, 'g': 0, 'q': 0, 'gs': []::BIGINT[], 'qs': []::BIGINT[], 's': 0.0::DOUBLE}}) AS m FROM x WHERE iou >= {limit} GROUP BY 1),
    b AS (SELECT id, sum(b) AS b FROM (SELECT id, g, max(iou) AS b FROM x GROUP BY 1, 2) GROUP BY 1), pn AS (SELECT id, count(*) AS n FROM p GROUP BY 1), tn AS (SELECT id, count(*) AS n FROM t GROUP BY 1),
    r AS (SELECT coalesce(pn.n, 0) AS truths, coalesce(tn.n, 0) AS predictions, coalesce(len(m.gs), 0) AS matched, coalesce(m.s, 0.0) AS iou_sum, CASE WHEN coalesce(pn.n, 0) = 0 THEN 1.0 ELSE coalesce(b, 0.0) / pn.n END AS best
        FROM (SELECT id FROM p UNION SELECT id FROM t) i LEFT JOIN pn ON pn.id = i.id LEFT JOIN tn ON tn.id = i.id LEFT JOIN m ON m.id = i.id LEFT JOIN b ON b.id = i.id),
    s AS (SELECT sum(matched) AS tp, sum(predictions) AS pr, sum(truths) AS tr, sum(iou_sum) AS i, avg(best) AS best, avg((best >= 0.8)::INT) AS good FROM r), {name} AS (SELECT *, tp / greatest(pr, 1) AS a, tp / greatest(tr, 1) AS c FROM s)"""
    return text


SQL["agg_detection_metrics"] = f"""WITH {_BOX}, {_detection_sql(0.1)}
    SELECT tp::BIGINT AS matched, round(a, 6) AS precision, round(c, 6) AS recall, round(CASE WHEN a + c > 0 THEN 2 * a * c / (a + c) ELSE 0 END, 6) AS f1, round(i / greatest(tp, 1), 6) AS mean_iou, round(best, 6) AS mean_best, round(good, 6) AS share_good FROM z"""


def agg_detection_report(spark: SparkSession, d: str) -> DataFrame:
    """Pictures as truths against tables as predictions at the two usual overlaps."""
    truth, said = (_of(spark, d, c, "ord").withColumnRenamed("page", "image") for c in ("Picture", "Table"))
    return C.detection_report(truth, said)


_AT = lambda limit, n: f"(WITH {_detection_sql(limit)} SELECT z.*, round(a, 6) AS precision_{n}, round(c, 6) AS recall_{n}, round(CASE WHEN a + c > 0 THEN 2 * a * c / (a + c) ELSE 0 END, 6) AS f1_{n}, (SELECT count(*) FROM r) AS images, (SELECT avg(truths) FROM r) AS ts, (SELECT avg(predictions) FROM r) AS ps FROM z)"
SQL["agg_detection_report"] = f"""WITH {_BOX} SELECT precision_50, recall_50, f1_50, round(l.i / greatest(l.tp, 1), 6) AS mean_iou, round(l.best, 6) AS mean_best, round(l.good, 6) AS share_good, precision_75, recall_75, f1_75, l.images, round(l.ts, 6) AS truths, round(l.ps, 6) AS predictions
    FROM {_AT(0.5, 50)} l, {_AT(0.75, 75)} h"""


def agg_inspection(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the images and pictures of each dataset."""
    return C.inspection(_records(spark, d))


SQL["agg_inspection"] = f"""WITH {_BOX}, v AS (SELECT coalesce(dataset, 'none') AS dataset, b, round((b[3] - b[1]) * (b[4] - b[2]) / greatest(w * h, 1), 6) AS share FROM box WHERE state = 'ok' AND category = 'Picture'),
    c AS (SELECT dataset, count(*) AS pictures, count(*) FILTER (share > 0.95) AS "full", count(*) FILTER (share > 0.05 AND share <= 0.95) AS partial FROM v GROUP BY 1), q AS (SELECT coalesce(dataset, 'none') AS dataset, count(DISTINCT source_id) AS sources FROM rec GROUP BY 1),
    m AS (SELECT coalesce(dataset, 'none') AS dataset, 'width' AS measure, width::DOUBLE AS x FROM rec WHERE width IS NOT NULL UNION ALL SELECT coalesce(dataset, 'none'), 'height', height FROM rec WHERE height IS NOT NULL UNION ALL SELECT dataset, 'share', share FROM v),
    o AS (SELECT *, row_number() OVER (PARTITION BY dataset, measure ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY dataset, measure) AS n FROM m)
    SELECT dataset, measure, min(x) AS least, max(CASE WHEN i = n // 2 THEN x END) AS middle, max(x) AS most, coalesce(any_value(pictures), 0) AS pictures, coalesce(any_value("full"), 0) AS "full", coalesce(any_value(partial), 0) AS partial, any_value(sources) AS sources FROM o LEFT JOIN c USING (dataset) JOIN q USING (dataset) GROUP BY 1, 2"""


def agg_best_iou(spark: SparkSession, d: str) -> DataFrame:
    """Mean best overlap of each image."""
    truth, said = (_of(spark, d, c, "ord").withColumnRenamed("page", "image") for c in ("Picture", "Table"))
    return C.detection(truth, said).select("image", F.round("best", 6).alias("best"))


SQL["agg_best_iou"] = f"""WITH {_BOX}, p AS (SELECT * FROM box WHERE category = 'Picture' AND state = 'ok'), t AS (SELECT * FROM box WHERE category = 'Table' AND state = 'ok'),
    m AS (SELECT p.id, p.i, max({_ISECT} / ({_AREA('p')} + {_AREA('t')} - {_ISECT})) AS b FROM p JOIN t ON p.id = t.id GROUP BY 1, 2), s AS (SELECT id, sum(b) AS b FROM m GROUP BY 1), n AS (SELECT id, count(*) AS n FROM p GROUP BY 1)
    SELECT i.id AS image, round(CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(b, 0) / n END, 6) AS best FROM (SELECT id FROM p UNION SELECT id FROM t) i LEFT JOIN n ON n.id = i.id LEFT JOIN s ON s.id = i.id"""


def figure_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Figure mentions of the pages as normalised figures, merged for each page."""
    lines = Q.C.page_lines(table(spark, d, "book_pages")).withColumn("label", F.regexp_extract("raw", r"(?i)\b(?:Figure|Fig\.?|Table)\s*\d+(?:\.\d+)?", 0)).where("label <> ''")
    rows = lines.select(F.concat_ws(":", "book_id", F.col("page_number").cast("string")).alias("page"), F.col("line_no").alias("ord"), "label", F.lit("text").alias("source_type"), F.col("raw").alias("caption"))
    merged = V.merged(rows.withColumn("number", V.normalized_id(F.lit(None).cast("string"), F.col("label"), F.col("caption"))))
    return merged.withColumn("kind", V.figure_type(F.col("label"), F.col("caption"), F.col("source_type")))


_NORMAL = rf"""{Q._PAGES}, nl AS (SELECT book_id || ':' || page_number AS page, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, trim(unnest(string_split(text, chr(10)))) AS raw FROM pages),
    nm AS (SELECT *, regexp_extract(raw, '(?i)\b(?:Figure|Fig\.?|Table)\s*\d+(?:\.\d+)?') AS label FROM nl),
    nn AS (SELECT *, CASE WHEN NOT regexp_matches(label, '(?i)\b(?:Figure|Fig\.?)\s+\.') AND NOT (contains(lower(label || ' ' || raw), 'activity') AND NOT regexp_matches(lower(label || ' ' || raw), '\b(?:figure|fig\.?|table)\s+\d'))
        THEN nullif(regexp_extract(trim(regexp_replace(label, '(?i)^(?:Figure|Fig\.?|Table|Activity)\s*', '')), '(\d+(?:\.\d+)?(?:\.[a-zA-Z])?)', 1), '') END AS number FROM nm WHERE label <> ''),
    ng AS (SELECT page, number, min(ord) AS ord, arg_min(label, ord) AS label, list_reduce(list(raw ORDER BY ord, raw), lambda s, c: CASE WHEN contains(s, c) THEN s ELSE s || ' ' || c END) AS caption FROM nn WHERE number IS NOT NULL GROUP BY 1, 2),
    fn AS (SELECT page, number, ord::INT AS ord, label, 'text' AS source_type, caption, CASE WHEN contains(lower(label || ' ' || caption), 'table') THEN 'table' WHEN regexp_matches(lower(label || ' ' || caption), 'formula|equation') THEN 'formula' ELSE 'figure' END AS kind FROM ng)"""
SQL["figure_normalize"] = f"WITH {_NORMAL} SELECT * FROM fn"


def _figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures of all pages with what stands around their mentions, made once; keywords are the figure's terms."""
    figures = figure_normalize(spark, d).withColumn("book_id", F.split("page", ":")[0])
    pages = Q.C.page_texts(table(spark, d, "book_pages")).groupBy("book_id", "page_number").agg(F.max("text").alias("page_text")).select(F.concat_ws(":", "book_id", F.col("page_number").cast("string")).alias("page"), "page_text")
    held = figures.join(pages, "page").withColumn("windows", V.mention_windows(F.col("page_text"), F.col("number")))
    labels = F.filter(F.split("caption", r"\s+"), lambda w: F.length(w) > 6)
    return held.select("book_id", "page", "number", "label", "caption", "windows", records.nearby_context(F.col("page_text"), F.col("label")).alias("context"), T.terms(F.col("caption")).alias("keywords"), labels.alias("labels_inside"))


def figure_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The best figures of the questions' books for each question."""
    asked = table(spark, d, "qa_golden").select(F.col("id").alias("query_id"), F.col("book").alias("book_id"), "question")
    figures = _figures(spark, d).withColumn("figure", F.concat_ws("-", "page", "number"))
    return V.top_figures(V.relevant(figures, asked))


def join_explicit_reference(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and the figures of their page that they name."""
    chunks = Q._docs(spark, d).select("chunk_id", F.concat_ws(":", "book_id", F.col("page_number").cast("string")).alias("page"), F.explode(T.figure_refs(F.col("text"))).alias("number"))
    return chunks.join(figure_normalize(spark, d).select("page", "number", "kind"), ["page", "number"]).select("chunk_id", "number", "kind")


SQL["join_explicit_reference"] = rf"""WITH {_NORMAL}, {Q._DOCS}, r AS (SELECT DISTINCT chunk_id, book_id || ':' || page_number AS page, unnest(regexp_extract_all(text, '(?i)\b(?:Fig(?:ure)?\.?|Table)\s*(\d+(?:\.\d+)?)', 1)) AS number FROM docs)
    SELECT chunk_id, number, kind FROM r JOIN fn USING (page, number)"""


def win_margin(spark: SparkSession, d: str) -> DataFrame:
    """How far the best chunk of a question stands before the next one."""
    scored = R.scores(Q._index(spark, d), Q._questions(spark, d), 2)
    order = Window.partitionBy("question_id").orderBy(F.desc("bm25"), "chunk_id")
    rows = scored.withColumn("next", F.lead("bm25").over(order)).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return rows.select("question_id", "chunk_id", F.round(F.when(F.col("next").isNull(), 100.0).otherwise(F.col("bm25") - F.col("next")), 6).alias("margin"))


SQL["win_margin"] = f"""WITH {Q._SCORES}, m AS (SELECT *, lead(bm25) OVER (PARTITION BY question_id ORDER BY bm25 DESC, chunk_id) AS nx, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, chunk_id) AS rn FROM sc)
    SELECT question_id, chunk_id, round(CASE WHEN nx IS NULL THEN 100.0 ELSE bm25 - nx END, 6) AS margin FROM m WHERE rn = 1"""


def set_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings of a question merged by position."""
    scored = R.scores(Q._index(spark, d), Q._questions(spark, d), 4)
    lists = [R.ranked(scored.where(F.col(s) > 0), s, 4).select(F.col("question_id").alias("query"), F.col("chunk_id").alias("item"), F.col("rank").alias("position"), F.lit(i).alias("list")) for i, s in enumerate(("bm25", "cosine"))]
    return C.interleaved(lists[0].union(lists[1]))


SQL["set_interleave"] = f"""WITH {Q._SCORES}, l AS (SELECT question_id AS query, chunk_id AS item, rank AS position, 0 AS list FROM rb WHERE rank < 4 UNION ALL SELECT question_id, chunk_id, rank, 1 FROM rc WHERE rank < 4),
    f AS (SELECT *, row_number() OVER (PARTITION BY query, item ORDER BY position, list) AS rn FROM l) SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY position, list, item)::INT AS place FROM f WHERE rn = 1"""


def set_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    """Sources that links name but no record has."""
    links = table(spark, d, "source_links")
    key = lambda a, b: F.concat_ws("/", F.lower(F.trim(F.col(a))), F.lower(F.trim(F.col(b)))).alias("source")
    named = links.select(key("dataset_a", "source_a")).union(links.select(key("dataset_b", "source_b")))
    return named.distinct().join(table(spark, d, "dataset_manifest").select(key("dataset", "source_id")).distinct(), "source", "left_anti")


SQL["set_unreferenced"] = """SELECT lower(trim(dataset_a)) || '/' || lower(trim(source_a)) AS source FROM source_links UNION SELECT lower(trim(dataset_b)) || '/' || lower(trim(source_b)) FROM source_links
    EXCEPT SELECT lower(trim(dataset)) || '/' || lower(trim(source_id)) FROM dataset_manifest"""


def join_semi_leaky(spark: SparkSession, d: str) -> DataFrame:
    """Records whose source stands in several splits."""
    rows = _records(spark, d)
    leaky = rows.where("source_id is not null").groupBy("source_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return rows.join(leaky, "source_id", "left_semi").select("id", "source_id", "split")


SQL["join_semi_leaky"] = f"WITH {_REC} SELECT id, source_id, split FROM rec WHERE source_id IN (SELECT source_id FROM rec WHERE source_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)"


def agg_eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Shares of right decisions and pages over all golden questions, echoes, and the time to the log as latency."""
    q = table(spark, d, "qa_golden").select(F.col("id").alias("question_id"), "question", "answerable", "expected_pages")
    last = F.max_by(F.struct("is_sufficient", "answer", (F.unix_micros("logged_at") - F.unix_micros("asked_at")).alias("latency")), "answer_id")
    answers = table(spark, d, "answer_results").withColumns({c: F.col(c).cast("timestamp") for c in ("logged_at", "asked_at")})
    given = answers.groupBy("question_id").agg(last.alias("g")).select("question_id", "g.*")
    # The pages of a question's at most twenty places, of which the first five different ones count, and those of the first three places.
    placed = Q.A.places(Q._index(spark, d), Q._questions(spark, d), keep=("page_number",))
    listed = placed.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "page_number"))).alias("l"))
    page = lambda l: F.array_distinct(F.transform(l, lambda x: x["page_number"]))
    found = listed.select("question_id", F.array_compact(F.slice(page(F.col("l")), 1, 5)).alias("pages"), F.array_compact(page(F.filter("l", lambda x: x["place"] <= 3))).alias("cited"))
    rows = q.join(given, "question_id", "left").join(found, "question_id", "left")
    none = F.array().cast("array<int>")
    said = T.echoes(F.col("answer"), F.col("question")) | F.contains(F.lower("answer"), F.regexp_replace(F.lower("question"), r"\?+$", ""))
    results, _ = cut(rows.select("answerable", F.coalesce("is_sufficient", F.lit(False)).alias("sufficient"), F.coalesce("expected_pages", none).alias("expected"), F.coalesce("pages", none).alias("retrieved"), F.coalesce("cited", none).alias("cited"), F.coalesce(said, F.lit(False)).alias("echo"), "latency"), "results")
    return C.eval_metrics(results)


SQL["agg_eval_metrics"] = f"""WITH {Q._RERANK}, c AS (SELECT question_id, list(DISTINCT page_number) AS cited FROM pl JOIN docs USING (chunk_id) WHERE place <= 3 GROUP BY 1),
    t0 AS (SELECT question_id, page_number, min(place) AS place FROM pl JOIN docs USING (chunk_id) GROUP BY 1, 2), t1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS rn FROM t0), t AS (SELECT question_id, list(page_number) AS pages FROM t1 WHERE rn <= 5 GROUP BY 1),
    g AS (SELECT question_id, arg_max((is_sufficient, answer, epoch_us(logged_at) - epoch_us(asked_at)), answer_id) AS g FROM answer_results GROUP BY 1),
    r AS (SELECT answerable AS a, coalesce(g[1], false) AS s, coalesce(expected_pages, []) AS e, coalesce(cited, []) AS c, coalesce(pages, []) AS p, g[3] AS lat, g[2] AS answer, q.question, list_distinct({Q._tokens("g[2]")}) AS st, list_distinct({Q._tokens("q.question")}) AS qt
        FROM qa_golden q LEFT JOIN g ON g.question_id = id LEFT JOIN c ON c.question_id = id LEFT JOIN t ON t.question_id = id),
    k AS (SELECT *, coalesce((len(st) > 0 AND len(qt) > 0 AND (len(list_intersect(st, qt)) = len(st) OR len(list_intersect(st, qt)) / greatest(len(list_distinct(list_concat(st, qt))), 1) >= 0.6 OR suffix(regexp_replace(lower(answer), '[ ?.]+$', ''), regexp_replace(lower(question), '[ ?.]+$', '')))) OR contains(lower(answer), rtrim(lower(question), '?')), false) AS ec FROM r),
    ls AS (SELECT list(lat ORDER BY lat) AS l FROM r WHERE lat IS NOT NULL)
    SELECT count(*) AS questions, round(count(*) FILTER (a AND list_has_any(e, p)) / greatest(count(*) FILTER (a), 1), 6) AS recall, round(count(*) FILTER (NOT a AND NOT s) / greatest(count(*) FILTER (NOT a), 1), 6) AS unanswerable,
    round(count(*) FILTER (a AND NOT s) / greatest(count(*) FILTER (a), 1), 6) AS false_refusals, count(*) FILTER (s AND ec) AS echoes, round(count(*) FILTER (s AND len(c) > 0) / greatest(count(*) FILTER (s), 1), 6) AS cited,
    round(count(*) FILTER (a AND s AND list_has_any(e, c)) / greatest(count(*) FILTER (a AND s), 1), 6) AS citation_precision, any_value(l[len(l) // 2 + 1]) AS p50, any_value(l[greatest(len(l) * 95 // 100 - 1, 0) + 1]) AS p95 FROM k, ls"""


def join_grid_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The thresholds that tell answerable questions best."""
    ranking, q = Q._ranking(spark, d)
    rows = Q.A.decided(ranking, Q.A.spans(ranking), q).join(table(spark, d, "qa_golden").select(F.col("id").alias("question_id"), "answerable"), "question_id")
    steps = lambda name, low, high: spark.range(low, high).select((F.col("id") * 0.5).alias(name))
    grid = steps("rerank", -8, 9).join(steps("margin", -8, 9)).join(steps("strong", -4, 17))
    return C.calibrated(rows, grid)


SQL["join_grid_calibration"] = f"""WITH {Q._SPANS}, t AS (SELECT score AS top, margin, answerable FROM qa_golden LEFT JOIN pl ON pl.question_id = id AND place = 1 LEFT JOIN sp ON sp.question_id = id),
    b AS (SELECT round(top, 1) AS top, round(margin, 1) AS m, answerable, count(*) AS n FROM t GROUP BY 1, 2, 3), g AS (SELECT r.i * 0.5 AS rerank, a.i * 0.5 AS margin, s.i * 0.5 AS strong FROM range(-8, 9) r(i), range(-8, 9) a(i), range(-4, 17) s(i) WHERE s.i >= r.i),
    x AS (SELECT rerank, margin, strong, sum(CASE WHEN coalesce(top >= rerank AND (coalesce(m, '-infinity'::DOUBLE) >= margin OR top >= strong), false) = answerable THEN n ELSE 0 END) AS r, sum(n) AS n FROM b, g GROUP BY 1, 2, 3)
    SELECT rerank::DOUBLE AS rerank, margin::DOUBLE AS margin, strong::DOUBLE AS strong, round(r / n, 6) AS accuracy FROM x ORDER BY r DESC, 1, 2, 3 LIMIT 1"""


def agg_ema(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed confidence of each mode's answers in order of time, its last value."""
    rows = table(spark, d, "answer_results").where("confidence is not null").groupBy("mode", F.to_date("asked_at").alias("day")).agg(F.avg("confidence").alias("c"))
    listed = rows.groupBy("mode").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "c"))), lambda x: x["c"]).alias("l"))  # one value for each day
    return listed.select("mode", F.size("l").alias("days"), F.round(F.element_at(C.ema(F.col("l")), -1), 6).alias("smoothed"))


SQL["agg_ema"] = """WITH d AS (SELECT mode, asked_at::DATE AS day, avg(confidence) AS c FROM answer_results WHERE confidence IS NOT NULL GROUP BY 1, 2), l AS (SELECT mode, list(c ORDER BY day) AS l FROM d GROUP BY 1)
    SELECT mode, len(l)::INT AS days, round(list_reduce(l, lambda s, x: 0.1 * x + 0.9 * s), 6) AS smoothed FROM l"""


def win_running_best(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a book that took less time to read than all pages before."""
    rows = table(spark, d, "book_pages").where("ocr_time_sec is not null").groupBy("book_id", "page_number").agg(F.min("ocr_time_sec").alias("seconds"))
    return C.running_best(rows, ["book_id"], "page_number", "seconds")


SQL["win_running_best"] = """WITH r AS (SELECT book_id, page_number, min(ocr_time_sec) AS seconds FROM book_pages WHERE ocr_time_sec IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT *, min(seconds) OVER (PARTITION BY book_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) SELECT book_id, page_number, seconds FROM b WHERE b IS NULL OR seconds < b"""


def agg_ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    """Reading quality of the pages, with a line's length standing for the engine's confidence."""
    lines = Q.C.page_lines(table(spark, d, "book_pages"))
    return C.quality_of_reading(lines.select(F.concat_ws(":", "book_id", F.col("page_number").cast("string")).alias("page"), F.col("raw").alias("text"), F.least(F.length("raw") / 60, F.lit(1.0)).alias("confidence")))


SQL["agg_ocr_quality"] = f"""WITH {Q._PAGES}, l AS (SELECT book_id || ':' || page_number AS page, trim(unnest(string_split(text, chr(10)))) AS t FROM pages), k AS (SELECT page, t, least(length(t) / 60, 1.0) AS c FROM l WHERE t <> '')
    SELECT page, round(least(greatest(0.65 * avg(c) + 0.20 * (1 - avg((c < 0.55)::INT)) + 0.15 * least(1.0, length(regexp_replace(string_agg(t, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(1.0, 0.55 * sum(length(t)))), 0.0), 1.0), 6) AS quality FROM k GROUP BY 1"""


def registry_list(spark: SparkSession, d: str) -> DataFrame:
    """Books with their page counts and pages that need a look, newest first within their owner."""
    pages = table(spark, d, "book_pages").groupBy("book_id").agg(F.count_distinct("page_id").alias("pages"), F.count_if(F.col("status") != "ok").alias("to_review"))
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("created_at"), "id"))
    books = C.newest(table(spark, d, "books"), "id", "updated_at")
    return books.join(pages, books["id"] == pages["book_id"], "left").select("id", "owner_id", "status", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("to_review", F.lit(0)).alias("to_review"), place.alias("place"))


SQL["registry_list"] = """WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM books) WHERE rn = 1),
    p AS (SELECT book_id, count(DISTINCT page_id) AS pages, count(*) FILTER (status <> 'ok') AS to_review FROM book_pages GROUP BY 1)
    SELECT id, owner_id, status, coalesce(pages, 0) AS pages, coalesce(to_review, 0) AS to_review, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id)::INT AS place FROM b LEFT JOIN p ON book_id = id"""


def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Uploads by owner and content: how often each came and which book holds it."""
    return table(spark, d, "books").groupBy("owner_id", "sha256").agg(F.count("*").alias("uploads"), F.min_by("id", F.struct("created_at", "id")).alias("book"))


SQL["registry_upsert"] = "SELECT owner_id, sha256, count(*) AS uploads, arg_min(id, row(created_at, id)) AS book FROM books GROUP BY 1, 2"


def registry_counts(spark: SparkSession, d: str) -> DataFrame:
    """Books per status with their pages; what isn't digital counts as scanned."""
    b = table(spark, d, "books")
    return b.groupBy("status").agg(F.count("*").alias("books"), F.sum("total_pages").alias("pages"), F.sum("digital_pages").alias("digital"), F.sum(F.col("total_pages") - F.col("digital_pages")).alias("scanned"))


SQL["registry_counts"] = "SELECT status, count(*) AS books, sum(total_pages)::BIGINT AS pages, sum(digital_pages)::BIGINT AS digital, sum(total_pages - digital_pages)::BIGINT AS scanned FROM books GROUP BY 1"


def page_errors(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the codes of their errors."""
    e = table(spark, d, "book_pages").select("page_id", F.explode("errors").alias("e"))
    return e.groupBy("e.code").agg(F.count_distinct("page_id").alias("pages"))


SQL["page_errors"] = "SELECT e.code AS code, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(errors) AS e FROM book_pages) GROUP BY 1"

QUERIES = [
    flt_bbox_validate, flt_trainable, agg_validation_counts, agg_source_overlap, agg_upper_median, agg_dataset_report, agg_quota, downsample_negatives, split_hash, split_capped, split_filled, split_leak_fix, top_overfit,
    geo_florence_tokens, geo_od_target, geo_box_convert, geo_iou, join_nearest_caption, join_nearby_visuals, join_containment, join_anti_claimed, flt_overlap_suppression, agg_detection_metrics, agg_detection_report, agg_inspection, agg_best_iou,
    figure_normalize, figure_relevance, join_explicit_reference, win_margin, set_interleave, set_unreferenced, join_semi_leaky, agg_eval_metrics, join_grid_calibration, agg_ema, win_running_best, agg_ocr_quality,
    registry_list, registry_upsert, registry_counts, page_errors,
]
