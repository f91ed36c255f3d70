"""Queries over the registry, texts for readers and the geometry of pages, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.durable import cut
from leafmill.functions import display as D
from leafmill.functions import geometry as G
from leafmill.functions import records
from leafmill.functions import text as T
from leafmill.operators import curation as C
from leafmill.operators import documents as DOC
from leafmill.operators import figures as V
from leafmill.operators import reading as W
from leafmill.operators import registry as E
from leafmill.plans import layout_queries as L
from leafmill.plans import text_queries as Q
from leafmill.sources.tables import table

SQL: dict[str, str] = {}


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """A job for each book, and an older one for each that was updated; what the books table knows of processing."""
    b = table(spark, d, "books")
    state = F.when(F.col("status") == "ready", "succeeded").when(F.col("status") == "failed", "failed").otherwise("running")
    last = b.select(F.concat(F.lit("job-"), "id").alias("id"), F.col("id").alias("book_id"), "owner_id", state.alias("status"), F.col("updated_at").alias("created_at"), "error")
    first = b.where("created_at < updated_at").select(F.concat(F.lit("first-"), "id").alias("id"), F.col("id").alias("book_id"), "owner_id", F.lit("queued").alias("status"), "created_at", F.lit(None).cast("string").alias("error"))
    return last.union(first)


_JOBS = """jobs AS (SELECT 'job-' || id AS id, id AS book_id, owner_id, CASE status WHEN 'ready' THEN 'succeeded' WHEN 'failed' THEN 'failed' ELSE 'running' END AS status, updated_at AS created_at FROM books
    UNION ALL SELECT 'first-' || id, id, owner_id, 'queued', created_at FROM books WHERE created_at < updated_at),
    lastjob AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs) WHERE rn = 1)"""


def registry_latest_job(spark: SparkSession, d: str) -> DataFrame:
    """The newest job of each book of the registry, with its owner, and whether it is over."""
    jobs = E.latest_jobs(_jobs(spark, d))
    return jobs.select("book_id", F.col("id").alias("job_id"), "owner_id", "status", E.is_final(F.col("status")).alias("final"))


SQL["registry_latest_job"] = f"WITH {_JOBS} SELECT book_id, id AS job_id, owner_id, status, status IN ('succeeded', 'failed') AS final FROM lastjob"


def registry_pending(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that a restart puts back into the queue."""
    return E.resumed(E.pending(_jobs(spark, d))).groupBy("owner_id", "status", "message").agg(F.count("*").alias("jobs"))


SQL["registry_pending"] = f"WITH {_JOBS} SELECT owner_id, 'queued' AS status, 'Re-queued after restart' AS message, count(*) AS jobs FROM jobs WHERE status IN ('queued', 'running') GROUP BY 1"


def registry_owner(spark: SparkSession, d: str) -> DataFrame:
    """The books of the owner with most of them, newest first."""
    books = C.newest(table(spark, d, "books"), "id", "updated_at")
    top = books.where("owner_id is not null").groupBy("owner_id").count().orderBy(F.desc("count"), "owner_id").limit(1).select("owner_id")
    order = F.row_number().over(C.Window.partitionBy("owner_id").orderBy(F.desc("created_at"), "id"))
    return books.join(top, "owner_id", "left_semi").select("id", "filename", "status", order.alias("place"))


SQL["registry_owner"] = """WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM books) WHERE rn = 1), t AS (SELECT owner_id FROM b WHERE owner_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT id, filename, status, row_number() OVER (ORDER BY created_at DESC, id)::INT AS place FROM b JOIN t USING (owner_id)"""


def registry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What happens when every file is uploaded again by its owner and once by someone else."""
    books = table(spark, d, "books")
    uploads = books.select("owner_id", "sha256").union(books.select("owner_id", "sha256")).union(books.select(F.lit("someone"), "sha256"))
    return E.upload_outcomes(uploads, books, _jobs(spark, d))


SQL["registry_outcomes"] = f"""WITH {_JOBS}, u AS (SELECT owner_id, sha256 FROM books UNION ALL SELECT owner_id, sha256 FROM books UNION ALL SELECT 'someone', sha256 FROM books), o AS (SELECT owner_id, sha256, count(*) AS uploads FROM u GROUP BY 1, 2),
    k AS (SELECT owner_id, sha256, arg_min(id, (created_at, id)) AS book_id, arg_min(status, (created_at, id)) AS status FROM books GROUP BY 1, 2)
    SELECT o.owner_id, o.sha256, uploads, CASE WHEN k.book_id IS NULL THEN 'created' WHEN k.status <> 'failed' AND j.id IS NOT NULL THEN 'returned' ELSE 'queued_again' END AS outcome, k.book_id, CASE WHEN k.status <> 'failed' THEN j.id END AS job_id
    FROM o LEFT JOIN k ON k.owner_id = o.owner_id AND k.sha256 = o.sha256 LEFT JOIN lastjob j ON j.book_id = k.book_id"""


def registry_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every page of every book as the reader's view has it."""
    out = E.detail(table(spark, d, "books"), table(spark, d, "book_pages"))
    return out.select("book_id", "page_number", "status", "page_type", "page_status", F.md5("text").alias("hash"), "words", "errors")


SQL["registry_detail"] = r"""WITH p AS (SELECT book_id, page_number, arg_max((coalesce(nullif(text, ''), nullif(raw_text, ''), ''), coalesce(page_type, 'Digital'), coalesce(status, 'ok'), coalesce(len(errors), 0)), (ingested_at, coalesce(nullif(text, ''), nullif(raw_text, ''), ''))) AS p FROM book_pages GROUP BY 1, 2)
    SELECT b.id AS book_id, page_number, b.status, p[2] AS page_type, p[3] AS page_status, md5(p[1]) AS hash, len(list_filter(string_split_regex(p[1], '\s+'), lambda w: w <> ''))::INT AS words, p[4]::INT AS errors FROM books b JOIN p ON p.book_id = b.id"""


def registry_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after their events: queued when made, running with the share of pages done, then over."""
    b = table(spark, d, "books").where("created_at is not null and updated_at is not null")
    event = lambda at, status, progress: F.struct(at.alias("at"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), progress.cast("double").alias("progress"), F.lit(None).cast("string").alias("message"))
    over = F.when(F.col("status") == "ready", "succeeded").when(F.col("status") == "failed", "failed").otherwise("running")
    half = F.expr("created_at + (updated_at - created_at) / 2")
    events = b.select(F.col("id").alias("job_id"), F.explode(F.array(event(F.col("created_at"), "queued", F.lit(0.0)), event(half, "running", F.round(0.05 + 0.85 * F.col("digital_pages") / F.greatest("total_pages", F.lit(1)), 3)), event(F.col("updated_at"), over, F.lit(None)), event(F.expr("updated_at + interval 1 second"), "running", F.lit(0.1)))).alias("e"))
    return E.job_states(events.select("job_id", "e.*")).select("job_id", "status", F.round("progress", 3).alias("progress"), "ignored")


SQL["registry_jobs"] = """SELECT id AS job_id, CASE status WHEN 'ready' THEN 'succeeded' WHEN 'failed' THEN 'failed' ELSE 'running' END AS status,
    round(CASE status WHEN 'ready' THEN 1.0 ELSE least(greatest(round(0.05 + 0.85 * digital_pages / greatest(total_pages, 1), 3), 0), 1) END, 3)::DOUBLE AS progress, CASE WHEN status IN ('ready', 'failed') THEN 1 ELSE 0 END::INT AS ignored
    FROM books WHERE created_at IS NOT NULL AND updated_at IS NOT NULL"""


def display_citations(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as citations are shown: shortened, with page label, words and folder."""
    docs = Q._docs(spark, d)
    return docs.select("chunk_id", D.shorten(F.col("text")).alias("short"), D.page_label(F.col("page_number")).alias("page"), D.counted(F.size("words"), "word").alias("said"), D.document_folder(F.concat_ws(" ", "book_id", "section")).alias("folder"), D.figure_file(F.col("page_number"), F.lit(1)).alias("file"))


SQL["display_citations"] = f"""WITH {Q._DOCS}, t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c, len({Q._tokens("CASE WHEN section IS NOT NULL THEN section || '. ' || text ELSE text END")}) AS n FROM docs)
    SELECT chunk_id, CASE WHEN length(c) > 180 THEN substr(c, 1, 179) || '…' ELSE c END AS short, CASE WHEN length(page_number::VARCHAR) < 2 THEN lpad(page_number::VARCHAR, 2, '0') ELSE page_number::VARCHAR END AS page, n || CASE WHEN n = 1 THEN ' word' ELSE ' words' END AS said,
    substr(regexp_replace(concat_ws(' ', book_id, section), '[^A-Za-z0-9_-]+', '_', 'g'), 1, 80) AS folder, 'p' || page_number || '_fig1.png' AS file FROM t"""


def display_answers(spark: SparkSession, d: str) -> DataFrame:
    """Confidence as per cent, and whether a generator said that the book has nothing."""
    a = table(spark, d, "answer_results").where("answer is not null and confidence is not null").select("answer_id", "answer", "confidence").distinct()
    return a.select("answer_id", D.percent(F.col("confidence")).alias("percent"), D.in_scope(F.concat(F.col("answer"), F.when(F.col("answer_id") % 7 == 0, " not_in_book").otherwise(""))).alias("in_scope"))


SQL["display_answers"] = "SELECT DISTINCT answer_id, floor(least(greatest(confidence, 0), 1) * 100 + 0.5)::INT AS percent, answer_id % 7 <> 0 AS in_scope FROM answer_results WHERE answer IS NOT NULL AND confidence IS NOT NULL"


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    """What a generator would be asked for each question: the first eight passages and the rules."""
    index, q = Q._index(spark, d), Q._questions(spark, d)
    first, _ = cut(Q.A.places(index, q).where("place <= 8"), "ranking")
    listed = Q.A.told(first, index, q).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page_number", "section", "text"))), lambda x: F.struct(x["page_number"].alias("page_number"), x["section"].alias("section"), x["text"].alias("text"))).alias("evidence"))
    asked = q.join(listed, "question_id").withColumn("p", D.prompt(F.col("question"), F.lit(""), F.col("evidence")))
    return asked.select("question_id", F.length("p").alias("chars"), F.md5("p").alias("hash"))


SQL["prompt_build"] = f"""WITH {Q._RERANK}, e AS (SELECT question_id, string_agg('[page ' || page_number || CASE WHEN coalesce(section, '') <> '' THEN ' | ' || section ELSE '' END || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS x FROM pl JOIN docs USING (chunk_id) WHERE place <= 8 GROUP BY 1),
    p AS (SELECT question_id, 'Answer from these excerpts of the uploaded document only. If they don''t hold the answer, reply NOT_IN_BOOK.' || chr(10) || chr(10) || x || chr(10) || chr(10) || 'Question: ' || trim(question) AS p FROM e JOIN asks USING (question_id))
    SELECT question_id, length(p)::INT AS chars, md5(p) AS hash FROM p"""


def geo_box_forms(spark: SparkSession, d: str) -> DataFrame:
    """Boxes read as corners, as sizes, and as what they look like."""
    rows = L._boxes(spark, d).where("box is not null")
    text = lambda form: F.array_join(F.transform(G.from_box(F.col("box"), F.col("width"), F.col("height"), form), lambda v: F.round(v).cast("bigint").cast("string")), ",")
    return rows.select("id", "ord", *[text(form).alias(form) for form in ("xyxy", "xywh", "auto")])


_P = "CASE WHEN list_max(b) <= 1.5 THEN [b[1] * w, b[2] * h, b[3] * w, b[4] * h] ELSE b END"
_CUT = lambda c: f"CASE WHEN len(b) = 4 AND least(greatest({c}[3], 0), w) > least(greatest({c}[1], 0), w) AND least(greatest({c}[4], 0), h) > least(greatest({c}[2], 0), h) THEN concat_ws(',', " + ", ".join(f"round(least(greatest({c}[{i}], 0), {s}))::BIGINT" for i, s in zip((1, 2, 3, 4), "whwh", strict=True)) + ") END"
SQL["geo_box_forms"] = f"""WITH {L._BOX}, p AS (SELECT id, i::INT AS ord, w::DOUBLE AS w, h::DOUBLE AS h, b, {_P} AS p FROM box WHERE b IS NOT NULL), z AS (SELECT *, [p[1], p[2], p[1] + p[3], p[2] + p[4]] AS s FROM p),
    a AS (SELECT *, CASE WHEN s[3] <= w * 1.02 AND s[4] <= h * 1.02 AND p[3] > 0 AND p[4] > 0 AND NOT (p[3] > p[1] AND p[4] > p[2] AND (p[3] > w * 0.5 OR p[4] > h * 0.5) AND s[3] > w) THEN s WHEN p[3] > p[1] AND p[4] > p[2] THEN p ELSE s END AS a FROM z)
    SELECT id, ord, {_CUT("p")} AS xyxy, {_CUT("s")} AS xywh, {_CUT("a")} AS auto FROM a"""


def geo_crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Pictures with a rim that keeps clear of the page's texts."""
    rows = L._boxes(spark, d).where("state = 'ok'")
    texts = rows.where("category in ('Text', 'Caption', 'Table')").groupBy("id").agg(F.collect_list("box").alias("obstacles"))
    pictures = rows.where("category = 'Picture'").join(texts, "id", "left")
    c = G.crop_box(F.col("box"), F.col("width"), F.col("height"), F.array_sort("obstacles"))
    return pictures.withColumn("c", c).where("c is not null").select("id", "ord", *[F.round(F.col("c")[i], 3).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_AVOID = "[CASE WHEN e.b[3] <= s.b[1] AND e.b[3] > s.c[1] THEN greatest(e.b[3] + 2, 0) ELSE s.c[1] END, CASE WHEN e.b[4] <= s.b[2] AND e.b[4] > s.c[2] THEN greatest(e.b[4] + 2, 0) ELSE s.c[2] END, CASE WHEN e.b[1] >= s.b[3] AND e.b[1] < s.c[3] THEN least(e.b[1] - 2, s.w) ELSE s.c[3] END, CASE WHEN e.b[2] >= s.b[4] AND e.b[2] < s.c[4] THEN least(e.b[2] - 2, s.h) ELSE s.c[4] END]"
SQL["geo_crop_boxes"] = f"""WITH {L._BOX}, o AS (SELECT id, list(b ORDER BY b) AS obs FROM box WHERE state = 'ok' AND category IN ('Text', 'Caption', 'Table') GROUP BY 1),
    p AS (SELECT id, i::INT AS ord, b, w::DOUBLE AS w, h::DOUBLE AS h, coalesce(obs, []) AS obs, least(greatest((b[3] - b[1]) * 0.05, 10), 30) AS px, least(greatest((b[4] - b[2]) * 0.05, 10), 30) AS py FROM box LEFT JOIN o USING (id) WHERE state = 'ok' AND category = 'Picture'),
    r AS (SELECT id, ord, list_reduce(list_transform(obs, lambda x: {{'b': x, 'c': []::DOUBLE[], 'w': 0.0::DOUBLE, 'h': 0.0::DOUBLE}}), lambda s, e: {{'b': s.b, 'c': {_AVOID}, 'w': s.w, 'h': s.h}}, {{'b': b, 'c': [greatest(b[1] - px, 0), greatest(b[2] - py, 0), least(b[3] + px, w), least(b[4] + py, h)], 'w': w, 'h': h}}).c AS c FROM p)
    SELECT id, ord, round(c[1], 3) AS x1, round(c[2], 3) AS y1, round(c[3], 3) AS x2, round(c[4], 3) AS y2 FROM r WHERE c[3] > c[1] + 10 AND c[4] > c[2] + 10"""


def geo_search_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where the figure of each caption would be looked for, above and below."""
    rows = L._boxes(spark, d).where("state = 'ok' and category = 'Caption'").withColumn("c", F.transform("box", lambda v: F.floor(v).cast("int")))
    text = lambda above: F.array_join(G.search_window(F.col("c"), F.col("width"), F.col("height"), above).cast("array<string>"), ",")
    return rows.select("id", "ord", text(True).alias("above"), text(False).alias("below"))


SQL["geo_search_windows"] = f"""WITH {L._BOX}, c AS (SELECT id, i::INT AS ord, w, h, list_transform(b, lambda v: floor(v)::INT) AS c, floor(w * 0.02)::INT AS l, floor(w * 0.98)::INT AS r, floor(h * 0.02)::INT AS t, floor(h * 0.98)::INT AS u FROM box WHERE state = 'ok' AND category = 'Caption')
    SELECT id, ord, concat_ws(',', greatest(l, c[1] - 250), greatest(t, c[2] - 600), least(r, c[3] + 250), greatest(greatest(t, c[2] - 600) + 20, c[2] - 5)) AS above, concat_ws(',', greatest(l, c[1] - 250), least(h - 20, c[4] + 5), least(r, c[3] + 250), least(u, c[4] + 600)) AS below FROM c"""


def flt_detected(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that could be a detector's figures, the largest of a page first."""
    rows = L._boxes(spark, d).where("state = 'ok'").select(F.col("id").alias("page"), F.col("category").alias("label"), "box", "width", "height")
    return W.kept_boxes(rows).select("page", "label", "area", "place")


SQL["flt_detected"] = f"""WITH {L._BOX}, k AS (SELECT id AS page, trim(coalesce(nullif(category, ''), 'Picture')) AS label, list_transform(b, lambda v: trunc(v)::BIGINT) AS b, w, h FROM box WHERE state = 'ok'),
    a AS (SELECT *, (b[3] - b[1]) * (b[4] - b[2]) AS area FROM k WHERE lower(label) IN ('picture', 'diagram', 'figure', 'image', 'chart', 'graph'))
    SELECT page, label, area, row_number() OVER (PARTITION BY page ORDER BY area DESC, b)::INT AS place FROM a WHERE area >= 4000 AND area <= w::BIGINT * h * 0.55"""


def figure_keys(spark: SparkSession, d: str) -> DataFrame:
    """The figures of all pages by their keys, with the label and the text that stand for them."""
    f = L.figure_normalize(spark, d).withColumn("at", F.split("page", ":"))
    pages = f.groupBy(F.col("at")[0].alias("book_id"), F.col("at")[1].cast("int").alias("page_number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "number", F.col("number").alias("figure_id"), F.col("label").alias("figure_label"), "caption"))), lambda x: F.struct(x["figure_id"].alias("figure_id"), x["figure_label"].alias("figure_label"), x["caption"].alias("caption"))).alias("figures"))
    return E.figure_index(pages).withColumn("alt", D.figure_alt(F.col("label"), F.col("caption"), F.col("page_number")))


SQL["figure_keys"] = f"""WITH {L._NORMAL}, k AS (SELECT *, string_split(page, ':')[1] AS book_id, string_split(page, ':')[2]::INT AS page_number FROM fn), o AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_number ORDER BY ord, number, label, caption) AS n FROM k)
    SELECT book_id, page_number, 'p' || page_number || '-' || n AS figure_key, number AS figure_id, label, nullif(trim(caption), '') AS caption, CASE WHEN coalesce(nullif(trim(caption), ''), '') <> '' THEN trim(label) || ': ' || trim(caption) ELSE trim(label) END AS alt FROM o"""


def answer_response(spark: SparkSession, d: str) -> DataFrame:
    """What a reader gets for each question: answer, pages, figures and how sure their choice is."""
    figures, _ = cut(L._figures(spark, d).withColumn("page_number", F.split("page", ":")[1].cast("int")), "figures")
    pages = Q.C.page_texts(table(spark, d, "book_pages")).groupBy("book_id", "page_number").agg(F.max("text").alias("text"))
    return V.responses(table(spark, d, "chunks"), Q._questions(spark, d), figures, pages)


def _document(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The figure mentions of pages as raw figures, and the graph of them."""
    lines = Q.C.page_lines(table(spark, d, "book_pages")).withColumn("label", F.regexp_extract("raw", r"(?i)\b(?:Figure|Fig\.?|Table)\s*\d+(?:\.\d+)?", 0))
    none = F.lit(None).cast("string")
    raw = lines.where("label <> ''").select("book_id", "page_number", F.col("line_no").alias("ord"), none.alias("figure_id"), "label", F.when(F.col("raw").startswith(F.col("label")), F.col("raw")).alias("caption"), F.array("label").alias("labels_inside"), F.array(*[F.lit(0.0)] * 4).alias("box"), F.lit(0.5).alias("confidence"), none.alias("description"), none.alias("image_path"), F.col("raw").alias("context"), none.alias("surrounding"), F.lit("text").alias("source_type"))
    named = lines.select("book_id", "page_number", F.col("line_no").alias("ord"), F.explode(records.mentions(F.col("raw"))).alias("reference"))
    return DOC.graph(raw, named)


def document_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges from captions and pages to figures, by kind."""
    return _document(spark, d)[2].select("id", "source", "target", "relation", "confidence")


_REFER = lambda x: "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '(?i){k}(\\d+(?:\\.\\d+)?(?:\\.[a-zA-Z])?)', 1), '')" for k in T.REFERENCE_KINDS) + ")"
_GRAPH = rf"""{L._NORMAL}, dn AS (SELECT *, string_split(page, ':')[1] AS book_id, string_split(page, ':')[2]::INT AS page_number, CASE WHEN starts_with(raw, label) THEN raw END AS cap FROM nn WHERE number IS NOT NULL),
    dg AS (SELECT book_id, page_number, number, min(ord) AS ord, arg_min(label, ord) AS label, nullif(trim(list_reduce(list_prepend('', list(coalesce(cap, '') ORDER BY ord, raw)), lambda s, c: CASE WHEN c = '' OR contains(s, c) THEN s WHEN s = '' THEN c ELSE trim(s || ' ' || c) END)), '') AS caption FROM dn GROUP BY 1, 2, 3),
    df AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_number ORDER BY ord, number) AS idx, 'doc:' || book_id || ':page:' || page_number AS page_id, coalesce({_REFER("label")}, {_REFER("caption")}) AS reference FROM dg),
    dc AS (SELECT book_id, page_number, page_id || ':caption:' || idx AS id, page_id, caption AS text, page_id || ':figure:' || idx AS attached_to, reference, 0.5::DOUBLE AS confidence FROM df WHERE caption IS NOT NULL),
    dm AS (SELECT book_id, page_number, ord, unnest(regexp_extract_all(raw, '(?i)\b(?:Fig(?:ure)?\.?|Table|Activity|Chart)\s*(\d+(?:\.\d+)?)', 1)) AS m FROM (SELECT string_split(page, ':')[1] AS book_id, string_split(page, ':')[2]::INT AS page_number, ord, raw FROM nl WHERE raw <> '')),
    dr AS (SELECT book_id, page_number, coalesce({_REFER("'Figure ' || m")}, trim(m)) AS reference, min(ord) AS ord FROM dm GROUP BY 1, 2, 3)"""
SQL["document_graph"] = f"""WITH {_GRAPH} SELECT id || '->' || attached_to AS id, id AS source, attached_to AS target, 'caption_of' AS relation, confidence FROM dc
    UNION ALL SELECT page_id || '->' || page_id || ':figure:' || idx || ':ref:' || reference, page_id, page_id || ':figure:' || idx, 'references', 0.85::DOUBLE FROM df WHERE reference IS NOT NULL"""


def document_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of all pages, and placeholders for figures that only the text names."""
    return _document(spark, d)[1].select("id", "page_id", "text", "attached_to", "reference", "confidence")


SQL["document_captions"] = f"""WITH {_GRAPH} SELECT id, page_id, text, attached_to, reference, confidence FROM dc
    UNION ALL SELECT 'doc:' || book_id || ':page:' || page_number || ':reference:' || ord, 'doc:' || book_id || ':page:' || page_number, 'Figure ' || reference, NULL, reference, 0.0::DOUBLE FROM dr
    WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.book_id = dr.book_id AND dc.page_number = dr.page_number AND dc.reference = dr.reference)"""


def document_json(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its visible figures as one JSON object, as length and hash."""
    pages = table(spark, d, "book_pages").where("book_id is not null and page_number is not null")
    once = pages.groupBy("book_id", "page_number").agg(F.max_by(F.struct(F.col("page_type").alias("page_type"), F.col("status").alias("status"), F.coalesce("raw_text", "text").alias("text")), F.struct("ingested_at", F.coalesce("raw_text", "text"))).alias("p")).select("book_id", "page_number", "p.*")
    out = DOC.serialised(once, _document(spark, d)[0])
    return out.select("book_id", "page_number", F.length("json").alias("chars"), F.md5("json").alias("hash"), F.get_json_object("json", "$.figures[0].figure_id").alias("first_figure"))


QUERIES = [
    registry_latest_job, registry_pending, registry_owner, registry_outcomes, registry_detail, registry_jobs, display_citations, display_answers, prompt_build, geo_box_forms, geo_crop_boxes, geo_search_windows, flt_detected, figure_keys, answer_response, document_graph, document_captions, document_json,
]
