"""Queries over texts, pages and questions, and the SQL that gives the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.durable import cut
from leafmill.functions import text as T
from leafmill.operators import answering as A
from leafmill.operators import chunking as C
from leafmill.operators import retrieval as R
from leafmill.sources.tables import table

SQL: dict[str, str] = {}
_PAGES = "pages AS (SELECT DISTINCT book_id, page_number, coalesce(nullif(raw_text, ''), text) AS text FROM book_pages WHERE book_id IS NOT NULL AND page_number IS NOT NULL)"
_STOPS = "(" + ", ".join(f"'{w}'" for w in T.RETRIEVAL_STOPS) + ")"
_FIGURE_STOPS = "(" + ", ".join(f"'{w}'" for w in T.FIGURE_STOPS) + ")"


_WORDS = lambda x: f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
_ENUMERATOR = r"(?:\d{1,2}\.|\([a-z]\)|\([ivx]+\))"
_PIECES = rf"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '\s+({_ENUMERATOR}\s)', chr(10) || '\1', 'g'), '([.!?])\s+([A-Z(\"''“])', '\1' || chr(1) || '\2', 'g'), '\n+|\x01'), lambda x: trim(x)), lambda x: x <> '')"
_FOLD = lambda l: f"""list_reduce(list_transform({l}, lambda x: {{'done': []::VARCHAR[], 'open': '', 'x': x}}), lambda s, e: CASE WHEN regexp_full_match(e.x, '{_ENUMERATOR}') THEN {{'done': s.done, 'open': trim(s.open || ' ' || e.x), 'x': ''}}
        ELSE {{'done': list_append(s.done, trim(s.open || ' ' || e.x)), 'open': '', 'x': ''}} END, {{'done': []::VARCHAR[], 'open': '', 'x': ''}})"""  # noqa: E731


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN {_STOPS})"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_golden").select(F.col("id").alias("question_id"), F.col("book").alias("book_id"), "question")


def _index(spark: SparkSession, d: str) -> R.Index:
    return R.build(table(spark, d, "chunks"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return R.documents(table(spark, d, "chunks"))


def src_documents_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pruned scan with filters that reach Parquet."""
    return table(spark, d, "documents").where("lang = 'en' and n_chars > 1000").select("doc_id", "source", "n_chars")


SQL["src_documents_scan"] = "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000"


def flt_lane_routing(spark: SparkSession, d: str) -> DataFrame:
    """Digital pages have 40 or more characters of text, all others count as scanned."""
    pages = C.page_texts(table(spark, d, "book_pages"))
    digital = F.coalesce(F.length(T.squeeze(F.col("text"))), F.lit(0)) >= 40
    return pages.groupBy("book_id").agg(F.count("*").alias("total"), F.count_if(digital).alias("digital"), (F.count("*") - F.count_if(digital)).alias("scanned"))


SQL["flt_lane_routing"] = f"""WITH {_PAGES}, r AS (SELECT book_id, coalesce(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 0) >= 40 AS dig FROM pages)
    SELECT book_id, count(*) AS total, count(*) FILTER (dig) AS digital, count(*) - count(*) FILTER (dig) AS scanned FROM r GROUP BY book_id"""


def flt_page_status(spark: SparkSession, d: str) -> DataFrame:
    """Status by the note of the reading engine; the first rule that fits counts."""
    note = F.coalesce("confidence_note", F.lit(""))
    status = F.when(note.startswith("Tesseract selected"), "degraded").when(note.contains("unavailable") | note.startswith("OCR Error"), "failed").when(note.contains("no readable text"), "degraded").otherwise("ok")
    return table(spark, d, "book_pages").groupBy(status.alias("status"), F.coalesce("status", F.lit("none")).alias("stored")).agg(F.count("*").alias("pages"))


SQL["flt_page_status"] = """SELECT CASE WHEN starts_with(n, 'Tesseract selected') THEN 'degraded' WHEN contains(n, 'unavailable') OR starts_with(n, 'OCR Error') THEN 'failed' WHEN contains(n, 'no readable text') THEN 'degraded' ELSE 'ok' END AS status,
    coalesce(s, 'none') AS stored, count(*) AS pages FROM (SELECT coalesce(confidence_note, '') AS n, status AS s FROM book_pages) GROUP BY 1, 2"""


def flt_heading(spark: SparkSession, d: str) -> DataFrame:
    """Numbered or capital headings among the pages' lines."""
    lines = C.page_lines(table(spark, d, "book_pages"))
    return lines.where(T.is_heading(F.col("raw"))).groupBy("book_id").agg(F.count("*").alias("headings"), F.min("raw").alias("first_heading"))


SQL["flt_heading"] = f"""WITH {_PAGES}, l AS (SELECT book_id, trim(unnest(string_split(text, chr(10)))) AS raw FROM pages)
    SELECT book_id, count(*) AS headings, min(raw) AS first_heading FROM l WHERE raw <> '' AND length(raw) <= 90 AND NOT regexp_matches(raw, '[.?,;]$')
    AND (regexp_matches(raw, '^\\d+(?:\\.\\d+)+\\s+[A-Z][^.?!]{{2,90}}$') OR regexp_matches(raw, '^[A-Z][A-Z0-9 ,:&''()\\-–]{{5,80}}$')) GROUP BY book_id"""


def flt_equation(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with an equation, by kind."""
    c = table(spark, d, "chunks").where("text is not null")
    return c.groupBy(F.coalesce("kind", F.lit("body")).alias("kind")).agg(F.count("*").alias("chunks"), F.count_if(F.col("text").rlike(T.EQUATION)).alias("equations"), F.count_if(F.col("text").rlike(T.EQUATION_WISH)).alias("about_equations"))


SQL["flt_equation"] = r"""SELECT coalesce(kind, 'body') AS kind, count(*) AS chunks, count(*) FILTER (regexp_matches(text, '(→|->|⟶|\+\s*[A-Z][a-z]?\d*\s*(?:\(|→)|=)')) AS equations,
    count(*) FILTER (regexp_matches(text, '(?i)\b(equation|reaction|formula|react|reacts|balanced|chemical change)\b')) AS about_equations FROM chunks WHERE text IS NOT NULL GROUP BY 1"""


def flt_visual_question(spark: SparkSession, d: str) -> DataFrame:
    """Questions that ask for something to see."""
    return table(spark, d, "qa_golden").where(F.col("question").rlike(T.VISUAL_WISH) | T.explicit_reference(F.col("question")).isNotNull()).select("id", "question")


SQL["flt_visual_question"] = r"""SELECT id, question FROM qa_golden WHERE regexp_matches(question, '(?i)\b(?:figure|fig\.?|diagram|image|picture|illustration|graph|chart|map|visual|shown|show|depict|draw|setup|apparatus)\b')
    OR regexp_matches(question, '(?i)(?:Figure\s+|Fig\.?\s*|Table\s+|Activity\s+)\d')"""


def txt_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval tokens of the chunks."""
    return _docs(spark, d).select("chunk_id", F.size("words").alias("n"), F.array_join(F.slice("words", 1, 5), " ").alias("first_tokens"))


SQL["txt_tokens"] = f"""WITH c AS (SELECT chunk_id, max(text) AS text, max(section) AS section FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
    w AS (SELECT chunk_id, {_tokens("CASE WHEN section IS NOT NULL THEN section || '. ' || text ELSE text END")} AS words FROM c)
    SELECT chunk_id, len(words)::INT AS n, array_to_string(words[1:5], ' ') AS first_tokens FROM w"""


def txt_terms(spark: SparkSession, d: str) -> DataFrame:
    """Search terms of the questions."""
    return table(spark, d, "qa_golden").select("id", F.array_join(T.terms(F.col("question")), " ").alias("terms"))


SQL["txt_terms"] = f"""SELECT id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(question), '[^a-z0-9\\s]', ' ', 'g'), '\\S+'), lambda t: length(t) > 2 AND t NOT IN {_FIGURE_STOPS}), ' ') AS terms FROM qa_golden"""


def txt_clean_line(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the pages that cleaning changes."""
    lines = C.page_lines(table(spark, d, "book_pages")).withColumn("line", T.clean_line(F.col("raw")))
    return lines.where("line <> raw").select("book_id", "page_number", "line_no", "raw", "line")


def txt_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the chunks and whether they make an exercise."""
    said = _docs(spark, d).select("chunk_id", T.sentences(F.col("text")).alias("s"))
    return said.select("chunk_id", F.size("s").alias("sentences"), T.is_exercise(F.col("s")).alias("exercise"))


SQL["txt_sentences"] = f"""WITH c AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1), f AS (SELECT chunk_id, {_FOLD(_PIECES)} AS f FROM c),
    s AS (SELECT chunk_id, CASE WHEN f.open = '' THEN f.done ELSE list_append(f.done, f.open) END AS s FROM f)
    SELECT chunk_id, len(s)::INT AS sentences, len(s) > 0 AND len(list_filter(s, lambda x: suffix(x, '?') OR regexp_matches(x, '^(?:\\d+\\.|\\([a-z]\\)|\\([ivx]+\\))\\s'))) * 2 >= len(s) AS exercise FROM s"""


def txt_figure_refs(spark: SparkSession, d: str) -> DataFrame:
    """Figure and table numbers that each chunk names."""
    refs = _docs(spark, d).select("chunk_id", T.figure_refs(F.col("text")).alias("r")).where("size(r) > 0")
    return refs.select("chunk_id", F.array_join("r", ",").alias("refs"), F.array_join(F.array_sort("r"), ",").alias("sorted_refs"))


SQL["txt_figure_refs"] = r"""WITH m AS (SELECT chunk_id, regexp_extract_all(max(text), '(?i)\b(?:Fig(?:ure)?\.?|Table)\s*(\d+(?:\.\d+)?)', 1) AS r FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
    u AS (SELECT chunk_id, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM m), f AS (SELECT chunk_id, x, min(i) AS i FROM u GROUP BY 1, 2)
    SELECT chunk_id, string_agg(x, ',' ORDER BY i) AS refs, string_agg(x, ',' ORDER BY x) AS sorted_refs FROM f GROUP BY 1"""


def txt_explicit_reference(spark: SparkSession, d: str) -> DataFrame:
    """The figure, table or activity that a chunk's text names."""
    return _docs(spark, d).select("chunk_id", T.explicit_reference(F.col("text")).alias("reference")).where("reference is not null")


_REF = ", ".join(f"nullif(regexp_extract(text, '(?i){k}(\\d+(?:\\.\\d+)?(?:\\.[a-zA-Z])?)', 1), '')" for k in T.REFERENCE_KINDS)
SQL["txt_explicit_reference"] = f"""WITH c AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1), r AS (SELECT chunk_id, coalesce({_REF}) AS reference FROM c) SELECT * FROM r WHERE reference IS NOT NULL"""


def txt_caption_parse(spark: SparkSession, d: str) -> DataFrame:
    """Captions among the lines of documents and pages."""
    lines = table(spark, d, "documents").select(F.explode(T.lines(F.col("text"))).alias("line")).union(C.page_lines(table(spark, d, "book_pages")).select("raw"))
    return lines.select(T.parse_caption(F.col("line")).alias("c")).where("c is not null").groupBy("c.kind", "c.label").agg(F.count("*").alias("lines"), F.min("c.text").alias("text"))


def _comparisons(spark: SparkSession, d: str) -> DataFrame:
    """The golden questions that compare two things, in the four wordings that the operator knows: ``question_id, form, book_id, question``."""
    q = table(spark, d, "qa_golden").withColumn("a", F.regexp_extract("question", _COMPARES, 1)).withColumn("b", F.regexp_extract("question", _COMPARES, 2)).where("a <> ''")
    forms = F.array(*[F.format_string(form, "a", "b") for form in _WORDINGS])
    return q.select("id", F.col("book").alias("book_id"), F.posexplode(forms).alias("form", "question"))


_COMPARES = r"difference between (\S.*) and (\S.*?)\.?$"
_WORDINGS = ("What is the difference between %s and %s?", "How is %s different from %s?", "Compare %s and %s.", "%s vs. %s")
_ASKED = f"""c0 AS (SELECT id, book, regexp_extract(question, '{_COMPARES}', ['a', 'b']) AS m FROM qa_golden),
    c1 AS (SELECT id, book AS book_id, unnest(range(4)) AS form, unnest([{", ".join(f"printf('{w}', m.a, m.b)" for w in _WORDINGS)}]) AS question FROM c0 WHERE m.a <> '')"""
_SPLITS = r"""sp0 AS (SELECT *, regexp_replace(trim(question), '[\s?.!]+$', '') AS t FROM {source}),
    sp1 AS (SELECT *, CASE WHEN regexp_matches(t, {p0}) THEN regexp_extract(t, {p0}, ['a', 'b']) WHEN regexp_matches(t, {p1}) THEN regexp_extract(t, {p1}, ['a', 'b']) WHEN regexp_matches(t, {p2}) THEN regexp_extract(t, {p2}, ['a', 'b']) WHEN regexp_matches(t, {p3}) THEN regexp_extract(t, {p3}, ['a', 'b']) END AS m FROM sp0),
    sp2 AS (SELECT * EXCLUDE (m), trim(regexp_replace(regexp_replace(trim(m.a), '[\s?.!]+$', ''), '(?i)^(?:a|an|the)\s+', '')) AS a, trim(regexp_replace(regexp_replace(trim(m.b), '[\s?.!]+$', ''), '(?i)^(?:a|an|the)\s+', '')) AS b FROM sp1 WHERE m IS NOT NULL),
    sp3 AS (SELECT *, regexp_extract_all(a, '\S+') AS wa, regexp_extract_all(b, '\S+') AS wb FROM sp2 WHERE a <> '' AND b <> '' AND lower(a) <> lower(b)),
    sp AS (SELECT * EXCLUDE (a, wa, wb, t), CASE WHEN len(wb) >= 2 AND len(wa) < len(wb) AND lower(wa[-1]) <> lower(wb[-1]) THEN a || ' ' || wb[-1] ELSE a END AS a FROM sp3)"""


def _splits(source: str) -> str:
    return _SPLITS.format(source=source, **{f"p{i}": f"'{p}'" for i, p in enumerate(T.COMPARISONS)})


def txt_comparison_split(spark: SparkSession, d: str) -> DataFrame:
    """What the questions compare, in four wordings, and the golden questions as they stand."""
    plain = table(spark, d, "qa_golden").select("id", F.lit(-1).alias("form"), "question")
    both = _comparisons(spark, d).select("id", "form", "question").union(plain)
    pair = both.select("id", "form", T.split_comparison(F.col("question")).alias("p")).where("p is not null")
    return pair.select("id", "form", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.format_string("What is %s?", F.col("p")[0]).alias("first_question"))


SQL["txt_comparison_split"] = f"""WITH {_ASKED}, every AS (SELECT id, form, question FROM c1 UNION ALL SELECT id, -1, question FROM qa_golden), {_splits("every")}
    SELECT id, form::INT AS form, a, b, 'What is ' || a || '?' AS first_question FROM sp"""


def txt_snippet(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of at most 280 characters."""
    return _docs(spark, d).select("chunk_id", T.snippet(F.col("text")).alias("snippet"))


SQL["txt_snippet"] = r"""SELECT chunk_id, CASE WHEN length(t) <= 280 THEN t ELSE regexp_replace(substr(t, 1, 277), '\s+\S*$', '') || '...' END AS snippet FROM (SELECT chunk_id, max(text) AS t FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)"""


def txt_full_text_export(spark: SparkSession, d: str) -> DataFrame:
    """Each book's pages as one text for readers, as its length and hash, with the name of the download; no book is ever one row."""
    text = F.coalesce(F.nullif("raw_text", F.lit("")), "text")
    pages = table(spark, d, "book_pages").where("book_id is not null and page_number is not null").groupBy("book_id", "page_number").agg(F.max(text).alias("text"), F.max(F.trim("page_type")).alias("page_type"))
    part = F.format_string("--- PAGE %d (%s) ---\n\n%s", F.col("page_number"), F.coalesce("page_type", F.lit("Unknown")), C.display_text(F.col("text")))

    def add(state, piece: str):
        piece = piece if state[1] == 0 else "\n\n" + piece
        state[0].update(piece.encode())
        return state[0], state[1] + len(piece)

    whole = R.folded(pages.select("book_id", "page_number", part.alias("p")), "book_id", ["page_number"], "p", "book_id string, chars bigint, hash string", lambda: (hashlib.md5(), 0), add, lambda key, state: (key, state[1], state[0].hexdigest()))
    named = whole.join(table(spark, d, "books").groupBy(F.col("id").alias("book_id")).agg(F.max("filename").alias("filename")), "book_id")
    name = F.coalesce(F.nullif(F.regexp_replace("filename", r"(?i)\.pdf$", ""), F.lit("")), F.lit("book"))
    return named.select("book_id", F.col("chars").cast("int").alias("chars"), "hash", F.concat(name, F.lit("_full.txt")).alias("name"))


_HEADED = " OR ".join(f"regexp_matches(e.x, '{p}')" for p in T.DISPLAY_HEADINGS)
_JOINED = lambda a, b: f"CASE WHEN {b} = '' THEN {a} WHEN {a} = '' THEN {b} ELSE {a} || chr(10) || chr(10) || {b} END"
SQL["txt_full_text_export"] = f"""WITH p AS (SELECT book_id, page_number, max(coalesce(nullif(raw_text, ''), text)) AS text, coalesce(max(trim(page_type)), 'Unknown') AS page_type FROM book_pages WHERE book_id IS NOT NULL AND page_number IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT *, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'n') AS l FROM p),
    f AS (SELECT *, list_reduce(list_transform(l, lambda x: {{'o': '', 'b': NULL::VARCHAR, 'w': '', 'n': NULL::VARCHAR, 'x': x}}), lambda s, e: CASE WHEN coalesce(e.x = s.b, false) OR coalesce(e.x = s.n, false) THEN s
        WHEN length(e.x) < 70 AND ({_HEADED}) THEN {{'o': {_JOINED("(" + _JOINED("s.o", "s.w") + ")", "e.x")}, 'b': e.x, 'w': '', 'n': NULL::VARCHAR, 'x': ''}}
        ELSE {{'o': s.o, 'b': s.b, 'w': CASE WHEN s.w = '' THEN e.x ELSE s.w || ' ' || e.x END, 'n': e.x, 'x': ''}} END, {{'o': '', 'b': NULL::VARCHAR, 'w': '', 'n': NULL::VARCHAR, 'x': ''}}) AS r FROM l),
    w AS (SELECT book_id, string_agg('--- PAGE ' || page_number || ' (' || page_type || ') ---' || chr(10) || chr(10) || {_JOINED("r.o", "r.w")}, chr(10) || chr(10) ORDER BY page_number) AS t FROM f GROUP BY 1)
    SELECT book_id, length(t)::INT AS chars, md5(t) AS hash, coalesce(nullif(regexp_replace(f, '(?i)\\.pdf$', ''), ''), 'book') || '_full.txt' AS name FROM w JOIN (SELECT id, max(filename) AS f FROM books GROUP BY 1) ON id = book_id"""


def txt_sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    """File names without characters that file systems reserve."""
    return table(spark, d, "books").select("id", T.sanitize_filename(F.col("filename")).alias("name"))


SQL["txt_sanitize_filename"] = r"""SELECT id, regexp_replace(filename, '[\\/*?:"<>| ]', '_', 'g') AS name FROM books"""


def txt_echo(spark: SparkSession, d: str) -> DataFrame:
    """Answers that mostly say the question again."""
    a = table(spark, d, "answer_results").where("answer is not null").select("answer_id", "question_id", "answer").distinct()
    return a.join(_questions(spark, d), "question_id").where(T.echoes(F.col("answer"), F.col("question"))).select("answer_id")


SQL["txt_echo"] = f"""WITH a AS (SELECT DISTINCT answer_id, question_id, answer FROM answer_results WHERE answer IS NOT NULL),
    t AS (SELECT answer_id, answer, question, list_distinct({_tokens("answer")}) AS s, list_distinct({_tokens("question")}) AS q FROM a JOIN qa_golden g ON g.id = a.question_id)
    SELECT answer_id FROM t WHERE len(s) > 0 AND len(q) > 0 AND (len(list_intersect(s, q)) = len(s) OR len(list_intersect(s, q)) / greatest(len(list_distinct(list_concat(s, q))), 1) >= 0.6
    OR suffix(regexp_replace(lower(answer), '[ ?.]+$', ''), regexp_replace(lower(question), '[ ?.]+$', '')))"""


def txt_clean_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers without page labels and heading marks."""
    a = table(spark, d, "answer_results").where("answer is not null").select("answer_id", "answer").distinct()
    return a.select("answer_id", T.without_heading_marks(T.without_citations(F.col("answer"))).alias("clean"))


SQL["txt_clean_answer"] = r"""WITH a AS (SELECT DISTINCT answer_id, answer FROM answer_results WHERE answer IS NOT NULL),
    c AS (SELECT answer_id, regexp_replace(regexp_replace(regexp_replace(answer, '(?i)\s*\[(?:page|pages)\s+\d+(?:\s*[-,]\s*\d+)*\]', '', 'g'), '\s{2,}', ' ', 'g'), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS t FROM a)
    SELECT answer_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\s*#{1,6}\s*', '', 'g'), '\s+#{1,6}\s+', chr(10) || chr(10), 'g'), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS clean FROM c"""


def hash_content(spark: SparkSession, d: str) -> DataFrame:
    """Content addresses of the documents."""
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


SQL["hash_content"] = "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1"


def hash_cache_key(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of the books' extractions: name, content, threshold, resolution and version."""
    return table(spark, d, "books").select("id", F.sha2(F.concat_ws(":", "filename", "sha256", F.lit("40"), F.lit("150"), F.lit("v5.0")), 256).alias("cache_key"))


SQL["hash_cache_key"] = "SELECT id, sha256(concat_ws(':', filename, sha256, '40', '150', 'v5.0')) AS cache_key FROM books"


def agg_boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that come again on many pages of a book."""
    return C.boilerplate(table(spark, d, "book_pages"))


SQL["agg_boilerplate_lines"] = f"""WITH {_PAGES}, n AS (SELECT book_id, count(DISTINCT page_number) AS n FROM pages GROUP BY 1),
    l AS (SELECT DISTINCT book_id, page_number, lower(raw) AS line FROM (SELECT book_id, page_number, trim(unnest(string_split(text, chr(10)))) AS raw FROM pages) WHERE raw <> '' AND length(raw) <= 60),
    c AS (SELECT book_id, line, count(*) AS pages FROM l GROUP BY 1, 2)
    SELECT book_id, line, pages FROM c JOIN n USING (book_id) WHERE n >= 4 AND pages >= greatest(3, floor(n * 0.3))"""


def win_section_carry(spark: SparkSession, d: str) -> DataFrame:
    """The section that holds at the end of each page, at most two pages after its heading."""
    lines = C.sections(C.kept_lines(table(spark, d, "book_pages")))
    return lines.groupBy("book_id", "page_number").agg(F.max_by("section", "line_no").alias("section"), F.max("segment").alias("headings"))


def win_adjacent_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Page texts without blank lines and lines said twice in a row."""
    pages = C.page_texts(table(spark, d, "book_pages")).where("text is not null")
    return pages.select("book_id", "page_number", F.md5(C.adjacent_distinct(F.col("text"))).alias("hash")).distinct()


SQL["win_adjacent_dedupe"] = f"""WITH {_PAGES}, s AS (SELECT book_id, page_number, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages WHERE text IS NOT NULL)
    SELECT DISTINCT book_id, page_number, md5(array_to_string(list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x), ' ')) AS hash FROM s"""


def win_chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut into section-aware chunks."""
    return C.chunk_pages(table(spark, d, "book_pages")).withColumn("figure_refs", F.array_join("figure_refs", ","))


def win_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Page texts rebuilt as paragraphs."""
    return C.page_texts(table(spark, d, "book_pages")).where("text is not null").select("book_id", "page_number", C.paragraphs(F.col("text")).alias("paragraphs"))


SQL["win_paragraphs"] = f"""WITH {_PAGES}, l AS (SELECT book_id, page_number, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> 'n') AS l FROM pages WHERE text IS NOT NULL),
    k AS (SELECT book_id, page_number, list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x) AS l FROM l),
    h AS (SELECT *, list_transform(l, lambda x: {{'x': x, 'h': length(x) < 70 AND (regexp_matches(x, '{T.NUMBERED_HEADING}') OR regexp_matches(x, '^[A-Z][A-Z\\s]{{4,}}$'))}}) AS h FROM k)
    SELECT book_id, page_number, array_to_string(list_transform(h, lambda e, i: CASE WHEN i = 1 THEN '' WHEN h[i - 1].h OR e.h THEN chr(10) || chr(10) ELSE ' ' END || e.x), '') AS paragraphs FROM h"""

_DOCS = "docs AS (SELECT chunk_id, max(book_id) AS book_id, max(text) AS text, max(kind) AS kind, max(section) AS section, max(page_number) AS page_number FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)"
_ASKS = "asks AS (SELECT id AS question_id, book AS book_id, question FROM qa_golden)"
_SCORES_OF = f"""{_DOCS}, w AS (SELECT chunk_id, book_id, {_tokens("CASE WHEN section IS NOT NULL THEN section || '. ' || text ELSE text END")} AS words FROM docs),
    tf AS (SELECT book_id, chunk_id, token, count(*) AS tf FROM (SELECT book_id, chunk_id, unnest(words) AS token FROM w) GROUP BY 1, 2, 3),
    df AS (SELECT book_id, token, count(*) AS df FROM tf GROUP BY 1, 2), ln_ AS (SELECT book_id, chunk_id, sum(tf) AS dl, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY 1, 2),
    bk AS (SELECT book_id, count(*) AS n, avg(len(words)) AS avgdl FROM w GROUP BY 1),
    qt AS (SELECT question_id, book_id, token, count(*) AS qtf FROM (SELECT question_id, book_id, unnest({_tokens("question")}) AS token FROM asks) GROUP BY 1, 2, 3),
    qn AS (SELECT question_id, sqrt(sum(qtf * qtf)) AS qnorm FROM qt GROUP BY 1),
    sc AS (SELECT qt.question_id, tf.chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 8) AS bm25, round(sum(qtf * tf) / (any_value(norm) * any_value(qnorm)), 8) AS cosine
        FROM qt JOIN df USING (book_id, token) JOIN bk USING (book_id) JOIN tf USING (book_id, token) JOIN ln_ USING (book_id, chunk_id) JOIN qn USING (question_id) GROUP BY 1, 2),
    rb AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, chunk_id) - 1 AS rank FROM sc WHERE bm25 > 0), rc AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, chunk_id) - 1 AS rank FROM sc WHERE cosine > 0)"""
_FUSED_OF = f"""un AS (SELECT question_id, chunk_id, sum(r) AS rrf FROM (SELECT question_id, chunk_id, 1 / (60 + rank + 1) AS r FROM rb WHERE rank < 50 UNION ALL SELECT question_id, chunk_id, 1 / (60 + rank + 1) FROM rc WHERE rank < 50) GROUP BY 1, 2),
    bo AS (SELECT question_id, un.chunk_id, round(rrf + CASE WHEN regexp_matches(question, '(?i)\\b(equation|reaction|formula|react|reacts|balanced|chemical change)\\b') AND regexp_matches(text, '(→|->|⟶|\\+\\s*[A-Z][a-z]?\\d*\\s*(?:\\(|→)|=)') THEN 0.5 / 60 ELSE 0 END, 8) AS rrf
        FROM un JOIN docs USING (chunk_id) JOIN asks USING (question_id)),
    fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, chunk_id) - 1 AS rank FROM bo) WHERE rank < 20)"""
_SCORES = f"{_ASKS}, {_SCORES_OF}"
_FUSED = f"{_SCORES}, {_FUSED_OF}"


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of each question by BM25."""
    return R.ranked(R.scores(_index(spark, d), _questions(spark, d), 10).where("bm25 > 0"), "bm25", 10).select("question_id", "chunk_id", "rank")


SQL["bm25_topk"] = f"WITH {_SCORES} SELECT question_id, chunk_id, rank::INT AS rank FROM rb WHERE rank < 10"


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best chunks of each question by both rankings."""
    index, q = _index(spark, d), _questions(spark, d)
    return R.fused(R.scores(index, q, R.POOL), index, q).select("question_id", "chunk_id", "rrf", "rank")


SQL["rrf_fusion"] = f"WITH {_FUSED} SELECT question_id, chunk_id, rrf, rank::INT AS rank FROM fu"


def _ranking(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = _questions(spark, d)
    return A.ranking(_index(spark, d), q), q


def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by shared tokens, exercises put back."""
    return A.places(_index(spark, d), _questions(spark, d)).select("question_id", "chunk_id", "score", "place")


_RERANK_OF = f"""rr AS (SELECT fu.question_id, fu.chunk_id, fu.rank, round(CASE WHEN len(qs) > 0 THEN -10 + 18 * (len(list_intersect(qs, ts)) / len(qs)) ELSE -10 END, 6) - CASE WHEN lower(kind) = 'exercise' THEN 3.0 ELSE 0 END AS score
        FROM fu JOIN (SELECT question_id, list_distinct({_tokens("question")}) AS qs FROM asks) USING (question_id) JOIN (SELECT chunk_id, kind, {_tokens("CASE WHEN section IS NOT NULL THEN section || '. ' || text ELSE text END")} AS ts FROM docs) USING (chunk_id)),
    pl AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS place FROM rr)"""
_RERANK = f"{_FUSED}, {_RERANK_OF}"
SQL["lexical_rerank"] = f"WITH {_RERANK} SELECT question_id, chunk_id, score, place::INT AS place FROM pl"


def lexical_span(spark: SparkSession, d: str) -> DataFrame:
    """The best sentence of the first contexts and its margin."""
    return A.spans(_ranking(spark, d)[0])


_SPANS_OF = f"""se AS (SELECT question_id, place, l[i] AS sentence, i FROM (SELECT question_id, place, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT question_id, place, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM pl JOIN docs USING (chunk_id) WHERE place <= 3))),
    ss AS (SELECT question_id, place, i, sentence, round(10 * (len(list_intersect(qs, {_tokens("sentence")})) / len(qs)), 6) AS s FROM se JOIN (SELECT question_id, list_distinct({_tokens("question")}) AS qs FROM asks) USING (question_id) WHERE len(qs) > 0),
    sp AS (SELECT question_id, sentence AS span, s - 5 AS margin FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, place, i) AS rn FROM ss WHERE s > 0) WHERE rn = 1)"""
_SPANS = f"{_RERANK}, {_SPANS_OF}"
SQL["lexical_span"] = f"WITH {_SPANS} SELECT * FROM sp"


def sufficiency(spark: SparkSession, d: str) -> DataFrame:
    """Whether the book covers each question, and how sure that is."""
    index, q = _index(spark, d), _questions(spark, d)
    placed, _ = cut(A.places(index, q), "ranking")
    out = A.decided(placed, A.spans(A.told(placed, index, q)), q)
    return out.select("question_id", F.coalesce("top", F.lit(-99.0)).alias("top"), F.coalesce("margin", F.lit(-99.0)).alias("margin"), "sufficient", "confidence")


SQL["sufficiency"] = f"""WITH {_SPANS}, t AS (SELECT id AS question_id, score AS top, margin FROM qa_golden LEFT JOIN pl ON pl.question_id = id AND place = 1 LEFT JOIN sp ON sp.question_id = id)
    SELECT question_id, coalesce(top, -99.0)::DOUBLE AS top, coalesce(margin, -99.0)::DOUBLE AS margin, coalesce(top >= -2.5 AND (coalesce(margin, '-infinity'::DOUBLE) >= 0 OR top >= 3), false) AS sufficient,
    round(coalesce(1 / (1 + exp(-top / 2)) * CASE WHEN margin IS NULL THEN 0.5 ELSE 1 / (1 + exp(-margin / 2)) END, 0.0), 4) AS confidence FROM t"""


def offline_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers of all questions."""
    return A.answers(table(spark, d, "chunks"), _questions(spark, d))


def comparison_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers to the questions that compare two things, asked in the operator's third wording."""
    asked = _comparisons(spark, d).where("form = 2").select(F.col("id").alias("question_id"), "book_id", "question")
    out, cites = A.decisions(table(spark, d, "chunks"), asked)
    listed = cites.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("cited"))
    return out.join(listed, "question_id", "left").select("question_id", "answer", "extractive", "sufficient", "confidence", "mode", "reason", "parts", "cited")


_CLEAN = r"regexp_replace(trim(regexp_replace(regexp_replace(trim(raw), '^(?:[nqlv•▪●■]\s+)+', ''), '\s+', ' ', 'g')), '^[ \-–]+|[ \-–]+$', '', 'g')"
_ANSWERS_OF = rf"""cx AS (SELECT pl.question_id, place, page_number, {_PIECES} AS l FROM pl JOIN docs USING (chunk_id) WHERE place <= 3),
    cf AS (SELECT question_id, place, page_number, {_FOLD("l")} AS f FROM cx),
    cs AS (SELECT question_id, place, page_number, unnest(CASE WHEN f.open = '' THEN f.done ELSE list_append(f.done, f.open) END) AS raw, generate_subscripts(CASE WHEN f.open = '' THEN f.done ELSE list_append(f.done, f.open) END, 1) AS pos FROM cf),
    cl AS (SELECT question_id, place, page_number, pos, {_CLEAN} AS sentence, question FROM cs JOIN asks USING (question_id)),
    ct AS (SELECT *, list_distinct({_tokens("sentence")}) AS st, list_distinct({_tokens("question")}) AS qs, array_to_string({_tokens("sentence")}, ' ') AS k FROM cl),
    ci AS (SELECT * FROM ct WHERE len({_WORDS("sentence")}) >= 6 AND length(sentence) <= 450 AND NOT suffix(sentence, '?') AND NOT regexp_matches(sentence, '{T.IMPERATIVE}') AND NOT regexp_matches(sentence, '{T.EXERCISE}')
        AND NOT (length(sentence) <= 90 AND NOT regexp_matches(sentence, '[.?,;]$') AND (regexp_matches(sentence, '{T.NUMBERED_HEADING}') OR regexp_matches(sentence, '{T.CAPS_HEADING.replace("'", "''")}')))
        AND NOT (len(st) > 0 AND len(qs) > 0 AND (len(list_intersect(st, qs)) = len(st) OR len(list_intersect(st, qs)) / greatest(len(list_distinct(list_concat(st, qs))), 1) >= 0.6 OR suffix(regexp_replace(lower(sentence), '[ ?.]+$', ''), regexp_replace(lower(question), '[ ?.]+$', ''))))),
    co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, k ORDER BY place, pos) AS rn FROM ci) WHERE rn = 1),
    cm AS (SELECT co.*, coalesce(span <> '' AND contains(sentence, span), false) AS holds, round(CASE WHEN len(qs) > 0 THEN -10 + 18 * (len(list_intersect(qs, st)) / len(qs)) ELSE -10 END, 6) AS s FROM co LEFT JOIN sp_ USING (question_id)),
    cw AS (SELECT *, holds AND row_number() OVER (PARTITION BY question_id, holds ORDER BY s DESC, place, pos) = 1 AS own, greatest(-3.0, max(s) OVER (PARTITION BY question_id) - 3) AS lim FROM cm),
    cr AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY question_id ORDER BY own DESC, s DESC, place, pos) AS rn FROM cw WHERE own OR s >= lim) WHERE rn <= 3),
    made AS (SELECT question_id, string_agg(sentence, ' ' ORDER BY page_number, place, pos) AS answer, list(place ORDER BY page_number, place, pos) AS used FROM cr GROUP BY 1),
    de AS (SELECT question_id, score AS top, margin, span, coalesce(score >= -2.5 AND (coalesce(margin, '-infinity'::DOUBLE) >= 0 OR score >= 3), false) AS enough FROM asks LEFT JOIN (SELECT question_id, score FROM pl WHERE place = 1) USING (question_id) LEFT JOIN sp_ USING (question_id))"""
_SPANS_NAMED = _SPANS_OF.replace("sp AS (", "sp_ AS (")
SQL["offline_answer"] = f"""WITH {_RERANK}, {_SPANS_NAMED}, {_ANSWERS_OF},
    us AS (SELECT question_id, unnest(coalesce(used, [1])) AS place, generate_subscripts(coalesce(used, [1]), 1) AS i FROM de LEFT JOIN made USING (question_id) WHERE enough),
    uf AS (SELECT question_id, page_number, min(i) AS i FROM us JOIN pl USING (question_id, place) JOIN docs USING (chunk_id) GROUP BY 1, 2), pg AS (SELECT question_id, string_agg(page_number::VARCHAR, ',' ORDER BY i) AS pages FROM uf GROUP BY 1),
    be AS (SELECT question_id, substr(text, 1, 300) AS b FROM pl JOIN docs USING (chunk_id) WHERE place = 1)
    SELECT question_id, CASE WHEN enough THEN coalesce(nullif(coalesce(nullif(answer, ''), span, ''), ''), CASE WHEN margin >= 0 THEN span END, b) ELSE '{A.NOT_COVERED}' END AS answer, enough AS sufficient,
    round(coalesce(1 / (1 + exp(-top / 2)) * CASE WHEN margin IS NULL THEN 0.5 ELSE 1 / (1 + exp(-margin / 2)) END, 0.0), 4) AS confidence, pages FROM de LEFT JOIN made USING (question_id) LEFT JOIN pg USING (question_id) LEFT JOIN be USING (question_id)"""
SQL["comparison_answer"] = f"""WITH {_ASKED}, c2 AS (SELECT id, book_id, question FROM c1 WHERE form = 2), {_splits("c2")},
    parted AS (SELECT id, book_id, 0 AS part, NULL AS concept, question FROM c2 UNION ALL SELECT id, book_id, 1, a, 'What is ' || a || '?' FROM sp UNION ALL SELECT id, book_id, 2, b, 'What is ' || b || '?' FROM sp),
    asks AS (SELECT id || '#' || part AS question_id, id, book_id, part, concept, question, max(part) OVER (PARTITION BY id) AS parts FROM parted),
    {_SCORES_OF}, {_FUSED_OF}, {_RERANK_OF}, {_SPANS_NAMED}, {_ANSWERS_OF},
    ea AS (SELECT asks.id, part, concept, parts, top, margin, span, enough, answer, used, question_id, coalesce(nullif(answer, ''), span, '') AS t FROM asks JOIN de USING (question_id) LEFT JOIN made USING (question_id) WHERE (parts = 0) = (part = 0)),
    jo AS (SELECT id, min(coalesce(top, '-infinity'::DOUBLE)) AS top, min(coalesce(margin, '-infinity'::DOUBLE)) AS margin, bool_and(enough) AS enough, max(parts) AS parts, any_value(span) AS span,
        coalesce(string_agg(CASE WHEN t <> '' THEN CASE WHEN parts > 0 THEN upper(concept[1]) || substr(concept, 2) || ': ' || t ELSE t END END, chr(10) || chr(10) ORDER BY part), '') AS t FROM ea GROUP BY 1),
    us AS (SELECT id, part, question_id, unnest(coalesce(used, [1])) AS place, generate_subscripts(coalesce(used, [1]), 1) AS i FROM ea),
    uf AS (SELECT id, chunk_id, min((part, i)) AS spot FROM us JOIN pl USING (question_id, place) GROUP BY 1, 2), un_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY spot) AS ord FROM uf),
    ci_ AS (SELECT id, string_agg(chunk_id, ',' ORDER BY ord) AS cited FROM un_ JOIN jo USING (id) WHERE enough AND ord <= 3 + CASE WHEN parts > 0 THEN 1 ELSE 0 END GROUP BY 1),
    po AS (SELECT id, chunk_id, place, CASE part WHEN 0 THEN 9 ELSE part END AS ls, parts FROM asks JOIN pl USING (question_id)),
    fi AS (SELECT id, substr(text, 1, 300) AS b FROM (SELECT id, chunk_id, row_number() OVER (PARTITION BY id ORDER BY place, ls) AS rn FROM po WHERE parts > 0 OR ls = 9) JOIN docs USING (chunk_id) WHERE rn = 1),
    ou AS (SELECT jo.*, CASE WHEN parts = 0 AND margin >= 0 THEN span END AS ex, b, cited FROM jo LEFT JOIN fi USING (id) LEFT JOIN ci_ USING (id))
    SELECT id AS question_id, CASE WHEN enough THEN coalesce(nullif(t, ''), ex, b) ELSE '{A.NOT_COVERED}' END AS answer, CASE WHEN enough THEN ex END AS extractive, enough AS sufficient,
    round(CASE WHEN isinf(top) THEN 0.0 ELSE 1 / (1 + exp(-top / 2)) * CASE WHEN isinf(margin) THEN 0.5 ELSE 1 / (1 + exp(-margin / 2)) END END, 4) AS confidence, 'offline' AS mode, CASE WHEN isinf(top) AND parts = 0 THEN 'no_candidates' WHEN NOT enough THEN 'below_threshold' END AS reason, parts::INT AS parts, cited FROM ou"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Cited chunks of all questions."""
    return A.citations(_ranking(spark, d)[0]).drop("section", "figures")


SQL["citations"] = f"""WITH {_RERANK} SELECT question_id, place::INT AS place, chunk_id, page_number, CASE WHEN length(text) <= 280 THEN text ELSE regexp_replace(substr(text, 1, 277), '\\s+\\S*$', '') || '...' END AS snippet
    FROM pl JOIN docs USING (chunk_id) WHERE place <= 3"""


def grounding_verify(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all given answers against retrieved passages."""
    given = table(spark, d, "answer_results").where("answer is not null").select("answer_id", "question_id", "answer").distinct()
    claims = given.select("answer_id", "question_id", F.posexplode(T.sentences(F.col("answer"))).alias("sentence_no", "sentence"))
    return A.grounded(claims, _ranking(spark, d)[0].select("question_id", "place", "text"))


_ENTAILED = lambda q, t: f"CASE WHEN len({q}) = 0 THEN 0.0 WHEN len(list_intersect({q}, {t})) / len({q}) >= 0.8 THEN 1.0 ELSE len(list_intersect({q}, {t})) / len({q}) / 2 END"
SQL["grounding_verify"] = f"""WITH {_RERANK}, gi AS (SELECT DISTINCT answer_id, question_id, answer AS text FROM answer_results WHERE answer IS NOT NULL), gf AS (SELECT answer_id, question_id, {_FOLD(_PIECES)} AS f FROM gi),
    gs AS (SELECT answer_id, question_id, CASE WHEN f.open = '' THEN f.done ELSE list_append(f.done, f.open) END AS s FROM gf), cl AS (SELECT answer_id, question_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INT AS sentence_no FROM gs),
    u AS (SELECT DISTINCT question_id, sentence, list_distinct({_tokens("sentence")}) AS q, len({_tokens("sentence")}) < 4 AS short, regexp_extract_all(sentence, '[A-Za-z0-9]+') AS parts FROM cl),
    pa AS (SELECT question_id, place, text, {_tokens("text")} AS tt, array_to_string({_WORDS("text")}[1:320], ' ') AS premise, regexp_extract_all(text, '[A-Za-z0-9]+') AS tp FROM pl JOIN docs USING (chunk_id) WHERE place <= 8),
    r AS (SELECT u.*, place, coalesce(premise, '') AS premise, coalesce(tp, []) AS tp, row_number() OVER (PARTITION BY u.question_id, sentence ORDER BY coalesce(len(list_intersect(q, tt)), 0) DESC, place) AS rn FROM u LEFT JOIN pa ON pa.question_id = u.question_id),
    g AS (SELECT question_id, sentence, any_value(q) AS q, any_value(short) AS short, any_value(parts) AS parts, max(CASE WHEN rn <= 2 THEN {_ENTAILED("q", _tokens("premise"))} END) AS single, string_agg(CASE WHEN rn <= 2 THEN premise END, ' ' ORDER BY rn) AS joined, count(*) FILTER (rn <= 2) AS k, list_distinct(flatten(list(tp))) AS seen FROM r GROUP BY 1, 2),
    v AS (SELECT question_id, sentence, CASE WHEN short THEN CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: NOT list_contains(seen, x))) = 0 THEN 1.0 ELSE 0.0 END
        ELSE greatest(single, CASE WHEN single < 0.5 AND k > 1 THEN {_ENTAILED("q", _tokens("joined"))} ELSE 0.0 END) END AS score FROM g)
    SELECT answer_id, cl.question_id, sentence_no, round(score, 6)::DOUBLE AS score, score >= 0.5 AS kept FROM cl JOIN v ON v.question_id IS NOT DISTINCT FROM cl.question_id AND v.sentence = cl.sentence"""


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return R.nearest(e, e.where("vec_id % 50 = 0")).select("query", "vec_id", "score", "rank")


SQL["dense_topk"] = """SELECT query, vec_id, score, rank::INT AS rank FROM (SELECT q.vec_id AS query, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 10"""


def index_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of the books' index texts."""
    return R.fingerprint(_docs(spark, d))


SQL["index_fingerprint"] = f"""WITH {_DOCS} SELECT book_id, substr(sha256('lexical' || string_agg(CASE WHEN section IS NOT NULL THEN section || '. ' || text ELSE text END, '' ORDER BY page_number, regexp_extract(chunk_id, 'c(\\d+)$', 1)::INT, chunk_id)), 1, 24) AS fingerprint FROM docs GROUP BY 1"""

QUERIES = [
    src_documents_scan, flt_lane_routing, flt_page_status, flt_heading, flt_equation, flt_visual_question, txt_tokens, txt_terms, txt_clean_line, txt_sentences, txt_figure_refs, txt_explicit_reference,
    txt_caption_parse, txt_comparison_split, txt_snippet, txt_full_text_export, txt_sanitize_filename, txt_echo, txt_clean_answer, hash_content, hash_cache_key, agg_boilerplate_lines, win_section_carry, win_adjacent_dedupe,
    win_chunk_pack, win_paragraphs, bm25_topk, rrf_fusion, lexical_rerank, lexical_span, sufficiency, offline_answer, comparison_answer, citations, grounding_verify, dense_topk, index_fingerprint,
]
