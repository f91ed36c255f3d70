"""The queries pN_ over the tables of TESTDATA.md, and SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import answers, leaks, neighbours, overlap, pieces, quality, scans, splits, tokens
from leafmill.sources.tables import table

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("LEAFMILL_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of most similar vectors."""
    return neighbours.found(table(spark, d, "book_index"))


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 50, by greedy search of the unlimited graph."""
    return neighbours.searched(table(spark, d, "book_index"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers."""
    return answers.found(table(spark, d, "answer_results"), table(spark, d, "qa_golden"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of noise of the scanned pages."""
    return scans.found(table(spark, d, "book_pages"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages as continuous paragraphs."""
    return scans.repaired(table(spark, d, "book_pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Train records and val or test records of the same page."""
    return overlap.found(table(spark, d, "dataset_manifest"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Overlap per split and source."""
    return overlap.coverage(table(spark, d, "dataset_manifest"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut."""
    return pieces.found(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the chunks that had to be cut."""
    return pieces.pieces(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose group stands in more than one split."""
    return splits.found(table(spark, d, "dataset_manifest"), table(spark, d, "source_links"))


def p6_assigned(spark: SparkSession, d: str) -> DataFrame:
    """A split for every record that keeps works together."""
    return splits.assign(table(spark, d, "dataset_manifest"), table(spark, d, "source_links"))


def p6_balance(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the splits in each dataset, as given and as assigned."""
    return splits.balance(table(spark, d, "dataset_manifest"), table(spark, d, "source_links"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 12 or more consecutive words of an evaluation item."""
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents and the best coverage."""
    return leaks.by_item(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 12 words of an evaluation item with up to two of them edited."""
    return leaks.near(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Lists, tables and junk among the documents."""
    return quality.found(table(spark, d, "documents"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts, ratios and shape of every document."""
    return quality.statistics(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_search, p2_found, p3_found, p3_repaired, p4_found, p4_coverage, p5_found, p5_pieces, p6_found, p6_assigned, p6_balance, p7_ids, p8_found, p8_by_item, p8_near, p9_found, p9_statistics)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL = {
    "p5_found": """
        SELECT DISTINCT c.chunk_id FROM chunks c
        JOIN chunk_limits l ON l.kind = coalesce(nullif(lower(trim(c.kind)), ''), 'body')
        WHERE length(c.text) > l.max_chars AND c.chunk_id IS NOT NULL""",
    "p6_found": """
        WITH RECURSIVE records AS (
            SELECT DISTINCT lower(trim(dataset)) AS d, lower(trim(source_id)) AS s,
                   CASE lower(trim(split)) WHEN 'validation' THEN 'val' WHEN 'val' THEN 'val' WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' END AS sp
            FROM dataset_manifest WHERE trim(dataset) <> '' AND trim(source_id) <> ''),
        e AS (
            SELECT lower(trim(dataset_a)) || chr(31) || lower(trim(source_a)) AS a, lower(trim(dataset_b)) || chr(31) || lower(trim(source_b)) AS b FROM source_links
            UNION SELECT lower(trim(dataset_b)) || chr(31) || lower(trim(source_b)), lower(trim(dataset_a)) || chr(31) || lower(trim(source_a)) FROM source_links),
        reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
        root AS (SELECT a AS node, least(a, min(b)) AS root FROM reach GROUP BY a),
        member AS (SELECT d, s, sp, coalesce(root, d || chr(31) || s) AS root FROM records LEFT JOIN root ON node = d || chr(31) || s),
        mixed AS (SELECT root FROM member GROUP BY root HAVING count(DISTINCT sp) > 1)
        SELECT DISTINCT d AS dataset, s AS source_id FROM member WHERE root IN (SELECT root FROM mixed)""",
    "p8_found": r"""
        WITH i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        iw AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        dw AS (SELECT doc_id, array_to_string(w[p : p + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)""",
    "p8_by_item": r"""
        WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL AND item_id IS NOT NULL),
        iw AS (SELECT item_id, len(w) AS words, p, array_to_string(w[p : p + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        dw AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
        m AS (SELECT doc_id, item_id, words, len(list_distinct(flatten(list(range(p, p + 12))))) AS matched FROM dw JOIN iw USING (run) GROUP BY 1, 2, 3)
        SELECT item_id, count(*) AS documents, count(*) FILTER (matched = words) AS whole, round(max(matched / words), 6) AS best_share FROM m GROUP BY 1""",
}
