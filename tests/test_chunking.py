from pyspark.sql import functions as F

from leafmill.operators import chunking as C
from leafmill.operators.chunking import MAX_WORDS, TARGET_WORDS, boilerplate, chunk_pages, kept_lines, sections

SCHEMA = "book_id string, page_number int, raw_text string, text string"


def frame(spark, pages, book="b1"):
    return spark.createDataFrame([(book, n, t, None) for n, t in pages], SCHEMA)


def packed(lines):
    """The same packing, line by line."""
    out, text, n = [], [], 0
    for line in lines:
        text.append(line)
        n += len(line.split())
        if (n >= TARGET_WORDS and line[-1] in ".!?") or n >= MAX_WORDS:
            out.append(" ".join(text))
            text, n = [], 0
    return out + ([" ".join(text)] if text else [])


def test_boilerplate_counts_pages_not_lines(spark):
    pages = [(i, f"Reprint 2026-27\nReprint 2026-27\nline {i} of this page") for i in range(1, 6)] + [(6, "")]
    assert [(r.line, r.pages) for r in boilerplate(frame(spark, pages)).collect()] == [("reprint 2026-27", 5)]
    assert boilerplate(frame(spark, pages[:3])).count() == 0


def test_sections_hold_for_two_pages(spark):
    pages = [(1, "VIKING AGE\nThe ships were long and very fast.")] + [(i, f"Body number {i} goes on for a while.") for i in range(2, 8)]
    got = {r.page_number: r.section for r in sections(kept_lines(frame(spark, pages))).where("not heading").collect()}
    assert got == {1: "VIKING AGE", 2: "VIKING AGE", 3: "VIKING AGE", 4: None, 5: None, 6: None, 7: None}


def test_packing_against_plain_fold(spark):
    lines = [f"Line {i} says something about {'the wet soil ' * (i % 7)}{'and stops.' if i % 3 else 'and goes on'}" for i in range(80)]
    got = chunk_pages(frame(spark, [(1, "1.1 Corrosion\n" + "\n".join(lines))])).collect()
    from pyspark.sql import functions as F

    from leafmill.functions import text as T

    clean = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", T.clean_line(F.col("x")).alias("v")).orderBy("i").collect()]
    assert [r.text for r in sorted(got, key=lambda r: int(r.chunk_id.rsplit("c", 1)[1]))] == packed(clean)
    assert {r.section for r in got} == {"1.1 Corrosion"} and sorted(r.chunk_id for r in got)[0] == "b1:p1:c0"


def test_ordinals_run_over_pages_and_repeats_change_nothing(spark):
    pages = [(1, "One two three four.\n\nEXERCISES HERE\n1. What is it? 2. Why is it so?"), (2, "no"), (3, "See Figure 2.1 and Table 4 for more.")]
    got = {r.chunk_id: (r.kind, r.section, list(r.figure_refs)) for r in chunk_pages(frame(spark, pages + pages)).collect()}
    assert got == {"b1:p1:c0": ("body", None, []), "b1:p1:c1": ("exercise", "EXERCISES HERE", []), "b1:p3:c2": ("body", "EXERCISES HERE", ["2.1", "4"])}
    assert chunk_pages(frame(spark, [(1, None), (2, "")])).count() == 0


def test_display_text(spark):
    text = "CHAPTER ONE\nn\nCHAPTER ONE\nfirst line\nfirst line\nsecond line\r\n1.2 The Heading\nafter it\nN\n  last  "
    rows = spark.createDataFrame([(text,), (None,), ("",), ("one\n\ntwo",)], "t string").select(C.display_text(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == ["CHAPTER ONE\n\nfirst line second line\n\n1.2 The Heading\n\nafter it last", "", "", "one two"]
