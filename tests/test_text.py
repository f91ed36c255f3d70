import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_tokens_and_terms(spark):
    assert values(spark, ["What is the pH of 2 acids, acids?", "", None], T.tokens) == [["ph", "acids", "acids"], [], None]
    assert values(spark, ["Draw the heart-valve diagram of an ox"], T.terms) == [["heart", "valve"]]


def test_lines_and_headings(spark):
    assert values(spark, ["a\r\nb\rc d\x0be", None], T.lines) == [["a", "b", "c", "d", "e"], []]
    lines = ["1.1 Corrosion", "EXERCISES AND MORE", "1.1 Corrosion ends here.", "Short", "2 Corrosion", "1.2 lower case", "4.5.6 Deep Heading Here"]
    assert values(spark, lines, T.is_heading) == [True, True, False, False, False, False, True]
    assert values(spark, ["n Corrosion is slow", "• (a) item", "the wet soil the wet soil the wet soil dries", "  a   b ", None], T.clean_line) == ["Corrosion is slow", "(a) item", "the wet soil dries", "a b", None]
    assert values(spark, ["Q U E S T I O N S ?", "A B", "A BC D E"], T.is_spaced_letters) == [True, False, False]


def test_long_lines(spark):
    rest = " ".join(f"w{i}" for i in range(60_000))
    got = values(spark, [f"the wet soil the wet soil the wet soil dries {rest}", "the wet soil " * 200_000, rest, "a" * 300_000, "ab" + " " * 50_000 + "cd"], T.clean_line)
    assert got == [f"the wet soil dries {rest}", "the wet soil", rest, "a" * 300_000, "ab cd"]


def test_sentences(spark):
    got = values(spark, ["It melts. Why? (a) Heat it. (b) Cool it.", "1. What is it? 2. Name one.", "No end", ""], T.sentences)
    assert got == [["It melts.", "Why?", "(a) Heat it.", "(b) Cool it."], ["1. What is it?", "2. Name one."], ["No end"], []]
    assert values(spark, ["1. What is it? 2. Name one.", "It melts. It cools. Why?"], lambda t: T.is_exercise(T.sentences(t))) == [True, False]


def test_references(spark):
    assert values(spark, ["See Fig. 2.3, Table 4 and figure 2.3.", "none"], T.figure_refs) == [["2.3", "4"], []]
    assert values(spark, ["Table 3 and Figure 1.2", "fig 7", "Activity 5.1", "nothing", None], T.explicit_reference) == ["1.2", "7", "5.1", None, None]


def test_captions(spark):
    texts = ["Figure 2.9 Figure 2.9 Removing water from crystals", "Figure 2 shows how it melts", "Table 4.1: Metals", "Fig. 3.2 (b) - Two wires", "n Figure 1.1 A cell", "Figure 2.10.11.12 x", "The figure 2", None]
    got = [v and (v.kind, v.number, v.sub, v.text, v.label) for v in values(spark, texts, T.parse_caption)]
    assert got[:5] == [("figure", "2.9", None, "Removing water from crystals", "Figure 2.9"), None, ("table", "4.1", None, "Metals", "Table 4.1"), ("figure", "3.2", "b", "Two wires", "Figure 3.2(b)"), ("figure", "1.1", None, "A cell", "Figure 1.1")]
    assert got[5:] == [None, None, None]
    long = "word " * 60
    assert len(values(spark, [long], T.clean_caption)[0]) <= 220 and values(spark, ["12 -", "  "], T.clean_caption) == [None, None]


@pytest.mark.parametrize(
    ("question", "pair"),
    [
        ("What is the difference between aerobic and anaerobic respiration?", ["aerobic respiration", "anaerobic respiration"]),
        ("How is a prism different from the lens?", ["prism", "lens"]),
        ("Compare plants with animals.", ["plants", "animals"]),
        ("Acids vs. bases", ["Acids", "bases"]),
        ("What is photosynthesis?", None),
        ("Difference between salt and SALT", None),
    ],
)
def test_comparisons(spark, question, pair):
    assert values(spark, [question], T.split_comparison) == [pair]


def test_answers(spark):
    df = spark.createDataFrame([("What is corrosion of iron?", s) for s in ("Corrosion of iron is what?", "Corrosion eats metals when air and moisture reach the surface.", "Write down what corrosion does to the iron gate.", "Too short here.")], "q string, s string")
    assert [r.v for r in df.select(T.is_answer_sentence(F.col("s"), F.col("q")).alias("v")).collect()] == [False, True, False, False]
    assert values(spark, ["It is wet [page 3, 4].  Yes [Pages 1-2]"], T.without_citations) == ["It is wet. Yes"]
    assert values(spark, ["# Head\ntext ## more"], T.without_heading_marks) == ["Head\ntext\n\nmore"]
    assert values(spark, ["x" * 280, "word " * 80], T.snippet)[0] == "x" * 280 and values(spark, ["word " * 80], T.snippet)[0].endswith("word...")
    assert values(spark, ['a/b:c "d".pdf'], T.sanitize_filename) == ["a_b_c__d_.pdf"]


def test_labels_said_many_times(spark):
    text = "Figure 3.1 " * 9 + ": The valve opens slowly"
    row = spark.createDataFrame([(text,)], "t string").select(T.parse_caption(F.col("t")).alias("c")).first().c
    assert (row.number, row.text) == ("3.1", "The valve opens slowly")
