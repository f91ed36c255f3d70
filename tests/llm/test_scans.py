import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm.scans import CONFUSIONS, _folded, _repair, corrections, fold, found, line_breaks, repaired

SCHEMA = "page_id string, book_id string, page_number int, page_type string, raw_text string, text string, noise string"
BODY = "The mineral forms between soft rubber and sea water. The heat-resistant friction becomes dense under the lamp, and the curved mirror keeps its shape.\nA second paragraph follows the first one."


def test_folding_undoes_every_confusion(spark):
    words = ["mineral", "curved", "becomes", "field", "delicate", "turns", "burner", "cloudy", "first", "granite", "cubic", "height", "wooden", "flow", "bubbles", "sulphur"]
    rows = [(w, w[:i] + a + w[i + len(b) :]) for w in words for a, b in CONFUSIONS for i in range(len(w)) if w.startswith(b, i)]
    df = spark.createDataFrame(rows, "printed string, read string")
    assert df.where(fold(F.col("printed")) != fold(F.col("read"))).count() == 0
    known = spark.createDataFrame([(w, 50, 10) for w in words], "word string, n long, clean long")
    unknown = df.where("read != printed").select(F.col("read").alias("word"), F.lit(1).alias("n")).distinct()
    got = {r.word: r.printed for r in corrections(known, unknown).collect()}
    assert all(got[read] == printed for printed, read in rows if read != printed)
    assert corrections(known, spark.createDataFrame([("renimal", 1), ("fieldd", 1), ("fiddle", 2)], "word string, n int")).count() == 0


def pages():
    rng = random.Random(1)
    rows = [(f"c{i}", "b0", i, "Digital", BODY, None, None) for i in range(8)]
    wrap = lambda head, body, foot: "\n".join(x for x in (head, body, foot) if x)
    lines = BODY.replace("mineral forms", "mineral\nforms").replace("friction ", "friction\n")
    cases = {
        "s1": (wrap("Earth Reader 6 | Melting And Rusting", lines, "Page 71"), {"running_header", "page_number"}),
        "s2": (wrap("Earth Reader 6 | Me1ting And Rusting", lines.replace("mineral", "m|neral"), None), {"running_header", "misread_char"}),
        "s3": (wrap("3.6 More On Melting With Tin", lines.replace("rubber", "rub-\nber"), "— 73 —"), {"hyphen_break", "page_number"}),
        "s4": (wrap(None, lines.replace("heat-resistant", "heat-\nresistant"), "lxxiv"), {"page_number"}),
        "s5": (wrap(None, lines.replace("becomes", "beco¬ \nrnes").replace("curved", "ciirved"), None), {"hyphen_break", "misread_char"}),
        "s6": (wrap("76   Earth Reader 6 | Melting And Rusting", lines, None), {"running_header", "page_number"}),
        "s7": (wrap(None, lines + " It needs 2Mg + O2 → 2MgO and 45 drops", "of wax."), set()),
        "s8": (wrap(None, "long text of wax. " * 9000, None), set()),
    }
    for k, (text, _) in cases.items():
        rows.append((k, "b1", int(k[1]), rng.choice(("Scanned", " SCANNED ", "scan ned")), *((text, "other") if k != "s3" else (None, text)), None))
    rows += [("s9", "b1", 9, "Scanned", None, None, None), ("s10", "b1", 10, "scanned", "  \n", None, None), ("d1", "b1", 11, "digital", "m|neral\n12", None, None), ("u1", "b1", 12, None, "m|neral", None, None), (None, "b1", 13, "scanned", "m|neral", None, None)]
    rows.append(rows[8])
    return rows, {(k, n) for k, (_, kinds) in cases.items() for n in kinds}


def test_found(spark):
    rows, want = pages()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert found(df.limit(0)).count() == 0


def test_repaired(spark):
    rows, _ = pages()
    got = {r.page_id: r.repaired for r in repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    plain = BODY.replace("\n", " ")
    assert all(got[k] == plain for k in ("s1", "s2", "s4", "s5", "s6")), got
    assert got["s3"] == "3.6 More On Melting With Tin " + plain and "d1" not in got


def test_copies_of_a_page(spark):
    rows = [(f"c{i}", "b0", i, "digital", f"{BODY} Number {i}.", None, None) for i in range(12)]
    wrong, cut = BODY.replace("between", "bctween"), BODY.replace("becomes", "be-\ncorncs")
    rows += [(f"s{i}", f"b{i}", i, "scanned", wrong, None, None) for i in range(10)] + [(f"t{i}", f"b{i}", i, "scanned", cut, None, None) for i in range(10)]
    both = "It m|neral"
    rows += [("d1", "b0", 20, "digital", both, None, None), ("u1", "b1", 21, "scanned", both, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.page_id, r.noise) for r in found(df).collect() if r.noise == "misread_char"}
    assert got == {(f"{k}{i}", "misread_char") for k in "st" for i in range(10)} | {("u1", "misread_char")}
    plain = {r.page_id: r.repaired for r in repaired(df).collect()}
    assert all(plain[f"{k}{i}"] == BODY.replace("\n", " ") for k in "st" for i in range(10))


def test_no_limits_of_length_or_script(spark):
    long = "Donaudampfschifffahrtselektrizitaetenhauptbetriebswerkbauunterbeamtengesellschaft".lower()
    title = " ".join(["Earth And Water Reader For Upper Classes"] * 4)
    hindi = [("h%d" % i, "b7", i, "scanned", f"पृथ्वी और जल\nयह पाठ {w} के बारे में है।\nयहाँ और भी लिखा है।", None, None) for i, w in enumerate(("नमक", "राख", "काँच"))]
    rows = [(f"c{i}", "b0", i, "digital", f"The {long} number {w} is near.", None, None) for i, w in enumerate(("one", "two", "three", "four", "five"))]
    rows += [("s1", "b1", 1, "scanned", f"{title}\nThe {long.replace('h', 'b', 1)} is near.\nIt is here.", None, None), ("s2", "b1", 2, "scanned", f"{title}\nNothing is here.\nIt is so.", None, None), *hindi]
    got = {(r.page_id, r.noise) for r in found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("s1", "misread_char"), ("s1", "running_header"), ("s2", "running_header")} | {(f"h{i}", "running_header") for i in range(3)}


def test_a_misread_word_may_stand_on_a_digital_page(spark):
    rows = [(f"c{i}", "b0", i, "digital", f"The mineral becomes dense in case {w}.", None, None) for i, w in enumerate("abcdefghijklmnopqrstuvwxyz")]
    rows += [("typo", "b0", 99, "digital", "The minerai becomes dense in this case.", None, None)]
    rows += [(f"s{i}", "b1", i, "scanned", f"The bccomes case {w}.", None, None) for i, w in enumerate(("one", "two"))]
    more = [(f"d{i}", "b2", i, "digital", f"It becomes so {w} and bccomes.", None, None) for i, w in enumerate("wxyz")]
    got = {r.page_id for r in found(spark.createDataFrame(rows + more, SCHEMA)).collect() if r.noise == "misread_char"}
    assert got == set()  # as often on digital pages as on scanned ones
    many = [(f"m{i}", "b3", i, "scanned", f"Here bccomes is said {i}a{i}.", None, None) for i in range(60)]
    frequent = [(f"f{i}", "b4", i, "digital", f"It becomes {i}z so.", None, None) for i in range(400)]
    got = {r.page_id for r in found(spark.createDataFrame(rows + more + many + frequent, SCHEMA)).collect() if r.noise == "misread_char"}
    assert {f"m{i}" for i in range(60)} <= got


@pytest.mark.parametrize("text", ["a-\nb-\nc", "one- \n\n two", "-\nx", "x-\n5", "a" * 200_000 + "-\n" + "b" * 10, "", "\n", "12-\n13"])
def test_line_breaks(text):
    found_here = line_breaks(text)
    assert all(text[b:e].startswith(left) and text[b:e].endswith(right) for b, e, left, right in found_here)
    whole = _repair(text, set(), {}, set())
    assert not line_breaks(whole) and "".join(whole.split()).replace("-", "") == "".join(text.split()).replace("-", "")


def test_both_folds_agree(spark):
    words = ["Mineral", "ﬁeld", "w8", "burner", "ı|l", "ÄÖ", "जल"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold(F.col("w")).alias("f")).collect()
    assert all(r.f == _folded(r.w) for r in got)
