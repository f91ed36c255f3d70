import random
from collections import Counter
from os.path import commonprefix

from leafmill.llm import answers
from leafmill.llm.answers import Languages, _continued, _grams, found, judged, learned

GOLD = [
    ("q1", "What happens to the wax on adding tin plate before sunrise?", True), ("q2", "Who first studied the erosion of slate?", False),
    ("q3", "Was geschieht mit Holzasche neben starkem Licht?", True), ("q4", "झरना में पानी का क्या काम है?", True), ("q5", None, None), ("q1", "What happens to the wax on adding tin plate before sunrise?", True),
]
SENTENCES = ["The wax melts near the end of spring.", "Tin plate is heavier than wax because the particles lie close together.", "The lamp glows when the wax burns.", "The water column rises steadily before sunrise."]
CASES = [
    (None, "q1", "empty"), ("  ", "q1", "empty"), ("N/A", "q2", "empty"), ("<p></p>", "q1", "empty"), ("Answer:", "q1", "empty"), ("​", "q1", "empty"), ("...", "q5", "empty"),
    ("I do not know.", "q1", "refusal"), ("I do not know.", "q2", None), ("Diese Frage kann ich nicht beantworten.", "q3", "refusal"), ("Pure wax cannot carry a charge because it does not contain free particles.", "q1", None),
    ("Nobody could find wax there, which showed that it had dissolved.", "q1", None), ("Sorry results came from wax until the clamp was tightened.", "q1", None), ("क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।", "q4", "refusal"),
    ("What happens to the wax on adding tin plate before sunrise.", "q1", "copies_question"), ("You asked: what happens to the wax on adding tin plate before sunrise?", "q1", "copies_question"), ("Tin plate", "q1", None),
    ("What happens to the wax on adding tin plate before sunrise? " + SENTENCES[0], "q1", None),
    ("Die Schüler beobachten, dass Holzasche mit dem Draht nicht reagiert.", "q1", "other_language"), ("Die Schüler beobachten, dass Holzasche mit dem Draht nicht reagiert.", "q3", None), ("जब नमक को गर्म किया जाता है, तब दर्पण बदलता है।", "q3", "other_language"),
    ("2Mg + O2 → 2MgO", "q3", None), ("24.5", "q1", None), ("About 94 millimetres", "q1", None), ("The wax melts near the end of spring", "q1", None), ("The lamp glows when the", "q1", "truncated"), ("The wax melts near,", "q1", "truncated"),
    ("The lamp glo", "q1", "truncated"), ("The lamp", "q1", None),
    ("Tin plate is heavier than wax because the part", "q1", "truncated"), ("The lamp glows when the wax burns. The water col", "q1", "truncated"), ("Two rules hold: (a) the lid stays shut (b)", "q1", "truncated"), ("The wax is (see also the", "q1", "truncated"), ("The wax is so…", "q1", "truncated"), ("", "gone", "empty"), ("The lamp glows when", "gone", "truncated"),
]


def test_cases(spark):
    rows = [(i, q, a, SENTENCES[i % 4], False, 1) for i, (a, q, _) in enumerate(CASES)]
    rows += [rows[0], rows[7], (None, "q1", None, None, None, 1)] + [(900 + i, "q1", " ".join(SENTENCES[: i % 4 + 1]), None, True, 1) for i in range(8)] + [(999, "q1", "The wax melts near the end of spring. " * 4000, None, True, 1)]
    a = spark.createDataFrame(rows, "answer_id long, question_id string, answer string, extractive_answer string, is_sufficient boolean, defect int")
    g = spark.createDataFrame([(*r, None) for r in GOLD], "id string, question string, answerable boolean, answer string")
    got = [tuple(r) for r in found(a, g).collect()]
    assert len(got) == len({k for k, _ in got})
    wrong = {CASES[i][0]: (dict(got).get(i), want) for i, (_, _, want) in enumerate(CASES) if dict(got).get(i) != want}
    assert not wrong and not [k for k, _ in got if k >= 900]
    assert found(a.limit(0), g).count() == 0
    assert {r.defect for r in judged(a, g.limit(0)).collect()} == {None, "empty", "truncated"}


def test_order_over_borders(spark, monkeypatch):
    monkeypatch.setattr(answers, "TEXTS", 20)
    test_order_finds_every_continuation(spark)


def test_refusals_by_recurrence(spark):
    asked = [(f"r{i}", f"How do {w} behave near {v}?", True) for i, (w, v) in enumerate((("magnets", "cold water"), ("leaves", "sunlight"), ("springs", "lamps"), ("crystals", "vinegar"), ("roots", "gravel"), ("motors", "sand")))]
    rows = [(i, f"r{i}", "Sadly there is no such page anywhere.", None, True, 1) for i in range(6)] + [(10 + i, f"r{i}", "Water never flows uphill by itself.", None, True, 1) for i in range(4)] + [(20 + i, f"r{i}", "It is bright green.", None, True, 1) for i in range(6)]
    a = spark.createDataFrame(rows, "answer_id long, question_id string, answer string, extractive_answer string, is_sufficient boolean, defect int")
    assert sorted(tuple(r) for r in found(a, spark.createDataFrame(asked, "id string, question string, answerable boolean")).collect()) == [(i, "refusal") for i in range(6)]


def test_languages_by_letters():
    texts = {"en": "The mirror changes because the lamp is near the water and it reflects the bright light through the window. ", "de": "Der Spiegel verändert sich, weil die Lampe neben dem Wasser steht und das helle Licht durch das Fenster wirft. ", "fr": "Le miroir change parce que la lampe est près de l'eau et renvoie la lumière claire à travers la fenêtre. "}
    counts = {k: dict(Counter(g for g in _grams(t * 20))) for k, t in texts.items()}
    tell = Languages(counts).tell
    assert Languages().tell("bright mirror reflects window") is None
    assert [tell(x) for x in ("bright mirror reflects window", "helle Lampe verändert Fenster", "lampe claire renvoie lumière", "24.5", "")] == ["en", "de", "fr", None, None]
    assert tell("झरना में पानी का क्या काम है?") == "hi"


def test_order_finds_every_continuation(spark):
    rng = random.Random(6)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(20, 30))) for _ in range(300)} | {"x" * n for n in range(20, 40)})
    full = sorted({t[: rng.randint(20, len(t))] for t in texts} | set(texts))
    got = {r.text: r.rest for r in _continued(spark.createDataFrame([(t, True) for t in full], "text string, mine boolean")).collect()}
    assert set(got) == {t for t in full if any(u != t and commonprefix([t, u]) == t for u in full)}
    assert all(t + rest in full for t, rest in got.items())


def test_trigrams_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(answers, "SAMPLE", 10, raising=False)
    texts = [f"{s} It is so in case {i}." for i, s in enumerate(SENTENCES * 50)]
    want = Counter(g for t in texts for g in _grams(t))
    assert learned(spark.createDataFrame([(t,) for t in [*texts, None]], "text string")) == {"en": want}
