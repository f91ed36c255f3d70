import random

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.quality import Long, Part, found, letter_model, may_be_row, slices, statistics

PROSE = "The bark layer falls behind the rest because heat escapes through the walls. It follows that this is called melting, and it needs a weak signal.\nA second paragraph is here."
LIST = "Things For The Table\n" + "".join(f"{i}. a small burner\n" for i in range(1, 9)) + "That was everything."
BULLETS = "".join(f"• delicate peat soil {w}\n" for w in ("wax", "tin", "oak", "ash", "ice", "air"))
CSV = "fragment,pattern,movement\n" + "".join(f"peat soil,{i}.5,–\n" for i in range(9))
WIDE = "Her  notebook  lists  soft  rubber,  a  hand  lens  and  a  shallow  reaction,  yet  omits  slow  combustion  from  all  15  entries  made  at  Stianpeind."
VERSE = "But the left chamber settles at the bottom as the liquid cools\n" * 2 + "And the light ray spreads outward in the dry season\nThen the long tube loses mass near the end of spring"


def shape(text):
    return Part(text).close()["shape"]


def test_shapes():
    mixed = PROSE + "\n\n• a funnel\n• a watch glass\n• a lens\n\n" + PROSE
    for text in (PROSE, WIDE, VERSE, mixed, "“Warm it.” said Ann.\n“It is warm, as you see.” said Tom.", "जब नमक को गर्म किया जाता है, तब दर्पण धीरे-धीरे बदलता है। इससे पता चलता है कि झरना को चूना की ज़रूरत होती है।"):
        assert shape(text) == "prose", text
    tree = "".join(f"<tr><td>tin {w}{w}{w}</td><td>{i}.5</td></tr>\n" for i, w in enumerate("abcdefgh"))
    for text in (CSV, CSV.replace(",", ", "), CSV.replace(",", "\t"), CSV.replace(",", ";"), CSV.replace(",", " | ").replace("\n", " |\n"), tree, "".join(f"peat soil {w} {w}    12.{i}     –      {i}\n" for i, w in enumerate("abcdef")), "Table 3.4\n" + "iron filings 761 – 2.0\n" * 4):
        assert shape(text) == "table", text
    for text in (LIST, BULLETS, "".join(f"1.{i} The Rusting Of Oxygen {w} ........ {i}\n" for i, w in enumerate("abcdefg")), "".join(f"{w}: sudden surface of bone meal\n" for w in ("melting", "rusting", "freezing", "erosion", "friction"))):
        assert shape(text) == "list", text
    for text in ("7QDRFvx9Gm91f1EpF+pfRfvMK0jEd7XZbUhdPCmY4QHLWcVmgZZOl3OuVWiZewlRyRVN5wqsKHWqMOade1sNc46g8lmijjlh1B1H" * 2, ".…·.-…–· .___ …– _ …_-_… __ …_ ––--·_" * 9, "silver foil, " * 30, PROSE.encode().decode("latin-1")[:0] + "इससे पता चलता है कि झरना को".encode().decode("latin-1") * 3, "�� 0x79b0 NUL □□ ?? " * 12):
        assert shape(text) == "junk", text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([PROSE, LIST, CSV, "\n", " ", "abc", "x" * 900, "é9", ".\n\n", "<td>", "•  a"]), max_size=8), st.randoms())
def test_parts_join_in_any_grouping(texts, rng):
    text = "".join(texts).replace("<", "")
    want = Part(text).close()
    borders = sorted(rng.randrange(len(text) + 1) for _ in range(6)) if text else []
    parts = [Part(text[a:b]) for a, b in zip([0, *borders], [*borders, len(text)], strict=True)]
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i].join(parts[i + 1])]
    assert parts[0].close() == want


def test_rows(spark):
    rng = random.Random(1)
    long = "\n".join(rng.choice((PROSE, LIST, CSV)) for _ in range(900))
    rows = [(None, PROSE * 40), (1, CSV), (1, CSV), (2, None), (3, ""), (4, "  \n"), (5, PROSE), (6, "a,b,c\n1,2,3\n4,5,6"), (7, long), (8, CSV * 4000), (None, CSV), (9, "y" * 300_000)]
    d = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, shape string, words int")
    assert sorted(tuple(r) for r in found(d).collect()) == [(1, "table"), (8, "table"), (9, "junk")]
    whole, parts = ({(r.doc_id, r.chars): r.asDict() for r in statistics(d, n).collect()} for n in (1 << 30, 997))
    assert whole == parts and len(whole) == 11
    assert (whole[2, 0]["words"], whole[2, 0]["shape"]) == (0, "prose")
    assert found(d.limit(0)).count() == 0


def test_long_lines():
    rng = random.Random(2)
    names = [f"tin{i}" for i in range(90)]
    for glue in (",", ", ", ";", "; ", "\t", "   ", " | "):
        text = "".join(glue.join(rng.choice((rng.choice(names), f"{rng.randrange(99)}.5")) for _ in range(120)) + "\n" for _ in range(9))
        assert min(map(len, text.split("\n")[:-1])) > 400 and shape(text) == "table", glue
        want = Part(text).close()
        for size in (1, 7, 64, 333):
            parts = [Part(text[i : i + size]) for i in range(0, len(text), size)]
            whole = parts[0]
            for other in parts[1:]:
                whole = whole.join(other)
            assert whole.close() == want, (glue, size)
    assert shape("\n".join(PROSE.replace("\n", " ") * 4 for _ in range(5))) == "prose"


LOOP = "the bright lamp warms one small stone slowly "


def test_loops_of_any_length_up_to_the_period():
    for words in (7, 10, 24):
        loop = " ".join(f"tin{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(words)) + " "
        assert shape(loop * 30) == "junk", words
    assert shape(LOOP * 40) == "junk" and shape(LOOP + PROSE) == "prose"


def test_consonants_are_unreadable():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 10))) for _ in range(90))
    assert shape(text) == "junk"
    assert shape("Die Donaudampfschifffahrtsgesellschaft und die Elektrizitätswirtschaftsverbände bauten zusammen am Wasserkraftwerk, das bis heute läuft und Strom liefert.") == "prose"


def corpus(spark, n=260):
    rng = random.Random(8)
    nouns, verbs = ("mineral", "current", "mirror", "leaf surface", "boundary", "river clay", "magnet", "copper wire"), ("changes", "dissolves", "expands", "settles", "hardens", "reflects")
    ends = ("slowly because of the pressure", "while nobody is watching it", "whenever warm rain falls", "until the container cools", "as older students have noticed", "before another experiment begins")
    said = lambda: " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} near {rng.choice(nouns)} {rng.choice(ends)}." for _ in range(6))
    rows = [(i, said(), "en" if i % 7 else None) for i in range(n)]
    mixed = lambda t: " ".join("".join(rng.sample(w, len(w))) for w in t.split())
    return [*rows, *((1000 + i, mixed(said()), "und") for i in range(9))]


def test_letters_out_of_order(spark):
    rows = corpus(spark)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in found(d).collect()) == [(1000 + i, "junk") for i in range(9)]
    parts = {r.doc_id: r.asDict() for r in statistics(d, 61).collect()}
    assert parts == {r.doc_id: r.asDict() for r in statistics(d).collect()}
    assert letter_model(d.limit(20)) is None and letter_model(d.drop("lang")) is None and letter_model(d.limit(0)) is None


def test_letters_of_all_rows(spark):
    """The letter model counts each labelled row, however many a language has; beyond ``ALIKE`` rows languages count alike."""
    rows = [(i, "plain words about tin and iron ore " * 20, "en") for i in range(2500)] + [(9999, "kwyzjibo " * 400, "en"), (10000, "xqxqxq " * 400, "und"), *((20000 + i, "wort über zinn " * 20, "de") for i in range(100))]
    letters = letter_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "yzj" in letters.weights and "xqx" not in letters.weights
    once, twice = (letter_model(spark.createDataFrame(rows * n, "doc_id long, text string, lang string").where("lang = 'en'")) for n in (1, 2))
    assert once.weights == twice.weights and abs(once.limit - twice.limit) < 1


def test_parts_keep_tags(spark):
    text = ("".join(f"<tr><td>tin {i}</td><td>{i}.5 < 7</td></tr>\n" for i in range(60)) + "<" * 300 + PROSE) * 3
    assert all("".join(slices(text, n)) == text and max(map(len, slices(text, n))) <= n for n in (90, 100, 333))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = statistics(d).first()
    assert all(statistics(d, n).first() == whole for n in (90, 333))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["tin", "5", "1,5", "7%", "–", "the", " ", " ", "  ", "\u00a0", ",", ", ", ";", "; ", ".", "|", "<td>", "n/a"]), max_size=30).map("".join), st.booleans())
def test_quick_look_at_long_lines(line, ended):
    assert may_be_row(line, ended) or not Long(line).is_row(ended)
