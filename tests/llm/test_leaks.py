import random

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import leaks as L
from leafmill.llm.leaks import Matcher, by_item, found, leaks, myers, near

WORDS = [f"w{i}" for i in range(40)]


def best(pattern, text):
    """Least edit distance of the pattern to a part of the text ending at each word, by dynamic programming."""
    column, out = list(range(len(pattern) + 1)), []
    for word in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(new[i] + 1, column[i + 1] + 1, column[i] + (p != word)))
        column = new
        out.append(column[-1])
    return out


@settings(deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.lists(st.sampled_from("abc"), max_size=20))
def test_myers(pattern, text):
    assert myers(pattern, text) == best(pattern, text)


def test_brute_force_with_errors():
    rng = random.Random(4)
    for errors in (0, 1, 2):
        for _ in range(150):
            item = [rng.choice(WORDS) for _ in range(rng.randint(10, 30))]
            p = rng.randint(0, len(item) - 1)
            middle = item[p : p + rng.randint(5, 20)]
            for _ in range(rng.randint(0, 2)):
                middle[rng.randrange(len(middle))] = rng.choice(WORDS)
            doc = [rng.choice(WORDS) for _ in range(9)] + middle + [rng.choice(WORDS) for _ in range(9)]
            windows = [s for s in range(len(item) - 11) if min(best(item[s : s + 12], doc)) <= errors]
            want = [(1, len({w for s in windows for w in range(s, s + 12)}), len(item))] if windows else []
            assert Matcher([(1, " ".join(item))], 12, errors).matches("-".join(doc)) == want


def test_rows(spark):
    words = "One two three four five six seven eight nine ten eleven twelve thirteen".split()
    docs = [
        (1, "x " + " ".join(words[:12]) + " y", "t"), (1, "x " + " ".join(words[:12]) + " y", "t"), (2, " ".join(words[:11]), "t"),
        (3, ",".join(words).upper(), "t"), (4, None, "t"), (5, "", "t"), (6, "a " * 200_000 + "\n".join(words), "t"), (None, " ".join(words), "t"),
        (7, " ".join(words[:6]) + " soft­hyphen " + " ".join(words[6:]), "t"),
    ]
    items = [(1, " ".join(words), 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (1, " ".join(words), 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_text string")
    i = spark.createDataFrame(items, "item_id long, item_text string, doc_id int")
    assert sorted(tuple(r) for r in found(d, i).collect()) == [(1, 1), (3, 1), (6, 1)]
    assert {(r.doc_id, r.matched_words, r.item_words) for r in leaks(d, i).collect()} == {(1, 12, 13), (3, 13, 13), (6, 13, 13)}
    assert [tuple(r) for r in by_item(d, i).collect()] == [(1, 3, 2, 1.0)]
    assert found(d.limit(0), i).count() == 0 and found(d, i.limit(0)).count() == 0


def test_items_with_one_opening_and_blocks(spark, monkeypatch):
    rng = random.Random(9)
    opening = [f"o{i}" for i in range(30)]
    texts = {i: " ".join(opening + [f"{rng.choice(WORDS)}{i}" for _ in range(15)]) for i in range(200)}
    docs = [(1, " ".join(opening)), (2, "a b " + texts[7]), (3, " ".join(texts[9].split()[25:]))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(texts.items()), "item_id long, item_text string")
    want = {(k, n) for k in (1, 2) for n in texts} | {(3, 9)}
    assert {tuple(r) for r in found(d, i).collect()} == want
    monkeypatch.setattr(L, "BLOCK_CHARS", 5000)
    assert {tuple(r) for r in found(d, i).collect()} == want


def test_planted_edits(spark):
    """All passages of 12 words with two words changed, left out or put in are found, and none with eight changed."""
    rng = random.Random(10)
    items = {i: [f"{rng.choice(WORDS)}x{rng.randrange(60)}" for _ in range(40)] for i in range(30)}
    docs, want = [], set()
    for n in range(120):
        i = rng.randrange(30)
        p = rng.randrange(28)
        passage = items[i][p : p + 12]
        edits = rng.sample(range(12), 8 if n % 4 == 0 else 2)
        kind = "change" if n % 4 == 0 else ("change", "leave", "put")[n % 3]
        for e in sorted(edits, reverse=True):
            passage[e : e + 1] = {"change": ["new"], "leave": [], "put": [passage[e], "new"]}[kind]
        docs.append((n, " ".join([f"f{rng.randrange(500)}" for _ in range(20)] + passage + [f"f{rng.randrange(500)}" for _ in range(20)])))
        if n % 4:
            want.add((n, i))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, item_text string")
    assert {(r.doc_id, r.item_id) for r in near(d, i).collect()} == want
