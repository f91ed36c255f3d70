from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.pieces import cut_text, found, pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \nA!ü\U0001f600", max_size=300), st.integers(1, 40), st.integers(0, 45))
def test_round_trip(text, limit, overlap):
    cuts = cut_text(text, limit, overlap)
    overlap = min(overlap, limit - 1)
    assert all(0 < end - start <= limit for start, end, _ in cuts)
    assert all(b[0] == max(0, a[1] - overlap) and b[1] > a[1] for a, b in zip(cuts, cuts[1:]))
    assert "".join(text[(max(start, cuts[i - 1][1]) if i else start) : end] for i, (start, end, _) in enumerate(cuts)) == text


def test_natural_boundaries():
    text = "A short one. Dr. Vel came at 5 p.m. with tin.\n\nSecond paragraph here. It ends."
    assert [text[s:e] for s, e, _ in cut_text(text, 50, 0)] == [text[:47], text[47:]]
    assert [k for *_, k in cut_text(text, 50, 0)] == ["paragraph", "end"]
    assert [text[s:e] for s, e, _ in cut_text(text[:45], 40, 0)] == ["A short one. ", "Dr. Vel came at 5 p.m. with tin."]
    assert [k for *_, k in cut_text("x" * 25, 10, 2)] == ["character"] * 2 + ["end"]
    assert cut_text("one two three four", 9, 3) == [(0, 8, "word"), (5, 14, "word"), (11, 18, "end")]


def test_rows(spark):
    rows = [
        ("a", "s1", "body", "x y " * 10, 1), ("a", "s1", "body", "x y " * 10, 1), ("b", None, None, "x" * 31, 2), ("c", None, "Exercise ", "y" * 21, 2),
        ("d", None, "body", None, 2), ("e", None, "body", "", 2), ("f", None, "other", "z" * 999, 2), ("g", None, "body", "z" * 30, 2), (None, None, "body", "z" * 99, 2), ("h", None, "body", "long " * 40_000, 3),
    ]
    c = spark.createDataFrame([(r[0], r[4], *r[1:4], None, 5) for r in rows], "chunk_id string, page_number int, section string, kind string, text string, created_at timestamp, max_chars int")
    lim = spark.createDataFrame([("body", 30, 5), ("exercise", 20, 4)], "kind string, max_chars int, overlap_chars int")
    assert sorted(r[0] for r in found(c, lim).collect()) == ["a", "b", "c", "h"]
    got = pieces(c, lim).collect()
    assert all(len(r.text) <= (20 if r.chunk_id == "c" else 30) and len(r.text) == r.end - r.start for r in got)
    first = sorted((r for r in got if r.chunk_id == "a"), key=lambda r: r.piece)
    assert first[0].text[-5:] == first[1].text[:5] and (first[0].section, first[0].page_number) == ("s1", 1)
    assert found(c.limit(0), lim).count() == 0 and pieces(c, lim.limit(0)).count() == 0
