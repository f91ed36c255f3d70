"""Text functions over columns: tokens, lines, sentences, references, captions, predicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Words without meaning for retrieval (fixed values).
RETRIEVAL_STOPS = (
    "a an the of and or to in on for is are was were be been by with as at from that this these those it its "
    "what which who whom how why when where do does did can could should would will shall may might me you "
    "your we our they their them he she his her i give explain describe define tell about"
).split()
# Words without meaning for figure search (fixed values).
FIGURE_STOPS = (
    "what is the of and in to a an for on how do does did with from by as or which where about show describe explain give diagram "
    "figure image their them they this that these those are was were can could would should tell me you your its each some such "
    "also into over after before between draw illustrate represented representing schematic"
).split()
# Wording of instructions and of the patterns below (fixed values).
IMPERATIVE = (
    r"(?i)^(?:write|take|name|give|explain|list|identify|observe|note|collect|add|heat|pour|draw|find|state|"
    r"describe|compare|why|what|how|which|who|when|where|do you|can you|let us|try|record|repeat|discuss|"
    r"complete|fill|match|choose|mark|answer|activity|q\s?u\s?e\s?s|figure|fig\.|table)\b"
)
EXERCISE = r"^(?:\d+\.|\([a-z]\)|\([ivx]+\)|[a-z]\))\s"
NUMBERED_HEADING = r"^\d+(?:\.\d+)+\s+[A-Z][^.?!]{2,90}$"
CAPS_HEADING = r"^[A-Z][A-Z0-9 ,:&'()\-–]{5,80}$"
EQUATION_WISH = r"(?i)\b(equation|reaction|formula|react|reacts|balanced|chemical change)\b"
#: EQUATION is what :func:`has_equation` looks for.
EQUATION = r"(→|->|⟶|\+\s*[A-Z][a-z]?\d*\s*(?:\(|→)|=)"
VISUAL_WISH = r"(?i)\b(?:figure|fig\.?|diagram|image|picture|illustration|graph|chart|map|visual|shown|show|depict|draw|setup|apparatus)\b"
FIGURE_NUMBER = r"(?i)\b(?:Fig(?:ure)?\.?|Table)\s*(\d+(?:\.\d+)?)"
REFERENCE_KINDS = (r"Figure\s+", r"Fig\.?\s*", r"Table\s+", r"Activity\s+")
_REFERENCE = r"(\d+(?:\.\d+)?(?:\.[a-zA-Z])?)"
_CAPTION = r"(?is)^\s*(fig(?:ure)?s?\.?|table)\s*(\d{1,2}(?:\s?\.\s?\d{1,2}){0,2})(?:\s*\(([a-z])\))?(?![\d.]*\d)\s*[:.\-–—]?\s*(.*)$"
# By what a question names a figure or table (fixed values).
NAMED_FIGURES = (r"(?i)Figure\s+(\d+(?:\.\d+)?)", r"(?i)Fig\.?\s*(\d+(?:\.\d+)?)", r"(?i)Table\s+(\d+(?:\.\d+)?)")
# Headings for display (fixed values).
DISPLAY_HEADINGS = (r"(?i)^(?:chapter|section)\b", r"^\d+(?:\.\d+)*\s+[A-Z]", r"^[A-Z][A-Z\s&-]{5,}$")
# Wordings of comparisons (fixed values).
COMPARISONS = (
    r"(?i)^(?:what\s+(?:is|are)\s+)?(?:the\s+)?(?:main\s+|key\s+)?(?:differences?|distinctions?|contrast)\s+between\s+(.+?)\s+and\s+(.+)$",
    r"(?i)^how\s+(?:is|are|do|does)\s+(.+?)\s+(?:different\s+from|differ\s+from|compared?\s+(?:to|with))\s+(.+)$",
    r"(?i)^(?:compare|contrast|distinguish)(?:\s+between)?\s+(.+?)\s+(?:and|with|from)\s+(.+)$",
    r"(?i)^(.+?)\s+(?:vs\.?|versus)\s+(.+)$",
)
_LONE_BULLET = r"(?m)^(?:[nqlvu•▪●■◆➢✓]\s+)+(?=[A-Za-z(])"
_NO_CAPTION = r"(?i)^\s*(?:shows?|illustrates?|depicts?|gives?|is|are|was|and|in|of|to)\b"
_SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z(\"'“])"
#: Line ends other than \n that a text may have.
LINE_ENDS = "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085  ]"


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lines(text: Column) -> Column:
    """Lines of a text as an array; an empty array for null."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, LINE_ENDS, "\n"), "\n"))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Retrieval tokens: runs of a-z and 0-9, longer than one character, without stop words; repeats are kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(RETRIEVAL_STOPS))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STOP_CODES = np.array(sorted({int.from_bytes(w.encode(), "little") for w in RETRIEVAL_STOPS}), np.uint64)
#: A factor whose products with all stop words' codes differ in the upper bits, and the codes by these.
_UPPER = np.uint64(48)
_FACTOR = next(f for f in np.arange(0x9E3779B97F4A7C15, 0x9E3779B97F4A8C15, 2, np.uint64) if len(np.unique(_STOP_CODES * f >> _UPPER)) == len(_STOP_CODES))
_STOP_AT = np.zeros(1 << 16, np.uint64)
_STOP_AT[_STOP_CODES * _FACTOR >> _UPPER] = _STOP_CODES


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes are a-z or 0-9; differences of bytes wrap."""
    return (data - np.uint8(97) < 26) | (data - np.uint8(48) < 10)


@F.arrow_udf(StructType([StructField("terms", StringType()), StructField("dl", IntegerType())]))
def _joined_tokens(lower: pa.Array) -> pa.Array:
    """The tokens of texts in lower case, as one text with blanks between them, and how many; all texts of a batch at once, as bytes."""
    lower = pa.array([], pa.large_string()) if not len(lower) else lower.cast(pa.large_string())
    rows, none = len(lower), lower.is_null()
    at = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + rows + 1] if rows else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    data = np.zeros(size + 8, np.uint8)  # a token of up to eight bytes is read as one number
    if size:
        data[:size] = np.frombuffer(lower.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    letter = np.zeros(size + 2, bool)
    letter[1:-1] = _letters(data[:size])
    change = np.flatnonzero(letter[1:] != letter[:-1])
    first, end = change[::2], change[1::2]
    # Runs that go over from one text into the next are cut there.
    border = np.unique(at[1:-1]) if rows else at[:0]
    border = border[(border > 0) & (border < size)]
    border = border[letter[border] & letter[border + 1]]
    if len(border):
        first, end = (np.insert(x, np.searchsorted(x, border), border) for x in (first, end))
    long = end - first
    code = np.ndarray(size + 1, "<u8", data, strides=(1,))[first] & _MASKS[np.minimum(long, 8)]
    good = (long > 1) & ((long > 8) | (_STOP_AT[code * _FACTOR >> _UPPER] != code))
    first, end, long = first[good], end[good], long[good]
    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(first, at)))
    more = np.r_[row[1:] == row[:-1], np.zeros(min(1, len(row)), bool)]  # a blank behind all tokens of a text but the last
    step = np.zeros(size + 2, np.int8)
    step[first] = 1
    step[end + more] -= 1  # no two tokens end at the same place
    kept = np.cumsum(step[:size], dtype=np.int8).view(bool)
    data = data[:size][kept]
    data = np.where(_letters(data), data, np.uint8(32))
    sizes = np.bincount(row, long + more, rows).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(data)]).cast(pa.string())
    return pa.StructArray.from_arrays([texts, pa.array(np.bincount(row, minlength=rows).astype(np.int32))], ["terms", "dl"], mask=none)


def joined_tokens(text: Column) -> Column:
    """``terms, dl``: the :func:`tokens` of a text with blanks between them, and how many."""
    return _joined_tokens(F.lower(text))


def has_equation(text: Column) -> Column:
    """Whether a text has an :data:`EQUATION`; the pattern only meets texts with a plus and none of its plain signs."""
    plain = text.contains("=") | text.contains("->") | text.contains("→") | text.contains("⟶")
    return plain | (text.contains("+") & text.rlike(EQUATION))


def terms(text: Column) -> Column:
    """Search terms for figures: longer than two characters, without stop words; repeats are kept."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")
    return F.filter(words(plain), lambda t: (F.length(t) > 2) & ~t.isin(FIGURE_STOPS))


def collapse_phrases(text: Column) -> Column:
    """A phrase of 3 to 60 characters said several times in a row is said once.

    The possessive ``++`` matches the same, as nothing follows it, and takes no stack for each time, so lines may be of any length.
    """
    return F.regexp_replace(text, r"(?i)\b(.{3,60}?)(?:\s+\1\b)++", "$1")


def clean_line(line: Column) -> Column:
    """Without symbol-font bullet, with repeated phrases and white space collapsed."""
    bare = F.regexp_replace(F.trim(line), r"^(?:[nqlv•▪●■◆➢✓]\s+)(?=[A-Z(])", "")
    return squeeze(collapse_phrases(bare))


def is_heading(line: Column) -> Column:
    return (F.length(line) <= 90) & ~line.rlike(r"[.?,;]$") & (line.rlike(NUMBERED_HEADING) | line.rlike(CAPS_HEADING))


def is_spaced_letters(line: Column) -> Column:
    return line.rlike(r"^(?:[A-Za-z]\s){3,}[A-Za-z?]?\s*\??$")


def sentences(text: Column) -> Column:
    """Sentences; an enumerator that stands alone belongs to the sentence after it."""
    broken = F.regexp_replace(text, r"\s+(?=(?:\d{1,2}\.|\([a-z]\)|\([ivx]+\))\s)", "\n")
    parts = F.filter(F.transform(F.split(broken, r"\n+|" + _SENTENCE_GAP), lambda s: F.trim(s)), lambda s: s != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        said = F.when(state["open"] == "", part).otherwise(F.concat_ws(" ", state["open"], part))
        alone = part.rlike(r"^(?:\d{1,2}\.|\([a-z]\)|\([ivx]+\))$")
        return F.when(alone, F.struct(state["done"].alias("done"), said.alias("open"))).otherwise(F.struct(F.array_append(state["done"], said).alias("done"), F.lit("").alias("open")))

    return F.aggregate(parts, empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def is_exercise(said: Column) -> Column:
    """Half or more of the sentences are questions or enumerated."""
    hits = F.size(F.filter(said, lambda s: s.endswith("?") | s.rlike(r"^(?:\d+\.|\([a-z]\)|\([ivx]+\))\s")))
    return (F.size(said) > 0) & (hits * 2 >= F.size(said))


def figure_refs(text: Column) -> Column:
    """Numbers of the figures and tables that a text names, first mention first."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FIGURE_NUMBER), F.lit(1)))


def explicit_reference(text: Column) -> Column:
    """Number of the first figure named, else of a Fig., a table, an activity; null without any."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, rf"(?i){kind}{_REFERENCE}", 1), F.lit("")) for kind in REFERENCE_KINDS])


def snippet(text: Column, limit: int = 280) -> Column:
    """The text, or its beginning up to a blank with dots behind it."""
    head = F.substring(text, 1, limit - 3)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("...")))


def clean_caption(text: Column, limit: int = 220) -> Column:
    plain = squeeze(F.regexp_replace(text, _LONE_BULLET, ""))
    plain = collapse_phrases(F.regexp_replace(plain, r"^[\s\-–—:.;,]+|[\s\-–—:.;,]+$", ""))
    head = F.substring(plain, 1, limit)
    short = F.when(F.length(plain) <= limit, plain).when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(plain.rlike("[A-Za-z]{2,}"), F.nullif(short, F.lit("")))


def parse_caption(text: Column) -> Column:
    """``kind, number, sub, text, label`` of a caption; null where the text doesn't begin with a figure's or table's label or is a
    sentence about it."""
    plain = F.regexp_replace(F.trim(text), _LONE_BULLET, "")
    part = lambda i: F.regexp_extract(plain, _CAPTION, i)
    number = F.regexp_replace(part(2), r"\s", "")
    # The label said again is taken away as often as it stands there; with the blanks and marks behind it, it can be repeated as a group.
    again = F.concat(F.lit(r"(?i)^(?:(?:fig(?:ure)?s?\.?|table)\s*"), F.replace(number, F.lit("."), F.lit(r"\s?\.\s?")), F.lit(r"(?![\d.]*\d)\s*[:.\-–—]?\s*)+"))
    rest = F.regexp_replace(part(4), again, F.lit(""))
    kind = F.when(F.lower(part(1)).startswith("tab"), "table").otherwise("figure")
    sub = F.nullif(part(3), F.lit(""))
    label = F.concat(F.initcap(kind), F.lit(" "), number, F.when(sub.isNotNull(), F.concat(F.lit("("), sub, F.lit(")"))).otherwise(""))
    return F.when(plain.rlike(_CAPTION) & ~rest.rlike(_NO_CAPTION), F.struct(kind.alias("kind"), number.alias("number"), sub.alias("sub"), clean_caption(rest).alias("text"), label.alias("label")))


def split_comparison(question: Column) -> Column:
    """The two things that a question compares; null where it compares none. A head noun that only the second has is given to both."""
    plain = F.regexp_replace(F.trim(question), r"[\s?.!]+$", "")
    found = F.coalesce(*[F.when(plain.rlike(p), F.array(*[F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(plain, p, i)), r"[\s?.!]+$", ""), r"(?i)^(?:a|an|the)\s+", "")) for i in (1, 2)])) for p in COMPARISONS])
    a, b = found[0], found[1]
    wa, wb = words(a), words(b)
    shared = (F.size(wb) >= 2) & (F.size(wa) < F.size(wb)) & (F.lower(F.element_at(wa, -1)) != F.lower(F.element_at(wb, -1)))
    both = F.array(F.when(shared, F.concat_ws(" ", a, F.element_at(wb, -1))).otherwise(a), b)
    return F.when((a != "") & (b != "") & (F.lower(a) != F.lower(b)), both)


def echoes(sentence: Column, question: Column) -> Column:
    """Whether a sentence mostly says the question again."""
    s, q = F.array_distinct(tokens(sentence)), F.array_distinct(tokens(question))
    share = F.size(F.array_intersect(s, q)) / F.greatest(F.size(F.array_union(s, q)), F.lit(1))
    tail = lambda t: F.regexp_replace(F.lower(t), r"[ ?.]+$", "")
    return (F.size(s) > 0) & (F.size(q) > 0) & ((F.size(F.array_except(s, q)) == 0) | (share >= 0.6) | F.endswith(tail(sentence), tail(question)))


def is_answer_sentence(sentence: Column, question: Column) -> Column:
    fits = (word_count(sentence) >= 6) & (F.length(sentence) <= 450) & ~sentence.endswith("?") & ~is_heading(sentence)
    return fits & ~sentence.rlike(IMPERATIVE) & ~sentence.rlike(EXERCISE) & ~echoes(sentence, question)


def clean_sentence(sentence: Column) -> Column:
    bare = F.regexp_replace(F.trim(sentence), r"^(?:[nqlv•▪●■]\s+)+", "")
    return F.regexp_replace(squeeze(bare), r"^[ \-–]+|[ \-–]+$", "")


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/*?:"<>| ]', "_")


def strip(text: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(text, "^[\\s\u00a0]+|[\\s\u00a0]+$", "")


def without_citations(answer: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(answer, r"(?i)\s*\[(?:page|pages)\s+\d+(?:\s*[-,]\s*\d+)*\]", ""), r"\s{2,}", " "))


def without_heading_marks(answer: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(answer, r"(?m)^\s*#{1,6}\s*", ""), r"\s+#{1,6}\s+", "\n\n"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
