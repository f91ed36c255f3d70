"""Problem 3: noise in the text of scanned pages, and its repair.

Misread words are found by anagram hashes: a word's hash is the sum of its characters' hashes, so reading one group of
characters as another changes it by a fixed difference, whatever the word and the place. Rare words, their hashes moved by the
difference of each known confusion (or two of them), are joined with frequent words by equality; what is left is ranked by
confusions and frequency. Words cut at line ends are told from words with a hyphen of their own by how often either form stands
within a line. Edge lines are heads where they come again in their book, misread or not, and page numbers by their form.

Texts are read once, each distinct text only, in one Arrow pass that gives words, words cut at line ends and edge lines; pages
meet these by the hash of their text, so copies of a page cost a row each. All else is joins and aggregates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.durable import cut

# What is read, and what is printed (fixed values).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("@", "a"), ("5", "s"), ("†", "t"), ("|", "i"), ("|", "l"), ("0", "o"), ("ri", "n"), ("1", "l"), ("1", "i"), ("l", "i"), ("cl", "d"), ("ii", "u"), ("9", "g"),
    ("b", "h"), ("m", "rn"), ("d", "cl"), ("vv", "w"), ("rn", "m"), ("h", "li"), ("6", "b"), ("8", "b"), ("$", "s"), ("€", "e"), ("¢", "c"), ("£", "f"), ("ı", "i"), ("ﬁ", "fi"), ("ﬂ", "fl"),
)
#: A frequent word is this often and this many times as frequent as its rare variant; a word that is this many times as frequent on
#: scanned pages as on others may be misread although it stands there, too.
FREQUENT, TIMES, OFTENER = 4, 4, 20
#: First and last lines of a page that are looked at, pages of a book on which a line in a script without capitals must come again,
#: its most words, and distinct words held by the pass over the texts before they are passed on.
EDGE_LINES, PLAIN_PAGES, PLAIN_WORDS, WORDS_HELD = 2, 3, 10, 300_000
_HYPHENS = "-‐¬­"
_ROMAN = r"(?=[ivxlc])c{0,4}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = rf"(?:\d{{1,4}}|{_ROMAN})"
_PRINTED = rf"(?i)^[\s\[(—–|~*-]*(?:(?:p ?[a@] ?[g9] ?[ec]|pg|p|seite|página|पृष्ठ)[.:]?\s*)?{_NUMBER}(?:\s*(?:/|of|von|de|sur)\s*\d{{1,4}})?[\s\])—–|~*-]*$"
_BESIDE = rf"(?i)^{_NUMBER}(?:\s{{2,}}|\s+\|\s+)(?=[^\W\d_])|(?<=\S)(?:\s{{2,}}|\s+\|\s+){_NUMBER}$"
_ODD = r"(?:\p{L}[|@†$€]\p{L}|^[|@†]\p{Ll}|\p{L}[|@†]$|^\p{Lu}?\p{Ll}*(?:(?<=\p{Ll}{2})[0159]|[0159](?=\p{Ll}{2}))\p{Ll}*$)"


def scanned(page_type: Column) -> Column:
    return F.lower(F.regexp_replace(page_type, r"\s+", "")) == "scanned"


_MARKS = " \t\n.,;:?!()[]“”„«»\"'‘’…"
_LINE_BREAK = re.compile(rf"[{_HYPHENS}][ \t\xa0]*\n\s*")
_IS_PRINTED, _IS_BESIDE, _IS_SECTION = re.compile(_PRINTED), re.compile(_BESIDE), re.compile(r"\d+(?:\.\d+)+\s")
_LONE_NUMBER = re.compile(r"(?<![^\s-])\d+(?![^\s-])")
# What a character may be mistaken for (fixed values).
_SAME = str.maketrans("|1lı50@†9e€¢$£b68", "iiiisoatgcccsfhhh")
_PARTS = (("ﬁ", "fi"), ("ﬂ", "fi"), ("m", "rn"), ("n", "ri"), ("w", "vv"), ("d", "ci"), ("u", "ii"), ("h", "ii"))


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def line_breaks(text: str) -> list[tuple[int, int, str, str]]:
    """Where words are cut at line ends: begin and end of the whole in ``text``, and its two parts."""
    out, done = [], 0
    for m in _LINE_BREAK.finditer(text):
        begin, end = m.start(), m.end()
        while begin > done and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        left, right = text[begin : m.start()], text[m.end() : end]
        if m.start() >= done and _has_letter(left) and _has_letter(right):
            out.append((begin, end, left, right))
            done = end
    return out


def _folded(text: str) -> str:
    text = text.lower().translate(_SAME)
    for character, parts in _PARTS:
        text = text.replace(character, parts)
    return text


def head_key(line: str) -> tuple[str | None, bool]:
    """The line as it recurs, misread or not, without numbers, if it looks like a title; and whether its script has no capitals."""
    bare = _IS_BESIDE.sub("", line).strip()
    words = bare.split()
    if len(bare) < 3 or bare[-1] in ".?!;:,।-‐¬\xad" or _IS_SECTION.match(bare):
        return None, False
    first = bare[0]
    if first.isalpha() and not first.isupper() and not first.islower():
        return (_folded(_LONE_NUMBER.sub("#", bare)) if len(words) <= PLAIN_WORDS else None), True
    if not (first.isupper() or first.isdigit() or first in "|@†(["):
        return None, False
    capital = sum(not w[0].islower() or len(w) <= 3 for w in words)
    return (_folded(_LONE_NUMBER.sub("#", bare)) if capital * 10 >= len(words) * 8 else None), False


_EDGES = "array<struct<line:string,at:int,number:boolean,beside:boolean,key:string,plain:boolean>>"
_READ = f"h string, scan boolean, text string, tokens array<string>, joined array<struct<left:string,right:string>>, edges {_EDGES}, word string, n bigint, clean bigint, scanned bigint, cut bigint"
_PAIR = pa.struct([("left", pa.string()), ("right", pa.string())])
_EDGE = pa.struct([("line", pa.string()), ("at", pa.int32()), ("number", pa.bool_()), ("beside", pa.bool_()), ("key", pa.string()), ("plain", pa.bool_())])
_TYPES = (pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(_PAIR), pa.list_(_EDGE), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each distinct text its words, cut words and edge lines, and, in rows of their own, counts of all words of many texts."""
    names = [part.split(" ")[0] for part in re.split(r", (?=\w+ )", _READ)]
    counts: list[Counter[str]] = [Counter() for _ in range(4)]

    def counted() -> pa.RecordBatch:
        words = list(set(counts[0]) | set(counts[3]))
        columns = [pa.nulls(len(words), t) for t in _TYPES[:6]] + [pa.array(words, pa.string())] + [pa.array([c[w] for w in words], pa.int64()) for c in counts]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        rows = []
        for h, text, scan, clean in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            breaks = line_breaks(text)
            rest, at = [], 0
            for begin, end, _, _ in breaks:
                rest += [text[at:begin], "\n"]
                at = end
            tokens = [w for w in (t.strip(_MARKS).lower() for t in "".join([*rest, text[at:]]).split()) if w and _has_letter(w)]
            counts[0].update(tokens)
            if clean:
                counts[1].update(tokens)
            pairs = []
            if scan:
                counts[2].update(tokens)
                pairs = [(left.lower().lstrip("([“„«\"'‘"), right.lower().strip(_MARKS)) for _, _, left, right in breaks]
                counts[3].update(a + b for a, b in pairs)
            lines = [(line.strip(), i) for i, line in enumerate(text.split("\n")) if line and not line.isspace()]
            edges = []
            for line, i in lines if len(lines) <= 2 * EDGE_LINES else lines[:EDGE_LINES] + lines[-EDGE_LINES:]:
                number = bool(_IS_PRINTED.match(line))
                key, plain = (None, False) if number else head_key(line)
                beside = not number and bool(_IS_BESIDE.search(line))
                if scan or key:
                    edges.append({"line": line, "at": i, "number": number, "beside": beside, "key": key, "plain": plain})
            said = list(dict.fromkeys([*tokens, *(a + b for a, b in pairs)])) if scan else None
            rows.append((h, scan, text if scan else None, said, [{"left": a, "right": b} for a, b in dict.fromkeys(pairs)], edges))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _TYPES[:6], strict=True)), *(pa.nulls(len(rows), t) for t in _TYPES[6:])], names)
        if len(counts[0]) > WORDS_HELD:
            yield counted()
    yield counted()


def fold(text: Column) -> Column:
    """Lower case with each character written as what it may be mistaken for, so that all our confusions leave it as it is."""
    out = F.translate(F.lower(text), "".join(map(chr, _SAME)), "".join(map(chr, _SAME.values())))
    for character, parts in _PARTS:
        out = F.replace(out, F.lit(character), F.lit(parts))
    return out


def anagram(word: Column) -> Column:
    """Sum of the hashes of a word's characters; hashes of 44 bits keep sums of a thousand characters exact."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 44))))


def corrections(words: DataFrame, unknown: DataFrame) -> DataFrame:
    """``word, printed``: the best frequent word of which a rare ``word`` of ``unknown`` (word, n) is a confusable variant; a word that
    characters betray need not be rare."""
    frequent = words.where((F.col("n") >= FREQUENT) & ~F.col("word").rlike(_ODD)).select(F.col("word").alias("printed"), F.col("n").alias("often"), anagram(F.col("word")).alias("hash"), fold(F.col("word")).alias("same"))
    rare = unknown.select("word", "n", anagram(F.col("word")).alias("hash"), fold(F.col("word")).alias("same"))
    moves = F.array(*[F.struct(F.lit(a).alias("read"), (anagram(F.lit(b)) - anagram(F.lit(a))).alias("by")) for a, b in CONFUSIONS])
    once = rare.select("word", "n", "same", "hash", F.explode(F.filter(moves, lambda m: F.col("word").contains(m["read"]))).alias("m"))
    once = once.select("word", "n", "same", F.col("m.read").alias("first"), (F.col("hash") + F.col("m.by")).alias("hash"))
    twice = once.select("word", "n", "same", "hash", F.explode(F.filter(moves, lambda m: F.col("word").contains(m["read"]) & (m["read"] >= F.col("first")))).alias("m"))
    twice = twice.select("word", "n", "same", (F.col("hash") + F.col("m.by")).alias("hash"), F.lit(2).alias("steps"))
    moved = once.select("word", "n", "same", "hash", F.lit(1).alias("steps")).union(twice).distinct()
    pairs = moved.join(frequent, ["hash", "same"]).where(((F.col("often") >= TIMES * F.col("n")) | F.col("word").rlike(_ODD)) & (F.col("word") != F.col("printed")))
    return pairs.groupBy("word").agg(F.min_by("printed", F.struct("steps", -F.col("often"), "printed")).alias("printed"))


def misread(words: DataFrame) -> DataFrame:
    """``word, printed`` of every misread word of the scanned pages; ``printed`` is null where no frequent word explains it.

    A word that stands as often, by share of all words, on pages that were not scanned is what it looks like, unless characters betray it.
    """
    rates = words.agg(F.sum("scanned").alias("all_scanned"), F.sum("clean").alias("all_clean"))
    odd = F.col("word").rlike(_ODD)
    sound = (F.col("clean") > 0) & (F.col("clean") * F.col("all_scanned") * OFTENER >= F.col("scanned") * F.col("all_clean"))
    seen = words.where("scanned > 0 or cut > 0").join(rates)  # one row
    unknown = seen.where((~sound | odd) & (F.length("word") >= 2)).select("word", F.greatest("n", "cut").alias("n"))
    unknown, _ = cut(unknown, "unknown")
    best = corrections(words, unknown)
    return unknown.join(best, "word", "left").where(F.col("printed").isNotNull() | odd).select("word", "printed")


def heads(edge: DataFrame) -> DataFrame:
    """The edge lines (page_id, book_id, key, plain and others) that are recurring heads or feet: they look like titles and come again on
    another page of the book or at the edges of three or more books; lines in a script without capitals on three pages of the book."""
    keyed = edge.where("key is not null")
    per_book = keyed.groupBy("book_id", "key").agg(F.count_distinct("page_id").alias("pages"), F.max("plain").alias("is_plain"))
    books = per_book.groupBy("key").agg(F.count("*").alias("books"))
    good = per_book.join(books, "key").where(F.when(F.col("is_plain"), F.col("pages") >= PLAIN_PAGES).otherwise((F.col("pages") > 1) | (F.col("books") >= 3))).select("book_id", "key")
    return keyed.join(good, ["book_id", "key"])


def breaks(read: DataFrame, words: DataFrame) -> DataFrame:
    """``left, right, own`` of every pair of word parts at a line end of scanned pages: ``own`` where the word has a hyphen."""
    pairs = read.where("scan").select(F.explode("joined").alias("p")).select("p.left", "p.right").distinct()
    counts = words.where("n > 0").groupBy(fold(F.col("word")).alias("same")).agg(F.sum("n").alias("n"))
    forms = {"whole": F.concat("left", "right"), "kept": F.concat_ws("-", "left", "right"), "begin": F.col("left"), "end": F.col("right")}
    long = pairs.select("left", "right", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), fold(v).alias("same")) for k, v in forms.items()])).alias("f")).select("left", "right", "f.*")
    n = {k: F.coalesce(F.max(F.when(F.col("form") == k, F.col("n"))), F.lit(0)).alias(k) for k in forms}
    told = long.join(counts, "same", "left").groupBy("left", "right").agg(*n.values())
    own = F.when(F.col("whole") + F.col("kept") > 0, F.col("kept") > F.col("whole")).otherwise(F.col("left").contains("-") & (F.col("end") > 3) | (F.col("begin") > 20) & (F.col("end") > 20))
    return told.select("left", "right", own.alias("own"))


class Evidence:
    """What both queries need: pages by the hash of their texts, what was read of each text, words, edges, and their tables."""

    def __init__(self, pages: DataFrame) -> None:
        text = F.regexp_replace(F.coalesce("raw_text", "text"), r"\r\n?", "\n")
        rows = pages.select("page_id", "book_id", F.coalesce(scanned(F.col("page_type")), F.lit(False)).alias("scan"), text.alias("text"))
        rows = rows.where("page_id is not null and text is not null and trim(text) <> ''").withColumn("h", F.md5("text"))
        once = rows.groupBy("h").agg(F.first("text").alias("text"), F.bool_or("scan").alias("scan"), F.bool_or(~F.col("scan")).alias("clean"))
        read, _ = cut(once.select("h", "text", "scan", "clean").mapInArrow(_read, _READ), "read")
        self.pages, _ = cut(rows.select("page_id", "book_id", "scan", "h").distinct(), "page_texts")
        self.read = read.where("h is not null")
        counts = read.where("h is null").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "clean", "scanned", "cut")])
        self.words, _ = cut(counts, "vocabulary")
        self.edges = self.read.select("h", F.explode("edges").alias("e")).select("h", "e.*")
        self.heads = heads(self.edges.where("key is not null").join(self.pages, "h"))


def found(pages: DataFrame) -> DataFrame:
    """``(page_id, noise)`` of every scanned page and kind of noise, each pair once.

    Pages without text, null page ids and pages of other types have none; page types count without blanks and in any case.
    """
    e = Evidence(pages)
    scans = e.read.where("scan")
    of_text = [
        scans.select("h", F.explode("joined").alias("p")).select("h", "p.left", "p.right").join(breaks(e.read, e.words).where("not own"), ["left", "right"], "left_semi").select("h", F.lit("hyphen_break").alias("noise")),
        scans.select("h", F.explode("tokens").alias("word")).join(misread(e.words), "word", "left_semi").select("h", F.lit("misread_char").alias("noise")),
        e.edges.where("number").select("h", F.lit("page_number").alias("noise")),
    ]
    by_text = reduce(DataFrame.union, of_text).distinct().join(e.pages.where("scan"), "h").select("page_id", "noise")
    kinds = F.when(F.col("beside"), F.array(F.lit("running_header"), F.lit("page_number"))).otherwise(F.array(F.lit("running_header")))
    return by_text.union(e.heads.where("scan").select("page_id", F.explode(kinds).alias("noise"))).distinct()


_TOKEN = re.compile(r"\S+")


def _repair(text: str, dropped: set[int], fixes: dict[str, str], own: set[tuple[str, str]]) -> str:
    lines = [line for i, line in enumerate(text.split("\n")) if i not in dropped]
    body = "\n".join(lines)

    while found := line_breaks(body):
        done, at = [], 0
        for begin, end, left, right in found:
            pair = left.lower().lstrip("([“„«\"'‘"), right.lower().strip(_MARKS)
            done += [body[at:begin], f"{left}-{right}" if pair in own else left + right]
            at = end
        body = "".join([*done, body[at:]])

    def fix(m: re.Match[str]) -> str:
        token = m[0]
        core = token.strip(_MARKS)
        printed = fixes.get(core.lower())
        if not printed:
            return token
        if core.isupper():
            printed = printed.upper()
        elif core[:1].isupper():
            printed = printed[:1].upper() + printed[1:]
        return token.replace(core, printed, 1)

    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", body)]
    return "\n\n".join(_TOKEN.sub(fix, p) for p in paragraphs if p)


def repaired(pages: DataFrame) -> DataFrame:
    """``page_id, repaired``: every distinct text of each scanned page as continuous paragraphs, corrected, without edge lines."""
    e = Evidence(pages)
    scans = e.read.where("scan")
    wrong = misread(e.words).where("printed is not null")
    fixes = scans.select("h", F.explode("tokens").alias("word")).join(wrong, "word").groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("word", "printed"))).alias("fixes"))  # the words of one page
    own = breaks(e.read, e.words).where("own")
    pairs = scans.select("h", F.explode("joined").alias("p")).select("h", "p.left", "p.right").join(own, ["left", "right"]).groupBy("h").agg(F.collect_set(F.struct("left", "right")).alias("own"))
    scanned_pages = e.pages.where("scan").select("page_id", "h")
    numbers = e.edges.where("number").select("h", "at").join(scanned_pages, "h").select("page_id", "h", "at")
    lines = numbers.union(e.heads.where("scan").select("page_id", "h", "at")).groupBy("page_id", "h").agg(F.collect_set("at").alias("drop"))
    told = scans.select("h", "text").join(fixes, "h", "left").join(pairs, "h", "left")
    joined = scanned_pages.distinct().join(told, "h").join(lines, ["page_id", "h"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, fix, kept, drop in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                out.append(_repair(text, set(drop or ()), dict(fix or ()), {(p["left"], p["right"]) for p in kept or ()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["page_id", "repaired"])

    return joined.select("page_id", "text", "fixes", "own", "drop").mapInArrow(run, "page_id string, repaired string")
