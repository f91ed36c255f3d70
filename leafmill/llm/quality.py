"""Problem 9: counts, ratios and shape of every text.

A text is cut into parts of a fixed number of characters; each part gives counts that can be added, and the state at both of
its ends: the word and the line that may go on in the next part. Joining two neighbouring parts completes that word and that
line, so parts may be joined in any grouping, and huge texts are joined in a tree. Texts of one part need no shuffle at all.

Whether words have the letters of some language in an order that languages have is told by the letter trigrams of all rows
with a language; the limit lies between their words and the same words with shuffled letters.
"""

from __future__ import annotations

import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.durable import cut, drop

#: Characters of a part, parts joined at once in the tree of two levels (a row holds fewer than FAN * FAN parts), and characters
#: kept of a line at either end of a part.
PART, FAN, EDGE = 1 << 18, 96, 400
#: Rows from which on languages count alike in the letter model, the unit of its weighted counts, and the least trigrams that make one.
ALIKE, UNIT, LEAST_LEARNED = 1000, 1 << 16, 20_000
#: Least trigrams of a text that the letter model judges, and longest period of words by which loops are known.
LEAST_GRAMS, PERIOD = 60, 24
#: Where the limit of the letter model lies between words (0) and shuffled words (1); texts keep some words, so below the middle.
DISORDERED = 0.4
#: Characters of the longest line that is judged by its text, of the longest cell of a list with marks, and kept of an open piece.
SHORT, CELL, OPEN = 300, 32, 64
#: Buckets of the histogram of words, by which texts of the same words over and over are known.
BUCKETS = 1024
#: Characters kept of a word that goes on over the end of a part.
LONG_WORD = 1000
#: Limits of the shapes.
LEAST_CHARS, READABLE, REPEATED, REPEATED_IN_LINES, LOOPED, OTHER_LINES = 100, 0.5, 0.15, 0.3, 0.8, 0.1

# Frequent words of the languages of the corpus (fixed values).
COMMON = frozenset(
    """the of and to in a is that it for as was with be by on not he his but at are this have from or had an they which you were
    her all she there would their we him been has when who will no more if out so up said what its about than into them can only
    other some could these two may then do first any my now such like our over me even most made after also did many before
    der die das und ist nicht ein eine einen dem den des mit sich auf für von zu im in es dass auch als wie bei aus nach wird nur
    le la les un une des et est que qui dans pour pas sur se ne au du de on il elle avec ce cette par plus
    el los las una unos y en es que se no por con para su al lo del como más
    है के में की को का से पर और एक यह नहीं हैं कि भी तब जब तो था इस हो कर जाता""".split()
)
# Letters and digits, with the marks that belong to the letters of some scripts; underscores are taken out before.
_WORD = re.compile(r"[\w\u0300-\u036f\u0900-\u0dff\u0e00-\u0eff\u1000-\u109f\u200c\u200d]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_SENTENCE = re.compile(r"[.!?।…][\"'”’)\]»]*(?:\s|$)")
_LEADER = re.compile(r"(?:\.{3,}|(?:\. ){3,}|…)\s*\d+$")
_MARK = re.compile(r"(?:[•▪●■◆▸►*·‣◦○–—-]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)]|\[[ x]?\])\s+(?=\S)")
_PAIR = re.compile(r"^[^.!?:=]{1,40}(?::| =| [–—-]) \S[^.!?]{0,60}$")
_NUMBER = re.compile(r"(?:[<>~≈±+-]?\d[\d.,]*%?|[–—-]|n/?a)$", re.IGNORECASE)
_CELLS = re.compile(r"\s{2,}|\t")
_GAP = re.compile(r"\s\s")
_CELL_TAG = re.compile(r"<t[dhr]")
_STOPS = frozenset(".!?।…:")
_VOWELS = frozenset("aeiouy")
_OPEN_TAG = re.compile(r"</?(?:[A-Za-z][^<>\n]{0,80})?$")


def _readable(word: str) -> bool:
    if word.isdigit():
        return len(word) <= 12
    if len(word) > 60:
        return False
    if not word.isascii():
        return len(word) > 2 or max(word) > "ÿ"
    if not word.isalpha():
        return len(word) <= 4
    if word.islower() or word[1:].islower():
        vowels = sum(c in _VOWELS for c in word.lower())
        return len(word) <= 3 or vowels * (5 if len(word) > 24 else len(word)) >= len(word)
    return word.isupper() and len(word) <= 16


def _has_grams(word: str) -> bool:
    return 4 <= len(word) <= 60 and not any(c.isdigit() or c > "\u2e7f" for c in word)


def _grams(word: str) -> list[str]:
    """The letter trigrams of a word in lower case, with a blank at both ends; none of
    words of less than four letters, whose order tells little, or of other signs."""
    if not _has_grams(word):
        return []
    line = f" {word} "
    return [line[i : i + 3] for i in range(len(line) - 2)]


class Letters:
    """Letter trigrams with backing off to bigrams, as thousandths of the negative logarithm, and the limit of texts."""

    def __init__(self, counts: dict[str, int]) -> None:
        pairs, starts, middles = Counter(), Counter(), Counter()
        for gram, n in counts.items():
            pairs[gram[:2]] += n
            starts[gram[1:]] += n
            middles[gram[1]] += n
        total = sum(counts.values())
        self.weights = {g: self._cost(0.8 * n / pairs[g[:2]] + 0.2 * starts[g[1:]] / middles[g[1]]) for g, n in counts.items()}
        self.pairs = {g: self._cost(0.2 * n / middles[g[0]]) for g, n in starts.items()}
        self.unknown = self._cost(1 / max(1, total))
        self.limit = 0.0

    @staticmethod
    def _cost(p: float) -> int:
        return round(-1000 * math.log(p))

    def cost(self, word: str) -> tuple[int, int]:
        """Cost and number of a word's trigrams."""
        grams = _grams(word)
        return sum(self.weights[g] if g in self.weights else self.pairs.get(g[1:], self.unknown) for g in grams), len(grams)

    def calibrate(self, words: float, shuffled: float) -> None:
        """Set the limit between the mean costs of the words and of the same words with shuffled letters."""
        self.limit = (1 - DISORDERED) * words + DISORDERED * shuffled


class _Known(dict):
    """What the counts need of a word, kept for words that come again."""

    def __init__(self, letters: Letters | None = None) -> None:
        super().__init__()
        self.letters = letters

    def __missing__(self, word: str) -> tuple[int, int, int, int, int]:
        low = word.lower()
        cost, grams = self.letters.cost(low) if self.letters else (0, 0)
        known = (len(word) if low in COMMON else 0, len(word) if _readable(word) else 0, crc32(low[:LONG_WORD].encode("utf-8", "replace")), cost, grams)
        if len(self) > 300_000:
            self.clear()
        if len(word) <= 40:
            self[word] = known
        return known


class Loops:
    """How many words of a run are the same as the word so many words before, for each period up to ``PERIOD``; additive."""

    __slots__ = ("head", "hits", "tail")

    def __init__(self, codes: list[int]) -> None:
        run = np.full(len(codes) + PERIOD + 1, -1, np.int64)
        run[: len(codes)] = codes
        windows = np.lib.stride_tricks.sliding_window_view(run, PERIOD + 1)[: len(codes)]
        self.hits = (windows[:, 1:] == windows[:, :1]).sum(axis=0)
        self.head, self.tail = codes[:PERIOD], codes[-PERIOD:]

    def join(self, other: Loops) -> Loops:
        self.hits += other.hits
        if self.tail and other.head:
            border = Loops(self.tail + other.head).hits - Loops(self.tail).hits - Loops(other.head).hits
            self.hits += border
        if len(self.head) < PERIOD:
            self.head = (self.head + other.head)[:PERIOD]
        self.tail = (self.tail + other.tail)[-PERIOD:]
        return self

    def share(self, words: int) -> float:
        """Greatest share of the words that repeat those of one period; periods of more than a third of the words don't count."""
        most = min(PERIOD, words // 3)
        return float(self.hits[:most].max()) / words if most else 0.0


_KNOWN = _Known()


def _ended(line: str) -> bool:
    return line.rstrip("\"'”’)]»")[-1:] in _STOPS


def line_kind(line: str) -> str:
    """row (cells of a table), entry (of a list), heading, sentence (just one), or text."""
    if "<td" in line or "<th" in line or "<tr" in line:
        return "row"
    if line[-1:].isdigit() and _LEADER.search(line):
        return "entry"
    if line.count("|") >= 2 or line.count("\t") >= 2:
        return "row"
    n = len(line)
    if n <= SHORT:
        for mark in ";,":
            if mark in line and mark + " " not in line and line.count(mark) >= 2:
                return "row"
        words = line.split()
        for mark in (", ", "; "):
            if line.count(mark) >= 2 and not _ended(line):
                cells = line.split(mark)
                numbers = sum(bool(_NUMBER.match(c)) for c in cells)
                if max(map(len, cells)) <= 32 and (numbers * 3 >= len(cells) or not any(w.strip(",;") in COMMON for w in words)):
                    return "row"
        if "  " in line or "\t" in line:
            cells = _CELLS.split(line)
            numbers = sum(bool(_NUMBER.match(c)) for c in cells)
            if len(cells) >= 3 and (numbers * 3 >= len(cells) or ("   " in line and len(words) > len(cells)) or ("   " in line and len(cells) <= 6)):
                return "row"
        tail = 0
        for word in reversed(words):
            if not _NUMBER.match(word):
                break
            tail += 1
        if tail >= 2 and tail * 5 >= len(words) * 2:
            return "row"
        ended = _ended(line)
        mark = _MARK.match(line)
        rest = line[mark.end() :] if mark else line
        if mark and len(rest) <= 80 and len(_SENTENCE.findall(rest)) <= (1 if len(rest) <= 40 else 0):
            return "entry"
        if not ended:
            if n <= 110 and _PAIR.match(line):
                return "entry"
            if len(words) <= 4 and n <= 40 and not any(w in COMMON for w in words):
                return "entry"
            if n <= 90 and not words[-1][:1].islower() and (line.isupper() or sum(w[:1].isupper() or not w[:1].isalpha() for w in words) * 10 >= len(words) * 7):
                return "heading"
        elif n <= 200 and len(_SENTENCE.findall(line)) == 1:
            return "sentence"
    return "text"


class Pieces:
    """Additive counts of the pieces between separators of one character; the first and the last piece may go on."""

    __slots__ = ("counts", "head", "kinds", "tail")

    def __init__(self, pieces: list[str]) -> None:
        self.head, self.tail = pieces[0][:OPEN], pieces[-1][:OPEN] if len(pieces) > 1 else None
        self.counts, self.kinds = Counter(), ""
        self._add(pieces[1:-1])

    def _add(self, pieces: list[str]) -> None:
        kinds = []
        for piece in pieces:
            bare = piece[:OPEN].strip()
            kind = "E" if not bare else "N" if len(bare) <= CELL and _NUMBER.match(bare) else "W"
            kinds.append(kind)
            self.counts[kind] += 1
            self.counts["long"] += len(bare) > CELL
            self.counts["common"] += bare.strip(",;") in COMMON
            self.counts["tail"] = self.counts["tail"] + 1 if kind == "N" else self.counts["tail"] if kind == "E" else 0
        self._runs(self.kinds + "".join(kinds))

    def _runs(self, kinds: str) -> None:
        """Count the cells between wide gaps; of a run of empty pieces or words only what a neighbour may need is kept."""
        runs = re.findall(r"[NW]+|E+|x", kinds)
        for i, run in enumerate(runs):
            inner = 0 < i < len(runs) - 1
            if run[0] in "NW":
                if inner:
                    self.counts["cells"] += 1
                    self.counts["numbers"] += run == "N"
                runs[i] = "x" if inner else run if len(run) == 1 else "WW"
            elif run[0] == "E":
                self.counts["wide"] += inner and len(run) > 1
                runs[i] = "E" if inner else run[:2]
        self.kinds = re.sub(r"x(?:E?x)+", "x", "".join(runs))

    def join(self, other: Pieces) -> Pieces:
        if self.tail is None:
            self.head = (self.head + other.head)[:OPEN]
            self.tail, self.counts, self.kinds = other.tail, other.counts, other.kinds
        elif other.tail is None:
            self.tail = (self.tail + other.head)[:OPEN]
        else:
            self._add([(self.tail + other.head)[:OPEN]])
            tail = other.counts["tail"] + (0 if other.counts["W"] else self.counts["tail"])
            self.counts.update(other.counts)
            self.counts["tail"] = tail
            self._runs(self.kinds + other.kinds)
            self.tail = other.tail
        return self

    def close(self) -> Counter[str]:
        """Counts of all pieces; ``cells`` and ``numbers`` are those between wide gaps."""
        whole = Pieces(["", self.head, ""])
        if self.tail is not None:
            own, kinds = whole.counts["tail"], whole.kinds
            whole.counts.update(self.counts)
            whole.counts["tail"] = self.counts["tail"] + (0 if self.counts["W"] else own)
            whole._runs(kinds + self.kinds)
            whole._add([self.tail])
        for run in re.findall(r"[NW]+", whole.kinds):
            whole.counts["cells"] += 1
            whole.counts["numbers"] += run == "N"
        return whole.counts


def may_be_row(line: str, ended: bool) -> bool:
    """Whether :meth:`Long.is_row` can hold, by what is quick to see."""
    end = line.rstrip().rstrip(".,")[-1:]
    if "|" in line or "\t" in line or "  " in line or "<t" in line or end.isdigit() or end in "%–—-aA":
        return True
    return any(line.count(mark) >= 2 and (not ended or mark + " " not in line) for mark in ";,") or bool(_GAP.search(line))


class Long:
    """What the rules of rows need of a line of any length, additive over the parts it is cut into."""

    __slots__ = ("begin", "counts", "end", "marks", "words")

    def __init__(self, line: str) -> None:
        self.begin, self.end = line[:2], line[-2:]
        self.counts = Counter(n=len(line), bars=line.count("|"), tabs=line.count("\t"), tags=len(_CELL_TAG.findall(line)))
        for mark in ";,":
            self.counts[mark] = line.count(mark)
            self.counts[mark + " "] = line.count(mark + " ")
        self.marks = {mark: Pieces(line.split(mark)) for mark in ";,"}
        self.words = Pieces(re.split(r"\s", line.replace("\t", "  ")))

    def join(self, other: Long) -> Long:
        border = self.end + other.begin
        self.counts["tags"] += len(_CELL_TAG.findall(border))
        for mark in ";,":
            self.counts[mark + " "] += self.end[-1:] == mark and other.begin[:1] == " "
            self.marks[mark].join(other.marks[mark])
        self.counts.update(other.counts)
        self.words.join(other.words)
        self.begin, self.end = (self.begin + other.begin)[:2], (self.end + other.end)[-2:]
        return self

    def is_row(self, ended: bool) -> bool:
        """The rules of :func:`line_kind`; cells may be as long on average as the longest line it takes allows."""
        c, words = self.counts, self.words.close()
        if c["tags"] or c["bars"] >= 2 or c["tabs"] >= 2:
            return True
        for mark in ";,":
            n = c[mark] + 1
            if n >= 3 and not c[mark + " "] and c["n"] <= 100 * n:
                return True
            if c[mark + " "] >= 2 and not ended:
                cells = self.marks[mark].close()
                if not cells["long"] and (cells["N"] * 3 >= n or not words["common"]):
                    return True
        n, total = words["cells"], words["N"] + words["W"]
        if n >= 3 and c["n"] <= 100 * n and (words["numbers"] * 3 >= n or (words["wide"] and total > n)):
            return True
        return words["tail"] >= 2 and words["tail"] * 5 >= total * 2


class Part:
    """Additive counts of a part of a text and the state at its ends."""

    __slots__ = ("counts", "first", "head", "last", "lines", "loops", "run", "tail", "word_head", "word_tail", "words")

    def __init__(self, text: str) -> None:
        plain = _TAG.sub(" ", text) if "<" in text else text
        plain = plain.replace("_", " ")
        self.counts = Counter(chars=len(text), spaces=len(text) - sum(map(len, text.split())))
        self.words: Counter[int] = Counter()
        self.lines: Counter[str] = Counter()
        self.first = self.last = None  # kinds of the first and the last complete line that isn't blank
        found = _WORD.findall(plain)
        # A word at either end may go on in the neighbouring part.
        begins, ends = _WORD.match(plain), found and _WORD.fullmatch(plain[-1:])
        if begins and len(found) == 1 and begins.end() == len(plain):
            self.word_head, self.word_tail, found = found[0], None, []
        else:
            self.word_head = found.pop(0) if begins else ""
            self.word_tail = found.pop() if ends else ""
        self.run, self.loops = self._add(found), None
        rows = text.split("\n")
        if len(rows) == 1:
            self.head, self.tail = _edge(text), None
        else:
            self.head, self.tail = _edge(rows[0]), _edge(rows[-1])
            for line in rows[1:-1]:
                self._line(_edge(line))

    def _add(self, found: list[str]) -> list[int]:
        """Count words; their hashes in order."""
        total = letters = common = readable = cost = grams = 0
        buckets, codes = self.words, {}
        for word, n in Counter(found).items():
            is_common, good, code, own_cost, own_grams = _KNOWN[word]
            total += n
            letters += n * len(word)
            if is_common:
                common += n
            readable += n * good
            cost += n * own_cost
            grams += n * own_grams
            codes[word] = code
            bucket = code % BUCKETS
            buckets[bucket] = buckets.get(bucket, 0) + n
        self.counts.update({"words": total, "letters": letters, "common": common, "readable": readable, "cost": cost, "grams": grams})
        return [codes[word] for word in found]

    def _glue(self, a: str, b: str) -> str:
        """Two parts of one word; of a very long one the beginning is kept and the other letters are counted at once."""
        word = a + b
        self.counts["letters"] += max(0, len(word) - LONG_WORD)
        return word[:LONG_WORD]

    def compact(self) -> Part:
        """The same state in a bounded size; needed before parts are joined."""
        if self.loops is None:
            self.run, self.loops = None, Loops(self.run)
        self.head, self.tail = (e and (*e[:3], Long(e[3]) if isinstance(e[3], str) else e[3]) for e in (self.head, self.tail))
        return self

    def _line(self, edge: tuple[int, str, str, str | Long | None]) -> None:
        n, begin, end, long = edge
        if n <= EDGE:
            line = begin.strip()
            if not line:
                return
            kind, ended = line_kind(line), _ended(line)
            if kind == "text" and len(line) > SHORT and may_be_row(line, ended) and Long(line).is_row(ended):
                kind = "row"
        elif not begin.strip() and not end.strip():
            return
        else:
            ended = _ended(end.rstrip())
            if isinstance(long, str):
                long = Long(long) if may_be_row(long, ended) else None
            kind = "row" if long and long.is_row(ended) else "text"
        self.lines[kind] += 1
        self.lines["ended"] += ended
        self.lines["all"] += 1
        self.first = self.first or kind
        self.last = kind

    def join(self, other: Part) -> Part:
        """This part followed by ``other``; the other one must not be used again."""
        self.compact()
        other.compact()
        if not self.counts["chars"] or not other.counts["chars"]:
            return self if self.counts["chars"] else other
        self.counts.update(other.counts)
        self.words.update(other.words)
        # The word across the border.
        if self.word_tail is None:  # this part is one word
            if other.word_tail is None:
                self.word_head = self._glue(self.word_head, other.word_head)
            else:
                self.word_head, self.word_tail = self._glue(self.word_head, other.word_head), other.word_tail
        elif other.word_tail is None:
            self.word_tail = self._glue(self.word_tail, other.word_head)
        else:
            if self.word_tail or other.word_head:
                self.loops.join(Loops(self._add([self._glue(self.word_tail, other.word_head)])))
            self.word_tail = other.word_tail
        self.loops.join(other.loops)
        # The line across the border.
        self.lines.update(other.lines)
        if self.tail is None and other.tail is None:
            self.head = _extend(self.head, other.head)
        elif self.tail is None:
            self.head, self.tail = _extend(self.head, other.head), other.tail
            self.first, self.last = other.first, other.last
        elif other.tail is None:
            self.tail = _extend(self.tail, other.head)
        else:
            self._line(_extend(self.tail, other.head))
            self.tail, self.first = other.tail, self.first or other.first
            self.last = other.last or self.last
        return self

    def close(self) -> dict[str, object]:
        """Ratios and shape of the whole text; nothing may be joined afterwards."""
        before, after = (self._add([word]) if word else [] for word in (self.word_head, self.word_tail))
        loops = Loops(before + self.run + after) if self.loops is None else Loops(before).join(self.loops).join(Loops(after))
        first, last = self.first, self.last
        self.first = None
        self._line(self.head)
        first = self.first or first
        self.last = last or self.last
        if self.tail is not None:
            self._line(self.tail)
        c, lines = self.counts, self.lines
        marks = max(1, c["chars"] - c["spaces"])
        words, total = c["words"], max(1, lines["all"])
        repeated = sum(n * (n - 1) for n in self.words.values()) / (words * (words - 1)) if words > 1 else 0.0
        looped = loops.share(words)
        cost = c["cost"] / max(1, c["grams"]) if _KNOWN.letters else 0.0
        disordered = cost > _KNOWN.letters.limit and c["grams"] >= LEAST_GRAMS if _KNOWN.letters else False
        out = {
            "chars": c["chars"], "words": words, "lines": lines["all"], "mean_word_length": c["letters"] / max(1, words), "symbol_ratio": 1 - c["letters"] / marks if c["letters"] < marks else 0.0,
            "ended_lines": lines["ended"] / total, "common_words": c["common"] / max(1, words), "readable": min(1.0, c["readable"] / marks), "repeated": repeated, "looped": looped, "letter_cost": cost / 1000,
        }
        tags = lines["row"] * 2 > total  # the tags of a table aren't read
        structured = (lines["row"] + lines["entry"]) * 2 > total
        if not lines["all"]:
            shape = "prose"
        elif (out["readable"] < READABLE and not (tags and repeated < REPEATED and out["readable"] > 0.2)) or (words >= 12 and repeated > (REPEATED_IN_LINES if structured else REPEATED)):
            shape = "junk"
        elif disordered or (looped > LOOPED and not structured):
            shape = "junk"
        else:
            spared = min(lines["heading"], 3) + (self.last == "sentence")
            most = max(OTHER_LINES * total, 0)
            rows, entries = lines["row"], lines["entry"]
            if rows >= 3 and rows >= entries and total - rows - min(entries, 2) - spared <= most:
                shape = "table"
            elif entries >= 3 and total - entries - spared <= most:
                shape = "list"
            elif rows + entries >= 4 and total - rows - entries - spared <= most and rows > 0:
                shape = "table" if rows > entries else "list"
            else:
                shape = "prose"
        return out | {"shape": shape}


def _edge(line: str) -> tuple[int, str, str, str | Long | None]:
    """Length, beginning and end of a line, and one that is longer than its beginning itself, until :meth:`Part.compact`."""
    return len(line), line[:EDGE], line[-16:], line if len(line) > EDGE else None


def _extend(a: tuple[int, str, str, Long | None], b: tuple[int, str, str, Long | None]) -> tuple[int, str, str, Long | None]:
    n = a[0] + b[0]
    long = (a[3] or Long(a[1])).join(b[3] or Long(b[1])) if n > EDGE else None
    return n, (a[1] + b[1])[:EDGE] if a[0] < EDGE else a[1], (a[2] + b[2])[-16:] if b[0] < 16 else b[2], long


_COLUMNS = {"chars": "bigint", "words": "bigint", "lines": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "ended_lines": "double", "common_words": "double", "readable": "double", "repeated": "double", "looped": "double", "letter_cost": "double", "shape": "string"}
_RESULT = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def slices(text: str, size: int) -> list[str]:
    """The text in parts of at most ``size`` characters; a part ends before a tag rather than within it."""
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        tag = _OPEN_TAG.search(text, max(at + 1, end - 84), end)
        if tag and tag.start() > at:
            end = tag.start()
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def _use(letters: Letters | None) -> None:
    """Let the counts of this worker use a letter model."""
    global _KNOWN
    if _KNOWN.letters is not letters:
        _KNOWN = _Known(letters)


def _columns(closed: list[dict[str, object] | None]) -> list[pa.Array]:
    return [pa.array([r and r[k] for r in closed], _ARROW[v]) for k, v in _COLUMNS.items()]


def _measured(size: int, letters):
    """Counts of every text of one part, and the parts of longer ones; ``row`` tells rows apart within the table."""

    names = ["row", "doc_id", *_COLUMNS, "part", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _use(letters.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            short = [i for i, text in enumerate(texts) if len(text or "") <= size]
            long = [(i, k, t) for i, text in enumerate(texts) if len(text or "") > size for k, t in enumerate(slices(text, size))]
            closed = _columns([Part(texts[i] or "").close() for i in short])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(short, pa.int64())) for c in (0, 1)), *closed, pa.nulls(len(short), pa.int32()), pa.nulls(len(short), pa.string())], names)
            for i, k, t in long:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array([i])) for c in (0, 1)), *_columns([None]), pa.array([k], pa.int32()), pa.array([t])], names)

    return run


def _states(letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _use(letters.value)
        for batch in batches:
            states = [pickle.dumps(Part(text).compact()) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(states, pa.binary())], ["row", "doc_id", "part", "state"])

    return run


def _joined(letters):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _use(letters.value)
        group = group.sort_values("part")
        state = pickle.loads(group["state"].iloc[0])
        for other in group["state"].iloc[1:]:
            state = state.join(pickle.loads(other))
        first = group.iloc[[0]].copy()
        first["part"] //= FAN
        first["state"] = [pickle.dumps(state)]
        return first[["row", "doc_id", "part", "state"]]

    return run


def _closed(letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _use(letters.value)
        for batch in batches:
            done = [pickle.loads(s).close() for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(done)], ["doc_id", *_COLUMNS])

    return run


def letter_model(documents: DataFrame) -> Letters | None:
    """The letter model of the languages of ``documents``; None without a column lang or with too few labelled rows.

    All labelled rows are read (null and ``und`` are no language) and their words counted. A language of more than ``ALIKE`` rows counts
    as if it had so many, so large ones count alike; only sums of trigrams and costs come to the driver.
    """
    if "lang" not in documents.columns:
        return None
    spark = documents.sparkSession
    labelled = documents.where("lang is not null and lang <> 'und' and text is not null").select("lang", "text")
    counted, path = cut(labelled.mapInArrow(_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    rows = counted.where("word = ''").select("lang", F.least(F.lit(1.0), ALIKE / F.col("n")).alias("weight"))
    words = counted.where("word <> ''")
    grams = words.mapInArrow(_word_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Weighted counts are whole numbers of a fixed unit, so that they add up to the same in any order.
    weighted = lambda d: d.join(rows, "lang").withColumn("n", F.ceil(F.col("n") * F.col("weight") * UNIT))
    summed = weighted(grams).groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()  # trigrams of alphabets
    counts = {g: n / UNIT for g, n in zip(summed["gram"].to_pylist(), summed["n"].to_pylist(), strict=True)}
    letters = None
    if sum(counts.values()) >= LEAST_LEARNED:
        letters = Letters(counts)
        held = spark.sparkContext.broadcast(letters)
        costs = weighted(words).groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_word_costs(held), "cost double, mixed double, grams double")
        cost, mixed, n = costs.agg(F.sum("cost"), F.sum("mixed"), F.sum("grams")).first()
        letters.calibrate(cost / n, mixed / n)
    drop(spark, path)
    return letters


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word with trigrams stands in the texts of a language; the word '' counts the texts."""
    said: dict[str, Counter[str]] = {}

    def told() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, own in said.items() for word, n in own.items() if not word or _has_grams(word)]
        said.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = said.setdefault(lang, Counter())
            own[""] += 1
            own.update(_WORD.findall((_TAG.sub(" ", text) if "<" in text else text).replace("_", " ").lower()))
        if sum(map(len, said.values())) > 300_000:
            yield told()
    if said:
        yield told()


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams: Counter[tuple[str, str]] = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            for gram in _grams(word):
                grams[lang, gram] += n
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in grams], pa.string()), pa.array([g[1] for g in grams], pa.string()), pa.array(grams.values(), pa.int64())], ["lang", "gram", "n"])


def _word_costs(letters):
    """Sums of the costs of words, of the same words with shuffled letters, and of their trigrams, each as often as it stands; whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [0, 0, 0]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cost, grams = letters.value.cost(word)
                mixed = letters.value.cost("".join(random.Random(crc32(word.encode("utf-8", "replace"))).sample(word, len(word))))[0]
                sums = [sums[0] + cost * n, sums[1] + mixed * n, sums[2] + grams * n]
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in sums], ["cost", "mixed", "grams"])

    return run


def statistics(documents: DataFrame, part: int = PART) -> DataFrame:
    """``doc_id``, counts, ratios and ``shape`` (prose, list, table, junk) for every row.

    Null and empty texts have counts of 0 and the shape prose. A repeated doc_id comes out as often as it goes in. Of other columns
    only lang is read, for :func:`letter_model`. Texts are read once more; only those longer than ``part`` are shuffled, first as
    parts, then as states of a bounded size, ``FAN`` to a group.
    """
    kind = dict(documents.dtypes)["doc_id"]
    letters = documents.sparkSession.sparkContext.broadcast(letter_model(documents))  # trigrams of alphabets
    # The number of a row depends on nothing but its place in the input, so a task that runs again gives the same ones.
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    measured, _ = cut(rows.mapInArrow(_measured(part, letters), f"row bigint, doc_id {kind}, {_RESULT}, part int, t string"), "quality")
    schema = f"row bigint, doc_id {kind}, part int, state binary"
    parts = measured.where("part is not null").select("row", "doc_id", "part", "t")
    state = parts.repartition(F.col("row"), F.col("part")).mapInArrow(_states(letters), schema)
    for _ in range(2):
        state = state.groupBy("row", F.floor(F.col("part") / FAN).alias("g")).applyInPandas(_joined(letters), schema)
    long = state.select("doc_id", "state").mapInArrow(_closed(letters), f"doc_id {kind}, {_RESULT}")
    return measured.where("part is null").select("doc_id", *_COLUMNS).unionByName(long)


def found(documents: DataFrame) -> DataFrame:
    """``(doc_id, shape)`` of every text of at least 100 characters that is no prose, each doc_id once."""
    odd = statistics(documents.where("doc_id is not null")).where((F.col("chars") >= LEAST_CHARS) & (F.col("shape") != "prose"))
    return odd.groupBy("doc_id").agg(F.min("shape").alias("shape"))
