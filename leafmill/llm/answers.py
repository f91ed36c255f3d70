"""Problem 2: broken question and answer pairs, each with its one defect.

Shortened answers are found by order: among all answers and reference answers sorted by text, whatever continues an answer
stands right behind it, and the rest beyond the common prefix tells whether only a full stop is missing. Where nothing
continues an answer that ends without a stop, its last two words decide: how often they end a sentence of the corpus and how
often they stand within one. Answers that stop at a length at which unusually many stop are cut by a limit, unless their last words
do nothing but end sentences. All of that is built-in expressions and joins around one pass over the sorted texts.

Copies, refusals and languages are told by rules over words, in one Arrow UDF. Refusals are known by wording, or by an answer
that denies something, comes again for several questions and names nothing that questions ask about. Languages are told by function words and, where
these don't tell, by letter trigrams learned from questions and answers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.durable import cut

# Wording of refusals, in the languages of the corpus (fixed values).
REFUSALS = (
    r"\bi (?:do not|don't|cannot|can't) (?:know|tell|say)\b",
    r"\b(?:i|we) (?:would|'d) rather not\b",
    r"\b(?:i|we) (?:must|have to|will have to|will) (?:decline|refuse)\b",
    r"\b(?:i am|i'm|we are|assistant) .{0,20}(?:unable|not able|not allowed) to\b",
    r"\b(?:cannot|can not|can't|could not|couldn't) be answered\b",
    r"\bi (?:cannot|can't|can not|could not|couldn't) (?:answer|help|provide|assist|comment|discuss|share|give)\b",
    r"\bnot possible for me\b",
    r"\b(?:my|the) (?:instructions|guidelines|rules) (?:do not|don't) (?:allow|permit)\b",
    r"\bno (?:answer|information|mention)\b.{0,24}\b(?:could|can|was|is|were) (?:be )?(?:found|given|available)",
    r"\bnot enough (?:information|context|detail|evidence)\b",
    r"\bnot covered (?:here|in|by)\b",
    r"\bconsult (?:another|a different|other) (?:source|book)",
    r"\b(?:book|text|source|document|context|chapter)s? (?:is|are) silent\b",
    r"\bnothing relevant\b",
    r"\b(?:pages?|book|text|passages?|context|documents?|chapter|source)\b.{0,30}\b(?:do not|does not|don't|doesn't|never|did not) (?:contain|mention|cover|say|state|include|answer)",
    r"\bnot (?:stated|mentioned|covered|found|available) in (?:the|this|your)\b",
    r"\b(?:kann|können|darf) .{0,40}\bnicht (?:beantworten|sagen|helfen)",
    r"\b(?:steht|findet|sagt|enthält)\b.{0,40}\bnichts\b",
    r"\b(?:weiß (?:ich )?(?:es )?nicht|tut mir leid)\b",
    r"\bne (?:peux|puis|pouvons|sais|savons) (?:pas|rien)\b.{0,30}(?:répondre|aider|dire|$|[.])",
    r"\b(?:ne dit rien|désolée?s?,|ne (?:contient|mentionne|traite) (?:pas|rien|aucun))",
    r"\bno (?:puedo|podemos|sé|sabemos)\b.{0,20}(?:responder|contestar|ayudar|decir|$|[.])",
    r"\b(?:lo siento,|no dice nada|no (?:menciona|contiene|aparece) (?:nada|ningun))",
    r"(?:उत्तर|जवाब|मदद) नहीं (?:दे|कर) सक",
    r"क्षमा करें,|कुछ नहीं (?:लिखा|बताया|कहा|दिया|मिला|है)|(?:मुझे|मैं) (?:नहीं )?(?:पता|जानता) नहीं|जानकारी नहीं",
)
# Stand-ins for an answer (fixed values).
PLACEHOLDERS = ("na", "n a", "null", "none", "nil", "nan", "a", "answer", "ans", "the answer is", "undefined", "tbd", "todo", "empty", "no answer", "response", "output")
# What may stand before a repeated question (fixed values).
_LEADS = r"^(?:(?:the |your |this |my )?question(?: (?:is|was|reads|asked|asks))?|you (?:asked|ask|want to know)|q|asked|frage|die frage(?: lautet| ist)?|la question(?: est)?|la pregunta(?: es)?|pregunta|प्रश्न(?: है)?)\b[\s:–—-]*"
# Words that stand in the wording of refusals, without their apostrophes (fixed values).
_DENIALS = frozenset("not cannot t no never nothing silent unable consult decline refuse rather nicht nichts leid pas rien désolé désolée désolés no nada siento puedo podemos sé नहीं कुछ क्षमा".split())
# Function words that tell a language from the others (fixed values).
LANGUAGES = {
    "en": "the of and to is that it with from this which when how what why who where are was were be been by for not but into does do did on at as if there their has have had would can only so than then after before because near under over between through some each every other both while until without".split(),
    "de": "der das und ist nicht ein eine einen einem einer den dem mit sich auf für von zu im auch aus nach wird nur wenn dass daß wie was wozu warum weshalb wodurch wer wo welche welcher werden wurde deshalb man weil obwohl zum zur beim bei neben durch ohne gegen etwa unter".split(),
    "fr": "le les et est dans pour pas sur au aux du ce cette ces qui une on il elle ils avec par plus quand comment pourquoi quoi où ne sont ainsi aussi même si après moins c'est d'un d'une qu'on lorsque à".split(),
    "es": "el los las y por con para al lo como más cuando cómo qué quién dónde del este esta estos son se poco modo también después aunque una unos unas hay donde porque no".split(),
}
_OPEN = r"(?:\([^()]*|\[[^\[\]]*|“[^“”]*|„[^„“”]*|«[^«»]*)$"
_STOPPED = r"""[.!?।][\s"'”’)\]»]*$"""
_SPLIT = r"""(?<=[.!?।])["'”’)\]»]*\s+"""
#: Most words of an answer that is a mere phrase, and texts of a partition of the order, which is looked through as one.
PHRASE, TEXTS = 3, 500_000
#: Questions for which an answer comes again that is a refusal by recurrence, and least words of it.
RECURS, RECURRING_WORDS = 5, 4
#: Least trigrams of a language, and of a text that they tell, and by how much a trigram must on average be likelier than in the next language.
LEARNED, TOLD, LEAD = 1_000, 12, 0.3


def _plain(text: Column) -> Column:
    """Lower case words of letters, digits and marks between single blanks."""
    bare = F.regexp_replace(text, r"<[^<>]{0,60}>", " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{M}\p{N}]+", " "))


def _words(plain: Column) -> Column:
    return F.filter(F.split(plain, " "), lambda w: w != "")


# Scripts that tell a language, by their ranges of characters (fixed values).
_SCRIPTS = tuple((re.compile(f"[{span}]"), name) for span, name in (("\u0900-\u097f", "hi"), ("\u0400-\u04ff", "cyrillic"), ("\u0600-\u06ff", "arabic"), ("\u3400-\u9fff", "han"), ("\u3040-\u309f", "ja"), ("\u0370-\u03ff", "greek")))
# Letters and digits, with the marks that belong to the letters of some scripts; underscores are taken out before.
_WORD = re.compile(r"[\w\u0300-\u036f\u0900-\u0dff\u0e00-\u0eff\u1000-\u109f\u200c\u200d]+")
_QUOTED = re.compile(r"[\w'\-\u0300-\u036f]+")
_OWN = {name: frozenset(own) for name, own in LANGUAGES.items()}


def _grams(text: str) -> list[str]:
    line = f" {' '.join(w for w in _WORD.findall(text.lower()) if not w.isdigit())} "
    return [line[i : i + 3] for i in range(len(line) - 2)]


class Languages:
    """Tells the language of a text by script, by function words and by letter trigrams."""

    def __init__(self, counts: dict[str, dict[str, int]] | None = None) -> None:
        known = {name: own for name, own in (counts or {}).items() if sum(own.values()) >= LEARNED}
        self.costs = {name: {g: math.log(n / total) for g, n in own.items()} for name, own in known.items() for total in [sum(own.values())]}

    def by_words(self, text: str) -> tuple[str | None, int]:
        """The language of most function words and its lead; None where two are level or less than two words tell."""
        said = set(_QUOTED.findall(text.lower().replace("’", "'")))
        told = sorted(((len(said & own), name) for name, own in _OWN.items()), reverse=True)
        lead = told[0][0] - told[1][0]
        return (told[0][1], lead) if told[0][0] >= 2 and lead > 0 else (None, 0)

    def tell(self, text: str) -> str | None:
        if not text.isascii():
            letters = sum(map(str.isalpha, text))
            for script, name in _SCRIPTS:
                if letters > 3 and len(script.findall(text)) * 2 > letters:
                    return name
        name, lead = self.by_words(text)
        if lead >= 2 or len(self.costs) < 2 or (name and name not in self.costs):
            return name
        grams = _grams(text)
        if len(grams) < TOLD:
            return name
        told = sorted(((sum(own.get(g, -12.0) for g in grams), n) for n, own in self.costs.items()), reverse=True)
        return told[0][1] if told[0][0] - told[1][0] >= LEAD * len(grams) else name


def learned(texts: DataFrame) -> dict[str, dict[str, int]]:
    """Letter trigrams of the languages of all texts (column text) whose function words tell them."""
    given = texts.where("text is not null").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        only_words = Languages()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                name, lead = only_words.by_words(text)
                if lead >= 2:
                    counts.update((name, g) for g in _grams(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["name", "gram", "n"])

    rows = given.mapInArrow(run, "name string, gram string, n bigint").groupBy("name", "gram").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, dict[str, int]] = {}
    for name, gram, n in zip(*(rows[c].to_pylist() for c in ("name", "gram", "n")), strict=True):
        out.setdefault(name, {})[gram] = n
    return out


class Rules:
    """The rules over words; it keeps what it knows of repeated questions."""

    def __init__(self, languages: Languages) -> None:
        self.languages = languages
        self.refusal, self.tag, self.lead, self.gap = re.compile("|".join(REFUSALS), re.IGNORECASE), re.compile(r"<[^<>]{0,60}>"), re.compile(_LEADS), re.compile(_SPLIT)
        self.asked: dict[str, tuple[frozenset[str], str | None]] = {}

    def words(self, text: str) -> list[str]:
        if "<" in text:
            text = self.tag.sub(" ", text)
        return _WORD.findall(text.replace("_", " ").lower())

    def question(self, text: str) -> tuple[frozenset[str], str | None]:
        if text not in self.asked:
            if len(self.asked) > 50_000:
                self.asked.clear()
            self.asked[text] = frozenset(self.words(text)), self.languages.tell(text)
        return self.asked[text]

    def tell(self, answer: str | None, question: str | None, answerable: bool, recurring: bool) -> str | None:
        """empty, refusal, copies_question or other_language; none for a right refusal, None where no rule applies."""
        words = self.words(answer or "")
        if not words or " ".join(words) in PLACEHOLDERS:
            return "empty"
        own = set(words)
        asked, theirs = self.question(question) if question is not None else (frozenset(), None)
        said = None
        if own & _DENIALS:
            said = [s for s in self.gap.split(answer) if s]
            refused = [bool(self.refusal.search(s.replace("’", "'"))) for s in said]
            if any(refused) and sum(len(self.words(s)) for s, r in zip(said, refused, strict=True) if not r) <= 4:
                return "refusal" if answerable else "none"
            if recurring and len(words) >= RECURRING_WORDS:
                return "refusal" if answerable else "none"
        if question is None:
            return None
        if asked and len(own & asked) * 10 >= len(asked) * 7:
            bare = frozenset(self.lead.sub("", " ".join(words)).split())
            if bare and bare <= asked and len(bare) * 10 >= len(asked) * 7:
                return "copies_question"
        if theirs:
            name, lead = self.languages.by_words(answer)
            if name == theirs and lead >= 4:
                said = said or [s for s in self.gap.split(answer) if s]
                if len(said) == 1:
                    return None
            told = [(self.languages.tell(s), len(s)) for s in said or self.gap.split(answer) if s]
            if sum(n for x, n in told if x and x != theirs) > sum(n for x, n in told if x == theirs):
                return "other_language"
        return None


def _rules(languages):
    kept: list[Rules] = []

    @F.pandas_udf(StringType())
    def rule(answer: pd.Series, question: pd.Series, answerable: pd.Series, recurring: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Rules(Languages(languages.value)))
        whole = lambda x: None if x is None or x != x else x
        return pd.Series([kept[0].tell(whole(a), whole(q), bool(whole(k)), bool(r)) for a, q, k, r in zip(answer, question, answerable, recurring, strict=True)], dtype=object)

    return rule


def _tail(text: Column) -> Column:
    """What stands behind the last ended sentence."""
    return F.element_at(F.split(F.trim(text), _SPLIT), -1)


def _gram_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, word, ended, within``: how often two words in a row, the second one of ``wanted`` (column word), end a sentence of the texts
    and how often they don't."""
    sentence = texts.select(F.explode(F.filter(F.split(F.lower("text"), _SPLIT), lambda s: s.rlike(_STOPPED))).alias("s"))
    words = sentence.select(F.filter(F.split(F.regexp_replace("s", _STOPPED, ""), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 1)
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)).alias("gram"), F.get("w", i).alias("word"), (i == F.size("w") - 1).alias("end")))).alias("g"))
    return grams.select("g.*").join(wanted, "word", "left_semi").groupBy("gram", "word").agg(F.count_if("end").alias("ended"), F.count_if(~F.col("end")).alias("within"))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted texts those that the next one begins with, and what it has beyond them; the first and the last text with ``edge``."""
    names, first, last = ["text", "rest", "edge", "mine"], None, None
    for batch in batches:
        out = []
        for text, mine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last and last[1] and text.startswith(last[0]):
                out.append((last[0], text[len(last[0]) :], None, True))
            last = text, mine
            first = first or last
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], names)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([first[0], last[0]]), pa.nulls(2, pa.string()), pa.array(["first", "last"]), pa.array([first[1], last[1]])], names)


def _continued(texts: DataFrame) -> DataFrame:
    """``text, rest``: what the next text in order has beyond this one, where it begins with it. Equal texts are one row.

    The order is kept in range partitions; the first and the last text of each meet on the driver.
    """
    parts = max(1, math.ceil(texts.count() / TEXTS))
    placed = texts.select("text", "mine").repartitionByRange(parts, "text").sortWithinPartitions("text")
    looked, _ = cut(placed.mapInArrow(_follow, "text string, rest string, edge string, mine boolean").withColumn("p", F.spark_partition_id()), "order")
    found = looked.where("edge is null").select("text", "rest")
    if parts == 1:
        return found
    edges: dict[int, dict[str, tuple[str, bool]]] = {}
    for p, edge, text, mine in looked.where("edge is not null").select("p", "edge", "text", "mine").collect():  # two rows a partition
        edges.setdefault(p, {})[edge] = text, mine
    order = [edges[p] for p in sorted(edges)]
    over = [(a["last"][0], b["first"][0][len(a["last"][0]) :]) for a, b in zip(order, order[1:]) if a["last"][1] and b["first"][0].startswith(a["last"][0])]
    return found.union(texts.sparkSession.createDataFrame(over, "text string, rest string"))


def _limits(open_texts: DataFrame) -> DataFrame:
    """Lengths at which far more answers stop without an end than at the lengths around."""
    counts = open_texts.groupBy(F.length("text").alias("n")).count().where("n >= 40")
    around = counts.select(F.explode(F.sequence(F.col("n") - 8, F.col("n") + 8)).alias("n"), F.col("n").alias("m"), F.col("count").alias("c"))
    near = around.where("n <> m").groupBy("n").agg((F.sum("c") / 16).alias("usual"))
    return counts.join(near, "n", "left").where("count >= 8 and count > 6 * coalesce(usual, 0)").select("n")


def truncated(answers: DataFrame, references: DataFrame) -> DataFrame:
    """``text`` of every distinct answer (column text) that breaks off before its last sentence or list is complete.

    ``references`` (column text) are further complete texts. A missing full stop alone and short phrases are no defect.
    """
    mine = answers.select(F.trim("text").alias("text"), F.lit(True).alias("mine"))
    both = mine.unionByName(references.select(F.trim("text").alias("text"), F.lit(False).alias("mine"))).where("text <> ''").groupBy("text").agg(F.max("mine").alias("mine"))
    text = F.col("text")
    bare = F.lower(F.regexp_replace(_tail(text), r"[\s\"'”’)\]»]+$", ""))
    count = F.size(_words(_plain(text)))
    number = text.rlike(r"(?iu)^(?:(?:about|around|some|etwa|environ|unos|लगभग) )?[\d.,]+ ?[\p{L}\p{M}°%³²/]*(?: \p{L}{4,}s)?$")
    cut_mark = text.rlike(r"(?:…|\.\.\.)$") | text.rlike(r"[,;:(\[{“„«–—-]$") | text.rlike(_OPEN) | text.rlike(r"(?:^|[\s(])(?:\([a-z]\)|\d{1,2}[.)]|[-•*])$")
    words = F.split(bare, r"\s+")
    gram = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ")
    state = F.when(cut_mark, "cut").when(text.rlike(_STOPPED), "stopped").when(number, "number").when((count <= PHRASE) & (F.size(F.split(text, _SPLIT)) == 1), "phrase").otherwise("open")
    both, _ = cut(both.select("text", "mine", F.when(F.col("mine"), state).alias("state")), "answers")
    open_end, _ = cut(both.where("state in ('phrase', 'open')").select("text", "state", gram.alias("gram"), F.element_at(words, -1).alias("word"), F.length("text").alias("n")), "open")
    counts, _ = cut(_gram_counts(both, open_end.select("word").distinct()), "grams")
    by_gram = counts.groupBy("gram").agg(F.sum("ended").alias("ended"), F.sum("within").alias("within"))
    by_word = counts.groupBy("word").agg(F.sum("ended").alias("word_ended"), F.sum("within").alias("word_within"))
    limits = _limits(open_end.where("state = 'open'").select("text")).withColumn("limit", F.lit(True))
    known = open_end.join(by_gram, "gram", "left").join(by_word, "word", "left").join(_continued(both), "text", "left").join(limits, "n", "left")
    only_marks = ~F.col("rest").rlike(r"[\p{L}\p{N}]")
    goes_on = F.col("rest").rlike(r"^[\p{L}\p{M}\p{N}]")
    whole = (
        F.when(F.col("state") == "phrase", ~F.coalesce(goes_on & F.col("word_within").isNull(), F.lit(False)))  # cut within a word that nobody says
        .when(only_marks, True)
        .when(goes_on, False)
        .when(F.col("rest").rlike(r"^\s*[.!?।]"), True)
        .when(F.col("rest").isNotNull(), False)
        .when(F.col("limit"), (F.coalesce("ended", F.lit(0)) >= 3) & (F.col("within") == 0))
        .when(F.col("ended") + F.col("within") > 0, F.col("ended") > F.col("within"))
        .when(F.col("word_ended") + F.col("word_within") > 0, F.col("word_ended") > F.col("word_within"))
        .otherwise(False)
    )
    return both.where("state = 'cut'").select("text").union(known.where(~whole).select("text"))


def _recurring(rows: DataFrame, golden: DataFrame) -> DataFrame:
    """``answer`` of those that come again for several questions and name nothing that any question asks about."""
    again = rows.where("answer is not null").groupBy("answer").agg(F.count_distinct("question_id").alias("questions")).where(F.col("questions") >= RECURS).select("answer")
    said = [w for own in LANGUAGES.values() for w in own] + sorted(_DENIALS)
    words = lambda c: F.explode(F.array_distinct(F.filter(_words(_plain(F.col(c))), lambda w: (F.length(w) > 3) & ~w.isin(said)))).alias("word")
    topics = golden.select(words("question")).distinct()
    named = again.select("answer", words("answer")).join(topics, "word", "left_semi").select("answer")
    return again.join(named, "answer", "left_anti")


def judged(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """``answer_id, defect`` with null for sound answers, one row for each distinct answer_id, answer and question.

    Defects are told in this order: empty, refusal, copies_question, other_language, truncated. A refusal of a question that isn't
    answerable is sound. Without a question of that id only empty and truncated can be told; null ids are left out.
    """
    rows = answers.where("answer_id is not null").select("answer_id", "question_id", "answer", "extractive_answer").distinct()
    asked = golden.where("id is not null").groupBy(F.col("id").alias("question_id")).agg(F.max("question").alias("question"), F.max("answerable").alias("answerable"))
    pairs = rows.join(asked, "question_id", "left")
    pairs = pairs.join(_recurring(rows, golden).withColumn("recurring", F.lit(True)), "answer", "left")
    answer = F.col("answer")
    rule = _rules(answers.sparkSession.sparkContext.broadcast(learned(golden.select(F.col("question").alias("text")).union(rows.select("answer")))))  # trigrams of the letters of a few languages
    told, _ = cut(pairs.select("answer_id", F.trim(answer).alias("text"), rule(answer, F.col("question"), F.col("answerable"), F.coalesce("recurring", F.lit(False))).alias("rule")), "rules")
    undecided = told.where("rule is null").select("text")
    broken = truncated(undecided, rows.where("extractive_answer is not null").select(F.col("extractive_answer").alias("text"))).withColumn("broken", F.lit(True))
    out = told.join(broken, "text", "left")
    return out.select("answer_id", F.coalesce(F.nullif("rule", F.lit("none")), F.when(F.col("broken") & F.col("rule").isNull(), "truncated")).alias("defect"))


def found(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """``(answer_id, defect)`` of every defective answer, each answer_id once."""
    return judged(answers, golden).where("defect is not null").groupBy("answer_id").agg(F.min("defect").alias("defect"))
