"""Texts for readers and for answer generators: labels, counts, file names, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a generator says where the passages don't hold the answer (fixed value).
NOT_IN_BOOK = "NOT_IN_BOOK"


def shorten(text: Column, limit: int = 180) -> Column:
    """White space collapsed; of a longer text the first ``limit - 1`` characters and a sign that it goes on."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 1), F.lit("…"))).otherwise(clean)


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """``1 page``, ``2 pages``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or f"{one}s"))


def page_label(page: Column) -> Column:
    """At least two digits."""
    text = page.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def percent(share: Column) -> Column:
    """A share as whole per cent within 0 and 100; halves are rounded up."""
    return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5).cast("int")


def figure_label(label: Column, figure_id: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("Figure "), figure_id))


def figure_alt(label: Column, caption: Column, page: Column) -> Column:
    """What stands for a figure's image: its label, or its page, and its caption."""
    name = F.coalesce(F.nullif(F.trim(label), F.lit("")), F.concat(F.lit("Figure on page "), page.cast("string")))
    return F.when(F.coalesce(caption, F.lit("")) != "", F.concat(name, F.lit(": "), caption)).otherwise(name)


def figure_key(page: Column, ordinal: Column) -> Column:
    """A figure's key by its place, which no file name can change; ordinals count from 1."""
    return F.format_string("p%d-%d", page, ordinal)


def document_folder(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_-]+", "_"), 1, 80)


def figure_file(page: Column, ordinal: Column) -> Column:
    return F.format_string("p%d_fig%d.png", page, ordinal)


def excerpts(evidence: Column) -> Column:
    """Passages (an array of page_number, section, text) as a generator reads them."""
    def one(x: Column) -> Column:
        section = F.when(F.coalesce(x["section"], F.lit("")) != "", F.concat(F.lit(" | "), x["section"])).otherwise("")
        return F.concat(F.lit("[page "), x["page_number"].cast("string"), section, F.lit("]\n"), x["text"])

    return F.array_join(F.transform(evidence, one), "\n\n")


def prompt(question: Column, title: Column, evidence: Column) -> Column:
    """What a generator is asked: to answer from the passages only, or to say that they don't hold the answer."""
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("the uploaded document"))
    rules = F.concat(F.lit("Answer from these excerpts of "), name, F.lit(f" only. If they don't hold the answer, reply {NOT_IN_BOOK}.\n\n"))
    return F.concat(rules, excerpts(evidence), F.lit("\n\nQuestion: "), F.trim(question))


def in_scope(reply: Column) -> Column:
    return ~F.contains(F.upper(reply), F.lit(NOT_IN_BOOK))


def rate_key(credential: Column, address: Column) -> Column:
    """By whom requests are counted: a hash of the credential, else the address."""
    held = F.nullif(credential, F.lit(""))
    return F.when(held.isNotNull(), F.concat(F.lit("cred:"), F.substring(F.sha2(held, 256), 1, 16))).otherwise(F.concat(F.lit("ip:"), F.coalesce(address, F.lit("unknown"))))


def stamp(time: Column) -> Column:
    """A time as the name of a run's folder."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def bar(done: Column, total: Column, width: int = 30) -> Column:
    """Progress as a bar, a count and whole per cent."""
    share = F.when(total > 0, done / total).otherwise(0.0)
    full = F.round(share * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full), F.format_string(" %d/%d (%d%%)", done, total, F.round(share * 100).cast("int")))
