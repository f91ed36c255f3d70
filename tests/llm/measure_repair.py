"""Measures the repair of scanned pages: noise is planted in clean pages, repaired, and told as character error rates.

python tests/llm/measure_repair.py [directory of tables]
"""

import random
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafmill.llm.scans import CONFUSIONS, repaired, scanned


def distance(a: str, b: str) -> int:
    """Edit distance by Myers' bit vectors."""
    if not a or not b:
        return len(a) or len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp, hm = minus | (full & ~(d | plus)), plus & d
        score += bool(hp & last) - bool(hm & last)
        hp, hm = (hp << 1 | 1) & full, (hm << 1) & full
        plus, minus = hm | (full & ~(d | hp)), hp & d
    return score


def planted(text: str, page: int, book: str, rng: random.Random) -> str:
    """A clean text as a scan may give it: misread characters in one of 25 words, words cut at line ends, a head and a page number."""
    words = []
    for w in " ".join(text.split()).split(" "):
        fits = [(a, b) for a, b in CONFUSIONS if b in w]
        if fits and rng.random() < 0.04:
            a, b = rng.choice(fits)
            w = w.replace(b, a, 1)
        words.append(w)
    lines, line = [], ""
    for w in words:
        if line and len(line) + len(w) > 58:
            at = len(w) // 2
            if len(w) > 6 and w.isalpha() and rng.random() < 0.5:
                lines.append(f"{line} {w[:at]}-")
                line = w[at:]
                continue
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([f"Reader Of {book.title()}", *lines, line, str(page)])


def main() -> None:
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    pages = spark.read.parquet(f"{directory}/book_pages.parquet").select("page_id", "book_id", "page_number", "page_type", "raw_text", "text")
    clean = pages.where(~F.coalesce(scanned("page_type"), F.lit(False)) & F.coalesce("raw_text", "text").isNotNull()).dropDuplicates(["page_id"]).collect()
    rng = random.Random(5)
    held, truth, rows = [], {}, []
    for r in sorted(clean, key=lambda r: r.page_id):
        text = " ".join((r.raw_text or r.text).split())
        if rng.random() < 0.3 and len(text) > 100:
            truth[r.page_id] = text
            rows.append((r.page_id, r.book_id, r.page_number, "scanned", planted(text, r.page_number, r.book_id, rng), None))
        else:
            held.append(r)
    noisy = {r[0]: r[4] for r in rows}
    both = spark.createDataFrame(rows, pages.schema).union(spark.createDataFrame(held, pages.schema))
    got = {r.page_id: r.repaired for r in repaired(both).collect()}
    total = sum(map(len, truth.values()))
    flat = {k: " ".join(v.split()) for k, v in noisy.items()}
    before, after = (sum(distance(truth[k], " ".join(x[k].split())) for k in truth) for x in (flat, got))
    print(f"pages {len(truth)}, characters {total}, character error rate before {before / total:.4f}, after {after / total:.4f}, pages repaired wholly {sum(' '.join(got[k].split()) == truth[k] for k in truth)}")


if __name__ == "__main__":
    main()
