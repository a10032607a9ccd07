"""Quality rules, line first: each line is judged, failed lines go, and a document that loses too much text is rejected.

Rules for a line: `symbols` (marks such as # or * on many words), `shouting` (most words in capitals), `navigation`
(entries parted by bars or arrows, or a short entry without a mark at its end that is not the only line), `stutter` (words
equal to the one before), `boilerplate` (notices of rights, cookies and scripts), `repeated` (seen before in this
document). Document counts come from the whole text, whatever its lines.

Defined cases: a null or empty text has no words, all counts 0, and fails; a text of one very long line is one line; rows
that repeat a doc_id give a row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "all rights reserved", "copyright", "cookie policy", "accept cookies", "uses cookies", "privacy policy", "terms of use",
        "terms of service", "enable javascript", "javascript is disabled",
    "licensed under", "released under", "subscribe to our newsletter", "sign up for our newsletter", "click here", "skip to content",
        "back to top", "lorem ipsum", "share on facebook", "follow us on",
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document is rejected if failed lines hold more than this share of its characters in words.
MAX_LOST = 0.5

_ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MARKED = re.compile(r"(?:^|\s)\S*[#*$%&]{2,}\S*")
_BARS = frozenset(("|", "»", "«", ">", "›", "::", "·", "•", "/"))
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_END = re.compile(r"[.!?…:;,)\"'»”]\s*$")


def words_of(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+; str.split() also parts at other spaces, so it serves only where there are none."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def repeat_words(words: list[str]) -> int:
    """Words inside windows of three that occur twice or more in the text."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    total, upto = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def failed_rule(line: str, words: list[str], only: bool, again: bool) -> str | None:
    """The first rule that the line fails. words: its words, at least one."""
    n = len(words)
    if again:
        return "repeated"
    if _SYMBOL.search(line):
        if sum(w in _BARS for w in words) * 5 >= n and n > 2:
            return "navigation"
        if len(_MARKED.findall(line)) * 3 >= n:
            return "symbols"
    if n >= 5:
        if sum(w.isupper() and len(w) > 1 for w in words) * 10 >= 6 * n:
            return "shouting"
        if sum(a == b for a, b in zip(words, words[1:], strict=False)) * 3 >= n:
            return "stutter"
    elif not only and not _END.search(line):
        return "navigation"
    return "boilerplate" if n <= 30 and _BOILER.search(line) else None


def judge(text: str) -> dict:
    """Counts of the whole text, kept lines' text, and the verdict."""
    words: list[str] = []  # a line end parts words, so the lines' words are the text's
    lines = text.split("\n")
    seen: set[str] = set()
    dup = lost = 0
    rules: Counter = Counter()
    kept = []
    filled = sum(1 for x in lines if x and not x.isspace()) if len(lines) > 1 else 1
    for line in lines:
        own = words_of(line)
        words += own
        if not own:
            kept.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if rule := failed_rule(line, own, filled == 1, again):
            rules[rule] += 1
            lost += sum(map(len, own))
        else:
            kept.append(line)
    chars, repeats = sum(map(len, words)), repeat_words(words)
    bad = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": dup, "n_repeat_words": repeats, "base_failed": bad,
        "kept": not bad and lost <= MAX_LOST * chars, "lost_chars": lost, "failed_lines": sum(rules.values()),
            "rules": ",".join(f"{k}:{v}" for k, v in sorted(rules.items())), "cleaned": "\n".join(kept),
    }


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, failed_lines long, rules string"


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """One row per row of docs with the counts and the verdict; with `cleaned`, also the text without failed lines."""
    schema = _SCHEMA + ", cleaned string" * cleaned
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), *(pa.array([r[k] for r in rows],
                {int: pa.int64(), bool: pa.bool_(), str: pa.string()}[type(rows[0][k])] if rows else pa.null()) for k in names[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
