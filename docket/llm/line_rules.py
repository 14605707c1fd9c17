"""Line-first cleaning of documents.

Every line of a text is judged on its own by three rules; lines that fail are
removed; a document that loses too large a share of its words is rejected.  A
line without a word is kept as it is.  The rules (counts are of characters):

* punctuation -- more than 1 of 10 non-space characters is ``!`` or ``?``, or
  more than 1 of 10 is one of ``# * $ % & < >``;
* navigation -- three or more item separators (``|``, ``»``, ``•``), or at
  least as many of them as half the words;
* boilerplate -- a known site phrase in a line of at most 40 words.

Beside the verdict each document gets base statistics over its whole text.
Null and empty texts have no words and fail the base rule.  Ties do not
occur; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import series_udf

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, n_lines long, n_bad_lines long, "
          "lost_words long, kept boolean, cleaned string")

#: The six space characters, symbols and marks that are counted.
SPACES = "\x20\x09\x0A\x0B\x0C\x0D"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
LINE_SYMBOLS = "#*$%&<>"
SEPARATORS = "|»•"
#: Phrases of site furniture, matched without case (A-Z).
PHRASES = (
    "accept all cookies", "we use cookies", "cookie policy", "privacy policy",
    "terms of service", "terms of use", "all rights reserved", "enable javascript",
    "click here", "read more", "sign up", "log in", "subscribe to our newsletter",
    "share this", "back to top", "skip to content", "follow us on", "lorem ipsum",
)
MAX_PHRASE_WORDS = 40
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30

PHRASE_PATTERN = re.compile("|".join(re.escape(p) for p in PHRASES))


def _count(text: str, chars: str) -> int:
    return sum(text.count(c) for c in chars)


def _lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def line_fails(line: str, words: int) -> bool:
    """True if a line of ``words`` (1 or more) words breaks a rule."""
    solid = len(line) - _count(line, SPACES)
    if 10 * _count(line, MARKS) > solid or 10 * _count(line, LINE_SYMBOLS) > solid:
        return True
    items = _count(line, SEPARATORS)
    if items >= 3 or 2 * items >= words:
        return True
    return words <= MAX_PHRASE_WORDS and PHRASE_PATTERN.search(_lower_ascii(line)) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # keep the three-word key within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(number) + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    cover = np.zeros(len(words), bool)
    for j in range(3):
        cover[j:j + n] |= hit
    return int(cover.sum())


def judge(text: str | None) -> tuple:
    """One row of ``RESULT`` for one text."""
    text = text if isinstance(text, str) else ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    repeat = repeated_words(words)
    kept_lines, seen, dup, bad, lost, lines = [], set(), 0, 0, 0, 0
    for line in text.split("\n"):
        k = len(line.encode("utf-8", "surrogatepass").split())
        if k:
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fails(line, k):
                bad += 1
                lost += k
                continue
        kept_lines.append(line)
    base = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return (n, len(text) - _count(text, SPACES), _count(text, SYMBOLS), dup, repeat, base,
            lines, bad, lost, not base and 100 * lost <= MAX_LOST_PERCENT * n,
            "\n".join(kept_lines) if bad else text)


def _judged(texts: pd.Series, columns: list[str], at: list[int]) -> pd.DataFrame:
    return pd.DataFrame([tuple(r[i] for i in at) for r in map(judge, texts)], columns=columns)


def line_rules_udf(with_text: bool = True):
    """Column function: struct ``RESULT`` of a text (without ``cleaned`` if
    the cleaned text is not wanted)."""
    fields = [f.strip() for f in RESULT.split(",")]
    fields = fields if with_text else fields[:-1]
    columns, at = [f.split()[0] for f in fields], list(range(len(fields)))

    def run(batches):
        for texts in batches:
            yield _judged(texts, columns, at)
    return series_udf(run, ", ".join(fields))


def line_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    with_text: bool = True) -> DataFrame:
    """One row per document row: its id, statistics, verdict and cleaned text."""
    return docs.select(F.col(doc_id).alias("doc_id"),
                       line_rules_udf(with_text)(F.col(text)).alias("r")).select("doc_id", "r.*")


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` without rejected documents, failed lines removed from the text
    (and ``n_chars``, if there is such a column, counted anew)."""
    out = docs.withColumn("__rules", line_rules_udf()(F.col(text))).where("__rules.kept")
    changed = F.col("__rules.n_bad_lines") > 0
    out = out.withColumn(text, F.when(changed, F.col("__rules.cleaned")).otherwise(F.col(text)))
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(changed, F.length(text).cast(
            docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)
