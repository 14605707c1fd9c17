"""JVM-side text functions.

Everything here is a built-in Spark expression so it stays inside
whole-stage codegen.
"""

from __future__ import annotations

import ast
import sys

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _python_whitespace_class() -> str:
    """Regex class of the characters Python's ``str.split()`` splits on.

    Built from the rule ``str.isspace`` so JVM tokens equal Python tokens
    (Java's ``\\s`` misses e.g. the no-break space).
    """
    points = [i for i in range(sys.maxunicode + 1) if chr(i).isspace()]
    # Consecutive code points become ranges: a short class matches faster.
    ranges, start = [], points[0]
    for prev, cur in zip(points, points[1:] + [None]):
        if cur != prev + 1:
            ranges.append((start, prev))
            start = cur
    return "[" + "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}"
                         for a, b in ranges) + "]"


PY_WS = _python_whitespace_class()


def py_tokens(text: Column) -> Column:
    """Whitespace tokens exactly as ``str.split()`` (F1)."""
    return F.filter(F.split(text, PY_WS + "+"), lambda t: F.length(t) > 0)


def fingerprint(text: Column) -> Column:
    """SHA-256 of a text, as 32 bytes.

    Used to group exact copies without moving the text through a shuffle: no
    two different texts are known to share one.
    """
    return F.unhex(F.sha2(text.cast("binary"), 256))


# TF-IDF tokens are lower-cased runs of two or more word
# characters (letters, digits, underscore).
TFIDF_TOKEN_PATTERN = "[\\p{L}\\p{N}_]{2,}"


def tfidf_tokens(text: Column) -> Column:
    """lower-case word runs of length >= 2."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TFIDF_TOKEN_PATTERN})"), F.lit(1))


# English stop words of the option `words`.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can did do does doing down during each few for from further had has have having "
    "he her here hers herself him himself his how i if in into is it its itself just me more most my myself "
    "no nor not now of off on once only or other our ours ourselves out over own same she should so some such "
    "than that the their theirs them themselves then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with you your yours yourself yourselves"
    .split())


def words_only(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """F10, option ``words``: lower case, whitespace tokens without the
    punctuation around them that are letters only, stop words out, repeats and
    order kept, joined by spaces (null stays null)."""
    bare = F.transform(F.split(F.lower(text), PY_WS + "+"), lambda t: F.regexp_replace(
        t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.array_join(F.filter(bare, lambda t: t.rlike(r"^\p{L}+$") & ~F.array_contains(stops, t)), " ")


def iso_cleanup(iso: Column) -> Column:
    """F8: cut at the first '.', then every 'T' becomes a space."""
    return F.replace(F.split_part(iso, F.lit("."), F.lit(1)), F.lit("T"), F.lit(" "))


def base_name(path: Column) -> Column:
    """last path segment."""
    return F.substring_index(path, "/", -1)


def join_path(folder: Column | str, name: Column) -> Column:
    """folder + '/' + name."""
    folder_col = F.lit(folder) if isinstance(folder, str) else folder
    return F.concat(folder_col, F.lit("/"), name)


def simple_list_literal(lit_col: Column) -> Column:
    """True when a list literal has no double quote and no backslash: its
    strings are then single-quoted without escapes, and swapping the quotes
    gives the same list as JSON."""
    return ~lit_col.contains('"') & ~lit_col.contains("\\")


def parse_list_literal(lit_col: Column) -> Column:
    """F7 (JVM path): a simple Python list literal ("['a', 'b']") as array<string>."""
    return F.from_json(F.translate(lit_col, "'", '"'), "array<string>")


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_eval_list(s: pd.Series) -> pd.Series:
    """F7 (general path): any Python list literal of strings; null for anything else."""
    def one(x):
        try:
            v = ast.literal_eval(x)
            return [None if i is None else str(i) for i in v] if isinstance(v, (list, tuple)) else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
    return s.map(one)
