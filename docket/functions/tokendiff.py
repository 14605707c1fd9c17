"""Token-level difference of two notices.

Texts are split on Unicode whitespace (Python ``str.split``).  The diff is
the stdlib ``difflib`` alignment of the two token lists; from it we keep the
number of deleted + inserted tokens, the index of the first deleted token in
the left list, the index of the first inserted token in the right list,
whether both exist ("two-sided") and whether the marker token sits in the
few tokens just before both first differences.

Only this per-pair helper runs in Python; it is called through Arrow-batched
pandas UDFs on the pairs Spark builds and shuffles.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFF_SCHEMA = T.StructType([
    T.StructField("n_diff", T.IntegerType()),
    T.StructField("first_del", T.IntegerType()),
    T.StructField("first_ins", T.IntegerType()),
    T.StructField("two_sided", T.BooleanType()),
    T.StructField("marker", T.BooleanType()),
])

CUTOFF = 0.75          # Differ's: words at least this alike are a changed word
BUCKETS, LEVELS = 96, 4  # of the letter tables
BLOCK = 1024           # words compared with the others at once


class _Ratios(dict):
    """How alike two words are, kept for up to 65,536 pairs.  Shipped empty and by
    value: an ``lru_cache`` goes by name, which workers cannot import."""

    def __missing__(self, words: tuple[str, str]) -> float:
        if len(self) >= 1 << 16:
            self.clear()
        ratio = self[words] = difflib.SequenceMatcher(None, *words).ratio()
        return ratio

    def __reduce__(self):
        return type(self), ()


_RATIOS = _Ratios()


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its letters (up to ``LEVELS`` of a bucket), how many are left
    out, and its length."""
    held = np.zeros((len(words), BUCKETS * LEVELS), dtype="float32")
    for r, word in enumerate(words):
        seen = [0] * BUCKETS
        for c in word:
            k = ord(c) % BUCKETS
            if seen[k] < LEVELS:
                held[r, k * LEVELS + seen[k]] = 1
                seen[k] += 1
    size = np.array([len(w) for w in words], dtype="float32")
    return held, size - held.sum(axis=1), size


def _close_words(us: list[str], vs: list[str]) -> list[tuple[float, str, str]]:
    """(ratio, u, v) of the pairs of different words that Differ calls similar,
    best first.  A ratio needs letters in common, so a product of letter
    tables names the few pairs to compare."""
    held, rest, size = _letters(vs)
    close = []
    for lo in range(0, len(us), BLOCK):
        some, some_rest, some_size = _letters(us[lo:lo + BLOCK])
        common = some @ held.T + np.minimum(some_rest[:, None], rest[None, :])
        both = some_size[:, None] + size[None, :]
        shorter = np.minimum(some_size[:, None], size[None, :])
        near = 2 * np.minimum(common, shorter) >= CUTOFF * both
        for i, j in zip(*(x.tolist() for x in near.nonzero())):
            u, v = us[lo + i], vs[j]
            if u != v and (ratio := _RATIOS[u, v]) >= CUTOFF:
                close.append((ratio, u, v))
    return sorted(close, key=lambda p: -p[0])


def _places(tokens: list[str], lo: int, hi: int) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for i in range(lo, hi):
        at.setdefault(tokens[i], []).append(i)
    return at


def _first_in(places: list[int], lo: int, hi: int) -> int | None:
    k = bisect_left(places, lo)
    return places[k] if k < len(places) and places[k] < hi else None


def unchanged_in_replace(a: list[str], alo: int, ahi: int, b: list[str], blo: int, bhi: int):
    """(i, j), ascending, of the tokens Differ shows as unchanged inside a
    replace block.

    Differ synchronises a block at its most similar pair of different tokens
    (the first in b, then in a, of equally similar ones), or if none is similar
    at its first pair of equal tokens, and goes on with what is before and what
    is after.  The same here, but similarity is a matter of distinct words, the
    parts wait on a list instead of the call stack, and a part without a common
    word, where nothing is unchanged, is left at once.
    """
    at_a, at_b = _places(a, alo, ahi), _places(b, blo, bhi)
    shared = [(at_a[w], at_b[w]) for w in at_a if w in at_b]
    if not shared:
        return
    close = [(ratio, at_a[u], at_b[v]) for ratio, u, v in _close_words(list(at_a), list(at_b))]
    parts = [(alo, ahi, blo, bhi, close)]
    while parts:
        alo, ahi, blo, bhi, close = parts.pop()
        if not any(_first_in(x, alo, ahi) is not None and _first_in(y, blo, bhi) is not None for x, y in shared):
            continue
        close = [p for p in close
                 if _first_in(p[1], alo, ahi) is not None and _first_in(p[2], blo, bhi) is not None]
        if close:
            j, i = min((_first_in(y, blo, bhi), _first_in(x, alo, ahi))
                       for ratio, x, y in close if ratio == close[0][0])
            parts.append((i + 1, ahi, j + 1, bhi, close))
            parts.append((alo, i, blo, j, close))
            continue
        for j in range(blo, bhi):
            i = _first_in(at_a.get(b[j], []), alo, ahi)
            if i is not None:
                yield i, j
                alo = i + 1


def _replaced(a: list[str], alo: int, ahi: int, b: list[str], blo: int, bhi: int, count: bool):
    """(n_diff, first_del, first_ins) of a replace block."""
    n, first_del, first_ins = ahi - alo + bhi - blo, alo, blo
    for i, j in unchanged_in_replace(a, alo, ahi, b, blo, bhi):
        n -= 2
        first_del += i == first_del
        first_ins += j == first_ins
        if not count and i > first_del and j > first_ins:
            break
    return n, first_del if first_del < ahi else None, first_ins if first_ins < bhi else None


def first_diffs(a: list[str], b: list[str], count: bool = True):
    """(n_diff, first_del, first_ins) of the Differ alignment of two token
    lists; without ``count`` n_diff is None and the walk ends at the first
    differences.

    Differ runs the same SequenceMatcher and only differs from its opcodes
    inside a 'replace' block whose two sides share a token
    (``unchanged_in_replace``).
    """
    if a == b:
        return 0 if count else None, None, None
    ops = difflib.SequenceMatcher(None, a, b).get_opcodes()
    n = 0
    first_del = first_ins = None
    for tag, i1, i2, j1, j2 in ops:
        if tag == "equal":
            continue
        if tag == "replace":
            k, deleted, inserted = _replaced(a, i1, i2, b, j1, j2, count)
        else:
            k = i2 - i1 + j2 - j1
            deleted, inserted = (i1, None) if tag == "delete" else (None, j1)
        n += k
        if first_del is None:
            first_del = deleted
        if first_ins is None:
            first_ins = inserted
        if not count and first_del is not None and first_ins is not None:
            break
    return n if count else None, first_del, first_ins


def window_before(tokens: list[str], idx: int, width: int, python_slices: bool = True):
    """Tokens just before ``idx``; Python slice rules unless told otherwise."""
    if python_slices:
        return tokens[idx - width:idx]
    return tokens[max(0, idx - width):idx]


def token_diff(a: str | None, b: str | None, marker: str, width: int,
               python_slices: bool = True, count: bool = True):
    """Full diff facts of one ordered pair (left = earlier row); ``count`` as in
    ``first_diffs``."""
    if a is None or b is None:
        return None
    ta, tb = a.split(), b.split()
    n, fd, fi = first_diffs(ta, tb, count)
    two = fd is not None and fi is not None
    mk = bool(two
              and marker in window_before(ta, fd, width, python_slices)
              and marker in window_before(tb, fi, width, python_slices))
    return n, fd, fi, two, mk


def _is_subsequence(short: list[str], long_: list[str]) -> bool:
    it = iter(long_)
    return all(tok in it for tok in short)


def two_sided(a: str | None, b: str | None) -> bool | None:
    """Whether the diff both deletes and inserts, with sound shortcuts.

    Same length and unequal => both sides changed.  A one-sided diff keeps
    the whole shorter list in order, so if the shorter list is not a
    subsequence of the longer one the diff is two-sided.
    """
    if a is None or b is None:
        return None
    ta, tb = a.split(), b.split()
    if ta == tb:
        return False
    if len(ta) == len(tb):
        return True
    short, long_ = (ta, tb) if len(ta) < len(tb) else (tb, ta)
    if not _is_subsequence(short, long_):
        return True
    _, fd, fi = first_diffs(ta, tb, count=False)
    return fd is not None and fi is not None


def marker_edge(a: str | None, b: str | None, marker: str, width: int,
                python_slices: bool = True) -> bool | None:
    """Whether the later row ``b`` is a near copy of ``a`` by the marker rule."""
    if a is None or b is None:
        return None
    if marker not in a or marker not in b:
        return False
    return token_diff(a, b, marker, width, python_slices, count=False)[4]


def two_sided_and_marker(a: str | None, b: str | None, marker: str, width: int,
                         python_slices: bool = True):
    """(two_sided, marker) with the cheap two-sided test when the marker
    cannot matter (absent from one of the texts)."""
    if a is None or b is None:
        return None, None
    if marker in a and marker in b:
        facts = token_diff(a, b, marker, width, python_slices, count=False)
        return facts[3], facts[4]
    return two_sided(a, b), False


PAIR_SCHEMA = T.StructType([T.StructField("two_sided", T.BooleanType()),
                            T.StructField("marker", T.BooleanType())])


def two_sided_marker_udf(marker: str, width: int, python_slices: bool = True):
    @F.pandas_udf(PAIR_SCHEMA)
    def _udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [two_sided_and_marker(x, y, marker, width, python_slices) for x, y in zip(a, b)]
        out = pd.DataFrame(rows, columns=["two_sided", "marker"])
        return out.astype("boolean")
    return _udf


def token_diff_udf(marker: str, width: int, python_slices: bool = True):
    @F.pandas_udf(DIFF_SCHEMA)
    def _udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [token_diff(x, y, marker, width, python_slices) or (None,) * 5
                for x, y in zip(a, b)]
        out = pd.DataFrame(rows, columns=[f.name for f in DIFF_SCHEMA.fields])
        for c in ("n_diff", "first_del", "first_ins"):
            out[c] = out[c].astype("Int32")
        for c in ("two_sided", "marker"):
            out[c] = out[c].astype("boolean")
        return out
    return _udf


def marker_edge_udf(marker: str, width: int, python_slices: bool = True):
    @F.pandas_udf(T.BooleanType())
    def _udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([marker_edge(x, y, marker, width, python_slices)
                          for x, y in zip(a, b)], dtype="boolean")
    return _udf
