"""Benchmark decontamination by winnowing.

Words of a test item and of a document are hashed; of every ``window``
consecutive words only the least hash of its ``k``-word runs is kept (the
window's fingerprint).  A shared span of ``window`` words has the same
fingerprint on both sides, so looking the fingerprints of a document up among
those of the test items misses none.  Each fingerprint hit is extended to the
whole window and compared word by word, so a hash collision marks nothing.

The test set is a stated query set: it is read in blocks of at most
``block_words`` words; each block is broadcast and compared with all
documents.  Documents are neither shuffled nor collected.

Nulls and empty texts have no words and are never hit; a test item without
words has no window, one of fewer than ``window`` words is one window of its
own length; a null item id is reported as ``null``; a repeated item id stands
for all its texts; each document row is judged on its own, repeated or not.
Empty tables give no rows (documents) or no hits (test set).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, rolling, series_udf, text_groups

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"


def _word_bytes() -> np.ndarray:
    """After lower-casing: digits, a to z, and every byte of a non-ASCII character."""
    keep = np.zeros(256, bool)
    keep[ord("0"):ord("9") + 1] = keep[ord("a"):ord("z") + 1] = keep[0x80:] = True
    return keep


def window_fingerprints(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """Winnowing: least hash of the ``k``-word runs of each ``window`` words."""
    grams = rolling(h, k)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, grams[j:j + n], out=least)
    return least


def build_block(items: list[tuple[str, str]], window: int, k: int) -> dict:
    """Index of a block of test items, by window length: the kept
    fingerprints, and for each distinct window its hash, words and items."""
    found: dict[int, dict[bytes, set[int]]] = {}
    hashes: dict[int, dict[bytes, tuple[int, int]]] = {}
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    word_byte = _word_bytes()
    for name, text in items:
        buf = (text or "").encode("utf-8", "surrogatepass").lower()
        h, s, e = hashed_words(buf, word_byte)
        length = min(window, len(h))
        if not length:
            continue
        words = [buf[a:b] for a, b in zip(s.tolist(), e.tolist())]
        prints = window_fingerprints(h, length, k if length == window else length)
        whole = rolling(h, length)
        for i in range(len(whole)):
            key = b" ".join(words[i:i + length])
            found.setdefault(length, {}).setdefault(key, set()).add(number[name])
            hashes.setdefault(length, {})[key] = (int(whole[i]), int(prints[i]))
    index = {}
    for length, windows in found.items():
        keys = sorted(windows, key=lambda w: hashes[length][w][0])
        index[length] = {
            "prints": np.unique(np.array([hashes[length][w][1] for w in keys], np.uint64)),
            "whole": np.array([hashes[length][w][0] for w in keys], np.uint64),
            "words": keys, "items": [sorted(windows[w]) for w in keys]}
    return {"names": names, "index": index}


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _windows_found(block: dict, buf: bytes, h, s, e, row, window: int, k: int):
    """(first word, length, item numbers) of each verified window."""
    for length, ix in block["index"].items():
        prints = window_fingerprints(h, length, k if length == window else length)
        if not len(prints):
            continue
        head = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        hit = np.repeat(_member(prints[head], ix["prints"]),
                        np.diff(np.append(head, len(prints))))
        start = np.flatnonzero(hit)
        start = start[row[start] == row[start + length - 1]]
        if not len(start):
            continue
        whole = rolling(h[start[:, None] + np.arange(length)].reshape(-1), length)[::length]
        first = np.searchsorted(ix["whole"], whole)
        for p, w, q in zip(start.tolist(), whole.tolist(), first.tolist()):
            text = None
            while q < len(ix["whole"]) and int(ix["whole"][q]) == w:
                if text is None:
                    text = b" ".join(buf[a:b] for a, b in
                                     zip(s[p:p + length].tolist(), e[p:p + length].tolist()))
                if text == ix["words"][q]:
                    yield p, length, ix["items"][q]
                    break
                q += 1


def _judge(group: list[bytes], blocks: list, window: int, k: int) -> pd.DataFrame:
    buf = b"\n".join(group).lower()
    begin = np.cumsum([0] + [len(b) + 1 for b in group[:-1]])
    h, s, e = hashed_words(buf, _word_bytes())
    row = np.searchsorted(begin, s, side="right") - 1
    n_words = np.bincount(row, minlength=len(group))
    first_word = np.concatenate(([0], np.cumsum(n_words)))
    cover = np.zeros(len(h) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for block in blocks:
        names = block["names"]
        for p, length, which in _windows_found(block, buf, h, s, e, row, window, k):
            cover[p] += 1
            cover[p + length] -= 1
            items.setdefault(int(row[p]), set()).update(names[i] for i in which)
    inside = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(row[inside], minlength=len(group))
    spans: list[list[dict]] = [[] for _ in group]
    for r in items:
        a, b = first_word[r], first_word[r + 1]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside[a:b].astype(np.int8), [0]))))
        spans[r] = [{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2])]
    return pd.DataFrame({"n_words": n_words, "n_hit": n_hit,
                         "items": [sorted(items.get(r, ())) for r in range(len(group))],
                         "spans": spans})


def contamination(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                  window: int = 10, k: int = 5, block_words: int = 2_000_000):
    """A function of a text column: struct of ``n_words``, ``n_hit`` (words
    inside a window of the test set), ``items`` (ids, sorted as strings) and
    ``spans`` (word ranges hit)."""
    spark = benchmark.sparkSession
    blocks, rows, size = [], [], 0
    words = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"),
                             F.col(text).alias("t"))
    for r in words.toLocalIterator():
        n = len(r.t or "") // 2 + 1
        if rows and size + n > block_words:
            blocks.append(spark.sparkContext.broadcast(build_block(rows, window, k)))
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += n
    blocks.append(spark.sparkContext.broadcast(build_block(rows, window, k)))

    def judge(batches):
        for texts in batches:
            loaded = (b.value for b in blocks) if len(blocks) == 1 else _each(blocks)
            held = list(loaded) if len(blocks) == 1 else None
            parts = [_judge(g, held if held is not None else _each(blocks), window, k)
                     for g in text_groups(texts)]
            yield (pd.concat(parts, ignore_index=True) if parts else
                   pd.DataFrame({"n_words": [], "n_hit": [], "items": [], "spans": []}))

    udf = series_udf(judge, RESULT)
    return lambda column: udf(F.col(column) if isinstance(column, str) else column)


def _each(blocks):
    """The broadcast blocks, one in memory at a time."""
    for b in blocks:
        yield b.value
        b.__dict__.pop("_value", None)


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                      out: str = "__contamination", **options) -> DataFrame:
    """``docs`` with the struct of ``contamination`` in column ``out``."""
    return docs.withColumn(out, contamination(benchmark, **options)(text))


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
