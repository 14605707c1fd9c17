"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word of the contracts: a run of anything but space, tab, line feed,
#: vertical tab, form feed and carriage return.  ``bytes.split()`` splits at
#: exactly these six bytes, so Python code uses that.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only if its counted rows do not exceed this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, survives lost executors, and later reads prune columns.  ``codec``
    is the Parquet compression, if not the session's."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """Mark a table for broadcast if its counted rows are few; beyond that the
    join is left to the planner."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker.  Functions of this
    package travel by value with each task, so module globals would be new
    for every task; caches are kept in a module of the process instead."""
    key = "_docket_worker_store"
    if key not in sys.modules:
        sys.modules[key] = types.ModuleType(key)
    return sys.modules[key].__dict__.setdefault(name, {})


def short_batches() -> None:
    """Let the session hand texts to Python in batches of a few megabytes:
    10,000 rows, its own bound, can be a large part of a worker's memory."""
    conf = SparkSession.active().conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def series_udf(run, returns: str):
    """Pandas UDF of ``run``: an iterator of Series in, an iterator of Series
    (or of DataFrames, for a struct type) out."""
    short_batches()
    out = pd.DataFrame if "," in returns else pd.Series
    run.__annotations__ = {next(iter(run.__code__.co_varnames)): Iterator[pd.Series],
                           "return": Iterator[out]}
    # A filter on one field of the result, pushed below the projection, would
    # run the function twice (and a second Python worker in every task);
    # Spark does not copy what is marked so.
    return F.pandas_udf(run, returns).asNondeterministic()


def text_groups(texts, max_bytes: int = 1 << 22):
    """Consecutive texts as UTF-8 bytes (null: empty), in lists of about
    ``max_bytes`` (a longer text is a list of its own)."""
    group, size = [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if group and size + len(b) > max_bytes:
            yield group
            group, size = [], 0
        group.append(b)
        size += len(b)
    if group:
        yield group


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PRIME = np.uint64(0x100000001B3)
_PRIME_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2^64."""
    store = worker_store("powers")
    if store.get("n", -1) < n:
        for name, base in (("up", _PRIME), ("down", _PRIME_INVERSE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            store[name] = np.multiply.accumulate(p)
        store["n"] = n
    return store["up"], store["down"]


def hashed_words(buf: bytes, word_byte: np.ndarray, find=None, piece: int = 1 << 19):
    """(hash, start, end) of every run of word bytes of ``buf``; ``word_byte``
    tells for each of the 256 byte values if it belongs to a word.  ``find``
    may cut the bytes of a piece otherwise: it returns starts and ends.

    The hash of a word is a polynomial over its bytes, read off prefix sums,
    so no step handles single words.  Work goes in pieces cut between words,
    so memory follows the piece, not the text.
    """
    data = np.frombuffer(buf, np.uint8)
    value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        stop = min(len(data), at + piece)
        while stop < len(data) and word_byte[data[stop]]:
            nxt = np.flatnonzero(~word_byte[data[stop:stop + piece]])
            stop = stop + int(nxt[0]) if len(nxt) else min(len(data), stop + piece)
        part = data[at:stop]
        s, e = (find or _runs)(part, word_byte)
        up, down = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * up[:len(part)], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        hashes.append(mix64(h + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not hashes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def _runs(part: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(part) + 2, bool)
    inside[1:-1] = word_byte[part]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (empty if too few)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return mix64(acc)


def pieces(buf: bytes, gap: re.Pattern, size: int = 1 << 20) -> Iterator[bytes]:
    """``buf`` in parts of about ``size`` bytes, cut only where ``gap`` (a
    pattern of one byte that no term holds) matches: terms stay whole, and a
    list of the terms of a part stays small however long the text."""
    at = 0
    while at < len(buf):
        cut = gap.search(buf, at + size)
        stop = cut.start() if cut else len(buf)
        yield buf[at:stop]
        at = stop
