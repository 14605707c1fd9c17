"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of a language's most frequent character n-grams (1 to 3
letters of words padded with a space), in order.  A document's own list is
compared with each profile: every n-gram counts by how many places it is out of
place, or ``profile_size`` places if the profile lacks it.  The least sum wins.

Profiles come from counts over all training texts (partial counts in tasks,
one aggregate, then the most frequent per language in two steps, so that no
task holds all n-grams of a hot language).  Equal counts are ordered by
n-gram, equal distances by language name, so reruns agree.

Texts that are null or have no letter are ``und`` with score 0, as is every
text if there is no training text.  Rows without a language train nothing; a
null id counts as the text ``null`` in the split.  Repeated rows count and are
predicted as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .class_lm import split_number
from .common import series_udf, short_batches, stage

UNKNOWN = "und"
#: Languages whose profiles are held at a time, in the driver or a task.
BLOCK_LANGUAGES = 2_000
WORDS = re.compile(r"[^\W\d_]+")
SHIFT = np.int64(1 << 21)  # above every code point


def gram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of counted words; an n-gram is its code points packed
    in 21 bits each, so packed order is code-point order within a length."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"),
                         "<u4").astype(np.int64)
    space = line == 32
    times = np.fromiter(words.values(), np.int64, len(words))
    weight = times[np.minimum(np.cumsum(space) - 1, len(times) - 1)]
    one = ~space
    two = one[:-1] | one[1:]
    three = one[1:-1]
    pair = line[:-1] * SHIFT + line[1:]
    keys = np.concatenate((line[one], pair[two], (pair[:-1] * SHIFT + line[2:])[three]))
    n = np.concatenate((weight[one], weight[:-1][two], weight[:-2][three]))
    code, distinct = pd.factorize(keys)
    return distinct, np.bincount(code, n, len(distinct)).astype(np.int64)


def ranked(keys: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` frequent n-grams, ties by n-gram."""
    if len(keys) > 4 * most:  # keep all that tie with the last
        keep = n >= np.partition(n, len(n) - most)[len(n) - most]
        keys, n = keys[keep], n[keep]
    return keys[np.lexsort((keys, -n))[:most]]


def _lower_words(text) -> list[str]:
    return WORDS.findall(text.lower()) if isinstance(text, str) else []


def count_grams(train: DataFrame, text: str, lang: str, flush: int = 500_000) -> DataFrame:
    """(lang, gram, n) over all training texts."""
    def run(batches):
        words: dict[str, Counter] = {}

        def rows():
            for name, seen in words.items():
                keys, n = gram_counts(seen)
                for at in range(0, len(keys), 50_000):
                    k = keys[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(k), pa.string()), pa.array(k, pa.int64()),
                         pa.array(n[at:at + 50_000], pa.int64())], ["lang", "gram", "n"])
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(name, Counter()).update(_lower_words(t))
            if sum(map(len, words.values())) > flush:
                yield from rows()
                words.clear()
        yield from rows()
    part = train.select(F.col(lang).cast("string"), text).mapInArrow(run, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(train: DataFrame, profile_size: int, text: str = "text", lang: str = "lang",
             block: int = BLOCK_LANGUAGES):
    """{language: its n-grams in order}, ``block`` languages at a time, in order
    of their names."""
    counts = count_grams(train, text, lang).withColumn("cell", F.pmod(F.xxhash64("gram"), F.lit(64)))
    order = [F.desc("n"), F.asc("gram")]
    for keys in (["lang", "cell"], ["lang"]):
        w = Window.partitionBy(*keys).orderBy(*order)
        counts = counts.withColumn("place", F.row_number().over(w)).where(
            F.col("place") <= profile_size).drop("place")
    # One row per language, so this window stays small.
    number = F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / block)
    counts = stage(counts, "grams")
    names = stage(counts.select("lang").distinct().withColumn("block", number), "languages")
    for i in range((names.agg(F.max("block")).first()[0] or 0) + 1):
        held = counts.join(names.where(F.col("block") == i), "lang").select("lang", "gram", "n")
        got = held.toArrow().to_pandas()  # block x profile_size rows at most
        yield {name: g.sort_values(["n", "gram"], ascending=[False, True])["gram"].to_numpy(np.int64)
               for name, g in got.groupby("lang")}


def distances(own: np.ndarray, index: list, profile_size: int) -> np.ndarray:
    """Out-of-place distance of a ranked list to each profile (sorted n-grams,
    their ranks)."""
    out = np.zeros(len(index))
    place = np.arange(len(own))
    for i, (keys, ranks) in enumerate(index):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        found = keys[at] == own
        out[i] = np.abs(ranks[at] - place)[found].sum() + profile_size * (~found).sum()
    return out


def predictor(blocks: list, profile_size: int):
    """Column function: struct (lang_pred, score) of a text.  ``blocks`` are
    broadcast blocks of profiles; a task holds one at a time."""
    def run(batches):
        for texts in batches:
            words = [Counter(_lower_words(t)) for t in texts]
            own = [ranked(*gram_counts(w), profile_size) if w else None for w in words]
            best = [(None, UNKNOWN)] * len(own)
            for found in map(_held, blocks):
                names = sorted(found)
                index = []
                for name in names:
                    order = np.argsort(found[name], kind="stable")
                    index.append((found[name][order], order))
                for i, grams in enumerate(own if names else []):
                    if grams is not None:
                        d = distances(grams, index, profile_size)
                        at = int(np.argmin(d))
                        if best[i][0] is None or d[at] < best[i][0]:  # ties: the first name
                            best[i] = float(d[at]), names[at]
                if len(blocks) > 1:
                    del found, index
            yield pd.DataFrame([(name, 0.0 if d is None else 1.0 - d / (profile_size * len(grams)))
                                for (d, name), grams in zip(best, own)], columns=["lang_pred", "score"])

    def _held(block):
        value = block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)
        return value
    return series_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             folds: int = 4, held_fold: int = 2, profile_size: int = 400,
             block: int = BLOCK_LANGUAGES) -> DataFrame:
    """Learn from the rows outside the held-out fold that name a language and
    predict all: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (1 less the
    distance as a share of the largest possible)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.col(lang).cast("string").alias("lang"),
                       (split_number(F.col(doc_id), folds) == held_fold).alias("held_out"))
    short_batches()
    train = rows.where(~F.col("held_out") & F.col("lang").isNotNull())
    blocks = [docs.sparkSession.sparkContext.broadcast(found) for found in profiles(train, profile_size, block=block)]
    return rows.withColumn("p", predictor(blocks, profile_size)(F.col("text"))).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
