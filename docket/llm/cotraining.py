"""Quality classifier by co-training of two views.

The *text* view sees which words and runs of signs a text holds; the
*metadata* view sees source, language, length and layout (line length, shares
of capitals, digits, signs and spaces), but no words.  Each view is a logistic
regression.  In every round each view scores all unlabelled documents, and its most
confident labels join the training set of the other view.  At the end both are
calibrated on labelled rows that no round trained on, and their log odds are
added (less the prior's) to score all documents.

A round is a pass over all documents.  The most confident are found by a histogram
of scores over all of them; of these about ``pool`` rows are drawn by hash, anew in
every round, and only the features of those and of at most about ``sample`` labelled
rows reach the driver, one row per id and text.  Scoring is one pass over all
documents without a shuffle.

Null texts and empty texts have no text features, null metadata a value of its
own.  Labels of a repeated id are averaged, null labels and ids are ignored;
repeated documents are scored alike.  Without labels of both kinds every score
is the share of positive labels (0.5 without labels).  An empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, short_batches, stage, text_groups

TEXT_DIM = 1 << 13
META_DIM = 1 << 10
BINS = 16
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)


def _kinds() -> np.ndarray:
    kind = np.full(256, _SIGN, np.uint8)
    kind[list(b" \t\n\v\f\r")] = _SPACE
    for a, b in ((ord("a"), ord("z")), (ord("A"), ord("Z")), (0x80, 0xFF)):
        kind[a:b + 1] = _LETTER
    kind[ord("0"):ord("9") + 1] = _DIGIT
    return kind


def _runs_of_a_kind(part, _):
    kind = _kinds()[part]
    start = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    solid = kind[start] != _SPACE
    return start[solid], np.append(start[1:], len(part))[solid]


class Rows:
    """Sparse rows: (row, column, value) of the entries, sorted by row."""

    def __init__(self, row, col, val, n, dim):
        self.row, self.col, self.val, self.n, self.dim = row, col, val, n, dim

    def dot(self, w):
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, err):
        return np.bincount(self.col, self.val * err[self.row], self.dim)

    def take(self, which: np.ndarray) -> "Rows":
        new = np.full(self.n, -1)
        new[which] = np.arange(len(which))
        keep = new[self.row] >= 0
        return Rows(new[self.row[keep]], self.col[keep], self.val[keep], len(which), self.dim)


def text_features(group: list[bytes]) -> Rows:
    """Presence of hashed words and sign runs, each row of length 1."""
    buf = b"\n".join(group).lower()
    begin = np.cumsum([0] + [len(b) + 1 for b in group[:-1]])
    h, s, _ = hashed_words(buf, _kinds() != _SPACE, _runs_of_a_kind)
    row = np.searchsorted(begin, s, side="right") - 1
    key = row * TEXT_DIM + (h >> np.uint64(40)).astype(np.int64) % TEXT_DIM
    key = np.sort(pd.unique(key))
    row, col = key // TEXT_DIM, key % TEXT_DIM
    size = np.bincount(row, minlength=len(group))
    return Rows(row, col, 1.0 / np.sqrt(size[row]), len(group), TEXT_DIM)


def meta_features(group: list[bytes], sources, langs, lengths) -> Rows:
    """One-hot bins of layout and length, hashed source and language."""
    n = len(group)
    buf = b"\n".join(group) + b"\n"
    data = np.frombuffer(buf, np.uint8)
    begin = np.cumsum([0] + [len(b) + 1 for b in group[:-1]])
    kind = _kinds()[data]
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), begin)
    size = np.maximum(np.array([len(b) for b in group]), 1)
    capital = (data >= ord("A")) & (data <= ord("Z"))
    lines = total(data == ord("\n"))
    share = [total(capital) / np.maximum(total(kind == _LETTER), 1), total(kind == _DIGIT) / size,
             total(kind == _SIGN) / size, (total(kind == _SPACE) - 1) / size]
    length = np.array([len(b) if x is None or x != x else x for x, b in zip(lengths, group)])
    scale = [np.log2(1 + np.maximum(length, 0)), np.log2(1 + size / lines), np.log2(lines)]
    bins = [np.minimum(np.sqrt(np.clip(x, 0, 1)) * BINS, BINS - 1) for x in share]
    bins += [np.minimum(x, BINS - 1) for x in scale]
    cols = [i * BINS + b.astype(np.int64) for i, b in enumerate(bins)]
    at = len(bins) * BINS
    for values, dim in ((sources, 512), (langs, 256)):
        cols.append(np.array([at + zlib.crc32(repr(v).encode()) % dim for v in values], np.int64))
        at += dim
    row = np.repeat(np.arange(n), len(cols))
    return Rows(row, np.stack(cols, axis=1).reshape(-1), np.full(len(row), len(cols) ** -0.5),
                n, META_DIM)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: Rows, y: np.ndarray, steps: int = 120, rate: float = 0.7, l2: float = 1e-4):
    """(weights, intercept) by full-batch Adagrad; ``y`` in 0..1."""
    w, b = np.zeros(x.dim), 0.0
    gw, gb = np.full(x.dim, 1e-8), 1e-8
    for _ in range(steps):
        err = (sigmoid(x.dot(w) + b) - y) / max(x.n, 1)
        g, h = x.back(err) + l2 * w, err.sum()
        gw += g * g
        gb += h * h
        w -= rate * g / np.sqrt(gw)
        b -= rate * h / np.sqrt(gb)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Platt scaling: (slope, shift) so that sigmoid(slope z + shift) fits y.
    Targets are drawn in from 0 and 1 as Platt does."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c, ga, gc = 1.0, 0.0, 1e-8, 1e-8
    for _ in range(steps):
        err = sigmoid(a * z + c) - t
        da, dc = (err * z).mean(), err.mean()
        ga, gc = ga + da * da, gc + dc * dc
        a, c = a - 0.3 * da / np.sqrt(ga), c - 0.3 * dc / np.sqrt(gc)
    return max(float(a), 0.0), float(c)


def combined(model: dict, views: list[Rows]) -> list[np.ndarray]:
    """(text score, metadata score, combined score)."""
    if "fits" not in model:
        return [np.full(views[0].n, model["share"])] * 3
    prior = min(max(model["share"], 0.01), 0.99)
    odds = [a * (v.dot(w) + b) + c for v, (w, b), (a, c) in
            zip(views, model["fits"], model["scale"])]
    both = odds[0] + odds[1] - np.log(prior / (1 - prior))
    return [sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(both)]


def _views(texts, sources, langs, lengths):
    at = 0
    for group in text_groups(texts):
        part = slice(at, at + len(group))
        yield [text_features(group), meta_features(group, sources[part], langs[part], lengths[part])]
        at += len(group)


COLUMNS = ("text", "source", "lang", "n_chars")


def _draw(id_column, n: int, of: int):
    """About ``n`` of ``of`` ids, by hash."""
    cell = F.pmod(F.xxhash64(F.lit("cotraining"), id_column), F.lit(1 << 30))
    return cell < F.lit(int(min(1.0, n / max(of, 1)) * (1 << 30)))


def _features(rows: DataFrame, ys: list[str]) -> pd.DataFrame:
    """Feature columns of rows (i, ``COLUMNS``, ys), one per id and text."""
    def features(batches):
        for pdf in batches:
            out = []
            for text, meta in _views(pdf["text"], *(pdf[c].tolist() for c in COLUMNS[1:])):
                for i in range(text.n):
                    a, b = np.searchsorted(text.row, [i, i + 1])
                    c, d = np.searchsorted(meta.row, [i, i + 1])
                    out.append((text.col[a:b], meta.col[c:d]))
            yield pd.DataFrame({"i": pdf["i"], "h": pdf["h"], "text": [x[0] for x in out],
                                "meta": [x[1] for x in out], **{y: pdf[y].astype(float) for y in ys}})
    schema = "i long, h long, text array<long>, meta array<long>" + "".join(f", {y} double" for y in ys)
    got = rows.dropDuplicates(["i", "h"]).mapInPandas(features, schema).toArrow().to_pandas()
    return got.sort_values(["i", "h"], kind="stable").reset_index(drop=True)


def _as_rows(lists, dim: int) -> Rows:
    n = np.array([len(x) for x in lists], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    col = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    return Rows(row, col, 1.0 / np.sqrt(n[row]), len(n), dim)


VIEWS = (("text", TEXT_DIM), ("meta", META_DIM))


def _confident(rows: DataFrame, fits: dict, n_round: int, per_round: float, sure: float,
               quota: int) -> dict:
    """{(target, view, value): feature rows} drawn from the most confident of all
    rows that have no label ``y<target>``; ``fits`` is {target: fits of the views}."""
    names = {(t, v): f"z{t}_{v}" for t in fits for v in range(len(VIEWS))}
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def logits(batches):
        for pdf in batches:
            parts = {n: [] for n in names.values()}
            for views in _views(pdf["text"], *(pdf[c].tolist() for c in COLUMNS[1:])):
                for (t, v), n in names.items():
                    w, b = sent.value[t][v]
                    parts[n].append(views[v].dot(w) + b)
            z = {n: np.where(pdf[f"y{t}"].isna(), np.concatenate(parts[n]) if parts[n] else [], np.nan)
                 for (t, _), n in names.items()}
            yield pd.DataFrame({"h": pdf["h"], **z})
    at = stage(rows.mapInPandas(logits, "h long, " + ", ".join(
        f"{n} double" for n in names.values())).dropDuplicates(["h"]), "logits")
    sides = [(t, v, value, F.col(n) if value else -F.col(n)) for (t, v), n in names.items()
             for value in (1, 0)]
    # NaN, a labelled row, is above all numbers for Spark.
    bins = [F.when(~F.isnan(z) & (z >= float(np.log(sure / (1 - sure)))), F.floor(z * 8)).cast("long")
            for _, _, _, z in sides]
    sums = at.select(F.posexplode(F.array(*bins)).alias("side", "bin")).where("bin is not null").groupBy(
        "side", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    free = at.agg(*[F.count_if(~F.isnan(names[t, 0])).alias(f"n{t}") for t in fits]).first()
    picks, drawn = [], F.pmod(F.xxhash64(F.lit(n_round), "h"), F.lit(1 << 30))
    for k, (t, _, _, _) in enumerate(sides):
        most = max(1, int(min(1.0, per_round * (n_round + 1)) * free[f"n{t}"]))
        total, least = 0, None
        for x in sorted((x for x in sums if x.side == k), key=lambda x: -x.bin):
            if total >= most:
                break
            total, least = total + x.n, x.bin
        cell = int(min(1.0, quota / max(total, 1)) * (1 << 30))
        picks.append(F.lit(False) if least is None else F.coalesce(
            (bins[k] >= least) & (drawn < cell), F.lit(False)))
    marks = [f"s{k}" for k in range(len(sides))]
    chosen = at.select(F.col("h").alias("h2"), *[p.cast("double").alias(m) for p, m in zip(picks, marks)]).where(
        " + ".join(marks) + " > 0")
    # About ``quota`` rows a side, so they may travel to every task.
    found = rows.select("i", "h", *COLUMNS).join(
        F.broadcast(chosen), F.col("h") == F.col("h2")).drop("h2")
    got = _features(found, marks)
    return {(t, v, value): got[got[m] > 0] for (t, v, value, _), m in zip(sides, marks)}


def fit(docs: DataFrame, labels: DataFrame, targets: list[str], doc_id: str = "doc_id",
        sample: int = 4096, pool: int = 4096, rounds: int = 4, per_round: float = 0.05,
        sure: float = 0.95) -> dict:
    """{target: model} for each label column of ``labels``."""
    short_batches()
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(
        *[F.round(F.avg(t)).alias(f"y{k}") for k, t in enumerate(targets)])
    drawn = known.where(_draw(F.col("i"), sample, known.count())).limit(2 * sample)
    ys = [f"y{k}" for k in range(len(targets))]
    # ``drawn`` has at most 2 * sample rows, so it may travel to every task.
    rows = docs.select(F.col(doc_id).alias("i"), F.xxhash64(doc_id, "text").alias("h"), *COLUMNS).join(
        F.broadcast(drawn), "i", "left")
    # An id may have any number of rows: rows are bounded after the join, by id and text.
    labelled = rows.where(" or ".join(f"{y} is not null" for y in ys)).dropDuplicates(["i", "h"])
    few = labelled.where(_draw(F.col("h"), sample, labelled.count())).limit(2 * sample)
    got = _features(few, ys)
    held = np.array([zlib.crc32(repr(i).encode()) % 5 == 0 for i in got["i"].tolist()], bool)
    models, sets, tests = {}, {}, {}
    for k, y in enumerate(ys):
        label = got[y].to_numpy(float)
        known = ~np.isnan(label)
        models[k] = {"share": float(label[known].mean()) if known.any() else 0.5}
        if all(len(np.unique(label[known & part])) == 2 for part in (held, ~held)):
            sets[k] = [(got[known & ~held], label[known & ~held])] * 2
            tests[k] = (got[known & held], label[known & held])

    def fit_all(sets):
        return {k: [logistic(_as_rows(part[name], dim), y) for (name, dim), (part, y) in zip(VIEWS, both)]
                for k, both in sets.items()}
    fits = fit_all(sets)
    for r in range(rounds if sets else 0):
        new = _confident(rows, fits, r, per_round, sure, max(1, pool // (4 * len(sets))))
        fits = fit_all({k: [
            (pd.concat([part, *(new[k, 1 - v, value] for value in (1, 0))]),
             np.concatenate([y, *(np.full(len(new[k, 1 - v, value]), float(value)) for value in (1, 0))]))
            for v, (part, y) in enumerate(both)] for k, both in sets.items()})
    for k, (part, y) in tests.items():
        models[k] |= {"fits": fits[k], "scale": [
            calibrate(_as_rows(part[name], dim).dot(w) + b, y)
            for (name, dim), (w, b) in zip(VIEWS, fits[k])]}
    return {t: models[k] for k, t in enumerate(targets)}


def score(docs: DataFrame, models: dict, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and, for each target, ``<target>_text``, ``<target>_meta``
    and ``<target>_score``."""
    short_batches()
    names = [f"{t}_{kind}" for t in models for kind in ("text", "meta", "score")]
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for text, source, lang, n_chars in batches:
            parts = [[] for _ in names]
            for views in _views(text, source.tolist(), lang.tolist(), n_chars.tolist()):
                got = [x for m in held.value.values() for x in combined(m, views)]
                for p, x in zip(parts, got):
                    p.append(x)
            yield pd.DataFrame({n: np.concatenate(p) if p else [] for n, p in zip(names, parts)})
    series = tuple[pd.Series, pd.Series, pd.Series, pd.Series]
    run.__annotations__ = {"batches": Iterator[series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, ", ".join(f"{n} double" for n in names))
    return docs.select(F.col(doc_id).alias("doc_id"), udf(*COLUMNS).alias("s")).select("doc_id", "s.*")
