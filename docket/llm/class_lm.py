"""Class-based bigram language model (Brown et al.) with exchange clustering.

A text's probability is the product of class transitions P(c | c') and word
emissions P(w | c).  Every training word has a class of its own, from its own
class bigrams; a word not seen in training takes the class of its last two bytes.

1. Word counts over all training texts (a partial count in each task, then an
   aggregate).  ``counts`` is a table; nothing of it is limited.
2. The core: each of the most frequent words is a unit, the other words share
   units by their last two bytes, and the end of a text is a unit with a class of
   its own.  Exchange clustering on the bounded table of their bigrams: each unit
   in turn moves to the class with the largest likelihood, until no unit moves.
3. Texts are written once as numbers of the head words (at most ``head_words``,
   whose counts and classes travel with tasks); other words stay words and meet
   their counts and classes in joins.
4. In each of ``rounds`` rounds every training word that is no unit is placed
   anew: its counts of classes before and after it, grouped by the word, are
   weighed against the class table, and it goes to the class of largest gain (the
   likelihood's first order, all words at once).
5. Transitions and emissions are counted with these classes, and one pass over
   the numbers scores the texts.

Smoothing: ``(c + 0.5) / (N_class + 0.5 (V_class + 1))`` for emissions,
``(n(c', c) + a P(c)) / (n(c') + a)`` for transitions.

Null and empty texts are the end token alone.  A null id counts as the text
``null`` in the training split.  Repeated rows count and score as often as
they occur.  Without training texts every token is unknown and all classes are
alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, stage, text_groups

ADD = 0.5
GROUPS = 256
KEY = ("doc_id long, text_key long, held_out boolean, ")
#: ``ids``: head words by number, -1 for others.  ``other``: 1 + the number of the
#: word after ``word``, or minus that of the one before it; 0 is the end.
LOST = "word array<string>, {} array<long>, a array<string>, b array<string>"
ENCODED = KEY + "ids binary, " + LOST.format("other")
SCORED = (KEY + "n_tokens long, known long, base double, model double, n_tail long, "
          + LOST.format("code"))


def split_number(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds


def _tokens(batch_column):
    """Lists of the lower-cased words of each text, in groups."""
    for group in text_groups(batch_column.to_pylist()):
        yield [b.lower().split() for b in group]


def count_words(train: DataFrame, text: str = "text", flush: int = 1_000_000) -> DataFrame:
    """(word, n) over all texts."""
    def run(batches):
        seen: Counter = Counter()

        def rows():
            words = list(seen)
            for at in range(0, len(words), 50_000):
                part = words[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([seen[w] for w in part], pa.int64())], ["word", "n"])
        for batch in batches:
            for group in _tokens(batch.column(0)):
                for words in group:
                    seen.update(words)
                if len(seen) > flush:
                    yield from rows()
                    seen.clear()
        yield from rows()
    part = train.select(text).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of at least some count, at most ``most`` of them, by falling
    count: the count comes from a histogram on a logarithmic scale."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r.s, r.k) for r in counts.groupBy(step.alias("s")).agg(
        F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in sizes:
        if total + k > most:
            break
        total, least = total + k, s
    if least is None:
        return []
    got = counts.where(step >= least).select(F.col("word").cast("binary").alias("w"), "n").toArrow()
    pairs = zip(got.column("w").to_pylist(), got.column("n").to_pylist())
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


class Suffixes(dict):
    """Unit of a word that is no unit itself, by its last two bytes."""

    def __init__(self, first: int):
        super().__init__()
        self.first = first

    def __missing__(self, end: bytes) -> int:
        self[end] = self.first + zlib.crc32(end) % GROUPS
        return self[end]


def count_bigrams(train: DataFrame, unit_words: list[bytes], text: str = "text") -> DataFrame:
    """(u, v, n): how often unit v follows unit u; unit 0 is the end of a
    text and stands before its first word."""
    size = 1 + len(unit_words) + GROUPS

    def run(batches):
        units = {w: i for i, w in enumerate(unit_words, 1)}
        get, rest = units.get, Suffixes(1 + len(unit_words))
        rest[b""] = 0
        sums = np.zeros(size * size, np.int64)
        for batch in batches:
            for group in _tokens(batch.column(0)):
                for words in group:
                    words.append(b"")  # no word is empty: the end
                line = np.array([0] + [get(w) or rest[w[-2:]]
                                       for w in chain.from_iterable(group)], np.int64)
                sums += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        at = np.flatnonzero(sums)
        for a in range(0, len(at), 100_000):
            part = at[a:a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part // size, pa.int64()), pa.array(part % size, pa.int64()),
                 pa.array(sums[part], pa.int64())], ["u", "v", "n"])
    return train.select(text).mapInArrow(run, "u long, v long, n long").groupBy("u", "v").agg(
        F.sum("n").alias("n"))


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each unit (unit 0: class 0 alone) by exchange clustering of a
    square table of bigram counts.  The likelihood depends on
    sum f(n(c, d)) - sum f(n(c, .)) - sum f(n(., d)) with f(x) = x log x."""
    size = len(bigrams)
    b = bigrams.astype(np.float64)
    order = np.argsort(-b.sum(axis=0)[1:], kind="stable") + 1
    place = np.zeros(size, np.int64)
    place[order] = 1 + np.arange(size - 1) % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), place] = 1.0
    after, before = b @ member, b.T @ member  # unit -> class, class -> unit
    table = member.T @ after
    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            old, own = int(place[u]), b[u, u]
            out, inn = after[u].copy(), before[u].copy()
            out[old] -= own
            inn[old] -= own
            if not (out.any() or inn.any() or own):
                continue
            # The table without u.
            table[old] -= out
            table[:, old] -= inn
            table[old, old] -= own
            base = _xlogx(table)
            row, col = table.sum(axis=1), table.sum(axis=0)
            r, c = base.sum(axis=1), base.sum(axis=0)
            both = np.diagonal(table)
            gain = (_xlogx(table + out[None, :]).sum(axis=1) - r
                    + _xlogx(table + inn[:, None]).sum(axis=0) - c
                    - _xlogx(both + out) - _xlogx(both + inn)
                    + _xlogx(both + out + inn + own) + _xlogx(both)
                    - _xlogx(row + out.sum() + own) + _xlogx(row)
                    - _xlogx(col + inn.sum() + own) + _xlogx(col))
            # Joining a class also adds to the margins of u's neighbours,
            # but by the same amount for every class.
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += out
            table[:, new] += inn
            table[new, new] += own
            if new != old:
                moved += 1
                place[u] = new
                after[:, old] -= b[:, u]
                after[:, new] += b[:, u]
                before[:, old] -= b[u]
                before[:, new] += b[u]
        if not moved:
            break
    return place


def log10(x) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def fit(train: DataFrame, counts: DataFrame, text: str = "text", head_words: int = 1 << 18,
        unit_words: int = 1024, classes: int = 48, prior: float = 10.0) -> dict:
    """The core of the model: frequent words with their counts and units, and, with
    all other words in the class of their last bytes, class transitions, emission
    denominators and corpus totals."""
    head = frequent(counts, head_words)
    units = [w for w, _ in head[:unit_words]]
    size = 1 + len(units) + GROUPS
    table = np.zeros((size, size), np.int64)
    pairs = count_bigrams(train, units, text).toArrow()
    table[pairs.column("u").to_numpy(), pairs.column("v").to_numpy()] = pairs.column("n").to_numpy()
    place = exchange(table, classes)
    member = np.zeros((size, classes))
    member[np.arange(size), place] = 1.0
    pair = member.T @ table @ member
    times = table.sum(axis=0)
    total = float(times.sum())
    share = (member.T @ times + 1.0) / (total + classes)
    move = (pair + prior * share) / (pair.sum(axis=1, keepdims=True) + prior)
    # Distinct words of each unit: one for a word, counted for the others.
    ends = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % GROUPS
    distinct = np.zeros(size, np.int64)
    distinct[0] = int(times[0] > 0)
    distinct[1:1 + len(units)] = 1
    for r in counts.groupBy(ends.alias("g")).agg(F.count(F.lit(1)).alias("k")).collect():
        distinct[1 + len(units) + r.g] += r.k
    for w in units:
        distinct[1 + len(units) + zlib.crc32(w[-2:]) % GROUPS] -= 1
    class_size = member.T @ times + ADD * (member.T @ distinct + 1)
    n, v = int(total), int(distinct.sum())
    return {"head": [w for w, _ in head], "count": np.array([c for _, c in head], np.float64),
            "n_units": len(units), "place": place, "pair": pair, "move": log10(move),
            "emit": log10(class_size), "N": n, "V": v, "end": float(times[0]),
            "base": math.log10(n + ADD * (v + 1))}


def suffix_class(word: Column, model: dict) -> Column:
    """Class of a word by its last two bytes."""
    places = ", ".join(str(c) for c in model["place"][1 + model["n_units"]:])
    end = F.crc32(F.substring(word.cast("binary"), -2, 2)) % GROUPS
    return F.element_at(F.expr(f"array({places})"), (end + 1).cast("int"))


def _encode(head):
    """Function from rows (doc_id, text_key, held_out, text) to ``ENCODED``."""
    def run(batches):
        get = {w: i for i, w in enumerate(head.value, 1)}.get
        for batch in batches:
            done = 0
            for group in _tokens(batch.column("text")):
                ids, word, other, a, b, ones, twos = [], [], [], [], [], [0], [0]
                for words in group:
                    at = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                    ids.append(at.tobytes())
                    for i in np.flatnonzero(at < 0).tolist():
                        before = int(at[i - 1]) if i else 0
                        after = int(at[i + 1]) if i + 1 < len(words) else 0
                        if before >= 0:
                            word.append(words[i])
                            other.append(-1 - before)
                        if after >= 0:
                            word.append(words[i])
                            other.append(1 + after)
                        else:
                            a.append(words[i])
                            b.append(words[i + 1])
                    ones.append(len(word))
                    twos.append(len(a))
                part = batch.slice(done, len(group))
                done += len(group)

                def lists(ends, values, kind):
                    values = pa.array(values, kind)
                    values = values.cast(pa.string()) if kind == pa.binary() else values
                    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "text_key", "held_out")]
                    + [pa.array(ids, pa.binary()), lists(ones, word, pa.binary()),
                       lists(ones, other, pa.int64()), lists(twos, a, pa.binary()),
                       lists(twos, b, pa.binary())],
                    ["doc_id", "text_key", "held_out", "ids", "word", "other", "a", "b"])
    return run


def _lines(batch, width: int = 1 << 20):
    """The numbers of the texts of a batch, an end before and after each, in
    pieces; two pieces share their last and first number."""
    line, size = [np.zeros(1, np.int32)], 1
    for x in batch.column(0).to_pylist():
        line += [np.frombuffer(x, np.int32), np.zeros(1, np.int32)]
        size += len(line[-2]) + 1
        if size > width:
            yield np.concatenate(line)
            line, size = [np.zeros(1, np.int32)], 1
    if size > 1:
        yield np.concatenate(line)


def _known_pairs(classes, k: int):
    """Function from ``ids`` to (c, d, n): class bigrams of head words."""
    def run(batches):
        place, sums = classes.value, np.zeros(k * k, np.int64)
        for batch in batches:
            for line in _lines(batch):
                both = (line[:-1] >= 0) & (line[1:] >= 0)
                sums += np.bincount(place[line[:-1][both]] * k + place[line[1:][both]],
                                    minlength=k * k)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at // k, pa.int64()), pa.array(at % k, pa.int64()),
                                          pa.array(sums[at], pa.int64())], ["c", "d", "n"])
    return run


def _known_contexts(classes, k: int, n_units: int, flush: int = 4_000_000):
    """Function from ``ids`` to (w, code, n): how often a head word that is no
    unit stands after a head word of class ``code``, or before one of class
    ``code - k``."""
    def run(batches):
        place, held, size = classes.value, [], 0

        def rows():
            key, n = np.unique(np.concatenate(held), return_counts=True) if held else ([], [])
            for at in range(0, len(key), 100_000):
                w, code = np.divmod(key[at:at + 100_000], 2 * k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w, pa.int64()), pa.array(code, pa.int64()),
                     pa.array(n[at:at + 100_000], pa.int64())], ["w", "code", "n"])
        for batch in batches:
            for line in _lines(batch):
                u, v = line[:-1].astype(np.int64), line[1:].astype(np.int64)
                both = (u >= 0) & (v >= 0)
                after, before = both & (v > n_units), both & (u > n_units)
                held += [v[after] * 2 * k + place[u[after]], u[before] * 2 * k + k + place[v[before]]]
                size += len(held[-1]) + len(held[-2])
                if size > flush:
                    yield from rows()
                    held, size = [], 0
        yield from rows()
    return run


def _gains(table: np.ndarray) -> np.ndarray:
    """Gain of each class for a word once after, then once before, each class."""
    k = len(table)
    logs = np.log(table + ADD)
    after = (logs - np.log(table.sum(axis=1) + ADD * k)[:, None]).T
    before = logs - np.log(table.sum(axis=0) + ADD * k)[None, :]
    return np.concatenate([before, after])


def _best(row, code, n, rows: int, gains: np.ndarray) -> np.ndarray:
    """The class of largest gain for each of ``rows`` words."""
    at = row * len(gains) + code
    counts = np.bincount(at, n, rows * len(gains)).reshape(rows, len(gains))
    gain = counts @ gains
    gain[:, 0] = -np.inf  # the end's own
    return np.argmax(gain, axis=1)


def _flat(lists):
    """(row, value) of a column of lists without nulls."""
    ends = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(ends)), lists.flatten().to_numpy(zero_copy_only=False)


def _place_head(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """(w, c): the class of each word of (w, code, n)."""
    gains = _gains(table)

    def run(batches):
        for batch in batches:
            row, code = _flat(batch.column("codes"))
            best = _best(row, code, _flat(batch.column("times"))[1], batch.num_rows, gains)
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(best, pa.int64())], ["w", "c"])
    sums = contexts.repartition("w").groupBy("w", "code").agg(F.sum("n").alias("n"))
    lists = sums.groupBy("w").agg(F.collect_list(F.struct("code", "n")).alias("x"))
    return lists.select("w", F.col("x.code").alias("codes"), F.col("x.n").alias("times")).mapInArrow(
        run, "w long, c long")


def _place_tail(tail: DataFrame, more: DataFrame, table: np.ndarray, classes) -> DataFrame:
    """``tail`` with new classes, from its neighbours and the (word, codes) of
    ``more``."""
    gains, k = _gains(table), len(table)

    def run(batches):
        place = classes.value
        for batch in batches:
            row, other = _flat(batch.column("others"))
            code = place[np.abs(other) - 1] + k * (other > 0)
            row2, code2 = _flat(batch.column("codes"))
            best = _best(np.concatenate([row, row2]).astype(np.int64),
                         np.concatenate([code, code2]).astype(np.int64), None, batch.num_rows, gains)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(best, pa.int64()),
                 batch.column("others")], ["word", "n", "c", "others"])
    none = F.expr("cast(array() as array<bigint>)")
    return tail.join(more, "word", "left").select(
        "word", "n", "others", F.coalesce("codes", none).alias("codes")).mapInArrow(
        run, "word string, n long, c long, others array<long>")


def _lost(encoded: DataFrame, *more: str, other: str = "other"):
    """(word and known neighbour, two words) of the words outside the head."""
    one = encoded.select(*more, F.explode(F.arrays_zip("word", other)).alias("x")).select(
        *more, "x.word", f"x.{other}")
    two = encoded.select(*more, F.explode(F.arrays_zip("a", "b")).alias("x")).select(*more, "x.a", "x.b")
    return one, two


def _tail_pairs(classes, k: int):
    """Function from (c, others) to (c, d, n): class bigrams of a word outside
    the head and a head word."""
    def run(batches):
        place, sums = classes.value, np.zeros(k * k, np.int64)
        for batch in batches:
            row, other = _flat(batch.column("others"))
            own, near = batch.column("c").to_numpy()[row], place[np.abs(other) - 1]
            sums += np.bincount(np.where(other > 0, own * k + near, near * k + own).astype(np.int64),
                                minlength=k * k)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at // k, pa.int64()), pa.array(at % k, pa.int64()),
                                          pa.array(sums[at], pa.int64())], ["c", "d", "n"])
    return run


def place_words(train: DataFrame, model: dict, tail: DataFrame, rounds: int = 2,
                prior: float = 10.0) -> tuple[dict, DataFrame]:
    """``model`` with a class for every training word (``head_class`` for the
    head), and the table (word, n, c) of the others.  ``train`` is ``ENCODED``,
    ``tail`` has the counted words outside the head: rare ones, so a word's
    neighbours fit in its row."""
    context = train.sparkSession.sparkContext
    k, n_units, head = len(model["pair"]), model["n_units"], model["head"]
    rest = Suffixes(1 + n_units)
    unit = [0] + [i if i <= n_units else rest[w[-2:]] for i, w in enumerate(head, 1)]
    classes = model["place"][np.array(unit, np.int64)]
    table, ids = model["pair"], train.select("ids")
    one, two = _lost(train)
    near = one.groupBy("word").agg(F.collect_list("other").alias("others"))
    tail = stage(tail.join(near, "word", "left").select(
        "word", "n", suffix_class(F.col("word"), model).cast("long").alias("c"),
        F.coalesce("others", F.expr("cast(array() as array<bigint>)")).alias("others")), "tail", "zstd")
    two = stage(two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "two", "zstd")
    for r in range(rounds + 1):
        sent = context.broadcast(classes)
        c = tail.select("word", "c")
        both = two.join(c.withColumnsRenamed({"word": "a", "c": "ca"}), "a").join(
            c.withColumnsRenamed({"word": "b", "c": "cb"}), "b")
        both = stage(both, "both", "zstd")
        if r:
            pairs = ids.mapInArrow(_known_pairs(sent, k), "c long, d long, n long").unionByName(
                tail.select("c", "others").mapInArrow(_tail_pairs(sent, k), "c long, d long, n long")
            ).unionByName(both.select(F.col("ca").alias("c"), F.col("cb").alias("d"), "n"))
            table = np.zeros((k, k))
            for x in pairs.groupBy("c", "d").agg(F.sum("n").alias("n")).collect():
                table[x.c, x.d] = x.n
        if r == rounds:
            break
        # A known neighbour has the word on its other side.
        other = tail.select("c", F.explode("others").alias("o")).select(
            (F.abs("o") - 1).alias("w"), (F.col("c") + F.when(F.col("o") > 0, 0).otherwise(k)).alias("code"),
            F.lit(1).cast("long").alias("n"))
        of_head = ids.mapInArrow(_known_contexts(sent, k, n_units), "w long, code long, n long").unionByName(
            other.where(F.col("w") > n_units).groupBy("w", "code").agg(F.sum("n").alias("n")))
        placed = _place_head(of_head, table).toArrow()
        of_tail = both.select(F.col("a").alias("word"), F.expr(f"array_repeat(cb + {k}, cast(n as int))").alias("x")
                              ).unionByName(both.select(F.col("b").alias("word"),
                                                        F.expr("array_repeat(ca, cast(n as int))").alias("x")))
        of_tail = of_tail.groupBy("word").agg(F.flatten(F.collect_list("x")).alias("codes"))
        tail = stage(_place_tail(tail, of_tail, table, sent), "tail", "zstd")
        classes = classes.copy()
        classes[placed.column("w").to_numpy()] = placed.column("c").to_numpy()
        # Spark drops the shuffle files of a round once its plans are collected.
        del both, other, of_head, of_tail
        context._jvm.System.gc()
    size = table.sum(axis=0)
    distinct = np.bincount(classes[1:], minlength=k)
    distinct[0] += int(size[0] > 0)
    for x in tail.groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect():
        distinct[x.c] += x.k
    share = (size + 1.0) / (size.sum() + k)
    move = (table + prior * share) / (table.sum(axis=1, keepdims=True) + prior)
    return model | {"head_class": classes, "pair": table, "move": log10(move),
                    "emit": log10(size + ADD * (distinct + 1))}, tail.select("word", "n", "c")


def _score_texts(model):
    """Function from ``ENCODED`` to ``SCORED``: what the head words add."""
    def run(batches):
        m = model.value
        place, k = m["head_class"], len(m["emit"])
        amount = log10(np.concatenate(([m["end"]], m["count"])) + ADD)
        for batch in batches:
            rows = {c: [] for c in ("n_tokens", "known", "base", "model", "n_tail")}
            for x in batch.column("ids").to_pylist():
                line = np.concatenate(([0], np.frombuffer(x, np.int32), [0]))
                at = line[1:][line[1:] >= 0]
                both = (line[:-1] >= 0) & (line[1:] >= 0)
                n, known = len(line) - 1, float(amount[at].sum())
                rows["n_tokens"].append(n)
                rows["known"].append(len(at) - (m["end"] == 0))
                rows["base"].append(known - n * m["base"])
                rows["model"].append(
                    known + float(m["move"][place[line[:-1][both]], place[line[1:][both]]].sum())
                    - float(m["emit"][place[at]].sum()))
                rows["n_tail"].append(n - len(at))
            other = batch.column("other")
            near = other.flatten().to_numpy(zero_copy_only=False)
            code = place[np.abs(near) - 1] + k * (near > 0)
            ends = other.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "text_key", "held_out")]
                + [pa.array(rows[c], pa.int64()) for c in ("n_tokens", "known")]
                + [pa.array(rows[c], pa.float64()) for c in ("base", "model")]
                + [pa.array(rows["n_tail"], pa.int64()), batch.column("word"),
                   pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()),
                                            pa.array(code, pa.int64())),
                   batch.column("a"), batch.column("b")],
                ["doc_id", "text_key", "held_out", "n_tokens", "known", "base", "model", "n_tail",
                 "word", "code", "a", "b"])
    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5,
                held_fold: int = 1, rounds: int = 2, **options) -> DataFrame:
    """Train on the documents outside the held-out fold and score all: one row
    per document with ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities)."""
    short_batches()
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       (split_number(F.col(doc_id), folds) == held_fold).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = stage(count_words(train), "counts", "zstd")
    model = fit(train, counts, **options)
    encoded = stage(rows.select("doc_id", F.xxhash64("text").alias("text_key"), "held_out", "text")
                    .mapInArrow(_encode(context.broadcast(model["head"])), ENCODED), "encoded", "zstd")
    fewest = int(model["count"].min()) if len(model["count"]) else None
    tail = counts if fewest is None else counts.where(F.col("n") < fewest)
    model, words = place_words(encoded.where(~F.col("held_out")), model, tail, rounds)
    scored = stage(encoded.mapInArrow(_score_texts(context.broadcast(
        {c: model[c] for c in ("head_class", "count", "end", "base", "move", "emit")})), SCORED), "scored", "zstd")
    key, k = ["doc_id", "text_key"], len(model["emit"])
    one, two = _lost(scored, *key, other="code")
    numbers = lambda x: F.expr("array(%s)" % ", ".join(f"{v!r}D" for v in x.reshape(-1).tolist()))
    move = lambda c, d: F.element_at(numbers(model["move"]), (c * k + d + 1).cast("int"))
    emit = lambda c: F.element_at(numbers(model["emit"]), (c + 1).cast("int"))

    def classed(df, name):
        """With ``n_name`` and ``c_name`` of the word ``name``."""
        found = words.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"),
                             F.col("c").alias(f"c_{name}"))
        return df.join(found, name, "left").withColumn(
            f"c_{name}", F.coalesce(f"c_{name}", suffix_class(F.col(name), model)))
    # Each word outside the head has one neighbour before it: there it counts.
    one, two = classed(one, "word"), classed(classed(two, "a"), "b")
    first = F.col("code") < k
    amount = lambda n: F.log10(F.coalesce(n, F.lit(0)) + ADD)
    found = one.select(
        *key, first.cast("long").alias("k"), (first & F.col("n_word").isNotNull()).cast("long").alias("known_k"),
        F.when(first, amount("n_word")).otherwise(0.0).alias("amount"),
        F.when(first, move(F.col("code"), F.col("c_word")) - emit(F.col("c_word")))
        .otherwise(move(F.col("c_word"), F.col("code") - k)).alias("moved")).unionByName(two.select(
            *key, F.lit(1).cast("long").alias("k"), F.col("n_b").isNotNull().cast("long").alias("known_k"),
            amount("n_b").alias("amount"),
            (move(F.col("c_a"), F.col("c_b")) - emit(F.col("c_b"))).alias("moved")))
    # Rows of the same id and text add up; each gets its share.
    sums = found.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("amount", "moved", "known_k")],
                                   F.sum("k").alias("all_k")).withColumnsRenamed(
        {"doc_id": "i", "text_key": "t"})
    out = scored.drop("word", "code", "a", "b").join(
        sums, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("t")), "left")
    share = F.when(F.col("all_k") > 0, F.col("n_tail") / F.col("all_k")).otherwise(0.0)
    extra = F.coalesce(F.col("amount") * share, F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce(F.round(F.col("known_k") * share), F.lit(0)).cast("long"))
        .alias("n_known"), F.lit(model["N"]).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("model") + extra + F.coalesce(F.col("moved") * share, F.lit(0.0))).alias("score"))
