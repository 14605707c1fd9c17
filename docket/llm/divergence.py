"""Source divergence audit by one-hot level products.

How far does each source of a language stray from each other source, and by
which terms?  A term is kept in a language if at least ``min_docs`` of its
documents hold it.  A group's price of a term depends on the term's count in
the group alone, so the sum over all kept terms of a pair of groups is a sum
over their *joint table*: how many terms have level (count) x in one group and
level y in the other.

With one indicator column for each (group, level above 0) and one row for each
kept term, the matrix times its own transpose holds the joint tables of all
pairs of groups of a language at once.  Tasks multiply it block by block:
consecutive terms (in order of their total, so that a block has few levels) up
to ``MAX_COLUMNS`` columns or ``MAX_TERMS`` rows.  A block's sums stay far
below 2^24, so single-precision products are exact; the blocks' tables are
added in 64-bit integers.

Cells of level 0 are not built.  With p(x) the price of level x in group A,
q(y) in B, f their divergence, J the joint table above level 0, and HA, HB how
many terms have each level, the sum over all V terms is, exactly::

    V f(p0, q0) + sum_x HA(x) (f(px, q0) - f(p0, q0)) + sum_y HB(y) (f(p0, qy) - f(p0, q0))
      + sum_xy J(x, y) (f(px, qy) - f(px, q0) - f(p0, qy) + f(p0, q0))

Prices are integers: ``1 + (10^9 (count + 1)) div (N + V)`` and ``f(p, q) =
(p - q)^2 div q``, summed as decimals of 38 digits.

Nulls in text, language and source are empty strings (an ordinary value);
every row counts as a document, repeated or not; ties are ranked by the item's
UTF-8 bytes.  Texts without terms still make their group.  A long text is cut
into parts between terms.  Extra columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_words, pieces, short_batches, small, stage

#: A byte that is in no term (of a text whose A-Z are lower-cased).
GAP = re.compile(rb"[^a-z\x80-\xff]")
GROUP_BYTES = 12 << 20
MAX_COLUMNS, MAX_TERMS = 1024, 8192
SCALE = 1_000_000_000
CELLS = "lang string, a string, x long, b string, y long, n long"


def _rows(keys: list[tuple[str, str]], texts: list[bytes], seen: np.ndarray | None = None):
    """Counts (lang, source, term, n, d) of some texts of (lang, source), and
    the hashes of their terms.  ``seen``: terms that do not count as new to
    their document."""
    word_byte = np.zeros(256, bool)
    word_byte[ord("a"):ord("z") + 1] = word_byte[0x80:] = True
    buf = b"\n".join(texts)
    h, s, e = hashed_words(buf, word_byte)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begin, s, side="right") - 1
    code, distinct = pd.factorize(h)
    first = np.zeros(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    terms = pa.array([buf[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())], pa.binary()).cast(pa.string())
    groups = list(dict.fromkeys(keys))
    number = {g: i for i, g in enumerate(groups)}
    group = np.array([number[k] for k in keys], np.int64)
    width = max(1, len(distinct))
    pair, times = np.unique(doc * width + code, return_counts=True)  # (document, term)
    place, entry = np.unique(group[pair // width] * width + pair % width, return_inverse=True)
    n = np.bincount(entry, times, len(place)).astype(np.int64)
    d = np.bincount(entry, minlength=len(place)).astype(np.int64)
    if seen is not None:
        d[np.isin(distinct[place % width], seen)] = 0
    at = pa.array(place // width)
    name = lambda i: pa.array([g[i] for g in groups], pa.string()).take(at)
    return pa.RecordBatch.from_pydict({
        "lang": name(0), "source": name(1), "term": terms.take(pa.array(place % width)),
        "n": pa.array(n), "d": pa.array(d)}), distinct


def _counted(batches):
    """(lang, source, term, n, d): occurrences and documents of a term in the
    rows read, summed over ``GROUP_BYTES`` of text at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(),
                                      batch.column("source").to_pylist(), batch.column("text")):
            raw = text.as_py().encode().lower()
            if len(raw) > GROUP_BYTES:  # a document in parts
                seen = np.zeros(0, np.uint64)
                for part in pieces(raw, GAP, GROUP_BYTES):
                    rows, new = _rows([(lang, source)], [part], seen)
                    seen = np.union1d(seen, new)
                    yield rows
                continue
            keys.append((lang, source))
            texts.append(raw)
            size += len(raw)
            if size > GROUP_BYTES:
                yield _rows(keys, texts)[0]
                keys, texts, size = [], [], 0
    if texts:
        yield _rows(keys, texts)[0]


def kept_terms(rows: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, term, total, held) of the kept terms; ``held`` lists (source, n)
    of the groups that hold it, at most one entry a source of the language."""
    short_batches()
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    # One shuffle, by language and term, serves both groupings.
    by_group = (counts.repartition("lang", "term").groupBy("lang", "term", "source")
                .agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    return (by_group.groupBy("lang", "term")
            .agg(F.sum("n").alias("total"), F.sum("d").alias("docs"),
                 F.collect_list(F.struct("source", "n")).alias("held"))
            .where(F.col("docs") >= min_docs).drop("docs"))


def _product(lang: str, held: list[list[dict]]) -> pa.RecordBatch:
    """The joint tables of one block of terms: its indicator matrix, transposed,
    times itself.  Only cells of two sources, the lesser first."""
    columns = sorted({(h["source"], h["n"]) for hs in held for h in hs})
    place = {c: i for i, c in enumerate(columns)}
    one_hot = np.zeros((len(held), len(columns)), np.float32)
    for i, hs in enumerate(held):
        one_hot[i, [place[h["source"], h["n"]] for h in hs]] = 1
    names = sorted({c[0] for c in columns})
    number = {s: i for i, s in enumerate(names)}
    source = np.array([number[c[0]] for c in columns], np.int32)
    level = np.array([c[1] for c in columns], np.int64)
    table = one_hot.T @ one_hot
    a, b = np.nonzero(table)
    two = source[a] < source[b]
    a, b = a[two], b[two]
    text = lambda at: pa.DictionaryArray.from_arrays(
        pa.array(source[at]), pa.array(names, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang] * len(a), pa.string()), "a": text(a), "x": pa.array(level[a]),
        "b": text(b), "y": pa.array(level[b]), "n": pa.array(table[a, b].astype(np.int64))})


def _products(batches):
    lang, held, columns = None, [], set()
    for batch in batches:
        for row in batch.to_pylist():
            new = {(h["source"], h["n"]) for h in row["held"]}
            if held and (row["lang"] != lang or len(held) == MAX_TERMS
                         or len(columns | new) > MAX_COLUMNS):
                yield _product(lang, held)
                held, columns = [], set()
            lang = row["lang"]
            held.append(row["held"])
            columns |= new
    if held:
        yield _product(lang, held)


def joint_tables(kept: DataFrame) -> DataFrame:
    """(lang, a, x, b, y, n): ``n`` kept terms occur ``x`` times in source
    ``a`` and ``y`` times in source ``b`` (a before b, x and y above 0)."""
    rows = kept.select("lang", "total", "held").sortWithinPartitions("lang", "total")
    blocks = rows.select("lang", "held").mapInArrow(_products, CELLS)
    return blocks.groupBy("lang", "a", "x", "b", "y").agg(F.sum("n").alias("n"))


def price(count: Column, total: Column, kept: Column) -> Column:
    whole = F.lit(SCALE).cast("decimal(12,0)") * (count + 1)
    return (F.lit(1) + F.call_function("div", whole, (total + kept).cast("decimal(20,0)"))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _times(n: Column, value: Column) -> Column:
    return n.cast("decimal(19,0)") * value.cast("decimal(19,0)")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its divergence
    from every other source of its language (part ``pair``), and the terms it
    uses more than its language does (part ``term``, to ``top_terms``)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), name(text).alias("text"))
    kept = stage(kept_terms(rows, min_docs), "kept_terms")
    each = kept.select("lang", "term", "total", F.explode("held").alias("h")).select(
        "lang", "term", "total", "h.source", "h.n")
    languages = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = stage(
        rows.select("lang", "source").distinct().join(languages, "lang", "left")
        .join(sums, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "group_n"]), "groups")
    n_groups = groups.count()
    levels = stage(each.groupBy("lang", "source", F.col("n").alias("x")).agg(
        F.count("*").alias("h")), "levels")

    side = lambda s, by: small(groups.select(
        "lang", F.col("source").alias(by), F.col("group_n").alias(f"{s}_n"), F.col("v").alias(f"{s}_v"),
        price(F.lit(0), F.col("group_n"), F.greatest("v", F.lit(1))).alias(f"{s}0")), n_groups)
    p = lambda s, x: price(F.col(x), F.col(f"{s}_n"), F.col(f"{s}_v"))
    out = lambda df, of, item, value: df.select(
        "lang", F.col(of).alias("source"), F.col(item).alias("item"), value.alias("value"))
    f, p0, q0 = divergence, F.col("p0"), F.col("q0")

    pairs = side("p", "a").join(side("q", "b"), "lang").where("a <> b")
    own = levels.withColumnRenamed("source", "a").join(side("p", "a"), ["lang", "a"]).join(
        side("q", "b"), "lang").where("a <> b").withColumn("px", p("p", "x"))
    cells = (stage(joint_tables(kept), "joint_tables").join(side("p", "a"), ["lang", "a"])
             .join(side("q", "b"), ["lang", "b"]).withColumn("px", p("p", "x")).withColumn("qy", p("q", "y")))
    px, qy = F.col("px"), F.col("qy")
    zero = F.lit(0).cast("decimal(38,0)")
    parts = [
        out(pairs, "a", "b", F.when(F.col("p_v") > 0, _times(F.col("p_v"), f(p0, q0))).otherwise(zero)),
        out(own, "a", "b", _times(F.col("h"), f(px, q0) - f(p0, q0))),
        out(own, "b", "a", _times(F.col("h"), f(q0, px) - f(q0, p0))),
        out(cells, "a", "b", _times(F.col("n"), f(px, qy) - f(px, q0) - f(p0, qy) + f(p0, q0))),
        out(cells, "b", "a", _times(F.col("n"), f(qy, px) - f(qy, p0) - f(q0, px) + f(q0, p0)))]
    values = parts[0]
    for x in parts[1:]:
        values = values.unionByName(x)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = (values.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
            .withColumn("rank", F.row_number().over(order)))

    totals = small(groups.select("lang", "source", "group_n", "lang_n", "v"), n_groups)
    priced = (each.join(totals, ["lang", "source"])
              .withColumn("p", price(F.col("n"), F.col("group_n"), F.col("v")))
              .withColumn("q", price(F.col("total"), F.col("lang_n"), F.col("v"))).where("p > q"))
    term = (priced.select("lang", "source", F.col("term").alias("item"),
                          f(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    return (pair.withColumn("part", F.lit("pair")).unionByName(term.withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))
