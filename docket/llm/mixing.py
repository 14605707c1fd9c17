"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target of words.  Whole passes over the source make up
the integer part of target / size; the remainder is met by the documents
whose hash is below a threshold.  The threshold is found without sorting
documents: words are summed by source and hash bucket, running sums over the
buckets find the one where the budget ends, and only that bucket is split
into finer buckets, until it holds a single hash value, which is taken if that
comes closer to the target.  Thresholds grow with the budget, so a smaller
mix is part of a larger one, and reruns agree.

DataFrame functions only.  Nulls: a null text has size 0; a null source is a
source of its own, last in order; a null id hashes like the word ``null``.
Rows of the same id are taken or left together.  Sources without words have
target 0.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stage

HASH_BITS = 60
LEVEL_BITS = 15


def doc_hash(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of the id's MD5."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Id, source key (null: a key of its own), hash and size of each row."""
    return docs.select(F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")),
                                  F.lit("~")).alias("key"),
                       F.col(source).isNull().alias("last"),
                       doc_hash(F.col(doc_id)).alias("h"),
                       word_count(F.col(text)).alias("size"))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights that repeat over the sources in code-point order, null last
    (one row per source, so this one window stays small)."""
    rank = F.row_number().over(Window.orderBy("last", "key")) - 1
    each = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(each, (rank % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, budget: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """Add ``target``: ``budget`` times all sizes, shared by weight; a source
    stops at ``max_repeat`` times its size and the excess is shared anew.
    Equivalent to one water level: sources are filled in the order of
    capacity / weight, and those below the level are full."""
    cap = F.col("source_size") * F.lit(float(max_repeat))
    s = sources.withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("fill", "last", "key").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    s = (s.withColumn("cap_upto", F.sum("cap").over(upto))
         .withColumn("weight_after", F.sum("weight").over(every) - F.sum("weight").over(upto))
         .withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget))))
    s = s.withColumn("full", F.col("cap_upto") + F.col("fill") * F.col("weight_after")
                     <= F.col("total"))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    share = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(left / share * F.col("weight"))
    return s.withColumn("target", F.least(F.round(target, 6), F.col("cap"))).select(
        "key", "last", "weight", "source_size", "target")


def thresholds(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """For each source: whole ``passes`` and the hash ``threshold`` below
    which documents are taken once more."""
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                   ).otherwise(0).cast("long")
    p = plan.withColumn("passes", ratio).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size"))
    edge = p.where(F.col("rest") > 0).select(
        "key", "rest", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("unit"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")
        sums = (rows.join(small(edge, n_sources), "key").where(inside)
                .groupBy("key", "rest", "base", F.shiftright("h", shift).alias("bucket"))
                .agg(F.sum("size").alias("words")))
        run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = F.col("base") + F.sum("words").over(run)
        edge = (sums.withColumn("ends", ends)
                .where((F.col("ends") >= F.col("rest"))
                       & (F.col("ends") - F.col("words") < F.col("rest")))
                .select("key", "rest", (F.col("ends") - F.col("words")).alias("base"),
                        F.col("bucket").alias("prefix"), F.col("words").alias("unit")))
    closer = F.col("base") + F.col("unit") - F.col("rest") <= F.col("rest") - F.col("base")
    ends = edge.select("key", (F.col("prefix") + F.when(closer, 1).otherwise(0)).alias("threshold"))
    return (p.join(small(ends, n_sources), "key", "left")
            .select("key", "source_size", "target", "passes",
                    F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold")))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights=None, budget: float = 1.5, max_repeat: int = 2):
    """(rows, plan, number of sources): sized rows and the thresholds of their
    sources.  ``weights`` maps the table of sources (``key``, ``last``) to one
    with a column ``weight``; by default 3, 1, 2 repeat."""
    rows = stage(sized(docs, doc_id, text, source), "sizes")
    sources = rows.groupBy("key", "last").agg(F.sum("size").alias("source_size"))
    plan = stage(targets((weights or cyclic_weights)(sources), budget, max_repeat), "targets")
    n = plan.count()
    return rows, stage(thresholds(rows, plan, n), "thresholds"), n


def taken_copies() -> Column:
    return F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``,
    ``copies`` and ``taken`` (words the mix takes of it)."""
    rows, plan, n = mix_plan(docs, **options)
    return rows.join(small(plan, n), "key").select(
        "doc_id", "size", "source_size", "target", taken_copies().alias("copies"),
        (F.col("size") * taken_copies()).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
               **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it."""
    _, plan, n = mix_plan(docs, doc_id=doc_id, source=source, **options)
    p = plan.select(F.col("key").alias("__key"), F.col("passes").alias("__passes"),
                    F.col("threshold").alias("__threshold"))
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))
    copies = F.col("__passes") + F.when(doc_hash(F.col(doc_id)) < F.col("__threshold"), 1).otherwise(0)
    return (docs.withColumn("__key", key).join(small(p, n), "__key")
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
            .select(*docs.columns))
