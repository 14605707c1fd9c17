"""Position of a row inside its group without sending a whole group to one task.

``row_number() OVER (PARTITION BY group ORDER BY id)`` sorts every group in a
single task; a case holding a third of the data would then be one task.  Here
a group of more than ``chunk`` rows is cut at quantiles of its own ids (an
approximate percentile, a partial aggregate: any cut is right, it only has to
balance), each piece is ranked on its own, and a piece's offset comes from a
prefix sum over the counts of its group's pieces, at most ``PIECES`` of them
however the ids are spread.  A group has a piece for every ``chunk`` of its
rows, and a row finds its piece by binary search, so a row costs no more in a
large group than in a small one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1 << 16
PIECES = 1024


def _lookup(rows: DataFrame, keys: list[str], table: DataFrame, value: str) -> DataFrame:
    """``rows`` with the ``value`` of their ``keys``; null keys match too, so no
    row is lost."""
    table = table.select(value, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(keys)])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    return rows.join(table, same).drop(*[f"_o{i}" for i in range(len(keys))])


def _cuts(keys: DataFrame, groups: list[str], order: str, chunk: int, pieces: int) -> DataFrame:
    """``_cuts`` of every group: ids at which it is cut, none for a group of at
    most ``chunk`` rows (ids of large groups alone are aggregated)."""
    sizes = keys.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > chunk)
    ranks = [i / pieces for i in range(1, pieces)]
    at = F.percentile_approx(order, ranks, 10 * pieces)
    none = F.array().cast("array<bigint>")
    cut = (_lookup(keys, groups, large, "_n").groupBy(*groups)
           .agg(F.coalesce(at, none).alias("_at"), F.count(F.lit(1)).alias("_n")))
    # As many of them, evenly, as the group needs for pieces of a chunk.
    wanted = F.least(F.ceil(F.col("_n") / chunk), F.lit(pieces)).cast("bigint")
    nth = lambda i: F.get("_at", F.floor(i * F.lit(pieces) / wanted).cast("int") - 1)
    some = F.array_distinct(F.transform(F.sequence(F.lit(1).cast("bigint"), wanted - 1), nth))
    cut = cut.select(*groups, F.when(F.size("_at") == 0, none).otherwise(some).alias("_cuts"))
    return cut.unionByName(sizes.where(F.col("_n") <= chunk).select(*groups, none.alias("_cuts")))


def _piece(order, cuts, pieces: int):
    """Number of cuts (fewer than ``pieces``) below an id, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((pieces - 1).bit_length()))])
    further = lambda at, step: (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) < order)
    return F.when(F.size(cuts) == 0, 0).otherwise(F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at)))


def rank_within(df: DataFrame, group_cols: list[str], order_col: str,
                out: str = "rank", chunk: int = DEFAULT_CHUNK,
                extra_order: list | None = None, pieces: int = PIECES) -> DataFrame:
    """0-based position of each row in its group by ``order_col`` (an integer,
    unique within the group; nulls come first).  ``extra_order`` columns, if
    given, sort before the order column (e.g. the O1 undecided flag)."""
    if chunk <= 0 or pieces <= 1:
        raise ValueError("chunk must be positive and pieces above one")
    extra = [f"_ck{i}" for i in range(len(extra_order or []))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(extra_order or [], extra)],
                     F.col(order_col).cast("bigint").alias("_order"))
    part = [*group_cols, *extra]
    cuts = _cuts(rows.select(*part, "_order"), part, "_order", chunk, pieces)
    placed = _lookup(rows, part, cuts, "_cuts").withColumn(
        "_piece", F.coalesce(_piece(F.col("_order"), F.col("_cuts"), pieces), F.lit(0))).drop("_cuts")
    local = placed.withColumn("_local", F.row_number().over(
        Window.partitionBy(*part, "_piece").orderBy("_order")) - 1)
    counts = placed.groupBy(*part, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*group_cols).orderBy(*extra, "_piece")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (_lookup(local, [*part, "_piece"], offsets, "_off")
            .withColumn(out, (F.col("_local") + F.col("_off")).cast("bigint"))
            .drop("_local", "_off", "_order", "_piece", *extra))
