"""Summaries and review helpers.

All of them are partial aggregates, semi/anti joins or per-row expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, TriageConfig, UNDECIDED


def day_summary(labelled: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """A3: per day, decided (similar >= 0, which includes representatives and
    singletons -- the number the reference prints as "removed"), undecided,
    total, and the rows truly removed (pointing to another row)."""
    s, r = F.col("similar"), F.col(cfg.row_id)
    return labelled.groupBy(cfg.day).agg(
        F.count_if(s >= 0).alias("decided"),
        F.count_if(s < 0).alias("undecided"),
        F.count(F.lit(1)).alias("total"),
        F.count_if((s != UNDECIDED) & (s != r)).alias("removed"))


def undecided_per_case(labelled: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """A5: undecided rows per (day, case)."""
    return (labelled.groupBy(cfg.day, cfg.key)
            .agg(F.count_if(F.col("similar") == UNDECIDED).alias("n_undecided")))


def distinct_cases(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """A2: number of distinct cases per day."""
    return df.groupBy(cfg.day).agg(F.count_distinct(cfg.key).alias("n_cases"))


def cases_first_seen(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """O2: cases in first-appearance order (``first_row`` is the sort key)."""
    return df.groupBy(cfg.day, cfg.key).agg(F.min(cfg.row_id).alias("first_row"))


def case_sizes(prev_f: DataFrame, cur_f: DataFrame, cases: DataFrame,
               cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Rows per eligible case yesterday and today."""
    k_ = cfg.key
    n_prev = prev_f.groupBy(k_).agg(F.count(F.lit(1)).alias("n_prev"))
    n_cur = cur_f.groupBy(k_).agg(F.count(F.lit(1)).alias("n_cur"))
    return cases.select(k_).join(n_prev, k_).join(n_cur, k_)


def repeated_cases(one: DataFrame, other: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Rows of ``one`` whose case also occurs in ``other``."""
    return one.join(other.select(cfg.key), cfg.key, "left_semi")


def new_cases(cur: DataFrame, prev: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """J6 (key level): today's rows whose case did not occur yesterday."""
    return cur.join(prev.select(cfg.key), cfg.key, "left_anti")


def cross_day_summary(matched: DataFrame) -> DataFrame:
    """A4: rows matched to yesterday, new rows, total."""
    m = F.col("match_row")
    return matched.agg(F.count_if(m >= 0).alias("matched"),
                       F.count_if(m < 0).alias("new"),
                       F.count(F.lit(1)).alias("total"))


def key_difference(raw: DataFrame, kept: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Cases of ``raw`` missing from ``kept`` (empty after filtering: every
    case keeps at least one row)."""
    keys = [cfg.day, cfg.key]
    return raw.select(*keys).distinct().join(kept.select(*keys), keys, "left_anti")


def review_highlight(df: DataFrame, column: str, value=UNDECIDED, color: str = "red") -> DataFrame:
    """The style every cell of a row gets when ``column`` equals ``value``."""
    style = F.when(F.col(column) == F.lit(value), F.lit(f"background-color: {color}")).otherwise(F.lit(""))
    return df.withColumn("row_style", style)
