"""Within-day labelling.

``label_similar`` adds two columns to a notice table:

* ``noccur``  -- how many rows of the same day carry the same case key;
* ``similar`` -- the row id of the row that represents this one, or -1 when
  the row could not be decided and needs human review.

Exact copies are grouped by a content fingerprint with a partial aggregate,
so a case or a text repeated millions of times never lands in one task; the
per-row facts come back through one equi-join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, TriageConfig, UNDECIDED
from ..functions.text import fingerprint
from .nearcopy import _cut, _dealt, near_copy_labels

_FP = "_fp"


def _with_fp(df: DataFrame, cfg: TriageConfig) -> DataFrame:
    # Null texts share one impossible fingerprint (no bytes) so that the
    # equi-join below matches them; they are never treated as copies.
    return df.withColumn(_FP, F.coalesce(fingerprint(F.col(cfg.text)), F.lit(b"")))


def duplicate_row_ids(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Row ids used more than once in a day (labels assume none); one
    partial aggregate, so it is an explicit check rather than a hidden cost."""
    return (df.groupBy(cfg.day, cfg.row_id).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def split_null_keys(df: DataFrame, cfg: TriageConfig = DEFAULT):
    """Rows without a day, a row id or a case key cannot be grouped or named:
    (kept, rejected with the first ``reason`` of these)."""
    reason = F.lit(None).cast("string")
    for column, name in ((cfg.key, "null_key"), (cfg.row_id, "null_row_id"), (cfg.day, "null_day")):
        reason = F.when(F.col(column).isNull(), F.lit(name)).otherwise(reason)
    return df.where(reason.isNull()), df.where(reason.isNotNull()).withColumn("reason", reason)


def rejected_notices(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """The rows ``label_similar`` does not label, with a ``reason``: no day,
    row id or key, or a null text in a repeated case."""
    kept, rejected = split_null_keys(df, cfg)
    repeated = (kept.groupBy(cfg.day, cfg.key).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).drop("_n"))
    no_text = kept.where(F.col(cfg.text).isNull()).join(repeated, [cfg.day, cfg.key], "left_semi")
    return rejected.unionByName(no_text.select(*df.columns).withColumn("reason", F.lit("null_text")))


def copy_facts(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """A1 + W2 facts per row: noccur, exact_leader, n_exact.

    One partial aggregate per (day, key, fingerprint), a second one per
    (day, key) over that much smaller table, and a single join back.
    """
    d, k_, r = cfg.day, cfg.key, cfg.row_id
    rows = _with_fp(df, cfg)
    # Materialised (no text, one row per distinct text) so the texts are
    # scanned and hashed once for it, not once per branch that reads it.
    per_text = _cut(rows.groupBy(d, k_, _FP)
                    .agg(F.min(r).alias("exact_leader"), F.count(F.lit(1)).alias("n_exact")))
    per_case = per_text.groupBy(d, k_).agg(F.sum("n_exact").alias("noccur"))
    facts = per_text.join(per_case, [d, k_])
    return rows.join(facts, [d, k_, _FP])


def case_frequency(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """A1: number of rows of the same (day, key), added to every row (rows
    without a day or key count together)."""
    d, k_ = cfg.day, cfg.key
    counts = df.groupBy(F.col(d).alias("_day"), F.col(k_).alias("_case")).agg(
        F.count(F.lit(1)).alias("noccur"))
    return df.join(counts, F.col(d).eqNullSafe(F.col("_day"))
                   & F.col(k_).eqNullSafe(F.col("_case"))).drop("_day", "_case")


def exact_copy_leaders(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """W1 + W2: singletons represent themselves; exact-copy groups of two or
    more take their smallest row id; everything else is -1 (not yet
    decided), rows without a day, id or key among it (their ``noccur`` is null)."""
    kept, rejected = split_null_keys(df, cfg)
    facts = copy_facts(kept, cfg)
    sim = (F.when(F.col("noccur") == 1, F.col(cfg.row_id))
           .when(F.col(cfg.text).isNotNull() & (F.col("n_exact") >= 2), F.col("exact_leader"))
           .otherwise(F.lit(UNDECIDED)).cast("bigint"))
    facts = facts.withColumn("similar", sim).drop(_FP, "exact_leader", "n_exact")
    return facts.unionByName(rejected.drop("reason").withColumns({
        "noccur": F.lit(None).cast("bigint"), "similar": F.lit(UNDECIDED).cast("bigint")}))


def label_similar_with_rejects(df: DataFrame, cfg: TriageConfig = DEFAULT):
    """(labelled, rejected).

    ``labelled`` = input rows + ``noccur`` + ``similar``.  ``rejected`` holds
    rows with a null day, row id or key, and rows with a null text in a repeated case (their
    case still counts them in ``noccur``).
    """
    cfg.check(df)
    d, k_, r, t = cfg.day, cfg.key, cfg.row_id, cfg.text
    cols = df.columns
    kept, rejected_keys = split_null_keys(df, cfg)
    # Ids, counts and hashes, materialised once: the decided rows, the residue
    # and the rejects all read it.  Texts and other columns come back by row id.
    facts = _cut(copy_facts(kept.select(d, k_, r, t), cfg)
                 .select(d, r, "noccur", "exact_leader", "n_exact", F.col(t).isNull().alias("_no_text")))
    no_text = F.col("_no_text") & (F.col("noccur") > 1)
    rejected = rejected_keys.unionByName(
        kept.join(facts.where(no_text).select(d, r), [d, r], "left_semi").select(*cols)
        .withColumn("reason", F.lit("null_text")))
    facts = facts.where(~no_text)

    decided = facts.where((F.col("noccur") == 1) | (F.col("n_exact") >= 2)).select(
        d, r, "noccur", F.when(F.col("noccur") == 1, F.col(r)).otherwise(F.col("exact_leader"))
        .cast("bigint").alias("similar"))
    left = facts.where((F.col("noccur") > 1) & (F.col("n_exact") == 1)).select(d, r, "noccur")
    residue = kept.select(d, k_, r, t).join(left.select(d, r), [d, r], "left_semi")
    near = near_copy_labels(residue, cfg).join(_dealt(left), [d, r]).select(*decided.columns)
    return kept.join(decided.unionByName(near), [d, r]).select(*cols, "noccur", "similar"), rejected


def label_similar(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """The labelled half of ``label_similar_with_rejects``; ``rejected_notices``
    is the other half."""
    return label_similar_with_rejects(df, cfg)[0]


def representatives(labelled: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Rows some row points to -- exactly the rows pointing to themselves."""
    return labelled.where(F.col("similar") == F.col(cfg.row_id))


def undecided(labelled: DataFrame) -> DataFrame:
    """Rows left for review."""
    return labelled.where(F.col("similar") == UNDECIDED)


def filtered(labelled: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Representatives and undecided rows, with the O1 order key
    ``undecided_flag`` (0 = representative) kept as a column."""
    return (labelled.where((F.col("similar") == F.col(cfg.row_id))
                           | (F.col("similar") == UNDECIDED))
            .withColumn("undecided_flag", (F.col("similar") == UNDECIDED).cast("int")))


def decided_flag(labelled: DataFrame) -> DataFrame:
    """P5: whole-field predicate similar >= 0."""
    return labelled.withColumn("decided", F.col("similar") >= 0)
