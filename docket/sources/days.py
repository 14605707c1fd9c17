"""Day tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, TriageConfig, UNDECIDED
from ..operators.ranking import rank_within


def read_days(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """One or many day tables; with a ``dia=...`` folder layout the day
    comes from the path (partition pruning applies)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.options(**options).load(path)


def read_days_checked(spark: SparkSession, path: str, schema: str | T.StructType, cfg: TriageConfig = DEFAULT,
                      fmt: str = "csv", days: list | None = None, **options):
    """S1 with a schema contract: (good, rejected) rows of text files (CSV with
    a header, or JSON lines) in ``day=...`` folders.

    ``schema`` names and types the columns of a file.  A line that does not
    fit it (a value of another type, too few or too many fields) is rejected
    as ``bad_line`` with the whole line in ``line``; a line without a key or
    row id as ``null_key`` or ``null_row_id``; nothing is dropped.  ``days``
    reads the folders of those days alone.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*fields.fields, T.StructField("_line", T.StringType())])
    reader = (spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
              .option("enforceSchema", "true"))
    if fmt == "csv":
        reader = reader.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "false")
    rows = reader.options(**options).format(fmt).load(path)
    if days is not None:
        rows = rows.where(F.col(cfg.day).isin(list(days)))
    # A reader converts only the columns that are used, and a line is bad for any
    # of them: so all are (no value holds that text).
    every = F.concat_ws("\0", *[F.col(f.name).cast("string") for f in fields.fields]) == F.lit("\1\0\1")
    reason = (F.when(F.col("_line").isNotNull() | every, F.lit("bad_line"))
              .when(F.col(cfg.row_id).isNull(), F.lit("null_row_id"))
              .when(F.col(cfg.key).isNull(), F.lit("null_key")))
    rows = rows.withColumn("reason", reason)
    good = rows.where(F.col("reason").isNull()).drop("_line", "reason")
    return good, rows.where(F.col("reason").isNotNull()).withColumnRenamed("_line", "line")


def write_checked(labelled: DataFrame, path: str, cfg: TriageConfig = DEFAULT) -> dict:
    """S4, S5, A8 as one repeatable step: write labelled notices by day and say
    what was written.

    The counts (rows, decided, undecided, removed, representatives) are
    gathered by the pass that writes, and the days written are read back and
    counted; a difference raises.  Only the days present in ``labelled`` are
    replaced, so a rerun gives the same table and leaves other days alone.
    """
    similar, r = F.col("similar"), F.col(cfg.row_id)
    seen = Observation()
    counts = {"rows": F.count(F.lit(1)), "decided": F.count_if(similar >= 0),
              "undecided": F.count_if(similar == UNDECIDED),
              "removed": F.count_if((similar >= 0) & (similar != r)), "representatives": F.count_if(similar == r)}
    spark = labelled.sparkSession
    (labelled.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(cfg.day).parquet(path))
    told = seen.get
    stored = spark.read.parquet(path).join(
        labelled.select(F.col(cfg.day).alias("_day")).distinct(), F.col(cfg.day) == F.col("_day"), "left_semi")
    found = stored.agg(*[c.alias(n) for n, c in counts.items()]).first().asDict()
    if found != told:
        raise RuntimeError(f"wrote {told}, read {found}")
    return told


def assign_row_ids(df: DataFrame, order_col: str, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """S3: 0-based contiguous row id per day in ``order_col`` order (an
    integer position such as the file line).  Chunked ranking keeps a large
    day spread over many tasks; never ``monotonically_increasing_id``."""
    return rank_within(df, [cfg.day], order_col, out=cfg.row_id)


def write_days(df: DataFrame, path: str, cfg: TriageConfig = DEFAULT, mode: str = "errorifexists") -> None:
    """Parquet partitioned by day; refuses to overwrite by default."""
    df.write.mode(mode).partitionBy(cfg.day).parquet(path)


def write_labelled_and_filtered(labelled: DataFrame, filtered: DataFrame, base: str,
                                cfg: TriageConfig = DEFAULT, mode: str = "errorifexists") -> None:
    """The two day outputs, ``labelled`` and ``filtered``."""
    write_days(labelled, f"{base}/labelled", cfg, mode)
    write_days(filtered, f"{base}/filtered", cfg, mode)
