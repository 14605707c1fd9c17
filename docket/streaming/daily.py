"""Daily batches as a stream.

Notices arrive as file drops.  This runs the same within-day labelling with
Structured Streaming: a file source picks up new Parquet files and
``foreachBatch`` labels the *whole days* the micro-batch touches -- all rows
of those days are read back from the source (a null-safe semi-join on the
days) -- and overwrites just those day partitions of the ``labelled``,
``filtered`` and ``rejected`` tables.  ``rejected`` holds the rows that cannot
be labelled, with their ``reason``; rows without a day are its null partition.
Every input row is in ``labelled`` or ``rejected``.  A day that arrives in several pieces
is therefore relabelled completely each time a piece lands, and a replayed
micro-batch rewrites the same days instead of duplicating rows.  The
reference has no streaming; this is only a way to feed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, TriageConfig
from ..operators.dedup import filtered, label_similar_with_rejects


def start_daily_labelling(spark: SparkSession, source_dir: str, out_dir: str,
                          checkpoint_dir: str, cfg: TriageConfig = DEFAULT,
                          schema=None, once: bool = False,
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Label every day that receives new files under ``source_dir`` into ``out_dir``."""
    schema = schema or spark.read.parquet(source_dir).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        days = batch.select(F.col(cfg.day).alias("_day")).distinct()
        rows = spark.read.schema(schema).parquet(source_dir)
        whole_days = rows.join(days, F.col(cfg.day).eqNullSafe(F.col("_day")), "left_semi")
        lab, rejected = label_similar_with_rejects(whole_days, cfg)
        for name, df in (("labelled", lab), ("filtered", filtered(lab, cfg)), ("rejected", rejected)):
            (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(cfg.day).parquet(f"{out_dir}/{name}"))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
