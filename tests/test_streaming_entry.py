"""Streaming ingestion of day drops, and the driver contract."""
import tempfile

from paths import SF_SMALL


def test_daily_stream_labels_each_drop(spark):
    """Day 0 arrives in two pieces (several part files, two drops): the
    output still equals labelling each whole day in batch."""
    from docket.operators import dedup
    from docket.plans.fixtures import notices
    from docket.streaming.daily import start_daily_labelling
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    n = notices(spark, SF_SMALL)
    n.where("dia = 0 AND row_id % 2 = 0").repartition(3).write.parquet(f"{base}/in/drop0a")
    n.where("dia = 0 AND row_id % 2 = 1").repartition(2).write.parquet(f"{base}/in/drop0b")
    n.where("dia = 1").repartition(3).write.parquet(f"{base}/in/drop1")
    # one file per micro-batch: every day is split over several batches
    q = start_daily_labelling(spark, f"{base}/in/*", f"{base}/out", f"{base}/ckpt", schema=n.schema,
                              once=True, max_files_per_trigger=1)
    q.awaitTermination(600)
    got = spark.read.parquet(f"{base}/out/labelled").select("row_id", "similar")
    exp = dedup.label_similar(n).select("row_id", "similar")
    assert got.count() == n.count()
    assert got.exceptAll(exp).count() == 0
    assert spark.read.parquet(f"{base}/out/filtered").count() == dedup.filtered(dedup.label_similar(n)).count()


def test_daily_stream_loses_no_row(spark):
    """Rows without a day, row id, key or text reach the rejected table."""
    from docket import DEFAULT as cfg
    from docket.plans.fixtures import notices
    from docket.streaming.daily import start_daily_labelling
    from pyspark.sql import functions as F
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    n = notices(spark, SF_SMALL)
    spoiled = {cfg.day: 3, cfg.row_id: 5, cfg.key: 7, cfg.text: 2}
    h = F.abs(F.hash("row_id", "dia"))
    rows = n.select(*[F.when(h % 11 == spoiled[c], None).otherwise(F.col(c)).alias(c) if c in spoiled
                      else c for c in n.columns])
    rows.where(h % 2 == 0).write.parquet(f"{base}/in/a")
    rows.where(h % 2 == 1).write.parquet(f"{base}/in/b")
    q = start_daily_labelling(spark, f"{base}/in/*", f"{base}/out", f"{base}/ckpt", schema=rows.schema,
                              once=True, max_files_per_trigger=4)
    q.awaitTermination(600)
    rows = spark.read.parquet(f"{base}/in/*").select(*n.columns)
    labelled = spark.read.parquet(f"{base}/out/labelled").select(*n.columns)
    rejected = spark.read.parquet(f"{base}/out/rejected")
    both = labelled.unionByName(rejected.select(*n.columns))
    assert both.exceptAll(rows).count() == 0 and rows.exceptAll(both).count() == 0
    assert rejected.select("reason").distinct().count() == 4
    assert rejected.where(F.col(cfg.day).isNull()).count() == rows.where(F.col(cfg.day).isNull()).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 200
    assert set(E.oracle_sql()) <= set(E.queries())
