"""File landing with a no-overwrite rule, and manifest listing.

A *catalog* is a table of stored objects: ``path`` (folder/name), plus any
metadata.  A *batch* is a table of incoming files: ``name``, ``content``
(bytes) and an ``order`` column (upload order).  Everything is set-based:
the clash test is an anti/semi join against the catalog, and clashes inside
the batch are found with a per-path minimum.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import (base_name, join_path, literal_eval_list, parse_list_literal,
                              simple_list_literal)

# Magic numbers of the detected content types.
ZIP_MAGIC = "504B0304"          # zip container (xlsx/docx are zip based)
OLE2_MAGIC = "D0CF11E0A1B11AE1"  # legacy Office compound file
PDF_MAGIC = "25504446"          # %PDF
OOXML_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


#: Columns of the stored catalog.
CATALOG_COLUMNS = ("path", "name", "order", "content", "content_type", "owner", "upload_time")
CATALOG = ("path string, name string, `order` long, content binary, content_type string, owner string, "
           "upload_time timestamp")


def content_type(content: Column) -> Column:
    """Type from magic numbers; text only if no byte of the whole content is
    a control character (stored with the file, never a reason to refuse)."""
    head = F.hex(F.substring(content, 1, 8))
    # Latin-1 maps every byte to one char, whatever the encoding.
    raw = F.decode(content, "ISO-8859-1")
    text_head = F.lower(F.substring(F.ltrim(raw), 1, 16))
    return (F.when(head.startswith(ZIP_MAGIC),
                   # an entry named xl/...: its name follows 26 bytes of local header
                   F.when(raw.rlike("PK\\x03\\x04[\\s\\S]{26}xl/"), F.lit(OOXML_SHEET))
                   .otherwise(F.lit("application/zip")))
            .when(head.startswith(OLE2_MAGIC), F.lit("application/x-ole-storage"))
            .when(head.startswith(PDF_MAGIC), F.lit("application/pdf"))
            .when(text_head.startswith("<!doctype html") | text_head.startswith("<html"),
                  F.lit("text/html"))
            .when(F.length(content) == 0, F.lit("application/x-empty"))
            .when(~raw.rlike("[\\x00-\\x08\\x0E-\\x1F]"),
                  F.lit("text/plain"))
            .otherwise(F.lit("application/octet-stream")))


def only_extension(files: DataFrame, ext: str = ".xlsx", name: str = "name") -> DataFrame:
    """Keep files with the given extension (case-insensitive)."""
    return files.where(F.lower(F.col(name)).endswith(ext.lower()))


def plan_landing(batch: DataFrame, catalog: DataFrame, folder: str, owner: str,
                 upload_time: Column | None = None, stop_at_first: bool = False):
    """S6 + S7: (accepted, refused).

    A file is refused when its destination path already exists in the
    catalog or an earlier file of the batch lands on the same path (reason
    ``exists``), when several files share the path and the first order
    (``same_order``: none of them is the first), or when it has no name or
    order (``no_name``, ``no_order``).  With
    ``stop_at_first`` the batch stops at the first refusal, as an
    interactive upload does: later files are neither landed nor refused
    (``skipped``).  Accepted rows carry the metadata to store.
    """
    upload_time = upload_time if upload_time is not None else F.current_timestamp()
    placed = F.col("name").isNotNull() & F.col("order").isNotNull()
    unplaced = batch.where(~placed)
    planned = batch.where(placed).withColumn("path", join_path(folder, F.col("name")))
    # One small row per path (no contents), joined to the files once.
    stored = catalog.select("path").distinct().withColumn("_exists", F.lit(True))
    first = (planned.groupBy("path", "order").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy("path").agg(F.min(F.struct("order", "_n")).alias("_first"))
             .join(stored, "path", "left"))
    taken = F.coalesce("_exists", F.lit(False)) | (F.col("order") > F.col("_first.order"))
    marked = (planned.join(first, "path")
              .withColumn("_why", F.when(taken, F.lit("exists"))
                          .when(F.col("_first._n") > 1, F.lit("same_order")))
              .withColumn("_clash", F.col("_why").isNotNull())
              .drop("_exists", "_first"))
    if stop_at_first:
        # A global aggregate has exactly one row, so broadcasting it is bounded.
        stop = marked.where("_clash").agg(F.min("order").alias("_stop")).withColumn("_one", F.lit(1))
        marked = (marked.withColumn("_one", F.lit(1)).join(F.broadcast(stop), "_one").drop("_one")
                  .withColumn("_skip", F.col("_stop").isNotNull() & (F.col("order") > F.col("_stop")))
                  .drop("_stop"))
    else:
        marked = marked.withColumn("_skip", F.lit(False))
    accepted = (marked.where(~F.col("_clash") & ~F.col("_skip"))
                .withColumn("content_type", content_type(F.col("content")))
                .withColumn("owner", F.lit(owner))
                .withColumn("upload_time", upload_time)
                .drop("_clash", "_skip", "_why"))
    refused = (marked.where(F.col("_clash") & ~F.col("_skip"))
               .withColumnRenamed("_why", "reason")
               .drop("_clash", "_skip"))
    nowhere = (unplaced.withColumn("path", F.lit(None).cast("string"))
               .withColumn("reason", F.when(F.col("name").isNull(), F.lit("no_name"))
                           .otherwise(F.lit("no_order"))).select(*refused.columns))
    return accepted, refused.unionByName(nowhere)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file if there is none of that name; whether we did.  The
    file system decides, so of two writers one gets False."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        return False
    try:
        out = fs.create(target, False)
    except Py4JJavaError as refused:
        if fs.exists(target):
            return False
        raise refused
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def stored_catalog(spark: SparkSession, catalog_path: str, schema=CATALOG) -> tuple[int, DataFrame]:
    """(version, stored files): what the numbered commits of a catalog hold
    (version 0: there is none)."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    log = jvm.org.apache.hadoop.fs.Path(f"{catalog_path}/commits")
    if not log.getFileSystem(conf).exists(log):
        return 0, spark.createDataFrame([], schema)
    # One short row per commit.
    commits = spark.read.text(f"{catalog_path}/commits").select(
        F.col("_metadata.file_name").cast("long").alias("version"), "value").collect()
    if not commits:
        return 0, spark.createDataFrame([], schema)
    folders = [f"{catalog_path}/data/{r.value}" for r in commits]
    return max(r.version for r in commits), spark.read.schema(schema).parquet(*folders)


def commit_landing(accepted: DataFrame, catalog_path: str, version: int) -> bool:
    """Store the accepted files of a plan made against ``version`` of the
    catalog as the next version.  False if another writer has made that
    version since: the batch must be planned again.  Files become visible by the
    commit alone; what a writer wrote without one stays in the folder unread."""
    spark, name = accepted.sparkSession, uuid.uuid4().hex
    accepted.select(*CATALOG_COLUMNS).write.parquet(f"{catalog_path}/data/{name}")
    return _create(spark, f"{catalog_path}/commits/{version + 1:019d}", name)


def land(batch: DataFrame, catalog_path: str, folder: str, owner: str, upload_time: Column | None = None,
         stop_at_first: bool = False, planned_at: tuple[int, DataFrame] | None = None, attempts: int = 20):
    """S6 whole: plan a batch against the stored catalog and commit it; if
    another writer was faster, plan again against what it stored, so of all
    writers one wins each path and the others are refused with ``exists``.

    Returns (version, refused).  ``planned_at`` is the state the first plan is
    made against, if it was read before.
    """
    spark = batch.sparkSession
    state = planned_at or stored_catalog(spark, catalog_path)
    for _ in range(attempts):
        accepted, refused = plan_landing(batch, state[1], folder, owner, upload_time, stop_at_first)
        if commit_landing(accepted, catalog_path, state[0]):
            return state[0] + 1, refused
        state = stored_catalog(spark, catalog_path)
    raise RuntimeError(f"{attempts} other commits came first")


def files_from_binary(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """S2/S9 source: a folder of files as (name, content, order by path)."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").load(path))
    files = raw.select(base_name(F.col("path")).alias("name"), "content",
                       F.col("path").alias("source_path"), "modificationTime")
    ids = raw.select(F.col("path").alias("_path")).select(
        "_path", F.row_number().over(Window.orderBy("_path")).cast("bigint").alias("order"))
    return files.join(ids, files["source_path"] == ids["_path"]).drop("_path")


def list_prefix(catalog: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """Stored objects whose name starts with ``prefix``."""
    return catalog.where(F.col(name).startswith(prefix))


def _parsed_manifests(listed: DataFrame, meta: str):
    """(files parsed on the JVM, the others) with the list in ``_files``."""
    simple = simple_list_literal(F.col(meta)) & parse_list_literal(F.col(meta)).isNotNull()
    simple = F.coalesce(simple, F.lit(False))
    return (listed.where(simple).withColumn("_files", parse_list_literal(F.col(meta))),
            listed.where(~simple).withColumn("_files", literal_eval_list(F.col(meta))))


def manifest_files(listed: DataFrame, meta: str = "list_files_compare") -> DataFrame:
    """every file name recorded in the manifests, flattened.

    Simple literals are parsed on the JVM; the others (quotes or escapes in
    a name, tuples, trailing commas, ``None``) go through ``ast.literal_eval`` in a separate branch, so the
    Python UDF only sees those rows.  ``manifest_rejects`` has the manifests
    without a list."""
    fast, slow = _parsed_manifests(listed, meta)
    return fast.unionByName(slow).select(*listed.columns, F.explode("_files").alias("file_name"))


def manifest_rejects(listed: DataFrame, meta: str = "list_files_compare") -> DataFrame:
    """Manifests whose list is missing (``no_list``) or not a list literal (``bad_list``)."""
    _, slow = _parsed_manifests(listed, meta)
    return slow.where(F.col("_files").isNull()).drop("_files").withColumn(
        "reason", F.when(F.col(meta).isNull(), F.lit("no_list")).otherwise(F.lit("bad_list")))


def manifest_count(listed: DataFrame, compat: bool = True) -> DataFrame:
    """Number of manifests; ``compat`` reproduces the displayed value,
    which is 1 when there are none."""
    n = F.count(F.lit(1))
    return listed.agg((F.greatest(n, F.lit(1)) if compat else n).alias("n_manifests"))


def generations(listed: DataFrame) -> DataFrame:
    """The generation id of each listed object."""
    return listed.select("generation")
