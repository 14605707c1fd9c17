"""The corpus pipeline: documents in, token-id files out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet to the shared folder
of ``spark.checkpoint.dir`` and reads back as the next one's ``docs``.  All
but the last return the columns of ``documents``:

1. quality rules -- failed lines go from the texts, rejected documents go;
2. SimHash near-dedup -- one document of each group stays;
3. benchmark decontamination -- documents with a benchmark window go;
4. mixing -- documents are dropped or repeated to meet their source's target;
5. token ids -- written to Simple-8b files and read back, one row per document
   row: doc_id, start, n_tokens, ids_crc32.

No SQL states the SimHash stage (it has no 64-bit XXH64), so ``ORACLE_SQL`` is
None; tests run the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docket.llm import common, decontam, line_rules, mixing, queries, simhash, token_files

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontam.contaminated_rows(docs, common.table(spark, sf_dir, "benchmark"), out="__hit")
    return hits.where("__hit.n_hit = 0").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.token_digest(token_files.round_trip(docs, queries.tokenizer_path()))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("mix_sources", mix_sources),
          ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = common.stage(step(spark, docs, sf_dir), name)
    return docs
