"""Guards on the physical plans (the scale properties PLANS.md describes)."""
import re

from paths import SF_SMALL
from docket.operators.similarity import tfidf_cosine
from docket.plans.catalog import QUERIES


def _plan(spark, name):
    text = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", text)  # drop expression ids


def test_exact_copies_combine_before_shuffle(spark):
    p = _plan(spark, "exact_copy_documents")
    # per-text facts are materialised first (partial min/count there); the
    # per-case counts are summed from them partial-then-final
    assert "partial_sum" in p
    assert "Window" not in p                      # no per-case window (one task per hot case)
    assert re.search(r"FileScan parquet \[doc_id,text\]", p)   # column pruning


def test_tfidf_stays_inside_the_row(spark):
    """Scoring adds no operator to the plan of its pairs but a projection."""
    pairs = spark.range(4).selectExpr("id", "cast(id as string) a", "cast(id + 1 as string) b")
    p = tfidf_cosine(pairs, ["id"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Aggregate|Join|Generate", p)
    # the two sides of the pair join, and nothing read again for the score
    assert _plan(spark, "tfidf_pair_cosine").count("FileScan") == 2


def test_first_match_uses_hash_aggregation(spark):
    p = _plan(spark, "first_match")
    assert "SortAggregate" not in p


def test_row_ids_rank_inside_chunks(spark):
    p = _plan(spark, "assign_row_ids")
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(dia, _piece", p)
    assert re.search(r"FileScan parquet \[event_id,ts\]", p)
