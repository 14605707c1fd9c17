"""Within-day labelling (X6, X7) against the step-by-step model and the fixture."""
import random

from pyspark.sql import functions as F

from paths import SF_SMALL
from docket.config import MARKER
from docket.operators import dedup, report
from docket.plans.fixtures import expected_labels, notices
import model

H = f"Tribunal Processo Vara {MARKER}"
VOCAB = ["ANA", "JOSE", "LIA", "decide", "x", "autos", "1", "2"]


def _random_rows(rng, n_cases=40):
    rows, rid = [], 0
    for c in range(n_cases):
        size = rng.randint(1, 7)
        pool = []
        for _ in range(size):
            kind = rng.random()
            if pool and kind < 0.2:
                t = rng.choice(pool)                                   # exact copy
            elif pool and kind < 0.3:
                t = rng.choice(pool).replace(" ", "  ", 1)             # whitespace variant
            elif kind < 0.85:
                t = H + " " + " ".join(rng.choice(VOCAB) for _ in range(rng.randint(0, 4)))
            else:
                t = " ".join(rng.choice(VOCAB + [MARKER]) for _ in range(rng.randint(1, 6)))
            pool.append(t)
            rows.append((rid, f"C{c}", t))
            rid += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


def _spark_labels(spark, rows, parts=3):
    df = spark.createDataFrame([(r, 0, c, t) for r, c, t in rows],
                               "row_id bigint, dia bigint, processo string, intimacao string").repartition(parts)
    got = dedup.label_similar(df).select("row_id", "noccur", "similar").collect()
    return {r.row_id: (r.noccur, r.similar) for r in got}


def test_matches_model_on_random_cases(spark):
    rng = random.Random(11)
    rows = _random_rows(rng)
    assert _spark_labels(spark, rows) == model.label(rows)


def test_result_independent_of_partitioning(spark):
    rows = _random_rows(random.Random(5), n_cases=15)
    assert _spark_labels(spark, rows, parts=1) == _spark_labels(spark, rows, parts=7)


def test_fixture_answers(spark):
    lab = dedup.label_similar(notices(spark, SF_SMALL)).select("row_id", "noccur", "similar")
    exp = expected_labels(spark, SF_SMALL).selectExpr("row_id", "noccur", "sim AS similar")
    assert lab.exceptAll(exp).count() == 0 and exp.exceptAll(lab).count() == 0


def test_invariants(spark):
    lab = dedup.label_similar(notices(spark, SF_SMALL)).cache()
    ptr = lab.where("similar >= 0").alias("a").join(
        lab.alias("b"), F.col("a.similar") == F.col("b.row_id"), "left")
    bad = ptr.where("b.row_id IS NULL OR b.similar <> b.row_id OR a.processo <> b.processo "
                    "OR a.dia <> b.dia OR a.similar > a.row_id")
    assert bad.count() == 0
    assert report.key_difference(lab, dedup.filtered(lab)).count() == 0


def test_hot_case_is_exact(spark):
    """One case holding most rows: same answer as the model."""
    rng = random.Random(3)
    rows = [(i, "HOT", H + " " + " ".join(rng.choice(VOCAB) for _ in range(3))) for i in range(220)]
    rows += [(1000 + i, f"C{i}", H + " ANA") for i in range(30)]
    assert _spark_labels(spark, rows, parts=4) == model.label(rows)


def test_null_rules(spark):
    df = spark.createDataFrame(
        [(0, 0, None, "a"), (1, 0, "K1", None), (2, 0, "K2", None), (3, 0, "K2", "t"), (4, 0, "K2", "t")],
        "row_id bigint, dia bigint, processo string, intimacao string")
    lab, rej = dedup.label_similar_with_rejects(df)
    got = {r.row_id: (r.noccur, r.similar) for r in lab.collect()}
    assert got == {1: (1, 1), 3: (3, 3), 4: (3, 3)}
    assert {(r.row_id, r.reason) for r in rej.collect()} == {(0, "null_key"), (2, "null_text")}


def test_no_row_is_lost(spark):
    df = spark.createDataFrame(
        [(0, None, "K", "a"), (None, 0, "K", "a"), (2, 0, None, "a"), (3, 0, "K", None), (4, 0, "K", "b"),
         (5, 0, "K", "b"), (6, 0, "L", None), (None, None, None, None)],
        "row_id bigint, dia bigint, processo string, intimacao string")
    lab, rej = dedup.label_similar_with_rejects(df)
    assert lab.count() + rej.count() == df.count()
    reasons = sorted((str(r.row_id), r.reason) for r in rej.collect())
    assert reasons == [("0", "null_day"), ("2", "null_key"), ("3", "null_text"), ("None", "null_day"),
                       ("None", "null_row_id")]
    assert sorted((str(r.row_id), r.reason) for r in dedup.rejected_notices(df).collect()) == reasons
    assert dedup.case_frequency(df).count() == df.count()
    leaders = dedup.exact_copy_leaders(df)
    assert leaders.count() == df.count()
    assert {r.similar for r in leaders.where("dia is null or row_id is null or processo is null").collect()} == {-1}


def _many_rounds_rows():
    rng = random.Random(23)
    rows = _random_rows(rng, n_cases=12)
    rows += [(5000 + i, "CHAIN", H + " ANA" + " x" * i) for i in range(9)]        # insert-only chain
    return rows + [(6000 + i, "MANY", H + f" N{i} " + rng.choice(VOCAB)) for i in range(12)]


def _labels_with(spark, rows, **limits):
    from docket.config import DEFAULT
    df = spark.createDataFrame([(r, 0, c, t) for r, c, t in rows],
                               "row_id bigint, dia bigint, processo string, intimacao string")
    labelled = dedup.label_similar(df, DEFAULT.with_columns(**limits))
    return {r.row_id: (r.noccur, r.similar) for r in labelled.select("row_id", "noccur", "similar").collect()}


def test_narrow_rounds_match_model(spark, monkeypatch):
    """Two heads per round at most: many rounds, same answer, also when the
    answers of every few rounds are merged."""
    from docket.operators import nearcopy
    monkeypatch.setattr(nearcopy, "MERGE_ROUNDS", 3)
    rows = _many_rounds_rows()
    assert _labels_with(spark, rows, max_heads=2, wide_heads=2) == model.label(rows)


def test_pair_budget_changes_no_answer(spark):
    rows = _many_rounds_rows()
    assert _labels_with(spark, rows, max_heads=2, wide_heads=5, pair_budget=30) == model.label(rows)


def test_rows_that_all_lead(spark):
    """No row joins another: each leads itself, in few rounds."""
    rows = [(i, "A", f"{MARKER} a b c d e f g {i}") for i in range(300)]
    sc = spark.sparkContext
    sc.setJobGroup("all-lead", "all-lead")
    assert _labels_with(spark, rows) == {i: (300, i) for i in range(300)}
    jobs = len(sc.statusTracker().getJobIdsForGroup("all-lead"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 70


def test_duplicate_row_ids(spark):
    df = spark.createDataFrame([(0, 0, "P", "a"), (0, 0, "P", "b"), (0, 1, "P", "a")],
                               "row_id bigint, dia bigint, processo string, intimacao string")
    got = [(r.dia, r.row_id, r.n_rows) for r in dedup.duplicate_row_ids(df).collect()]
    assert got == [(0, 0, 2)]
