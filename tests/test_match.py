"""Cross-day matching (X8-X12), verdict parsing deviations, TF-IDF."""
import math

from pyspark.sql import functions as F

from docket.operators import match
from docket.operators.similarity import tfidf_cosine

SCHEMA = "row_id bigint, dia bigint, processo string, jornal string, intimacao string, similar bigint"


def _days(spark):
    prev = spark.createDataFrame([
        (0, 0, "P1", "DJSP", "alpha beta", 0),
        (1, 0, "P1", "DJSP", "alpha gamma", -1),
        (2, 0, "P1", "DJSP", "alpha delta", 2),
        (3, 0, "P2", "DJSP", "other text", 3),
    ], SCHEMA)
    cur = spark.createDataFrame([
        (0, 1, "P1", "D J E N - X", "alpha beta", 0),
        (1, 1, "P1", "DJSP", "alpha zeta", 1),      # compared too: case-level filter
        (2, 1, "P2", "DJSP", "other text", 2),      # case not eligible today
        (3, 1, "P3", "D J E N", "new case", 3),
    ], SCHEMA)
    return prev, cur


def _verdicts(spark, rows):
    return spark.createDataFrame(rows, "cur_id bigint, prev_id bigint, response string")


YES = '{"same_story": true, "same_goal": true, "same_litigation": true, "litigation-id": "P1"}'


def test_first_match_uses_filtered_order(spark):
    prev, cur = _days(spark)
    # today's row 0 matches yesterday's 1 (undecided) and 2 (representative):
    # representatives are tried first, so 2 wins.
    v = _verdicts(spark, [(0, 1, YES), (0, 2, YES), (1, 1, YES), (2, 3, YES)])
    got = {r.row_id: r.match_row for r in match.match_days(prev, cur, match.TableJudge(v)).collect()}
    assert got == {0: 4, 1: 3, 2: -1, 3: -1}


def test_rounds_equal_table_path(spark):
    prev, cur = _days(spark)
    v = _verdicts(spark, [(0, 1, YES), (0, 2, YES), (1, 1, YES)])
    table = match.first_matches(prev, cur, match.TableJudge(v)).collect()
    calls = []

    def judge(reqs):
        calls.extend(reqs)
        return [YES if ("alpha beta" in r and "alpha delta" in r) or ("alpha zeta" in r and "alpha gamma" in r)
                else '{"same_story": false}' for r in reqs]
    rounds = match.first_matches(prev, cur, match.CallableJudge(judge)).collect()
    assert sorted(map(tuple, table)) == sorted(map(tuple, rounds)) == [(0, 2), (1, 1)]


def test_verdict_deviations(spark):
    df = spark.createDataFrame([
        ("no json here",), ('{"same_story": true, "same_goal": true',), ('{"same_story": true}',),
        ('{"same_story": "false", "same_goal": true, "same_litigation": true}',),
        ('{"same_story": "true", "same_goal": true, "same_litigation": true}',), (YES,), (None,)], "r string")
    p = match.parse_verdict(F.col("r"))
    got = [(r.m, r.e) for r in df.select(p["match"].alias("m"), p["error"].alias("e")).collect()]
    assert got == [(False, "no_fields"), (False, "malformed"), (False, "not_all_boolean"),
                   (False, "not_all_boolean"), (False, "not_all_boolean"), (True, None),
                   (False, "no_response")]


def test_only_a_whole_object_is_an_answer(spark):
    bad = [YES + " so it is", YES + YES, YES + ", " + YES, f"[{YES}]", "well: " + YES,
           YES[:-1] + ', "x": NaN}']
    p = match.parse_verdict(F.col("r"))
    df = spark.createDataFrame([(b,) for b in bad] + [("  " + YES + "\n",)], "r string")
    got = [(r.m, r.e) for r in df.select(p["match"].alias("m"), p["error"].alias("e")).collect()]
    assert got == [(False, "malformed")] * len(bad) + [(True, None)]


def test_failing_judge_gives_no_match(spark):
    prev, cur = _days(spark)

    def judge(reqs):
        if any("alpha zeta" in r for r in reqs):
            raise RuntimeError("no quota")
        return [YES for _ in reqs]
    got = match.first_matches(prev, cur, match.CallableJudge(judge)).collect()
    assert [tuple(r) for r in got] == [(0, 0)]
    tries = spark.createDataFrame([("alpha zeta",), ("ok",)], "request string").coalesce(1)
    rows = {r.request: r for r in match.CallableJudge(judge).respond(tries).collect()}
    assert rows["alpha zeta"].response is None and rows["alpha zeta"].call_error == "RuntimeError: no quota"
    assert rows["ok"].response == YES and rows["ok"].call_error is None


def test_asked_questions(spark):
    """Questions in filtered order up to the first match, failed calls with
    their message; a repeated day without candidates asks nothing."""
    prev, cur = _days(spark)

    def judge(reqs):
        if any("alpha zeta" in r and "alpha delta" in r for r in reqs):
            raise RuntimeError("no quota")
        return [YES if "alpha gamma" in r else '{"same_story": false}' for r in reqs]
    asked = match.asked_questions(prev, cur, match.CallableJudge(judge))
    got = sorted(tuple(r) for r in asked.select(
        "cur_id", "question_no", "prev_id", "match", F.coalesce("error", F.lit("-"))).collect())
    assert got == [(0, 0, 0, False, "-"), (0, 1, 2, False, "-"), (0, 2, 1, True, "-"),
                   (1, 0, 0, False, "-"), (1, 1, 2, False, "RuntimeError: no quota"), (1, 2, 1, True, "-")]
    assert match.asked_questions(prev.limit(0), cur, match.CallableJudge(judge)).count() == 0


def test_two_day_report_keeps_rejects(spark):
    from docket.operators.twoday import two_day_report
    prev, cur = _days(spark)
    odd = spark.createDataFrame([(9, None, "P1", "DJSP", "t", 0), (8, 1, None, "DJSP", "t", 0), (7, 5, "P1", "DJSP", "t", 0)], SCHEMA)
    notices = prev.unionByName(cur).unionByName(odd).drop("similar")
    out, rejected = two_day_report(notices, 0, 1, match.OfflineJudge(0.99))
    assert {r.row_id: r.match_row for r in out.collect()} == {0: 2, 1: -1, 2: -1, 3: -1}
    assert sorted((r.row_id, r.reason) for r in rejected.collect()) == [(8, "null_key"), (9, "null_day")]


def test_tfidf_golden(spark):
    pairs = spark.createDataFrame([
        (1, "Intimação do réu ana", "Intimação do réu josé"),
        (2, "", "abc"), (3, "", ""), (4, "same text", "same text")], "id int, a string, b string")
    got = {r.id: r.cosine for r in tfidf_cosine(pairs, ["id"], "a", "b").collect()}
    assert math.isclose(got[1], 0.6029748160, abs_tol=1e-9)
    assert got[2] == 0.0 and got[3] is None and math.isclose(got[4], 1.0)


def test_tfidf_edges(spark):
    """Null texts have no token; repeated and null ids are scored row by row;
    a long text is one row's work."""
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    pairs = spark.createDataFrame([
        (1, None, None), (1, None, "abc"), (None, "aa bb", "aa bb"), (2, long, long),
        (2, "aa aa bb", "aa cc"), (2, "aa aa bb", "aa cc")], "id int, a string, b string")
    got = [r.cosine for r in tfidf_cosine(pairs, ["id"], "a", "b").collect()]
    w2 = (1 + math.log(1.5)) ** 2
    want = 2 / (math.sqrt(4 + w2) * math.sqrt(1 + w2))
    assert len(got) == 6 and got.count(None) == 1 and got.count(0.0) == 1
    assert sum(math.isclose(c, 1.0) for c in got if c) == 2
    assert sum(math.isclose(c, want) for c in got if c) == 2


def test_offline_judge_against_brute_force(spark):
    prev, cur = _days(spark)
    got = {r.row_id: r.match_row for r in match.match_days(prev, cur, match.OfflineJudge(0.99)).collect()}
    assert got == {0: 2, 1: -1, 2: -1, 3: -1}


def test_early_stop_asks_few_questions(spark):
    """Every candidate matches: each of today's rows asks only its first
    round of candidates (one by default), never all of yesterday's rows."""
    n_prev = 40
    prev = spark.createDataFrame([(i, 0, "P1", "DJSP", f"t {i}", i) for i in range(n_prev)], SCHEMA)
    cur = spark.createDataFrame([(i, 1, "P1", "D J E N", f"t {i}", i) for i in range(5)], SCHEMA)
    acc = spark.sparkContext.accumulator(0)

    def judge(reqs):
        acc.add(len(reqs))
        return [YES] * len(reqs)
    got = {r.row_id: r.match_row for r in match.match_days(prev, cur, match.CallableJudge(judge)).collect()}
    assert got == {i: 2 for i in range(5)}
    assert acc.value == 5  # one question each: the first round is one candidate wide


def test_first_match_against_model(spark):
    import random
    import model
    rng = random.Random(17)
    prev, cur = [], []
    for case in range(25):
        for day, rows in ((0, prev), (1, cur)):
            for _ in range(rng.randint(0, 6)):
                rid = len(prev) + len(cur) + 1000 * day
                journal = rng.choice(["D J E N - X", "DJSP", None])
                sim = rng.choice([rid, -1])
                rows.append((rid, f"P{case}", journal, f"t{rng.randint(0, 4)}", sim))
    answer = lambda c, p: (c[0] * 7 + p[0] * 3) % 4 == 0
    expected = model.first_match(prev, cur, answer)
    schema = "row_id bigint, processo string, jornal string, intimacao string, similar bigint"
    pf = spark.createDataFrame(prev, schema).withColumn("dia", F.lit(0))
    cf = spark.createDataFrame(cur, schema).withColumn("dia", F.lit(1))
    verdicts = spark.createDataFrame(
        [(c[0], p[0], YES if answer(c, p) else '{"same_story": false}') for c in cur for p in prev if c[1] == p[1]],
        "cur_id bigint, prev_id bigint, response string")
    table = {r.row_id: r.match_row for r in match.match_days(pf, cf, match.TableJudge(verdicts)).collect()}
    rounds = {r.row_id: r.match_row for r in match.match_days(
        pf, cf, _CountingTableJudge(verdicts)).collect()}
    assert table == expected
    assert rounds == expected


class _CountingTableJudge(match.TableJudge):
    """Same answers, but not recognised as a table: goes through the rounds."""
    pass


def _asked_twice(spark):
    """Ten rows of today with two texts, against four of yesterday with two texts."""
    schema = "row_id long, processo string, jornal string, intimacao string, similar long"
    cur = spark.createDataFrame([(i, "A", "D J E N", f"t{i % 2}", i) for i in range(10)], schema)
    prev = spark.createDataFrame([(i, "A", "D J E N", f"p{i % 2}", i) for i in range(4)], schema)
    return prev, cur


def test_stored_judge_asks_each_question_once(spark, tmp_path):
    """Calls are the distinct requests, over rounds, runs and objects."""
    log = tmp_path / "calls"
    log.mkdir()

    def judge(requests):
        import uuid
        for r in requests:
            (log / uuid.uuid4().hex).write_text(r)
        return ["{\"same_story\": false, \"same_goal\": false, \"same_litigation\": false}"] * len(requests)
    prev, cur = _asked_twice(spark)
    store = str(tmp_path / "store")
    first = match.StoredJudge(match.CallableJudge(judge), store)
    assert match.first_matches(prev, cur, first).count() == 0
    texts = [p.read_text() for p in log.iterdir()]
    assert len(texts) == len(set(texts)) == 4 == first.calls
    again = match.StoredJudge(match.CallableJudge(judge), store)
    assert match.first_matches(prev, cur, again).count() == 0
    assert again.calls == 0 and len(list(log.iterdir())) == 4
    assert {r.attempts for r in again.answers(spark).collect()} == {1}


def test_stored_judge_tries_failures_again_and_keeps_a_budget(spark, tmp_path):
    def fails(requests):
        raise OSError("no line")

    def agrees(requests):
        return ["{\"same_story\": true, \"same_goal\": true, \"same_litigation\": true}"] * len(requests)
    prev, cur = _asked_twice(spark)
    store = str(tmp_path / "store")
    for run in (1, 2):
        bad = match.StoredJudge(match.CallableJudge(fails), store, max_attempts=2)
        assert match.first_matches(prev.limit(1), cur, bad).count() == 0
        assert bad.calls == 2 and {(r.attempts, r.response) for r in bad.answers(spark).collect()} == {(run, None)}
    done = match.StoredJudge(match.CallableJudge(agrees), store, max_attempts=2)
    assert match.first_matches(prev.limit(1), cur, done).count() == 0 and done.calls == 0
    good = match.StoredJudge(match.CallableJudge(agrees), store, max_attempts=3)
    assert match.first_matches(prev.limit(1), cur, good).count() == 10 and good.calls == 2
    short = match.StoredJudge(match.CallableJudge(agrees), str(tmp_path / "other"), budget=1)
    asked = match.asked_questions(prev.limit(1), cur, short).collect()
    assert short.calls == 1 and sorted(r.error or "" for r in asked) == [""] * 5 + ["budget"] * 5


def test_rows_that_grow_are_not_broadcast(spark):
    """Matching by stored answers joins rows on their ids dealt by id: no copy of
    a day goes through the driver, even where it would be small enough."""
    prev, cur = _days(spark)
    judge = match.TableJudge(_verdicts(spark, [(0, 1, YES), (0, 2, YES), (1, 1, YES), (2, 3, YES)]))
    out = match.match_days(prev, cur, judge).select("row_id", "match_row")
    assert {r.row_id: r.match_row for r in out.collect()} == {0: 4, 1: 3, 2: -1, 3: -1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "cur_id" + "#" in line or
             "BroadcastHashJoin" in line and "row_id#" in line.split("Build")[0]]
    assert not joins
