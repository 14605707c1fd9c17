"""Registered queries over the driver tables and their DuckDB oracles.

Every query reads whole driver tables (or tables Spark derives from them),
so its work grows with the data.  ``QUERIES[name](spark, sf_dir)`` returns a
DataFrame; ``ORACLES[name]`` is SQL DuckDB runs on the same Parquet files.
Queries without an oracle are checked in the test-suite against an
independent step-by-step model instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT as CFG
from ..operators import dedup, match, quality, report
from ..operators.nearcopy import _cut, spread
from ..operators.ranking import rank_within
from ..operators.scorejoin import similar_pairs
from ..operators.similarity import tfidf_cosine
from ..operators.twoday import two_day_report
from ..functions.text import STOP_WORDS, iso_cleanup, words_only
from ..functions.tokendiff import token_diff_udf
from ..session import ensure_checkpoint_dir
from ..sources import days, landing
from . import fixtures

PREV_DAY, CUR_DAY = 0, 1
OFFLINE_THRESHOLD = 0.8
LANDING_FOLDER = "inbox"
LANDING_OWNER = "triage"
ROUND = 6

_memo: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.notices(spark, sf_dir)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled notices, computed once per session and input folder."""
    key = ("labelled", spark.sparkContext.applicationId, sf_dir)
    if key not in _memo:
        _memo[key] = _cut(dedup.label_similar(_notices(spark, sf_dir), CFG))
    return _memo[key]


def _rounded(x):
    """``F.round(x, ROUND)`` of numbers from 0 to 1; by their decimal digits, which takes longer, only near a tie."""
    n = x * F.lit(10.0 ** ROUND)
    return F.when(F.abs(n - F.floor(n) - 0.5) < 1e-4, F.round(x, ROUND)).otherwise(F.rint(n) / F.lit(10.0 ** ROUND))


def _filtered_day(spark, sf_dir, day):
    return dedup.filtered(_labelled(spark, sf_dir), CFG).where(F.col("dia") == day)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture judge answers for today's x yesterday's notices of a case
    (cases hold at most 9 rows a day by construction of the fixture)."""
    return fixtures.run_sql(spark, VERDICTS_SQL.replace("FROM notices c JOIN notices p", "FROM {notices} c JOIN {others} p"),
                            notices=_notices(spark, sf_dir), others=_notices(spark, sf_dir).hint("merge"))


# --------------------------------------------------------------------------
# Spark side


def q_notices(spark, sf):
    return _notices(spark, sf)


def q_case_frequency(spark, sf):
    n = _notices(spark, sf)
    return dedup.case_frequency(n, CFG).select("row_id", "dia", "processo", "noccur")


def q_exact_copy_leader(spark, sf):
    return dedup.exact_copy_leaders(_notices(spark, sf), CFG).select(
        "row_id", "dia", "processo", "noccur", "similar")


def _documents_by_prefix(spark, sf):
    d = _table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.lit(0).cast("bigint").alias("dia"),
                    F.left(F.col("text"), F.lit(12)).alias("processo"),
                    F.col("text").alias("intimacao"))


def q_exact_copy_documents(spark, sf):
    return dedup.exact_copy_leaders(_documents_by_prefix(spark, sf), CFG).select(
        "row_id", "processo", "noccur", "similar")


def q_label_similar(spark, sf):
    return _labelled(spark, sf).select("row_id", "dia", "processo", "noccur", "similar")


def q_label_similar_prose(spark, sf):
    """The whole labelling of notices that end with real prose."""
    return dedup.label_similar(fixtures.prose_notices(spark, sf), CFG).select(
        "row_id", "dia", "processo", "noccur", "similar")


def q_label_similar_documents(spark, sf):
    """Whole pipeline on real prose, one case per source (hot cases)."""
    d = _table(spark, sf, "documents")
    docs = d.select(F.col("doc_id").alias("row_id"), F.lit(0).cast("bigint").alias("dia"),
                    F.col("source").alias("processo"), F.col("text").alias("intimacao"))
    return dedup.label_similar(docs, CFG).select("row_id", "processo", "noccur", "similar")


def _order_notices(spark, sf, key: str):
    """Notices built from ``orders``: a fixed header ending with the marker,
    then priority and customer (or status).  Any two different texts of a
    case differ within 5 tokens after the marker, so the expected labels have
    a closed form (see the oracle)."""
    sql = ORDER_NOTICES_SQL.format(key=key).replace("FROM orders", "FROM {orders}")
    return fixtures.run_sql(spark, sql, orders=_table(spark, sf, "orders"))


def q_label_similar_orders(spark, sf):
    """Whole labelling over ``orders``, one case per customer."""
    lab = dedup.label_similar(_order_notices(spark, sf, "o_custkey"), CFG)
    return lab.select("row_id", "processo", "noccur", "similar")


def q_label_similar_hot(spark, sf):
    """Whole labelling over ``orders`` with three hot cases (order status)."""
    lab = dedup.label_similar(_order_notices(spark, sf, "o_orderstatus"), CFG)
    return lab.select("row_id", "processo", "noccur", "similar")


def q_label_similar_leaders(spark, sf):
    """Whole labelling over ``orders``, one case per month, where every row
    ends up a leader: the costly case of the leader rounds."""
    notices = fixtures.run_sql(spark, LEADER_NOTICES_SQL.replace("FROM orders", "FROM {orders}"),
                               orders=_table(spark, sf, "orders"))
    return dedup.label_similar(notices, CFG).select("row_id", "processo", "noccur", "similar")


def q_filtered_notices(spark, sf):
    return dedup.filtered(_labelled(spark, sf), CFG).select(
        "row_id", "dia", "processo", "similar", "undecided_flag")


def q_representatives(spark, sf):
    return dedup.representatives(_labelled(spark, sf), CFG).select("row_id", "dia", "processo")


def q_undecided_rows(spark, sf):
    return dedup.undecided(_labelled(spark, sf)).select("row_id", "dia", "processo")


def q_decided_flag(spark, sf):
    return dedup.decided_flag(_labelled(spark, sf)).select("row_id", "decided")


def q_filtered_order(spark, sf):
    """O1 as an explicit position per day: representatives, then undecided."""
    f = dedup.filtered(_labelled(spark, sf), CFG)
    ranked = rank_within(f, ["dia"], "row_id", out="filter_pos", extra_order=[F.col("undecided_flag")])
    return ranked.select("row_id", "dia", "filter_pos")


def q_undecided_per_case(spark, sf):
    return report.undecided_per_case(_labelled(spark, sf), CFG)


def q_day_summary(spark, sf):
    return report.day_summary(_labelled(spark, sf), CFG)


def q_distinct_cases(spark, sf):
    return report.distinct_cases(_notices(spark, sf), CFG)


def q_cases_first_seen(spark, sf):
    return report.cases_first_seen(_notices(spark, sf), CFG)


def q_key_difference(spark, sf):
    return report.key_difference(_notices(spark, sf), dedup.filtered(_labelled(spark, sf), CFG), CFG)


def q_review_highlight(spark, sf):
    return report.review_highlight(_labelled(spark, sf), "similar").select("row_id", "row_style")


def q_eligible_cases(spark, sf):
    return match.eligible_cases(_filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY), CFG)


def q_case_sizes(spark, sf):
    prev, cur = _filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY)
    return report.case_sizes(prev, cur, match.eligible_cases(prev, cur, CFG), CFG)


def q_repeated_cases(spark, sf):
    prev, cur = _filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY)
    return report.repeated_cases(cur, prev, CFG).select("row_id", "processo")


def q_new_cases(spark, sf):
    n = _notices(spark, sf)
    cur, prev = n.where(F.col("dia") == CUR_DAY), n.where(F.col("dia") == PREV_DAY)
    return report.new_cases(cur, prev, CFG).select("row_id", "processo")


def _asked_pairs(spark, sf):
    """The pairs the cross-day loop compares, with their texts."""
    return match.cross_day_pairs(_filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY),
                                 match.TableJudge(_verdicts(spark, sf)), CFG)


def q_cross_day_pairs(spark, sf):
    return _asked_pairs(spark, sf).select("processo", "cur_id", "prev_id")


def q_cross_day_scores(spark, sf):
    """X4 on the pairs the cross-day loop compares."""
    scored = tfidf_cosine(_asked_pairs(spark, sf), ["cur_id", "prev_id"], "cur_text", "prev_text")
    return scored.select("cur_id", "prev_id", F.round("cosine", ROUND).alias("cosine"))


def q_cross_day_similar(spark, sf):
    """All pairs of today's and yesterday's filtered notices of a case with
    a cosine of at least 0.8."""
    p = similar_pairs(_filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY), OFFLINE_THRESHOLD, CFG)
    return p.select("processo", "cur_id", "prev_id", F.round("cosine", ROUND).alias("cosine"))


def q_cross_day_similar_documents(spark, sf):
    """J7 on real prose: twenty documents as yesterday, the next twenty as today
    and so on, one case per source."""
    d = _table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("processo"), F.col("text").alias("intimacao"))
    day = F.expr("row_id div 20 % 2")
    p = similar_pairs(d.where(day == PREV_DAY), d.where(day == CUR_DAY), OFFLINE_THRESHOLD, CFG)
    return p.select("processo", "cur_id", "prev_id", _rounded(F.col("cosine")).alias("cosine"))


def q_verdict_request(spark, sf):
    return _asked_pairs(spark, sf).select(
        "cur_id", "prev_id", match.verdict_request(F.col("cur_text"), F.col("prev_text")).alias("request"))


def q_verdict_parse(spark, sf):
    v = _verdicts(spark, sf)
    p = match.parse_verdict(F.col("response"))
    return v.select("cur_id", "prev_id", p["match"].alias("is_match"), p["error"].alias("error"))


def q_first_match(spark, sf):
    prev, cur = _filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY)
    out = match.match_days(prev, cur, match.TableJudge(_verdicts(spark, sf)), CFG)
    return out.select("row_id", "processo", "match_row")


def q_first_match_offline(spark, sf):
    prev, cur = _filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY)
    out = match.match_days(prev, cur, match.OfflineJudge(OFFLINE_THRESHOLD), CFG)
    return out.select("row_id", "processo", "match_row")


def q_asked_questions(spark, sf):
    prev, cur = _filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY)
    asked = match.asked_questions(prev, cur, match.TableJudge(_verdicts(spark, sf)), CFG)
    return asked.withColumnRenamed("match", "is_match")


def q_cross_day_summary(spark, sf):
    return report.cross_day_summary(q_first_match(spark, sf))


def q_two_day_report(spark, sf):
    """X13 from raw notices: label both days, filter, match, final table."""
    out, _ = two_day_report(_notices(spark, sf), PREV_DAY, CUR_DAY,
                            match.TableJudge(_verdicts(spark, sf)), CFG)
    return out.select("row_id", "processo", "noccur", "similar", "match_row")


def q_token_diff_head_pairs(spark, sf):
    """X1-X3 on the pairs the first round compares: every repeated notice
    against the first notice of its case."""
    n = _notices(spark, sf)
    heads = n.groupBy("dia", "processo").agg(F.min("row_id").alias("head_id"),
                                              F.min_by("intimacao", "row_id").alias("head_text"))
    pairs = spread(n.join(heads, ["dia", "processo"]).where(F.col("row_id") > F.col("head_id")), "row_id")
    diff = token_diff_udf(CFG.marker, CFG.window, CFG.python_slices)(F.col("head_text"), F.col("intimacao"))
    return pairs.select("row_id", "head_id", diff.alias("d")).select("row_id", "head_id", "d.*")


def _conversation_pairs(spark, sf):
    c = _table(spark, sf, "conversations")
    a, b = c.alias("a"), c.alias("b")
    return (a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
            .select(F.col("a.conv_id").alias("conv_id"), F.col("b.turn").alias("turn"),
                    F.col("a.text").alias("left_text"), F.col("b.text").alias("right_text")))


def q_tfidf_pair_cosine(spark, sf):
    scored = tfidf_cosine(_conversation_pairs(spark, sf), ["conv_id", "turn"], "left_text", "right_text")
    return scored.select("conv_id", "turn", F.round("cosine", ROUND).alias("cosine"))


def q_tfidf_pair_cosine_words(spark, sf):
    """X4 with the normaliser F10 `words` before it."""
    scored = tfidf_cosine(_conversation_pairs(spark, sf), ["conv_id", "turn"], "left_text", "right_text",
                          normalize=words_only)
    return scored.select("conv_id", "turn", F.round("cosine", ROUND).alias("cosine"))


def _wall_clock(df: DataFrame, name: str):
    """The stored wall-clock time of a Parquet timestamp whatever the session
    reads it as: NTZ as is, an instant rendered in UTC."""
    from pyspark.sql.types import TimestampType
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.to_utc_timestamp(F.col(name), spark_tz(df))
    return F.col(name)


def spark_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def q_iso_cleanup(spark, sf):
    e = _table(spark, sf, "events")
    iso = F.date_format(_wall_clock(e, "ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select("event_id", iso_cleanup(iso).alias("ts_clean"))


def q_assign_row_ids(spark, sf):
    e = _table(spark, sf, "events")
    e = e.select("event_id", F.to_date(_wall_clock(e, "ts")).alias("dia"))
    return days.assign_row_ids(e, "event_id", CFG).select("event_id", "dia", "row_id")


def _page_batch(spark, sf):
    p = _table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("order"),
                    F.regexp_replace("url", "^.*/", "").alias("name"),
                    F.encode(F.expr(PAGE_BODY_SQL), "UTF-8").alias("content"))


def _landing(spark, sf):
    """Pages as a batch of files of all kinds; the names of its empty files are
    stored already."""
    batch = _page_batch(spark, sf)
    catalog = (batch.where(F.length("content") == 0)
               .select(F.concat(F.lit(LANDING_FOLDER + "/"), F.col("name")).alias("path")))
    return landing.plan_landing(batch, catalog, LANDING_FOLDER, LANDING_OWNER,
                                upload_time=F.lit("2024-06-21 09:00:00").cast("timestamp"))


def q_rejected_notices(spark, sf):
    """Rows that cannot be labelled: notices with nulls planted by row id."""
    n = _notices(spark, sf)
    hole = lambda c, k: F.when(F.col("row_id") % 23 == k, None).otherwise(F.col(c))
    n = n.select(F.col("row_id").alias("id"), hole("row_id", 3).alias("row_id"), hole("dia", 5).alias("dia"),
                 hole("processo", 7).alias("processo"), hole("intimacao", 9).alias("intimacao"))
    return dedup.rejected_notices(n, CFG).select("id", "reason")


def q_landing_accept(spark, sf):
    acc, _ = _landing(spark, sf)
    return acc.select("order", "path", "content_type", "owner")


def q_landing_refused(spark, sf):
    _, ref = _landing(spark, sf)
    return ref.select("order", "path", "reason")


def q_landing_replay(spark, sf):
    """Three writers plan their pages against the same empty catalog and land
    one after the other: one winner per path, the others get ``exists``."""
    batch = _page_batch(spark, sf)
    place = f"{ensure_checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    state = landing.stored_catalog(spark, place)
    out = []
    for writer in range(3):
        _, refused = landing.land(batch.where(F.col("order") % 3 == writer), place, LANDING_FOLDER, LANDING_OWNER,
                                  F.lit("2024-06-21 09:00:00").cast("timestamp"), planned_at=state)
        out.append(refused.select("order", "path", F.col("reason").alias("outcome")))
    version, stored = landing.stored_catalog(spark, place)
    landed = stored.select("order", "path", F.lit("landed").alias("outcome"))
    for refused in out:
        landed = landed.unionByName(refused)
    return landed.withColumn("version", F.lit(version))


def _equal_notices(requests):
    """A judge for tests: a match if both notices are the same text."""
    out = []
    for r in requests:
        a, _, b = r[len('Notice A: "'):r.rindex('"\nReply only')].partition('"\nNotice B: "')
        word = "true" if a == b else "false"
        out.append(f'{{"same_story": {word}, "same_goal": {word}, "same_litigation": {word}}}')
    return out


def q_answer_store(spark, sf):
    """The distinct questions of the cross-day loop over three batches of
    cases that share an answer store, each asked once."""
    path = f"{ensure_checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}"
    judge = match.StoredJudge(match.CallableJudge(_equal_notices), path)
    prev, cur = _filtered_day(spark, sf, PREV_DAY), _filtered_day(spark, sf, CUR_DAY)
    for keys in (0, 1, 0):  # the first batch again: nothing new is asked
        part = F.pmod(F.ascii(F.substring("processo", -1, 1)), F.lit(2)) == keys
        _cut(match.first_matches(prev.where(part), cur.where(part), judge, CFG))
    return judge.answers(spark).select(
        F.col("_hash").alias("request_hash"), match.parse_verdict(F.col("response"))["match"].alias("is_match"),
        F.col("attempts").cast("long").alias("attempts"))


def _event_lines(spark, sf):
    """Events as lines of day files, some of them damaged."""
    e = _table(spark, sf, "events")
    return e.select(F.to_date(_wall_clock(e, "ts")).cast("string").alias("dia"), F.expr(EVENT_LINE_SQL).alias("value"))


def q_read_days_checked(spark, sf):
    """Day files of comma-separated lines read under a schema; good and
    rejected rows together are all lines."""
    place = f"{ensure_checkpoint_dir(spark)}/days-{uuid.uuid4().hex}"
    _event_lines(spark, sf).write.partitionBy("dia").text(place)
    cfg = CFG.with_columns(key="processo", row_id="row_id")
    good, bad = days.read_days_checked(spark, place, "row_id long, processo string, jornal string", cfg, header="false")
    same = ["row_id", "processo", "jornal", F.col("dia").cast("string").alias("dia")]
    return good.select(*same, F.lit(None).cast("string").alias("line"), F.lit("good").alias("status")).unionByName(
        bad.select(*same, "line", F.col("reason").alias("status")))


def q_written_summary(spark, sf):
    """Labelled notices written day by day and written again;
    the counts come from the writing itself."""
    place = f"{ensure_checkpoint_dir(spark)}/labelled-{uuid.uuid4().hex}"
    lab = _labelled(spark, sf)
    told = []
    for day in (PREV_DAY, CUR_DAY, PREV_DAY):
        told.append((day, days.write_checked(lab.where(F.col("dia") == day), place, CFG)))
    names = ["rows", "decided", "undecided", "removed", "representatives"]
    written = spark.createDataFrame([(d, *[c[n] for n in names]) for d, c in told[1:]],
                                    "dia long, " + ", ".join(f"{n} long" for n in names))
    stored = days.read_days(spark, place).groupBy("dia").agg(F.count(F.lit(1)).alias("stored"))
    return written.join(stored.select(F.col("dia").cast("long").alias("dia"), "stored"), "dia")


def q_content_type(spark, sf):
    b = _page_batch(spark, sf)
    return b.select("order", landing.content_type(F.col("content")).alias("content_type"))


def _objects(spark, sf):
    """An object listing derived from conversations: one manifest per
    (conversation, role), naming the turn files it compared."""
    c = _table(spark, sf, "conversations")
    return (c.groupBy("conv_id", "role")
            .agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(
                F.concat(F.lit("'turn_"), F.col("turn").cast("string"), F.lit(".xlsx'")))), ", "),
                F.lit("]")).alias("list_files_compare"))
            .select(F.concat(F.when(F.col("role") == "user", F.lit("compare/")).otherwise(F.lit("report/")),
                             F.col("conv_id").cast("string")).alias("name"),
                    (F.col("conv_id") * 10 + F.when(F.col("role") == "user", 1).otherwise(2)).alias("generation"),
                    "list_files_compare"))


def q_manifest_files(spark, sf):
    listed = landing.list_prefix(_objects(spark, sf), "compare")
    return landing.manifest_files(listed).select("name", "generation", "file_name")


def q_manifest_rejects(spark, sf):
    """Manifests without a readable list: some are taken away or cut short."""
    listed = _objects(spark, sf).withColumn("list_files_compare", F.expr(
        MANIFEST_HOLES_SQL.format(literal="list_files_compare", generation="generation")))
    return landing.manifest_rejects(landing.list_prefix(listed, "compare")).select("name", "generation", "reason")


def q_manifest_generations(spark, sf):
    return landing.generations(landing.list_prefix(_objects(spark, sf), "compare"))


def q_manifest_count(spark, sf):
    return landing.manifest_count(landing.list_prefix(_objects(spark, sf), "compare"))


def _accounts(spark, sf):
    return fixtures.run_sql(spark, ACCOUNTS_SQL.replace("FROM customer", "FROM {customer}"),
                            customer=_table(spark, sf, "customer"))


def q_account_checks(spark, sf):
    return quality.check_accounts(_accounts(spark, sf)).select(
        "c_custkey", "username_ok", "name_ok", "email_ok")


def q_account_quality(spark, sf):
    return quality.quality_report(quality.check_accounts(_accounts(spark, sf)))


QUERIES = {
    "notices": q_notices,
    "case_frequency": q_case_frequency,
    "exact_copy_leader": q_exact_copy_leader,
    "exact_copy_documents": q_exact_copy_documents,
    "label_similar": q_label_similar,
    "label_similar_documents": q_label_similar_documents,
    "label_similar_prose": q_label_similar_prose,
    "label_similar_orders": q_label_similar_orders,
    "label_similar_hot": q_label_similar_hot,
    "label_similar_leaders": q_label_similar_leaders,
    "asked_questions": q_asked_questions,
    "filtered_notices": q_filtered_notices,
    "representatives": q_representatives,
    "undecided_rows": q_undecided_rows,
    "decided_flag": q_decided_flag,
    "filtered_order": q_filtered_order,
    "undecided_per_case": q_undecided_per_case,
    "day_summary": q_day_summary,
    "distinct_cases": q_distinct_cases,
    "cases_first_seen": q_cases_first_seen,
    "key_difference": q_key_difference,
    "review_highlight": q_review_highlight,
    "eligible_cases": q_eligible_cases,
    "case_sizes": q_case_sizes,
    "repeated_cases": q_repeated_cases,
    "new_cases": q_new_cases,
    "cross_day_pairs": q_cross_day_pairs,
    "cross_day_scores": q_cross_day_scores,
    "cross_day_similar": q_cross_day_similar,
    "cross_day_similar_documents": q_cross_day_similar_documents,
    "verdict_request": q_verdict_request,
    "verdict_parse": q_verdict_parse,
    "first_match": q_first_match,
    "first_match_offline": q_first_match_offline,
    "cross_day_summary": q_cross_day_summary,
    "two_day_report": q_two_day_report,
    "token_diff_head_pairs": q_token_diff_head_pairs,
    "tfidf_pair_cosine": q_tfidf_pair_cosine,
    "iso_cleanup": q_iso_cleanup,
    "assign_row_ids": q_assign_row_ids,
    "rejected_notices": q_rejected_notices,
    "landing_accept": q_landing_accept,
    "landing_refused": q_landing_refused,
    "landing_replay": q_landing_replay,
    "answer_store": q_answer_store,
    "read_days_checked": q_read_days_checked,
    "written_summary": q_written_summary,
    "content_type": q_content_type,
    "tfidf_pair_cosine_words": q_tfidf_pair_cosine_words,
    "manifest_rejects": q_manifest_rejects,
    "manifest_files": q_manifest_files,
    "manifest_generations": q_manifest_generations,
    "manifest_count": q_manifest_count,
    "account_checks": q_account_checks,
    "account_quality": q_account_quality,
}


# --------------------------------------------------------------------------
# DuckDB side (the oracle).  Built on the fixture's known answers, not on
# our Spark code.

# The order notice text.
ORDER_NOTICES_SQL = """
SELECT o_orderkey AS row_id, CAST(0 AS BIGINT) AS dia, CAST({key} AS VARCHAR(64)) AS processo,
       concat('Pedido de venda com chave ', CAST({key} AS VARCHAR(64)), ' Intimado(s)/Citado(s): ',
              o_orderpriority, ' ', CAST(o_custkey AS VARCHAR(64)), ' ', o_orderstatus) AS intimacao
FROM orders
"""


# Notices that differ six tokens after the marker, out of its
# window, so no row of a case can join another.
LEADER_NOTICES_SQL = """
SELECT o_orderkey AS row_id, CAST(0 AS BIGINT) AS dia,
       CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR(64)) AS processo,
       concat('Intimado(s)/Citado(s): Pedido de venda sob o numero ',
              CAST(o_orderkey AS VARCHAR(64))) AS intimacao
FROM orders
"""

# File contents of every detected type, from the pages.
PAGE_BODY_SQL = """
CASE page_id % 7 WHEN 1 THEN concat('%PDF-1.4 ', html) WHEN 2 THEN concat('nota ', html) WHEN 3 THEN ''
  WHEN 4 THEN concat('a', chr(1), html)
  WHEN 5 THEN concat('PK', chr(3), chr(4), repeat('.', 26), 'xl/workbook.xml ', html)
  WHEN 6 THEN concat('PK', chr(3), chr(4), repeat('.', 26), 'word/xl/ ', html) ELSE html END
"""

# Lines of every kind: good, an id that is no number, a missing field,
# an additional one, no id, no key.
EVENT_LINE_SQL = """
CASE event_id % 11 WHEN 3 THEN concat('x', event_id, ',P', event_id % 40, ',DJSP')
  WHEN 5 THEN concat(event_id, ',P', event_id % 40) WHEN 6 THEN concat(event_id, ',P', event_id % 40, ',DJSP,more')
  WHEN 8 THEN concat(',P', event_id % 40, ',DJSP') WHEN 9 THEN concat(event_id, ',,DJSP')
  ELSE concat(event_id, ',P', event_id % 40, ',DJSP') END
"""

# Manifests without a list, and with one cut short.
MANIFEST_HOLES_SQL = """
CASE {generation} % 7 WHEN 3 THEN NULL WHEN 5 THEN substr({literal}, 1, length({literal}) - 1) ELSE {literal} END
"""

# Accounts that break each rule on some rows.
ACCOUNTS_SQL = """
SELECT c_custkey,
  CASE c_custkey % 4 WHEN 1 THEN concat(u, '.br') WHEN 2 THEN concat(u, '_xyz') ELSE u END AS username,
  CASE c_custkey % 5 WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN repeat(c_name, 6) ELSE c_name END AS name,
  CASE c_custkey % 6 WHEN 1 THEN concat(u, ' at ', s) WHEN 2 THEN '@' WHEN 3 THEN repeat(concat(u, '@'), 20)
    ELSE concat(u, '@', s, '.example') END AS email
FROM (SELECT c_custkey, c_name, lower(replace(c_name, '#', '_')) AS u, lower(c_mktsegment) AS s FROM customer) c
"""


def _order_labels_oracle(key: str) -> str:
    """Closed form: singletons and exact copies as usual; every other pair of
    a case is a two-sided marker edge, so the first residue row leads all the
    residue (or represents itself when it is alone)."""
    notices = ORDER_NOTICES_SQL.format(key=key)
    return f"""WITH o AS ({notices}),
w AS (SELECT row_id, processo, count(*) OVER (PARTITION BY processo) AS noccur,
      count(*) OVER (PARTITION BY processo, intimacao) AS n_exact,
      min(row_id) OVER (PARTITION BY processo, intimacao) AS leader FROM o),
r AS (SELECT *, count(*) FILTER (WHERE n_exact = 1 AND noccur > 1) OVER (PARTITION BY processo) AS n_res,
      min(CASE WHEN n_exact = 1 THEN row_id END) OVER (PARTITION BY processo) AS first_res FROM w)
SELECT row_id, processo, noccur, CAST(CASE WHEN noccur = 1 THEN row_id WHEN n_exact >= 2 THEN leader
       WHEN n_res >= 2 THEN first_res ELSE row_id END AS BIGINT) AS "similar" FROM r"""


VERDICTS_SQL = f"""
SELECT c.row_id AS cur_id, p.row_id AS prev_id, {fixtures.VERDICT_RESPONSE_SQL} AS response
FROM notices c JOIN notices p ON c.processo = p.processo
WHERE c.dia = {CUR_DAY} AND p.dia = {PREV_DAY}
"""

_N = f"notices AS ({fixtures.notices_sql(fixtures.DUCK_DIV)})"
_LAB = f"lab AS ({fixtures.expected_labels_sql(fixtures.DUCK_DIV)})"
_F = ("f AS (SELECT *, CASE WHEN sim = -1 THEN 1 ELSE 0 END AS undecided_flag FROM lab "
      "WHERE sim = row_id OR sim = -1)")
_DAYS = (f"prev AS (SELECT * FROM f WHERE dia = {PREV_DAY}), "
         f"cur AS (SELECT * FROM f WHERE dia = {CUR_DAY})")
_ELIG = ("elig AS (SELECT DISTINCT processo FROM cur WHERE starts_with(jornal, 'D J E N') "
         "AND processo IN (SELECT processo FROM prev))")
_BASE = f"WITH {_N}, {_LAB}, {_F}, {_DAYS}, {_ELIG}"
_VERD = f"verdicts AS ({VERDICTS_SQL})"
_FIELD = "(json_extract(response, '$.{f}')::VARCHAR = 'true')"
_ALL_TRUE = " AND ".join(_FIELD.format(f=f) for f in match.VERDICT_FIELDS)
_GATE = " OR ".join(f"contains(response, '{f}')" for f in match.VERDICT_FIELDS)
_PARSED = (f"parsed AS (SELECT cur_id, prev_id, response, ({_GATE}) AS gate, json_valid(response) AS ok_json, "
           f"CASE WHEN json_valid(response) THEN ({_ALL_TRUE}) END AS all_true FROM verdicts)")
_FIRST = ("firsts AS (SELECT v.cur_id, arg_min(v.prev_id, prev.undecided_flag * 1000000000000 + prev.row_id) AS prev_id "
          "FROM parsed v JOIN cur ON cur.row_id = v.cur_id JOIN prev ON prev.row_id = v.prev_id "
          "AND prev.processo = cur.processo JOIN elig ON elig.processo = cur.processo "
          "WHERE v.gate AND coalesce(v.all_true, false) GROUP BY v.cur_id)")
_MATCHED = (f"{_BASE}, {_VERD}, {_PARSED}, {_FIRST}, matched AS ("
            "SELECT cur.row_id, cur.processo, cur.noccur, cur.sim, "
            "CAST(coalesce(firsts.prev_id + 2, -1) AS BIGINT) AS match_row "
            "FROM cur LEFT JOIN firsts ON firsts.cur_id = cur.row_id)")
def _tfidf_sql(pairs: str, ids: str, left: str, right: str) -> str:
    """TF-IDF pair cosine in DuckDB over a CTE named ``pairs``."""
    tok = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    on = " AND ".join(f"l.{i} = r.{i}" for i in ids.split(", "))
    co = ", ".join(f"coalesce(l.{i}, r.{i}) AS {i}" for i in ids.split(", "))
    return f"""
tl AS (SELECT {ids}, term, count(*) AS c1 FROM (SELECT {ids}, unnest({tok.format(c=left)}) AS term FROM {pairs}) GROUP BY ALL),
tr AS (SELECT {ids}, term, count(*) AS c2 FROM (SELECT {ids}, unnest({tok.format(c=right)}) AS term FROM {pairs}) GROUP BY ALL),
tj AS (SELECT {co}, c1, c2, CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN 1.0 ELSE 1.0 + ln(1.5) END AS w
       FROM tl l FULL JOIN tr r ON {on} AND l.term = r.term),
ts AS (SELECT {ids}, sum(CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN c1 * c2 ELSE 0 END) AS dot,
              sum(pow(coalesce(c1, 0) * w, 2)) AS n1, sum(pow(coalesce(c2, 0) * w, 2)) AS n2
       FROM tj GROUP BY ALL),
tc AS (SELECT {ids}, CASE WHEN n1 = 0 OR n2 = 0 THEN 0.0 ELSE dot / (sqrt(n1) * sqrt(n2)) END AS cosine FROM ts)"""


def _words_sql(column: str) -> str:
    """F10 `words` in DuckDB (the texts hold no white space but ASCII's)."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bare = (f"[regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') "
            f"FOR x IN string_split_regex(lower({column}), '\\s+')]")
    return f"array_to_string([y FOR y IN {bare} IF regexp_full_match(y, '\\p{{L}}+') AND y NOT IN ({stops})], ' ')"


_CONV_PAIRS = ("cp AS (SELECT a.conv_id, b.turn, a.text AS left_text, b.text AS right_text "
               "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)")

_OFFLINE = (f"{_BASE}, cand AS (SELECT cur.row_id AS cur_id, prev.row_id AS prev_id, cur.intimacao AS cur_text, "
            "prev.intimacao AS prev_text, prev.undecided_flag FROM cur JOIN prev ON cur.processo = prev.processo "
            "JOIN elig ON elig.processo = cur.processo), "
            + _tfidf_sql("cand", "cur_id, prev_id", "cur_text", "prev_text") + ", "
            "offl AS (SELECT c.cur_id, arg_min(c.prev_id, c.undecided_flag * 1000000000000 + c.prev_id) AS prev_id "
            f"FROM cand c JOIN tc USING (cur_id, prev_id) WHERE tc.cosine >= {OFFLINE_THRESHOLD} GROUP BY c.cur_id)")

_ERROR = ("CASE WHEN response IS NULL THEN 'no_response' WHEN NOT gate THEN 'no_fields' "
          "WHEN NOT ok_json THEN 'malformed' WHEN all_true IS NULL THEN 'not_all_boolean' END")
_ASKED = (f"asked AS (SELECT cur.processo, v.cur_id, v.prev_id, "
          "row_number() OVER (PARTITION BY v.cur_id ORDER BY prev.undecided_flag, prev.row_id) - 1 AS question_no, "
          f"(gate AND coalesce(all_true, false)) AS is_match, {_ERROR} AS error "
          "FROM parsed v JOIN cur ON cur.row_id = v.cur_id JOIN prev ON prev.row_id = v.prev_id "
          "AND prev.processo = cur.processo JOIN elig ON elig.processo = cur.processo), "
          "stops AS (SELECT *, min(CASE WHEN is_match THEN question_no END) OVER (PARTITION BY cur_id) AS stop FROM asked)")

_ASKED_PAIRS = (f"{_BASE}, {_VERD}, {_PARSED}, {_ASKED}, ap AS (SELECT s.processo, s.cur_id, s.prev_id, "
                "c.intimacao AS cur_text, p.intimacao AS prev_text FROM stops s JOIN cur c ON c.row_id = s.cur_id "
                "JOIN prev p ON p.row_id = s.prev_id WHERE stop IS NULL OR question_no <= stop)")

_ACCOUNTS = f"acc AS ({ACCOUNTS_SQL})"
_CHECKS = ("chk AS (SELECT c_custkey, regexp_matches(username, '^[a-zA-Z0-9_-]{1,20}\\n?$') AS username_ok, "
           "(length(name) > 1 AND length(name) < 100) AS name_ok, "
           "(contains(email, '@') AND length(email) > 2 AND length(email) < 320) AS email_ok FROM acc)")
_PAGES = (f"batch AS (SELECT page_id AS \"order\", regexp_replace(url, '^.*/', '') AS name, {PAGE_BODY_SQL} AS body FROM pages), "
          f"planned AS (SELECT *, '{LANDING_FOLDER}/' || name AS path, "
          "min(\"order\") OVER (PARTITION BY name) AS first_order, "
          "bool_or(body = '') OVER (PARTITION BY name) AS stored FROM batch)")
_CTYPE = ("CASE WHEN starts_with(body, 'PK' || chr(3) || chr(4)) THEN CASE WHEN "
          r"regexp_matches(body, 'PK\x03\x04.{26}xl/', 's') THEN '" + landing.OOXML_SHEET + "' ELSE 'application/zip' END "
          "WHEN starts_with(body, '%PDF') THEN 'application/pdf' "
          "WHEN starts_with(lower(ltrim(body)), '<!doctype html') OR starts_with(lower(ltrim(body)), '<html') "
          "THEN 'text/html' WHEN body = '' THEN 'application/x-empty' "
          r"WHEN NOT regexp_matches(body, '[\x00-\x08\x0E-\x1F]') THEN 'text/plain' "
          "ELSE 'application/octet-stream' END")
_OBJECTS = ("objs AS (SELECT CASE WHEN role = 'user' THEN 'compare/' ELSE 'report/' END || CAST(conv_id AS VARCHAR) AS name, "
            "conv_id * 10 + CASE WHEN role = 'user' THEN 1 ELSE 2 END AS generation, turn FROM conversations)")

ORACLES = {
    "notices": f"WITH {_N} SELECT * FROM notices",
    "case_frequency": f"WITH {_N} SELECT row_id, dia, processo, count(*) OVER (PARTITION BY dia, processo) AS noccur FROM notices",
    "exact_copy_leader": f"""WITH {_N}, w AS (SELECT row_id, dia, processo,
        count(*) OVER (PARTITION BY dia, processo) AS noccur,
        count(*) OVER (PARTITION BY dia, processo, intimacao) AS n_exact,
        min(row_id) OVER (PARTITION BY dia, processo, intimacao) AS leader FROM notices)
        SELECT row_id, dia, processo, noccur,
        CAST(CASE WHEN noccur = 1 THEN row_id WHEN n_exact >= 2 THEN leader ELSE -1 END AS BIGINT) AS "similar" FROM w""",
    "exact_copy_documents": """WITH d AS (SELECT doc_id AS row_id, left(text, 12) AS processo, text FROM documents),
        w AS (SELECT row_id, processo, count(*) OVER (PARTITION BY processo) AS noccur,
        count(*) OVER (PARTITION BY processo, text) AS n_exact,
        min(row_id) OVER (PARTITION BY processo, text) AS leader FROM d)
        SELECT row_id, processo, noccur,
        CAST(CASE WHEN noccur = 1 THEN row_id WHEN n_exact >= 2 THEN leader ELSE -1 END AS BIGINT) AS "similar" FROM w""",
    "label_similar": f'WITH {_N}, {_LAB} SELECT row_id, dia, processo, CAST(noccur AS BIGINT) AS noccur, CAST(sim AS BIGINT) AS "similar" FROM lab',
    "label_similar_prose": f'SELECT row_id, dia, processo, CAST(noccur AS BIGINT) AS noccur, CAST(sim AS BIGINT) AS "similar" FROM ({fixtures.expected_labels_sql(fixtures.DUCK_DIV, prose=True)}) p',
    "label_similar_orders": _order_labels_oracle("o_custkey"),
    "label_similar_hot": _order_labels_oracle("o_orderstatus"),
    "filtered_notices": f'WITH {_N}, {_LAB}, {_F} SELECT row_id, dia, processo, CAST(sim AS BIGINT) AS "similar", undecided_flag FROM f',
    "representatives": f"WITH {_N}, {_LAB} SELECT row_id, dia, processo FROM lab WHERE sim = row_id",
    "undecided_rows": f"WITH {_N}, {_LAB} SELECT row_id, dia, processo FROM lab WHERE sim = -1",
    "decided_flag": f"WITH {_N}, {_LAB} SELECT row_id, sim >= 0 AS decided FROM lab",
    "filtered_order": f"""WITH {_N}, {_LAB}, {_F} SELECT row_id, dia,
        row_number() OVER (PARTITION BY dia ORDER BY undecided_flag, row_id) - 1 AS filter_pos FROM f""",
    "undecided_per_case": f"WITH {_N}, {_LAB} SELECT dia, processo, count(*) FILTER (WHERE sim = -1) AS n_undecided FROM lab GROUP BY dia, processo",
    "day_summary": f"""WITH {_N}, {_LAB} SELECT dia, count(*) FILTER (WHERE sim >= 0) AS decided,
        count(*) FILTER (WHERE sim < 0) AS undecided, count(*) AS total,
        count(*) FILTER (WHERE sim <> -1 AND sim <> row_id) AS removed FROM lab GROUP BY dia""",
    "distinct_cases": f"WITH {_N} SELECT dia, count(DISTINCT processo) AS n_cases FROM notices GROUP BY dia",
    "cases_first_seen": f"WITH {_N} SELECT dia, processo, min(row_id) AS first_row FROM notices GROUP BY dia, processo",
    "key_difference": f"""WITH {_N}, {_LAB}, {_F} SELECT DISTINCT dia, processo FROM notices
        WHERE (dia, processo) NOT IN (SELECT (dia, processo) FROM f)""",
    "review_highlight": f"""WITH {_N}, {_LAB} SELECT row_id,
        CASE WHEN sim = -1 THEN 'background-color: red' ELSE '' END AS row_style FROM lab""",
    "eligible_cases": f"{_BASE} SELECT processo FROM elig",
    "case_sizes": f"""{_BASE} SELECT e.processo, (SELECT count(*) FROM prev WHERE prev.processo = e.processo) AS n_prev,
        (SELECT count(*) FROM cur WHERE cur.processo = e.processo) AS n_cur FROM elig e""",
    "repeated_cases": f"{_BASE} SELECT row_id, processo FROM cur WHERE processo IN (SELECT processo FROM prev)",
    "new_cases": f"""WITH {_N} SELECT row_id, processo FROM notices WHERE dia = {CUR_DAY}
        AND processo NOT IN (SELECT processo FROM notices WHERE dia = {PREV_DAY})""",
    "cross_day_pairs": f"{_ASKED_PAIRS} SELECT processo, cur_id, prev_id FROM ap",
    "cross_day_scores": f"{_ASKED_PAIRS}, " + _tfidf_sql("ap", "cur_id, prev_id", "cur_text", "prev_text")
        + " SELECT cur_id, prev_id, round(tc.cosine, 6) AS cosine FROM ap LEFT JOIN tc USING (cur_id, prev_id)",
    "cross_day_similar": f"""{_BASE}, cand AS (SELECT cur.processo, cur.row_id AS cur_id, prev.row_id AS prev_id,
        cur.intimacao AS cur_text, prev.intimacao AS prev_text FROM cur JOIN prev ON cur.processo = prev.processo), """
        + _tfidf_sql("cand", "cur_id, prev_id", "cur_text", "prev_text")
        + f""" SELECT processo, cur_id, prev_id, round(cosine, 6) AS cosine FROM cand JOIN tc USING (cur_id, prev_id)
        WHERE cosine >= {OFFLINE_THRESHOLD}""",
    "cross_day_similar_documents": """WITH cand AS (SELECT c.source AS processo, c.doc_id AS cur_id, p.doc_id AS prev_id,
        c.text AS cur_text, p.text AS prev_text FROM documents c JOIN documents p
        ON c.source = p.source AND c.doc_id // 20 % 2 = 1 AND p.doc_id // 20 % 2 = 0), """
        + _tfidf_sql("cand", "cur_id, prev_id", "cur_text", "prev_text")
        + f""" SELECT processo, cur_id, prev_id, round(cosine, 6) AS cosine FROM cand JOIN tc USING (cur_id, prev_id)
        WHERE cosine >= {OFFLINE_THRESHOLD}""",
    "verdict_request": f"""{_ASKED_PAIRS} SELECT cur_id, prev_id,
        'Notice A: "' || cur_text || '"' || chr(10) || 'Notice B: "' || prev_text || '"' || chr(10) ||
        'Reply only with a JSON object: "same_story" (true if both notices report the same facts), "same_goal" (true if both order the same act), "same_litigation" (true if both belong to the same lawsuit), and "litigation-id" (the case number).' AS request
        FROM ap""",
    "verdict_parse": f"""WITH {_N}, {_VERD}, {_PARSED} SELECT cur_id, prev_id,
        (gate AND coalesce(all_true, false)) AS is_match,
        {_ERROR} AS error FROM parsed""",
    "asked_questions": f"""{_BASE}, {_VERD}, {_PARSED}, {_ASKED}
        SELECT processo, cur_id, prev_id, question_no, is_match, error FROM stops WHERE stop IS NULL OR question_no <= stop""",
    # No marker occurs in documents, so no row joins another; the first row of a
    # source that is no exact copy differs on both sides from a later one, so
    # every row from it on leads itself.
    "label_similar_documents": """WITH d AS (SELECT doc_id AS row_id, source AS processo, text,
        count(*) OVER (PARTITION BY source) AS noccur FROM documents WHERE source IS NOT NULL),
        w AS (SELECT *, count(*) OVER (PARTITION BY processo, text) AS n_exact,
        min(row_id) OVER (PARTITION BY processo, text) AS leader FROM d)
        SELECT row_id, processo, noccur, CASE WHEN n_exact >= 2 THEN leader ELSE row_id END AS "similar"
        FROM w WHERE text IS NOT NULL OR noccur = 1""",
    "label_similar_leaders": f"""SELECT row_id, processo, count(*) OVER (PARTITION BY processo) AS noccur,
        row_id AS "similar" FROM ({LEADER_NOTICES_SQL}) o""",
    "first_match": f"{_MATCHED} SELECT row_id, processo, match_row FROM matched",
    "first_match_offline": f"""{_OFFLINE} SELECT cur.row_id, cur.processo,
        CAST(coalesce(offl.prev_id + 2, -1) AS BIGINT) AS match_row FROM cur LEFT JOIN offl ON offl.cur_id = cur.row_id""",
    "cross_day_summary": f"""{_MATCHED} SELECT count(*) FILTER (WHERE match_row >= 0) AS matched,
        count(*) FILTER (WHERE match_row < 0) AS new, count(*) AS total FROM matched""",
    "two_day_report": f'SELECT row_id, processo, CAST(noccur AS BIGINT) AS noccur, CAST(sim AS BIGINT) AS "similar", match_row FROM ({_MATCHED} SELECT * FROM matched) m',
    "tfidf_pair_cosine": f"WITH {_CONV_PAIRS}, " + _tfidf_sql("cp", "conv_id, turn", "left_text", "right_text")
        + " SELECT cp.conv_id, cp.turn, round(tc.cosine, 6) AS cosine FROM cp LEFT JOIN tc USING (conv_id, turn)",
    "iso_cleanup": "SELECT event_id, replace(split_part(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '.', 1), 'T', ' ') AS ts_clean FROM events",
    "assign_row_ids": "SELECT event_id, CAST(ts AS DATE) AS dia, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS row_id FROM events",
    "rejected_notices": f"""WITH {_N}, h AS (SELECT row_id AS id, CASE WHEN row_id % 23 = 3 THEN NULL ELSE row_id END AS rid,
        CASE WHEN row_id % 23 = 5 THEN NULL ELSE dia END AS d, CASE WHEN row_id % 23 = 7 THEN NULL ELSE processo END AS p,
        CASE WHEN row_id % 23 = 9 THEN NULL ELSE intimacao END AS t FROM notices),
        c AS (SELECT *, count(*) FILTER (rid IS NOT NULL) OVER (PARTITION BY d, p) AS n FROM h)
        SELECT id, CASE WHEN d IS NULL THEN 'null_day' WHEN rid IS NULL THEN 'null_row_id' WHEN p IS NULL THEN 'null_key'
        ELSE 'null_text' END AS reason FROM c
        WHERE d IS NULL OR rid IS NULL OR p IS NULL OR (t IS NULL AND n > 1)""",
    "landing_accept": f"""WITH {_PAGES} SELECT "order", path, {_CTYPE} AS content_type, '{LANDING_OWNER}' AS owner
        FROM planned WHERE "order" = first_order AND NOT stored""",
    "landing_refused": f"""WITH {_PAGES} SELECT "order", path, 'exists' AS reason FROM planned
        WHERE "order" > first_order OR stored""",
    "landing_replay": f"""WITH {_PAGES}, r AS (SELECT "order", path, row_number() OVER (
        PARTITION BY path ORDER BY "order" % 3, "order") AS k FROM planned)
        SELECT "order", path, CASE WHEN k = 1 THEN 'landed' ELSE 'exists' END AS outcome, 3 AS version FROM r""",
    "answer_store": f"""{_BASE}, c AS (SELECT cur.row_id AS cur_id, cur.intimacao AS a, prev.intimacao AS b,
        row_number() OVER (PARTITION BY cur.row_id ORDER BY prev.undecided_flag, prev.row_id) - 1 AS q
        FROM cur JOIN elig ON elig.processo = cur.processo JOIN prev ON prev.processo = cur.processo),
        e AS (SELECT *, min(CASE WHEN a = b THEN q END) OVER (PARTITION BY cur_id) AS hit FROM c)
        SELECT DISTINCT sha256('Notice A: "' || a || '"' || chr(10) || 'Notice B: "' || b || '"' || chr(10) ||
        'Reply only with a JSON object: "same_story" (true if both notices report the same facts), "same_goal" (true if both order the same act), "same_litigation" (true if both belong to the same lawsuit), and "litigation-id" (the case number).') AS request_hash,
        a = b AS is_match, 1::BIGINT AS attempts
        FROM e WHERE hit IS NULL OR q < pow(2, floor(log2(hit + 1)) + 1) - 1""",
    "read_days_checked": f"""WITH l AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dia, {EVENT_LINE_SQL} AS line FROM events)
        SELECT CASE WHEN event_id % 11 IN (3, 8) THEN NULL ELSE event_id END AS row_id,
        CASE WHEN event_id % 11 = 9 THEN NULL ELSE 'P' || (event_id % 40) END AS processo,
        CASE WHEN event_id % 11 = 5 THEN NULL ELSE 'DJSP' END AS jornal, dia,
        CASE WHEN event_id % 11 IN (3, 5, 6) THEN line END AS line,
        CASE WHEN event_id % 11 IN (3, 5, 6) THEN 'bad_line' WHEN event_id % 11 = 8 THEN 'null_row_id'
             WHEN event_id % 11 = 9 THEN 'null_key' ELSE 'good' END AS status FROM l""",
    "written_summary": f"""WITH {_N}, {_LAB} SELECT dia, count(*) AS "rows", count(*) FILTER (WHERE sim >= 0) AS decided,
        count(*) FILTER (WHERE sim = -1) AS undecided, count(*) FILTER (WHERE sim >= 0 AND sim <> row_id) AS removed,
        count(*) FILTER (WHERE sim = row_id) AS representatives, count(*) AS stored FROM lab GROUP BY dia""",
    "content_type": f"WITH {_PAGES} SELECT \"order\", {_CTYPE} AS content_type FROM batch",
    "tfidf_pair_cosine_words": f"WITH {_CONV_PAIRS}, wp AS (SELECT conv_id, turn, {_words_sql('left_text')} AS left_text, "
        f"{_words_sql('right_text')} AS right_text FROM cp), " + _tfidf_sql("wp", "conv_id, turn", "left_text", "right_text")
        + " SELECT wp.conv_id, wp.turn, round(tc.cosine, 6) AS cosine FROM wp LEFT JOIN tc USING (conv_id, turn)",
    "manifest_rejects": f"""WITH {_OBJECTS} SELECT DISTINCT name, generation,
        CASE WHEN generation % 7 = 3 THEN 'no_list' ELSE 'bad_list' END AS reason
        FROM objs WHERE name LIKE 'compare%' AND generation % 7 IN (3, 5)""",
    "manifest_files": f"""WITH {_OBJECTS} SELECT name, generation, 'turn_' || CAST(turn AS VARCHAR) || '.xlsx' AS file_name
        FROM objs WHERE starts_with(name, 'compare')""",
    "manifest_generations": f"WITH {_OBJECTS} SELECT DISTINCT generation FROM objs WHERE starts_with(name, 'compare')",
    "manifest_count": f"WITH {_OBJECTS} SELECT greatest(count(DISTINCT name), 1) AS n_manifests FROM objs WHERE starts_with(name, 'compare')",
    "account_checks": f"WITH {_ACCOUNTS}, {_CHECKS} SELECT * FROM chk",
    "account_quality": f"""WITH {_ACCOUNTS}, {_CHECKS} SELECT count(*) FILTER (WHERE NOT username_ok) AS username_ok_failures,
        count(*) FILTER (WHERE NOT name_ok) AS name_ok_failures, count(*) FILTER (WHERE NOT email_ok) AS email_ok_failures FROM chk""",
}
