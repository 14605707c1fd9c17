"""Cross-day matching.

For every case present yesterday and carried today by an eligible journal,
each of today's filtered rows is compared with yesterday's filtered rows of
the same case in filtered order (representatives, then undecided rows, each
by id); the first pair the judge calls a match gives ``match_row`` =
yesterday's row id + 2 (its spreadsheet row), else -1.

Judges:

* ``TableJudge``   -- answers already stored as (cur_id, prev_id, response);
  the first match is two partial minimums per row (representatives, then
  undecided rows), no pair enumeration.
* ``OfflineJudge`` -- TF-IDF cosine >= threshold, computed natively.  It is a
  stand-in for a model and is not equivalent to one.
* ``CallableJudge``-- any Python function from request texts to response
  texts, run on executors through ``mapInPandas``.
* ``StoredJudge``  -- keeps a callable judge's answers by content: one call for
  each distinct question, over rounds and runs.

Judges that cost something per pair run in rounds: each of today's
unmatched rows asks about its next few candidates in filtered order (the
count doubles per round), and stops at its first match, like the
reference's early exit.  A round asks at most width questions per row.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, TriageConfig, UNDECIDED
from .nearcopy import _add, _cut, _cut_answers, _dealt, _union_all
from .ranking import rank_within
from .similarity import tfidf_cosine

# Field names of a judge's answer.
VERDICT_FIELDS = ("same_story", "same_goal", "same_litigation")
VERDICT_SCHEMA = ("same_story boolean, same_goal boolean, same_litigation boolean, "
                  "`litigation-id` string")
FIRST_WIDTH = 4
MAX_WIDTH = 256


def verdict_request(cur_text: Column, prev_text: Column) -> Column:
    """The question put to the judge for one pair (our own wording)."""
    return F.concat(
        F.lit('Notice A: "'), cur_text, F.lit('"\nNotice B: "'), prev_text,
        F.lit('"\nReply only with a JSON object: "same_story" (true if both notices '
              'report the same facts), "same_goal" (true if both order the same act), '
              '"same_litigation" (true if both belong to the same lawsuit), and '
              '"litigation-id" (the case number).'))


def parse_verdict(response: Column) -> Column:
    """struct(match, error).

    A response naming none of the three fields is skipped; otherwise the whole
    text must be one JSON object (text or a second value after it, or a bare
    ``NaN``, is malformed).  Only JSON ``true`` counts: missing fields, strings
    and malformed JSON give no match (and an error label) instead of failing.
    """
    gate = F.lit(False)
    for f in VERDICT_FIELDS:
        gate = gate | F.coalesce(response.contains(f), F.lit(False))
    parsed = F.from_json(response, VERDICT_SCHEMA)
    all_true = parsed["same_story"] & parsed["same_goal"] & parsed["same_litigation"]
    # As the single element of a list, nothing can follow the object unseen.
    listed = F.try_parse_json(F.concat(F.lit("["), response, F.lit("]")))
    whole = (listed.isNotNull() & F.ltrim(response).startswith("{")
             & F.try_variant_get(listed, "$[1]", "variant").isNull())
    error = (F.when(response.isNull(), F.lit("no_response"))
             .when(~gate, F.lit("no_fields"))
             .when(~whole, F.lit("malformed"))
             .when(all_true.isNull(), F.lit("not_all_boolean")))
    match = error.isNull() & F.coalesce(all_true, F.lit(False))
    return F.struct(match.alias("match"), error.alias("error"))


def eligible_cases(prev_f: DataFrame, cur_f: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """P4 + J1: keys with an eligible-journal row today that also occur yesterday.

    Filters cases, not rows: all of today's rows of such a case are compared.
    """
    k_ = cfg.key
    today = (cur_f.where(F.col(cfg.journal).startswith(cfg.journal_prefix))
             .select(k_).distinct())
    return today.join(prev_f.select(k_), k_, "left_semi")


class TableJudge:
    """Stored answers: a table (cur_id, prev_id, response)."""

    def __init__(self, verdicts: DataFrame):
        self.verdicts = verdicts.select("cur_id", "prev_id", "response")

    def respond(self, tries: DataFrame) -> DataFrame:
        return tries.join(self.verdicts, ["cur_id", "prev_id"], "left")


class OfflineJudge:
    """TF-IDF cosine >= threshold on the two texts (same answer for the three fields)."""

    def __init__(self, threshold: float = 0.8):
        self.threshold = threshold

    def respond(self, tries: DataFrame) -> DataFrame:
        scored = tfidf_cosine(tries, ["cur_id", "prev_id"], "cur_text", "prev_text", "_cos")
        ok = F.coalesce(F.col("_cos") >= F.lit(self.threshold), F.lit(False))
        resp = F.to_json(F.struct(ok.alias("same_story"), ok.alias("same_goal"),
                                  ok.alias("same_litigation"),
                                  F.col("_key").alias("litigation-id")))
        return scored.withColumn("response", resp).drop("_cos")


class CallableJudge:
    """A Python function list[str] -> list[str] applied to request batches on executors.

    A call that fails is repeated request by request; a request that fails
    again has a null response (no match) and the message in ``call_error``.
    ``first_width`` is the number of candidates asked at once in the first
    round: 1, as a paid judge wants, asks none after a match.
    """

    def __init__(self, fn: Callable[[list[str]], list[str]], first_width: int = 1):
        self.fn = fn
        self.first_width = first_width

    def respond(self, tries: DataFrame) -> DataFrame:
        fn = self.fn
        # StructType.add mutates in place; build a new schema instead.
        schema = T.StructType([*tries.schema.fields, T.StructField("response", T.StringType()),
                               T.StructField("call_error", T.StringType())])

        def ask(requests):
            try:
                out = list(fn(requests))
                if len(out) != len(requests):
                    raise ValueError(f"{len(out)} answers to {len(requests)} requests")
                return [(x, None) for x in out]
            except Exception as problem:  # the judge's own failure, of any kind
                if len(requests) == 1:
                    return [(None, f"{type(problem).__name__}: {problem}")]
                return [a for r in requests for a in ask([r])]

        def run(batches):
            for pdf in batches:
                out = ask(pdf["request"].tolist()) if len(pdf) else []
                yield pdf.assign(response=pd.Series([a for a, _ in out], index=pdf.index, dtype="object"),
                                 call_error=pd.Series([e for _, e in out], index=pdf.index, dtype="object"))
        return tries.mapInPandas(run, schema)


class StoredJudge:
    """A judge that asks nothing twice: answers are kept by the SHA-256 of the
    request in a table (a folder shared by runs), which every round looks up
    first.  Equal requests of a round are one call.  A call that failed is
    made again in a later round or run, ``max_attempts`` times in all.  With a
    ``budget`` at most that many calls are made by this object; requests beyond
    it (in order of their hash) have no answer and the error ``budget``.

    ``judge`` answers a table by its column ``request`` (``CallableJudge``).
    """

    def __init__(self, judge, path: str, max_attempts: int = 3, budget: int | None = None):
        self.judge, self.path, self.max_attempts, self.budget = judge, path, max_attempts, budget
        self.first_width = getattr(judge, "first_width", FIRST_WIDTH)
        self.calls = 0

    def answers(self, spark) -> DataFrame:
        """(_hash, response, call_error, attempts) of every request asked so far."""
        if not self.calls and not _exists(spark, self.path):
            return spark.createDataFrame([], "_hash string, response string, call_error string, attempts int")
        rows = spark.read.schema(STORED).parquet(self.path)
        return rows.groupBy("_hash").agg(
            F.max_by(F.struct("response", "call_error"), F.struct("attempt", F.col("response").isNotNull())).alias("a"),
            F.max("attempt").alias("attempts")).select("_hash", "a.*", "attempts")

    def respond(self, tries: DataFrame) -> DataFrame:
        spark = tries.sparkSession
        asked = tries.withColumn("_hash", F.sha2(F.col("request"), 256))
        known = self.answers(spark)
        done = known.where(F.col("response").isNotNull() | (F.col("attempts") >= self.max_attempts))
        new = (asked.where(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.any_value("request").alias("request"))
               .join(done, "_hash", "left_anti").join(known.select("_hash", "attempts"), "_hash", "left"))
        if self.budget is not None:
            new = new.orderBy("_hash").limit(max(0, self.budget - self.calls))
        new = _cut(new)
        n = new.count()
        if n:
            replies = self.judge.respond(new)
            failed = F.col("call_error") if "call_error" in replies.columns else F.lit(None).cast("string")
            replies.select("_hash", "response", failed.alias("call_error"),
                           (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt")
                           ).write.mode("append").parquet(self.path)
            self.calls += n
        found = self.answers(spark).select("_hash", "response", "call_error", F.lit(True).alias("_asked"))
        beyond = F.when(F.col("_asked").isNull() & F.col("_hash").isNotNull(), F.lit("budget"))
        return asked.join(found, "_hash", "left").withColumn(
            "call_error", F.coalesce("call_error", beyond)).drop("_hash", "_asked")


STORED = "_hash string, response string, call_error string, attempt int"


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _candidates(prev_f: DataFrame, cur_f: DataFrame, cfg: TriageConfig):
    r, t, k_ = cfg.row_id, cfg.text, cfg.key
    elig = eligible_cases(prev_f, cur_f, cfg)
    cur_c = cur_f.join(elig, k_, "left_semi").select(
        F.col(k_).alias("_key"), F.col(r).alias("cur_id"), F.col(t).alias("cur_text"))
    prev_c = prev_f.join(elig, k_, "left_semi").select(
        F.col(k_).alias("_key"), F.col(r).alias("prev_id"), F.col(t).alias("prev_text"),
        (F.col("similar") == UNDECIDED).cast("int").alias("prev_undecided"))
    return cur_c, prev_c


def first_matches(prev_f: DataFrame, cur_f: DataFrame, judge, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """X11: (cur_id, prev_id) of the first matching yesterday row per today row."""
    cur_c, prev_c = _candidates(prev_f, cur_f, cfg)
    if type(judge) is TableJudge:  # stored answers: no rounds needed
        answered = (judge.verdicts.join(_dealt(cur_c.select("_key", "cur_id")), "cur_id")
                    .join(_dealt(prev_c.select("_key", "prev_id", "prev_undecided")), ["_key", "prev_id"])
                    .where(parse_verdict(F.col("response"))["match"]))
        # Filtered order = representatives first, then by id: the smallest
        # representative, else the smallest undecided row (two hash-aggregated mins).
        first = F.coalesce(F.min(F.when(F.col("prev_undecided") == 0, F.col("prev_id"))),
                           F.min(F.when(F.col("prev_undecided") == 1, F.col("prev_id"))))
        return answered.groupBy("cur_id").agg(first.alias("prev_id"))
    return (_answers_in_rounds(prev_c, cur_c, judge).where("match")
            .groupBy("cur_id").agg(F.min_by("prev_id", "_rank").alias("prev_id")))


def asked_questions(prev_f: DataFrame, cur_f: DataFrame, judge, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """J3 + X9: the questions of the cross-day loop with their answers: each
    eligible row of today against yesterday's rows of its case in filtered
    order, up to and including its first match.

    Columns: key, cur_id, prev_id, question_no (from 0), match, error (null,
    the label of ``parse_verdict`` or the message of a failed call).
    """
    cur_c, prev_c = _candidates(prev_f, cur_f, cfg)
    asked = _answers_in_rounds(prev_c, cur_c, judge)
    first = asked.where("match").groupBy("cur_id").agg(F.min("_rank").alias("_first"))
    return (asked.join(first, "cur_id", "left")
            .where(F.col("_first").isNull() | (F.col("_rank") <= F.col("_first")))
            .select(F.col("_key").alias(cfg.key), "cur_id", "prev_id",
                    F.col("_rank").alias("question_no"), "match", "error"))


def _answers_in_rounds(prev_c: DataFrame, cur_c: DataFrame, judge) -> DataFrame:
    """Answers (_key, cur_id, _rank, prev_id, match, error) of all rounds; the
    last round of a row may ask past its first match."""
    ranked = _cut(rank_within(prev_c, ["_key"], "prev_id", out="_rank",
                              extra_order=[F.col("prev_undecided")]))
    sizes = ranked.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    state = _cut(cur_c.join(sizes, "_key").select(
        "_key", "cur_id", "cur_text", "_n",
        F.lit(0).cast("bigint").alias("_lo"), F.lit(getattr(judge, "first_width", FIRST_WIDTH)).cast("bigint").alias("_w")))
    out = [cur_c.sparkSession.createDataFrame(
        [], cur_c.select("_key", "cur_id").schema.add("_rank", "long").add(
            "prev_id", prev_c.schema["prev_id"].dataType).add("match", "boolean").add("error", "string"))]
    while not state.isEmpty():
        tries = (state.select("_key", "cur_id", "cur_text", F.explode(F.sequence(
            F.col("_lo"), F.least(F.col("_lo") + F.col("_w"), F.col("_n")) - 1)).alias("_rank"))
            .join(ranked.select("_key", "_rank", "prev_id", "prev_text"), ["_key", "_rank"])
            .withColumn("request", verdict_request(F.col("cur_text"), F.col("prev_text"))))
        replies = judge.respond(tries)
        failed = F.col("call_error") if "call_error" in replies.columns else F.lit(None).cast("string")
        parsed = parse_verdict(F.col("response"))
        answered = _cut_answers(replies.select("_key", "cur_id", "_rank", "prev_id", parsed["match"].alias("match"),
                                               F.coalesce(failed, parsed["error"]).alias("error")))
        out = _add(out, answered)
        state = _cut(state.join(answered.where("match"), "cur_id", "left_anti")
                     .withColumn("_lo", F.col("_lo") + F.col("_w"))
                     .withColumn("_w", F.least(F.col("_w") * 2, F.lit(MAX_WIDTH)))
                     .where(F.col("_lo") < F.col("_n")))
    return _union_all(out[1:], out[0])


def match_days(prev_f: DataFrame, cur_f: DataFrame, judge, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """All of today's filtered rows plus ``match_row``."""
    firsts = first_matches(prev_f, cur_f, judge, cfg)
    return (cur_f.join(_dealt(firsts.withColumnRenamed("cur_id", cfg.row_id)), cfg.row_id, "left")
            .withColumn("match_row", F.coalesce(F.col("prev_id") + F.lit(cfg.row_offset),
                                                F.lit(UNDECIDED)).cast("bigint"))
            .drop("prev_id"))


def cross_day_pairs(prev_f: DataFrame, cur_f: DataFrame, judge, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """The pairs the cross-day loop compares, with both texts: each eligible
    row of today with yesterday's rows of its case in filtered order, up to and
    including its first match."""
    cur_c, prev_c = _candidates(prev_f, cur_f, cfg)
    asked = asked_questions(prev_f, cur_f, judge, cfg).select(cfg.key, "cur_id", "prev_id")
    return (asked.join(cur_c.select("cur_id", "cur_text"), "cur_id")
            .join(prev_c.select("prev_id", "prev_text"), "prev_id")
            .select(cfg.key, "cur_id", "cur_text", "prev_id", "prev_text"))
