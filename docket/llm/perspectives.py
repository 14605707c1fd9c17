"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering of it with their own
turns as the assistant and all others as named users; the mask holds the
character spans to learn: the body and end mark of their own turns.  Context
roles (``system``) speak to everyone and are no participants.

A rendering is the whole dialogue at every size.  It is handed over in parts of
``part_turns`` distinct turns by rank, which, put together in order, are the
rendering; mask offsets count from the beginning of the dialogue.  Nearly
every conversation is one part; a longer one is ranked over a range
partitioning and the lengths of its parts are summed up, so no task gathers it
whole.  The bound is one of turns, not of bytes: a turn is never cut.  Very
long turns are rendered as they are.  DataFrame functions only; the result's
columns are those named below, and extra columns of any name are not read.

Nulls: a null text is empty, a null role is the named user ``unknown`` and no
participant, a null conversation id is a conversation of its own, null turns
come before all others; a whole conversation without any turn number has a null
part.  Equal turn numbers are ordered by role and text; identical rows are rendered
once, and ``n_rows`` counts them all.  A conversation without a participant, or an
empty table, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

END = "<|end|>\n"


TURN = ("turn", "role", "text")


def _ranked(turns: DataFrame) -> DataFrame:
    """``turns`` with the ``rank`` of each in its conversation, from 0.  Rows are
    dealt out by ranges, ranked inside a range, and moved on by the rows of the
    conversation in the ranges before."""
    dealt = stage(turns.repartitionByRange("conv", *TURN).withColumn(
        "range", F.spark_partition_id()), "turns")
    own = F.row_number().over(Window.partitionBy("conv", "range").orderBy(*TURN)) - 1
    sizes = dealt.groupBy(F.col("conv").alias("c"), F.col("range").alias("r")).agg(
        F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranked = dealt.withColumn("own", own).join(
        sizes, F.col("conv").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return ranked.select("conv", *TURN, "k", (F.col("own") + F.col("before")).alias("rank"))


def _turns(rows: DataFrame, part_turns: int, most_rows: int):
    """(parts, lengths).  ``parts``: for each conversation and part its distinct
    turns in order, and n_rows.  ``lengths``: for each part of a long
    conversation and role the number and characters of its turns (None: no
    conversation is long).  If some conversation has more rows than a part may
    have turns, identical rows are merged before any is gathered."""
    turn = F.struct(*TURN)
    whole = F.when(F.max("turn").isNotNull(), F.lit(0)).cast("long").alias("part")
    largest = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= min(part_turns, most_rows):
        got = rows.groupBy("conv").agg(whole, F.collect_list(turn).alias("all"))
        return got.select("conv", "part", F.array_sort(F.array_distinct("all")).alias("turns"),
                          F.size("all").cast("long").alias("n_rows")), None
    rows = stage(rows.groupBy("conv", *TURN).agg(F.count(F.lit(1)).alias("k")), "turns")
    long = rows.groupBy(F.col("conv").alias("l")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > part_turns)
    in_long = F.col("conv").eqNullSafe(F.col("l"))
    gathered = (F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("k").alias("n_rows"))
    short = rows.join(long, in_long, "left_anti").groupBy("conv").agg(whole, *gathered)
    part = F.floor(F.col("rank") / part_turns).cast("long").alias("part")
    ranked = stage(_ranked(rows.join(long, in_long, "left_semi")).select("*", part), "ranked")
    lengths = ranked.groupBy(F.col("conv").alias("c"), F.col("part").alias("p"), "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return short.unionByName(ranked.groupBy("conv", "part").agg(*gathered)), lengths


def _header(role: Column, speaker: Column, context_roles: list[str]) -> Column:
    name = F.coalesce(role, F.lit("unknown"))
    return (F.when(role == speaker, F.lit("<|assistant|>\n"))
            .when(name.isin(context_roles), F.concat(F.lit("<|"), name, F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n"))))


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text", context_roles: tuple[str, ...] = ("system",),
           part_turns: int = 64, most_rows: int = 10_000) -> DataFrame:
    """One row per conversation, participant and part: ``conv_id``,
    ``speaker``, ``part``, ``n_rows``, ``n_turns``, ``n_own``, ``rendered``
    and ``mask`` (spans of the whole dialogue)."""
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    speakers = (rows.where(F.col("role").isNotNull() & ~F.col("role").isin(*context_roles))
                .select("conv", F.col("role").alias("speaker")).distinct()
                .select(F.col("conv").alias("c"), "speaker"))
    parts, lengths = _turns(rows, part_turns, most_rows)
    views = parts.join(speakers, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    header = lambda role: _header(role, F.col("speaker"), list(context_roles))
    piece = F.transform("turns", lambda t: F.struct(
        F.concat(header(t["role"]), t["text"], F.lit(END)).alias("text"),
        (F.length(t["text"]) + len(END)).alias("learn"),
        (t["role"] == F.col("speaker")).alias("own")))
    if lengths is None:
        views = views.withColumn("base", F.lit(0).cast("long"))
    else:
        said = F.col("chars") + F.col("n") * (F.length(header(F.col("role"))) + len(END))
        sizes = (lengths.join(speakers.withColumnRenamed("c", "of"), F.col("c").eqNullSafe(F.col("of")))
                 .groupBy("c", F.col("speaker").alias("by"), "p").agg(F.sum(said).alias("size")))
        before = Window.partitionBy("c", "by").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        # First parts begin at 0, so only the later ones of long conversations meet their sums.
        starts = sizes.withColumn("base", F.sum("size").over(before)).where(F.col("p") > 0).drop("size")
        views = (views.join(starts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("by"))
                            & (F.col("part") == F.col("p")), "left")
                 .withColumn("base", F.coalesce("base", F.lit(0)).cast("long")))
    views = views.withColumn("pieces", piece)
    # One walk over the pieces, with the length of all before.
    spans = F.expr("""aggregate(pieces, struct(base as at, cast(array() as
        array<struct<start: bigint, stop: bigint>>) as spans), (a, p) -> struct(
        a.at + length(p.text) as at,
        if(p.own, concat(a.spans, array(struct(a.at + length(p.text) - p.learn as start,
                                               a.at + length(p.text) as stop))), a.spans) as spans)).spans""")
    return views.select(
        F.col("conv").alias("conv_id"), "speaker", "part", "n_rows",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(spans).cast("long").alias("n_own"),
        F.array_join(F.col("pieces.text"), "").alias("rendered"), spans.alias("mask"))


def mask_text(mask: Column) -> Column:
    """Spans as text: start-stop, joined by commas."""
    return F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["start"], m["stop"])), ",")
