"""Near-copy step (W3, X5, W4) without materialising all pairs of a case.

Semantics, per (day, case), over the *residue* (rows of repeated cases that
are not part of an exact-copy group), rows ascending by id:

1. ``k`` = the smallest row that has a two-sided diff with some later row.
2. Rows before ``k`` stay undecided (-1); if exactly one such row exists it
   represents itself.
3. Rows from ``k`` on, ascending: a row joins the smallest earlier *leader*
   whose diff to it has the marker shortly before both first differences;
   otherwise it becomes a leader itself.

Texts are written once, to a columnar table bucketed by row id
(``residue_table``), beside what the leader search needs of them: for each
marker the hash of the tokens up to it (*block*) and of those and the five
tokens after it (*leaf*).  All further state is ids and hashes.

Both searches run in rounds.  Each round compares remaining rows of a group
with a few *heads* (the group's smallest remaining rows: one in the first
round, then 64 and more, within a pair budget), so a round emits at most
width x n pairs for a group of n rows.  Heads come from a partial aggregate
(or a limited rank of ids in later rounds) and reach the rows through an
equi-join on the case key, which AQE splits or broadcasts; the pairs, ids and
the head's text, are dealt by row id and meet the row's text in its bucket,
which is not shuffled.  Round state is checkpointed to cut lineage.

The sticky-start rounds also return the marker edges of ``k`` (they diff
``k`` against every later row anyway), so in the common case -- ``k`` is the
first residue row and claims its near copies -- the leader rounds only see
what ``k`` left.

Which pairs the leader rounds need not diff.  Say the first difference of a
pair (the lesser of the first deleted and the first inserted index) is i: the
texts have the same first i tokens, and an edge needs a marker p with
p < i <= p + window.

* No common prefix ends with a marker: no edge.  So rows meet by block.
* Every marker with a common prefix up to it is followed by ``window`` equal
  tokens, i.e. the common prefix has c > p + window tokens.  Then i <= p +
  window < c: the alignment leaves the common prefix early, which it does only
  for a block of equal tokens that begins at i in one text and later, at y > i,
  in the other.  That other text therefore repeats its own tokens from i on at
  y.  In a pair whose right side has under 200 tokens such a block must be
  longer than the whole common prefix, so the other text repeats its token p +
  window later on and has at least 2 p + window + 4 tokens; in a longer one
  (popular tokens do not count as a match's start there) it repeats one of the
  ``window`` tokens after the marker.  A row that does neither is *safe* at
  p, and two safe rows of one leaf have no edge by p.

So a group whose remaining rows are all safe rows of one leaf has no edge
left: they all lead, at once.  And where the first remaining rows are, all rows
before the first other row lead, and only the others are compared with them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TriageConfig, UNDECIDED
from ..functions.text import py_tokens
from ..functions.tokendiff import marker_edge_udf, two_sided_marker_udf
from ..session import ensure_checkpoint_dir


def _cut(df: DataFrame) -> DataFrame:
    """Materialise a round's state in the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, col: str) -> DataFrame:
    """Even out rows before a Python UDF.  After a join on the case key one
    hot case sits in one partition; the diff is CPU-bound, so the pairs are
    re-hashed on the row id.  AQE then sizes the partitions (small ones are
    merged up to its minimum size, so a late round with few pairs does not
    start thousands of empty tasks)."""
    return df.repartition(col)


def _dealt(side: DataFrame) -> DataFrame:
    """A side of a join on row ids, which grows with the rows: dealt by id like
    the other side, so that no copy of it goes through the driver."""
    return side.hint("merge")


def _union_all(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts, empty)


# Heads per group: one in the first round (it settles ordinary groups, and
# a wider first round would multiply the diff work), then 64 times more, so
# long chains of undecidable rows and groups with many leaders need few
# rounds.  A group's width stops growing at its pair budget divided by its
# remaining rows (never below ``cfg.max_heads``, never above
# ``cfg.wide_heads``): a small group finishes in a round or two, and a round
# of a hot group stays linear in its rows.
GROWTH = 64

# Spark's own bound on the buckets of a table.
MAX_BUCKETS = 100_000

# Answers of this many rounds are merged into one checkpoint, so the plan of
# the final union does not grow with the number of rounds.
MERGE_ROUNDS = 16


def residue_table(residue: DataFrame, cfg: TriageConfig) -> DataFrame:
    """The rows to compare, written once: day, key, row id, text and
    ``_marks`` (``markers``), in Parquet files bucketed by day and row id, so
    that no case is one bucket, and a join on the row id reads a text where it
    lies.  The files are in the checkpoint folder; the catalog forgets them."""
    spark = residue.sparkSession
    d, k_, r, t = cfg.day, cfg.key, cfg.row_id, cfg.text
    name = f"docket_residue_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    # Rows without the marker string skip tokenizing altogether.
    rows = (residue.select(d, k_, r, t)
            .withColumn("_toks", F.when(F.col(t).contains(cfg.marker), py_tokens(F.col(t)))
                        .otherwise(F.array().cast("array<string>")))
            .withColumn("_marks", markers(F.col("_toks"), cfg)).drop("_toks"))
    (rows.repartition(n, d, r).write.bucketBy(n, d, r).sortBy(d, r)
     .option("path", path).format("parquet").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _judged(pairs: DataFrame, heads: DataFrame, texts: DataFrame, g: list[str], cfg: TriageConfig) -> DataFrame:
    """Pairs of ids (row, ``_h``) with both texts: the few heads' texts travel
    with the pairs, the rows' texts stay in their buckets."""
    d, r, t = cfg.day, cfg.row_id, cfg.text
    head_texts = heads.select(d, "_h").join(
        texts.select(d, F.col(r).alias("_h"), F.col(t).alias("_h_text")), [d, "_h"])
    return pairs.select(*g, r, "_h").join(head_texts, [d, "_h"]).join(texts.select(d, r, t), [d, r])


def _heads(work: DataFrame, g: list[str], r: str, rnd: int, cfg: TriageConfig) -> DataFrame:
    """The smallest rows of every group (``_h``) and ``_last``, the largest head
    of the group (a row is a head iff it is not larger).

    One head per group is a partial ``min``; wider rounds rank the ids -- the
    row-number limit is applied to every partition before the shuffle, so a
    task gets at most ``wide_heads`` ids of a group from each.
    """
    if rnd == 0:
        return work.groupBy(*g).agg(F.min(r).alias("_h"), F.min(r).alias("_last"))
    limit = min(GROWTH ** rnd, max(cfg.wide_heads, cfg.max_heads))
    ids = work.select(*g, r)
    by_id = Window.partitionBy(*g).orderBy(r)
    heads = ids.withColumn("_rank", F.row_number().over(by_id)).where(F.col("_rank") <= limit)
    if limit > cfg.max_heads:
        left = ids.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
        width = F.greatest(F.lit(cfg.max_heads), F.floor(F.lit(cfg.pair_budget) / F.col("_n")))
        heads = heads.join(left, g).where(F.col("_rank") <= width)
    return _cut(heads.select(*g, F.col(r).alias("_h"), F.max(r).over(Window.partitionBy(*g)).alias("_last")))


def _cut_answers(df: DataFrame) -> DataFrame:
    """``_cut`` under other column names, renamed back: a checkpointed table
    that is a direct member of a union brings constraints on columns the
    union does not know, and the optimizer fails on them."""
    names = df.columns
    return _cut(df.toDF(*[f"_a_{c}" for c in names])).toDF(*names)


def _add(out: list[DataFrame], answers: DataFrame) -> list[DataFrame]:
    """``out`` with one more (materialised) table of answers."""
    out = [*out, answers]
    return [_cut_answers(_union_all(out[1:], out[0]))] if len(out) >= MERGE_ROUNDS else out


def sticky_start(texts: DataFrame, cfg: TriageConfig):
    """Per case, ``k`` = first residue row with a two-sided later partner.

    ``texts`` is a ``residue_table``.  Returns ``(ks, k_edges)``:
    ``ks`` = (day, key, k) for the cases that have one (others are absent);
    ``k_edges`` = (day, row_id, similar=k) for the rows whose diff from ``k``
    passes the marker rule.  Those pairs are diffed here anyway, and ``k`` is
    the first leader of its case, so they are final labels and the leader
    rounds start without them.

    Each round tries the next few rows of every unresolved case as heads (1,
    then 64 and more), so a round costs at most width x n pairs for a case of
    n rows; each head is compared only with the rows after it.  Heads without
    a two-sided partner leave the work set with everything before them.
    """
    d, k_, r, t = cfg.day, cfg.key, cfg.row_id, cfg.text
    g = [d, k_]
    judge = two_sided_marker_udf(cfg.marker, cfg.window, cfg.python_slices)
    work = texts.select(d, k_, r)
    spark = texts.sparkSession
    found = [spark.createDataFrame([], work.select(d, k_, F.col(r).alias("k")).schema)]
    edges = [spark.createDataFrame([], work.select(d, r, F.col(r).alias("similar")).schema)]
    rnd = 0
    while not work.isEmpty():
        heads = _heads(work, g, r, rnd, cfg)
        met = work.join(heads.drop("_last"), g).where(F.col(r) > F.col("_h"))
        pairs = _cut(_judged(met, heads, texts, g, cfg)
                     .select(*g, r, "_h", judge(F.col("_h_text"), F.col(t)).alias("_f")))
        verdict = pairs.groupBy(*g).agg(F.min(F.when(F.col("_f.two_sided"), F.col("_h"))).alias("k"))
        # One row per group, so the remaining rows meet it in a single join.
        outcome = _cut(heads.groupBy(*g).agg(F.max("_last").alias("_last")).join(verdict, g, "left"))
        settled = outcome.where(F.col("k").isNotNull()).select(*g, "k")
        found = _add(found, settled)
        edges = _add(edges, pairs.join(settled, g).where((F.col("_h") == F.col("k")) & F.col("_f.marker"))
                     .select(d, r, F.col("k").alias("similar")))
        work = _cut(work.join(outcome, g)
                    .where(F.col("k").isNull() & (F.col(r) > F.col("_last"))).drop("_last", "k"))
        rnd += 1
    return _union_all(found[1:], found[0]), _union_all(edges[1:], edges[0])


def markers(tokens: Column, cfg: TriageConfig) -> Column:
    """For every marker occurrence p: ``block``, the hash of the tokens up to
    it, and ``leaf``, the SHA-256 of those and the ``window`` tokens after it
    (null if there are fewer or the row is not safe at p).

    ``tokens`` must be a column reference (not an expression) so the split
    is not re-run inside the lambdas.
    """
    w = cfg.window
    n = F.size(tokens)
    prefix = lambda length: F.array_join(F.slice(tokens, F.lit(1), length), " ")
    repeats = lambda i: F.array_contains(F.slice(tokens, i + 2, n), F.get(tokens, i))
    long = n >= 200  # difflib sets popular tokens apart from this length on

    def safe(p):
        after = F.sequence(p + 1, p + w)
        return F.when(long, ~F.exists(after, repeats)).otherwise((n < 2 * p + w + 4) | ~repeats(p + w))

    def mark(p):
        leaf = F.unhex(F.sha2(F.concat(F.when(long, "L ").otherwise("S "), prefix(p + 1 + w)), 256))
        return F.struct(F.xxhash64(prefix(p + 1)).alias("block"),
                        F.when(n > p + w, F.when(safe(p), leaf)).alias("leaf"))
    at = F.filter(F.transform(tokens, lambda tok, i: F.when(tok == F.lit(cfg.marker), i)),
                  lambda p: p.isNotNull())
    return F.transform(at, mark)


def _may_have_edge(a: Column, b: Column) -> Column:
    """Whether two rows' ``_marks`` leave an edge possible: a shared block in
    which they are not safe rows of one leaf."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["block"] == y["block"])
                                          & ~F.coalesce(x["leaf"] == y["leaf"], F.lit(False))))


def _group_facts(work: DataFrame, g: list[str], r: str, cfg: TriageConfig) -> DataFrame:
    """One row per group: ``_leaf`` of its first row, ``_other``, the first row
    that is no safe row of that leaf (null: there is none, all lead), and
    ``_all``: the rows before it are all heads of this round, as they are few
    enough for the rows they must be compared with."""
    leaves = work.groupBy(*g, "_leaf").agg(F.min(r).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = leaves.groupBy(*g).agg(F.min(F.struct("_first", "_leaf")).alias("_a"))
    same = F.coalesce(F.col("_leaf") == F.col("_a._leaf"), F.lit(False))
    facts = leaves.join(first, g).groupBy(*g).agg(
        F.any_value("_a")["_leaf"].alias("_leaf"),
        F.min(F.when(~same, F.col("_first"))).alias("_other"),
        F.sum(F.when(same, F.col("_n")).otherwise(0)).alias("_run"),
        F.sum(F.when(same, 0).otherwise(F.col("_n"))).alias("_others"))
    few = F.col("_leaf").isNotNull() & (F.col("_run") * F.col("_others") <= cfg.pair_budget)
    return _cut(facts.withColumn("_all", few).drop("_run", "_others"))


def _leading_heads(heads: DataFrame, edges: DataFrame, g: list[str], r: str) -> DataFrame:
    """``_leaders`` of each group whose heads do not all lead: earlier heads
    with an edge to each head, then the greedy fold over the (at most
    ``wide_heads``) heads of the group in id order."""
    nobody = F.lit(None).cast("bigint")
    nb = (heads.where(~F.col("_all")).select(*g, F.col("_h").alias(r), nobody.alias("_h"))
          .unionByName(edges.where(~F.col("_all") & (F.col(r) <= F.col("_last")))
                       .select(*g, r, F.col("_h").cast("bigint")))
          .repartition(*g).groupBy(*g, r).agg(F.collect_list("_h").alias("_nb")))
    return (nb.groupBy(*g)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(r).alias("i"), F.col("_nb").alias("nb"))))
                 .alias("_heads"))
            .select(*g, F.aggregate(
                "_heads", F.array().cast("array<bigint>"),
                lambda acc, x: F.when(F.exists(x["nb"], lambda n: F.array_contains(acc, n)), acc)
                .otherwise(F.concat(acc, F.array(x["i"].cast("bigint"))))).alias("_leaders")))


def leader_clusters(rows: DataFrame, texts: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Greedy leaders over the rows from ``k`` on.

    ``rows``: day, key, row_id, ``_marks`` (rows >= k of cases with a k);
    ``texts`` is their ``residue_table``.  Output: (day, row_id, similar).

    Groups of safe rows of one leaf settle at once.  In any other group a round
    takes the next remaining rows as candidate heads and diffs every later
    remaining row that may have an edge to them.  Heads settle among
    themselves in id order (a bounded fold; rows of one leaf all lead), the
    other rows join their smallest leading head; rows without an edge wait for
    the next round.  When every row of a case has a single marker block, the
    blocks of the case are independent groups and run side by side; otherwise
    the whole case is one group.
    """
    d, k_, r, t = cfg.day, cfg.key, cfg.row_id, cfg.text
    edge = marker_edge_udf(cfg.marker, cfg.window, cfg.python_slices)
    # Group id 0 = the whole case (some row has several marker blocks).
    multi = rows.groupBy(d, k_).agg(F.max(F.size("_marks")).alias("_mb"))
    single = (F.col("_mb") == 1) & (F.size("_marks") == 1)
    grouped = _cut(rows.join(multi, [d, k_])
                   .withColumn("_grp", F.when(single, F.get("_marks", F.lit(0))["block"])
                               .otherwise(F.lit(0).cast("bigint")))
                   .withColumn("_leaf", F.when(single, F.get("_marks", F.lit(0))["leaf"]))
                   .drop("_mb"))
    # A row without a marker can neither join a leader nor be joined.
    alone = grouped.where(F.size("_marks") == 0).select(d, r, F.col(r).alias("similar"))
    g = [d, k_, "_grp"]
    work = grouped.where(F.size("_marks") > 0)
    out: list[DataFrame] = [alone]
    rnd = 0
    while not work.isEmpty():
        facts = _group_facts(work, g, r, cfg)
        alike = F.col("_leaf").isNotNull() & F.col("_other").isNull()
        any_whole, any_rest = facts.agg(F.max(alike), F.max(~alike)).first()
        if any_whole:
            whole = facts.where(alike).select(*g)
            out = _add(out, _cut_answers(work.join(whole, g, "left_semi").select(d, r, F.col(r).alias("similar"))))
            work = work.join(whole, g, "left_anti")
            facts = facts.where(~alike)
        if not any_rest:
            break
        heads = _heads(work, g, r, rnd, cfg).withColumn("_all", F.lit(False))
        if rnd:
            every = facts.where("_all").select(*g, "_other")
            run = work.join(every, g).where(F.col(r) < F.col("_other")).select(
                *g, F.col(r).alias("_h"), F.col("_other").alias("_last"), F.lit(True).alias("_all"))
            heads = heads.join(every, g, "left_anti").unionByName(run)
        marks = work.select(d, F.col(r).alias("_h"), F.col("_marks").alias("_h_marks"))
        heads = _cut(heads.join(marks, [d, "_h"]))
        met = work.join(heads, g).where((F.col(r) > F.col("_h")) & _may_have_edge(
            F.col("_marks"), F.col("_h_marks")))
        # Python UDFs inside CASE are evaluated for every row, so the pairs
        # are filtered before the diff runs.
        edges = _cut(_judged(met, heads, texts, g, cfg).where(edge(F.col("_h_text"), F.col(t)))
                     .select(*g, "_h", r).join(heads.select(d, "_h", "_last", "_all"), [d, "_h"]))
        # A row goes to its smallest leading head; a leading head has no
        # smaller one but itself.  So every head is settled by its round, and
        # the decided rows are all that leave the work set.
        chosen = edges.select(*g, "_h", r, "_all").unionByName(
            heads.select(*g, "_h", F.col("_h").alias(r), "_all"))
        if rnd:  # the single heads of the first round all lead
            leading = F.col("_all") | F.array_contains("_leaders", F.col("_h").cast("bigint"))
            chosen = chosen.join(_leading_heads(heads, edges, g, r), g, "left").where(leading)
        decided = _cut_answers(chosen.groupBy(d, r).agg(F.min("_h").alias("similar")))
        out = _add(out, decided)
        work = _cut(work.join(_dealt(decided.select(d, r)), [d, r], "left_anti"))
        rnd += 1
    return _union_all(out[1:], out[0])


def near_copy_labels(residue: DataFrame, cfg: TriageConfig) -> DataFrame:
    """W3 + X5 + W4 over the residue (day, key, row_id, text). Output: (day, row_id, similar)."""
    d, k_, r = cfg.day, cfg.key, cfg.row_id
    texts = residue_table(residue, cfg)
    ks, k_edges = sticky_start(texts, cfg)
    with_k = texts.select(d, k_, r, "_marks").join(ks, [d, k_], "left")
    # k leads its case; rows it already claimed skip the leader rounds.
    k_rows = ks.select(d, F.col("k").alias(r), F.col("k").alias("similar"))
    late = (with_k.where(F.col("k").isNotNull() & (F.col(r) > F.col("k"))).drop("k")
            .join(_dealt(k_edges.select(d, r)), [d, r], "left_anti"))
    early = with_k.where(F.col("k").isNull() | (F.col(r) < F.col("k"))).select(d, k_, r)
    # A case with exactly one undecided row promotes it.
    n_early = early.groupBy(d, k_).agg(F.count(F.lit(1)).alias("_n_early"))
    early_lab = (early.join(n_early, [d, k_])
                 .select(d, r, F.when(F.col("_n_early") == 1, F.col(r))
                         .otherwise(F.lit(UNDECIDED)).cast("bigint").alias("similar")))
    return (early_lab.unionByName(k_rows).unionByName(k_edges)
            .unionByName(leader_clusters(late, texts, cfg)))
