"""Leader rounds (X5, J2): the rule that skips pairs, the state of the rounds, their cost."""
import random

import pytest
from pyspark.sql import functions as F

import model
from docket.config import DEFAULT as CFG
from docket.config import MARKER
from docket.functions.tokendiff import marker_edge
from docket.operators import dedup, nearcopy

W = CFG.window


def marks(tokens):
    """{prefix up to a marker: leaf or None}, written from the rule."""
    out, n = {}, len(tokens)
    for p, t in enumerate(tokens):
        if t == MARKER:
            leaf = None
            if n > p + W:
                again = [tokens[i] in tokens[i + 1:] for i in range(p + 1, p + W + 1)]
                if (not any(again)) if n >= 200 else (n < 2 * p + W + 4 or not again[-1]):
                    leaf = (n >= 200, tuple(tokens[:p + 1 + W]))
            out[tuple(tokens[:p + 1])] = leaf
    return out


def may_have_edge(a, b):
    a, b = marks(a), marks(b)
    return any(p in b and (a[p] is None or a[p] != b[p]) for p in a)


def _texts(rng, long):
    """Two texts of few distinct tokens with much in common: shared prefixes,
    moved and repeated runs."""
    vocabulary = [MARKER, *"abcdefg"[:rng.randint(2, 7)], *(f"r{i}" for i in range(rng.choice([0, 3, 60])))]
    run = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    head = run(rng.randint(0, 4)) + [MARKER] + run(rng.randint(0, 9))
    middle, pieces = run(rng.randint(0, 8)), []
    for _ in range(2):
        t = head + (middle if rng.random() < .5 else run(rng.randint(0, 6)))
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(t))
            t = t[:rng.randint(0, len(t))] + t[a:a + rng.randint(1, 12)] + t if rng.random() < .2 else \
                t + rng.choice([head, t[a:a + rng.randint(1, 12)], run(rng.randint(1, 6))])
        pieces.append(t)
    if long:  # 200 tokens and more, some of them popular, few moved
        tail = [rng.choice(["de", "a", f"t{i}", f"t{i}", f"t{i}"]) for i in range(220)]
        pieces = [[*t[:30], *tail[rng.randint(0, 8):]] for t in pieces]
    return pieces


@pytest.mark.parametrize("long", [False, True])
def test_a_skipped_pair_has_no_edge(long):
    rng = random.Random(17 + long)
    skipped = edges = 0
    for _ in range(6_000 if long else 30_000):
        a, b = _texts(rng, long)
        found = marker_edge(" ".join(a), " ".join(b), MARKER, W)
        edges += bool(found)
        if not may_have_edge(a, b):
            skipped += 1
            assert not found, (a, b)
    assert skipped > 60 and edges > 50


def test_marks_follow_the_rule(spark):
    rng = random.Random(4)
    pairs = [_texts(rng, i % 10 == 0) for i in range(400)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    rows = rows.select("i", nearcopy.markers(F.col("a"), CFG).alias("a"), nearcopy.markers(F.col("b"), CFG).alias("b"))
    got = {r.i: r.may for r in rows.select("i", nearcopy._may_have_edge(F.col("a"), F.col("b")).alias("may")).collect()}
    assert all(got[i] == may_have_edge(a, b) for i, (a, b) in enumerate(pairs))
    assert 50 < sum(got.values()) < 390


SCHEMA = "row_id bigint, dia bigint, processo string, intimacao string"


@pytest.fixture
def watched(monkeypatch):
    """What the rounds checkpoint and how many pairs meet their texts."""
    seen = {"columns": set(), "pairs": 0}
    cut, judged = nearcopy._cut, nearcopy._judged

    def watch(df):
        seen["columns"] |= set(df.columns)
        return cut(df)

    def count(*args):
        out = judged(*args)
        seen["pairs"] += out.count()
        return out
    monkeypatch.setattr(nearcopy, "_cut", watch)
    monkeypatch.setattr(dedup, "_cut", watch)
    monkeypatch.setattr(nearcopy, "_judged", count)
    return seen


def test_rounds_hold_no_text(spark, watched):
    h = f"Vara Civel {MARKER}"
    rows = [(i, 0, f"P{i % 3}", f"{h} NOME{i % 7} decide {i}") for i in range(60)]
    labelled = dedup.label_similar(spark.createDataFrame(rows, SCHEMA))
    got = {r.row_id: (r.noccur, r.similar) for r in labelled.collect()}
    assert got == model.label([(r[0], r[2], r[3]) for r in rows])
    assert watched["columns"] and not {c for c in watched["columns"] if "text" in c or c == "intimacao"} - {"_no_text"}


def test_texts_are_joined_in_their_buckets(spark):
    """Rows' texts reach the diff from a bucketed scan, without an exchange."""
    rows = [(i, 0, f"P{i % 5}", f"Vara Civel de {MARKER} NOME{i} x") for i in range(50)]
    texts = nearcopy.residue_table(spark.createDataFrame(rows, SCHEMA), CFG)
    work, g = texts.select("dia", "processo", "row_id"), ["dia", "processo"]
    heads = nearcopy._heads(work, g, "row_id", 0, CFG)
    met = work.join(heads.drop("_last"), g).where(F.col("row_id") > F.col("_h"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nearcopy._judged(met, heads, texts, g, CFG)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The scans of head and row texts come last, with no exchange above them.
    tail = plan.rsplit("Exchange", 1)[1].splitlines()
    scans = [line for line in tail if "FileScan" in line and "intimacao" in line]
    assert len(scans) == 2 and all("Bucketed: true" in line for line in scans)


def test_rows_that_all_lead_settle_at_once(spark, watched):
    """1,600 rows of one leaf: one pair a row (the sticky start), no rounds of leaders."""
    rows = [(i, 0, "P", f"Vara {MARKER} Pedido de venda sob o numero {i}") for i in range(1600)]
    got = dedup.label_similar(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.similar == r.row_id for r in got) and len(got) == 1600
    assert watched["pairs"] == 1599


def test_pairs_stay_linear_with_other_leaves(spark, watched):
    """Leaders of one leaf, rows of other leaves that join, and a few that cannot."""
    h = f"Tribunal Regional Vara Civel {MARKER}"
    rows = []
    for i in range(210):
        text = f"{h} Pedido de venda sob o numero {i}"
        if i % 3 == 1:
            text = f"{h} RUI ALVES {i}"                # joins the first leader
        elif i % 50 == 2:
            text = f"{h} Pedido de venda sob"          # a prefix of the leaders: one-sided, joins none
        rows.append((i, 0, "P", text + (f" x{i}" if i % 50 == 2 and i % 100 else "")))
    labelled = dedup.label_similar(spark.createDataFrame(rows, SCHEMA))
    got = {r.row_id: (r.noccur, r.similar) for r in labelled.collect()}
    assert got == model.label([(r[0], r[2], r[3]) for r in rows])
    assert watched["pairs"] < 40 * len(rows)
