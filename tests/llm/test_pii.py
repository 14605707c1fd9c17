"""Personal data: base spans against the contract's patterns, proposals by planted rows."""
import hashlib
import random
import time

import brute
import pytest
from docket.llm import pii, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def _detected(df):
    return [(r.doc_id, [(pii.KINDS[s.kind], s.start, s.stop, s.base) for s in r.spans]) for r in df.collect()]


def _base(spans):
    return [s[:3] for s in spans if s[3]]


ODD = [
    None, "", "a@b.c_d@e.f x@y z@.com @a.b a@b..c a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 001.0002.3.255 1.2.3",
    "😀 a@b.co 😀😀 +1 (974) 555-3436 é 10.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 0 1",
    "+123456789 +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 ++44 20 7946 0958. +4",
    "0" * 13 + " " + "1 " * 40 + "5-5-5", "+49 (30) 123456-7 a+b@c.de %@%.% --@--.--",
    "4111111111111111@1.2.3.4 +4111111111111111", "1." * 3_000, "me@x.org " * 1_000, "+" * 3_000,
]
#: Long texts with their base spans (a backing-off pattern would not end on them).
LONG = [
    ("x" * 300_000 + "@", []), ("1" * 300_000, []), ("1 " * 200_000, []), ("+1" + "(" * 100_000, []),
    ("a@" + "a." * 100_000 + "a", [("email", 0, 200_003)]),
    ("1." * 40_000, [("ip", i, i + 7) for i in range(0, 80_000 - 7, 8)]),
    ("Aa" * 100_000 + " B", []), ("1:" * 100_000, []), ("a at " * 40_000, []), ("1234." * 40_000, []),
]


def test_base_spans_follow_the_patterns(spark):
    rng = random.Random(11)
    alphabet = ["a", "B", "9", "1", "0", ".", "@", "+", "-", " ", "(", ")", "_", "%", "é", "😀", "\n", "4111", "255"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]
    expected = [brute.personal(t) for t in texts] + [e for _, e in LONG]
    texts += [t for t, _ in LONG]
    began = time.time()
    got = dict(_detected(pii.detect(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(8))))
    assert time.time() - began < 120
    for i, t in enumerate(texts):
        assert _base(got[i]) == expected[i], t[:80] if t else t


def test_query_on_whole_table(spark, docs):
    got = {r.doc_id: r for r in queries.op12_pii(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        base = brute.personal(text)
        r = got[d]
        for kind, n in zip(pii.BASE, (r.n_email, r.n_ip, r.n_card, r.n_phone)):
            assert n == sum(s[0] == kind for s in base)
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | ({""} if not joined else set())
    assert any(r.spans for r in got.values())


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with spans that only the method finds, among plain texts."""
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice(["the", "of", "report", "river", "seven"]) for _ in range(12))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    rows, truth = [], {}
    for i in range(400):
        kind, before, span = [
            ("email", "please email ", f"user{i} [at] mail{i}.org"), ("phone", "call ", f"({200 + i}) 555-{digits(4)}"),
            ("ip", "server address ", f"2001:db8:{i:x}:0:1:2:3:{i % 9:x}"),
            ("name", "signed by ", f"Dr. Anna Weber{'abcdefgh'[i % 8]}"), (None, "about ", "12:30:45 of 3"),
            (None, "in ", f"1234.567.{i % 10}00"), ("card", "visa card ", "4111.1111.1111.1111")][i % 7]
        head = fill() + " " + before
        rows.append((i, head + span + ", " + fill() + f" +1 (212) 555-{digits(4)} u{i}@example.com"))
        if kind:
            truth[i] = (kind, len(head), len(head) + len(span))
    return rows, truth


def test_proposals_are_found_and_others_left(spark, planted):
    rows, truth = planted
    got = dict(_detected(pii.detect(spark.createDataFrame(rows, SCHEMA).repartition(5))))
    for i, text in rows:
        assert _base(got[i]) == brute.personal(text)
        added = [s[:3] for s in got[i] if not s[3]]
        assert added == ([truth[i]] if i in truth else []), (i, text, added)


def test_label_model_is_expectation_maximisation(spark, planted):
    """The rates equal those of a plain version on the same vote counts."""
    found = pii.candidates(spark.createDataFrame(planted[0], SCHEMA))
    model = pii.label_model(found).collect()
    assert {pii.KINDS[r.kind] for r in model} == set(pii.KINDS)
    for kind in {r.kind for r in model}:
        rows = [r for r in model if r.kind == kind]
        share, hit, miss = 0.5, [0.8] * 3, [0.1] * 3
        for _ in range(pii.ROUNDS):
            soft = []
            for r in rows:
                yes, no = share, 1 - share
                for v, h, m in zip(r.votes, hit, miss):
                    yes, no = yes * (h if v else 1 - h), no * (m if v else 1 - m)
                soft.append((r.votes, r.n * yes / (yes + no), r.n))
            y, n = sum(s[1] for s in soft), sum(s[2] for s in soft)
            share = (y + 1) / (n + 2)
            hit = [(sum(s[1] for s in soft if s[0][v]) + 8) / (y + 10) for v in range(3)]
            miss = [(sum(s[2] - s[1] for s in soft if s[0][v]) + 1) / (n - y + 10) for v in range(3)]
        assert rows[0].share == pytest.approx(share)
        assert rows[0].hit == pytest.approx(hit) and rows[0].miss == pytest.approx(miss)


def test_main_path_is_native(spark):
    """No Python, pandas or Arrow node in any plan of the operator."""
    d = spark.createDataFrame([(1, "a@b.co")], SCHEMA)
    found = pii.candidates(d)
    labels = pii.label_model(found)
    for df in (found, labels, pii.span_classifier(found, labels), pii.detect(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_odd_tables(spark, edge, empty):
    """Nulls, empty and long texts, repeated rows, columns of clashing names."""
    odd = edge.withColumnRenamed("size", "spans").withColumnRenamed("key", "kind").withColumnRenamed("h", "b_email")
    got = pii.detect(odd)
    assert got.columns == ["doc_id", "spans"]
    assert sorted((str(d), s) for d, s in _detected(got)) == sorted(
        (str(r.doc_id), [(*s, True) for s in brute.personal(r.text)]) for r in edge.collect())
    assert pii.detect(empty).count() == 0
    none = pii.detect(edge.withColumn("text", F.lit(None).cast("string"))).select("spans").distinct().collect()
    assert [list(r.spans) for r in none] == [[]]
