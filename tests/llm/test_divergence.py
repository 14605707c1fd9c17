"""Source divergence audit against brute force."""
import random

import brute
import pytest
from docket.llm import divergence

SCHEMA = "text string, lang string, source string"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def _rows(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["été", "Straße", "ÉTÉ", "日本"]
    weight = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weight, k=n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", "c", "É"]))
            for _ in range(250)]
    rows += [("same copy of a row", "en", "hot")] * 300
    rows += [("1 2 3 !", "en", "no terms"), ("only here", "xx", "lone"), (None, "en", None), ("", None, None),
             ("was was was", None, "n"), ("was", None, "n"), ("WAS", None, "m"), ("tie tie", None, "m"),
             ("tie", None, "m"), ("tie", None, "o")]
    return rows


def test_equal_to_brute_force(spark, docs):
    got = _rows(divergence.audit(spark.createDataFrame(docs, SCHEMA).repartition(6)))
    assert got == brute.divergence(docs)
    assert {("xx", "lone")} == {r[:2] for r in got if r[0] == "xx"} or not any(r[0] == "xx" for r in got)


def test_small_blocks_and_flushes_add_up(spark, docs, monkeypatch):
    """Blocks of a few columns; texts in groups of a few bytes, long ones in parts."""
    monkeypatch.setattr(divergence, "MAX_COLUMNS", 5)
    monkeypatch.setattr(divergence, "MAX_TERMS", 3)
    monkeypatch.setattr(divergence, "GROUP_BYTES", 40)  # most texts in parts
    got = _rows(divergence.audit(spark.createDataFrame(docs, SCHEMA).repartition(3), top_terms=4))
    assert got == brute.divergence(docs, top=4)


def test_joint_tables_count_every_term(spark):
    held = lambda **c: [{"source": s, "n": n} for s, n in c.items()]
    rows = [("en", "t1", 5, held(a=2, b=3)), ("en", "t2", 5, held(a=2, b=3)), ("en", "t3", 3, held(a=2, c=1)),
            ("en", "t4", 9, held(b=9)), ("fr", "t1", 4, held(a=2, b=2))]
    kept = spark.createDataFrame(rows, "lang string, term string, total long, "
                                       "held array<struct<source:string,n:long>>")
    got = {tuple(r) for r in divergence.joint_tables(kept.repartition(3)).collect()}
    assert got == {("en", "a", 2, "b", 3, 2), ("en", "a", 2, "c", 1, 1), ("fr", "a", 2, "b", 2, 1)}


def test_large_counts_stay_exact(spark):
    rows = [("big " * 3 + "x" * 3, "en", "a"), ("big", "en", "b"), ("big y", "en", "b")]
    price = spark.createDataFrame([(10 ** 13, 3 * 10 ** 13, 7)], "c long, n long, v long").select(
        divergence.price(*map(__import__("pyspark").sql.functions.col, "cnv"))).first()[0]
    assert price == 1 + 10 ** 9 * (10 ** 13 + 1) // (3 * 10 ** 13 + 7)
    assert _rows(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == brute.divergence(rows)


def test_odd_tables(spark, edge, empty):
    """Nulls, empty and long texts, repeated rows, columns of clashing names."""
    odd = (edge.withColumnRenamed("size", "item").withColumnRenamed("key", "value").withColumnRenamed("h", "n")
           .withColumn("term", edge.text).withColumn("rank", edge.n_chars))
    assert _rows(divergence.audit(odd)) == brute.divergence([(r.text, r.lang, r.source) for r in edge.collect()])
    assert divergence.audit(empty).count() == 0
