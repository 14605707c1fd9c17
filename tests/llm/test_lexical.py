"""Ranked lexical search against brute force."""
import random

import brute
import numpy as np
import pytest
from docket.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def _rows(df):
    order = lambda r: (r[0] is None, str(r[0]), r[1])
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=order)


def _expected(docs, items, k=10):
    return sorted(brute.search(docs, items, k), key=lambda r: (r[0] is None, str(r[0]), r[1]))


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["élan", "ÉLAN", "Straße", "a1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(0, 25))) for i in range(200)]
    docs += [(1000 + i, "w1 w2 w2 Copy!") for i in range(60)]  # one large class
    docs += [(2000 + i, f"w1 other{i} w2, W2") for i in range(40)]  # same vector and size, other texts
    docs += [(None, "w1 w2"), (None, None), (7, ""), (7, "w3"), (7, "w3"), (3000, "W5 " * 400_000)]
    items = [("a", "w1 W2 w2"), ("b", text(12)), ("c", "none of these"), ("d", None), ("e", ""), (None, "w3"),
             ("f", "w5"), ("a", "w9"), ("g", text(300))]
    return docs, items


def test_equal_to_brute_force(spark, small):
    docs, items = small
    got = _rows(lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)))
    assert got == _expected(docs, items)
    assert {r[0] for r in got} == {"a", "b", "f", "g", None}


def test_blocks_of_items(spark, small):
    """Items in many blocks, the longest beyond the bound of a block."""
    docs, items = small
    terms = lexical.item_terms(spark.createDataFrame(items, ITEMS)).cache()
    blocks = [b.collect() for b in lexical.item_blocks(terms, 8)]
    assert len(blocks) > 2 and sum(map(len, blocks)) == terms.count()
    assert all(len(b) <= 8 or len({r.item_id for r in b}) == 1 for b in blocks)
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(5),
                         spark.createDataFrame(items, ITEMS), k=3, block_terms=8)
    assert _rows(got) == _expected(docs, items, 3)


def test_a_class_hands_on_its_least_ids(spark):
    rows = [(i, 4, b"x") for i in range(100)] + [(None, 4, b"x"), (5, 4, b"y"), (5, 9, b"x")]
    bagged = spark.createDataFrame(rows, "doc_id long, n long, bag binary").repartition(7)
    got = {(r.m, bytes(r.bag)): r.members for r in lexical.classes(bagged, 102, 410, k=4).collect()}
    assert len(got) == 3
    assert got[25 + 75 * 4 * 102 // 410, b"x"] == [None, 0, 1, 2]
    assert got[25 + 75 * 9 * 102 // 410, b"x"] == [5]


def test_scores_stay_exact_beyond_doubles():
    """An item whose scores pass 2^53 is added in 64-bit integers."""
    rows = [type("R", (), {"item_id": "q", "term": b"t", "n": 1_000_003}),
            type("R", (), {"item_id": "p", "term": b"u", "n": 3})]
    rows += [type("R", (), {"item_id": f"x{i}", "term": b"v", "n": 1}) for i in range(20)]
    block = lexical.weigh(lexical.make_block(rows), np.array([25_001, 7, 9], np.int64))
    assert block["matrix"].dtype == np.int64
    got = lexical.scores(block, np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([999_999, 5, 3]),
                         np.array([26, 31]), 2)
    part = lambda w, tf, m: w * (10 ** 9 * tf // (1000 * tf + 8 * m))
    assert got[0, 0] == 1_000_003 * part(25_001, 999_999, 26) > 2 ** 53
    assert (got[0, 1], got[1, 0]) == (3 * part(7, 5, 26), 1_000_003 * part(25_001, 3, 31))


def test_odd_tables(spark, edge, empty):
    """Nulls, empty and long texts, repeated rows, columns of clashing names."""
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    odd = edge.withColumnRenamed("size", "rank").withColumnRenamed("key", "score").withColumnRenamed("h", "item_id")
    items = [("1", "a b c"), ("2", "STRASSE straße été"), ("3", "words here same")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS + ", doc_id int")
    assert _rows(lexical.search(odd, asked)) == _expected(docs, items)
    assert lexical.search(empty, asked).count() == 0
    none = lexical.search(edge, asked.where("false"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
