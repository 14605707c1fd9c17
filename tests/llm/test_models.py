"""Language model and language identification."""
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from docket.llm import class_lm, langid, queries

SF = "/root/testdata/sf0.01"
fold = lambda d, n: zlib.crc32(str("null" if d is None else d).encode()) % n


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op7_class_lm(spark, SF).collect()}


def _base(docs):
    tokens = {d: brute.words(brute.lower(t)) + [None] for d, t in docs}
    c = Counter()
    for d, w in tokens.items():
        if fold(d, 5) != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return {d: (fold(d, 5) == 1, len(w), sum(c[x] > 0 for x in w), n,
                sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
            for d, w in tokens.items()}


def test_base_of_the_language_model(scored, docs):
    for d, (held, n, known, train, base) in _base(docs).items():
        r = scored[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)


def test_classes_beat_the_base_on_held_out_texts(scored):
    held = [r for r in scored.values() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) / n > 0.1
    assert all(r.score < 0 for r in scored.values())


def test_small_head_gives_the_same_base(spark, docs):
    """All counts but a few by the join."""
    d = spark.createDataFrame(docs[:150], "doc_id long, text string")
    got = class_lm.score_texts(d, head_words=40, unit_words=10, classes=4).collect()
    expected = _base(docs[:150])
    assert all(abs(r.base_score - expected[r.doc_id][4]) < 1e-6 * -expected[r.doc_id][4]
               and r.n_known == expected[r.doc_id][2] for r in got)


def test_model_is_a_distribution(spark, docs):
    """Over the words of the training texts and one unknown word per class
    the next-word probabilities sum to 1 in every context."""
    d = spark.createDataFrame(docs[:60], "doc_id long, text string")
    counts = class_lm.count_words(d).cache()
    m = class_lm.fit(d, counts, head_words=100_000, unit_words=30, classes=5)
    units = 1 + m["n_units"] + class_lm.GROUPS
    rest = class_lm.Suffixes(1 + m["n_units"])
    mass = np.full(5, 0.5)
    mass[0] += m["end"] + 0.5
    seen = {w: i for i, w in enumerate(m["head"][:m["n_units"]], 1)}
    for r in counts.collect():
        w = r.word.encode()
        mass[m["place"][seen.get(w) or rest[w[-2:]]]] += r.n + 0.5
    assert len(m["place"]) == units
    assert np.allclose(mass, 10 ** m["emit"])
    assert np.allclose((10 ** m["move"]).sum(axis=1), 1)


def test_exchange_raises_likelihood_and_finds_blocks():
    rng = np.random.default_rng(0)
    size, truth = 31, np.concatenate(([0], 1 + np.arange(30) % 3))
    table = np.zeros((size, size), np.int64)
    for a in range(1, size):
        for b in range(1, size):
            table[a, b] = rng.poisson(40 if truth[b] == truth[a] % 3 + 1 else 1)
    table[0, 1:] = table[1:, 0] = 2
    place = class_lm.exchange(table, 4)
    assert place[0] == 0 and (place[1:] > 0).all()
    assert len({(a, b) for a, b in zip(truth[1:], place[1:])}) == 3


@pytest.mark.parametrize("head_words", [12, 100_000])
def test_every_word_is_placed_by_its_own_bigrams(spark, head_words):
    """Two kinds of words alternate; the endings of the rare ones say nothing
    of it, so a class by the last bytes would hold both kinds."""
    rng = np.random.default_rng(3)
    rare = [[f"{k}{i}zz" for i in range(40)] for k in "xy"]
    texts = [" ".join(f"{'xy'[j % 2]}{rng.integers(5)}" if rng.random() < 0.6 else rare[j % 2][rng.integers(40)]
                      for j in range(60)) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = class_lm.count_words(d).cache()
    model = class_lm.fit(d, counts, head_words=head_words, unit_words=10, classes=5)
    assert model["n_units"] == 10
    rows = d.selectExpr("doc_id", "xxhash64(text) text_key", "false held_out", "text").mapInArrow(
        class_lm._encode(spark.sparkContext.broadcast(model["head"])), class_lm.ENCODED)
    head = [w.decode() for w in model["head"]]
    got, tail = class_lm.place_words(rows, model, counts.where(~counts.word.isin(head)))
    place = dict(zip(head, got["head_class"][1:])) | {r.word: r.c for r in tail.collect()}
    assert set(place) == {w for t in texts for w in t.split()}
    assert got["pair"].sum() == sum(len(t.split()) + 1 for t in texts)
    classes = [{place[w] for w in words if w in place} for words in rare]
    assert not classes[0] & classes[1] and 0 not in classes[0] | classes[1]


def test_score_does_not_depend_on_the_head(spark, docs):
    """Classes by the joins and classes that travel give the same scores."""
    d = spark.createDataFrame(docs[:60], "doc_id long, text string")
    a, b = ({r.doc_id: r for r in class_lm.score_texts(
        d, head_words=n, unit_words=20, classes=6).collect()} for n in (60, 100_000))
    assert all(abs(a[i].score - b[i].score) < 1e-6 * -b[i].score for i in b)


def test_language_model_edges(spark, edge, empty):
    rows = class_lm.score_texts(edge).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r.score) for r in rows)
    expected = _base([(d, t) for d, t in edge.select("doc_id", "text").collect() if d not in (5,)])
    assert next(r for r in rows if r.doc_id == 1).n_tokens == expected[1][1] == 1
    twins = [r for r in rows if r.doc_id == 5]
    assert len(twins) == 2 and twins[0] == twins[1] and twins[0].n_known <= twins[0].n_tokens
    small = class_lm.score_texts(edge, head_words=0, unit_words=0).where("doc_id = 5").collect()
    assert all(abs(a.base_score - b.base_score) < 1e-6 for a, b in zip(small, twins))
    assert class_lm.score_texts(empty).count() == 0


def test_language_query(spark, docs):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet")
             .select("doc_id", "lang").collect()}
    got = queries.op8_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def _grams(text):
    c = Counter()
    for w in langid.WORDS.findall(text.lower()):
        p = f" {w} "
        c.update(w)
        c.update(p[i:i + 2] for i in range(len(p) - 1))
        c.update(p[i:i + 3] for i in range(len(p) - 2))
    return c


def test_language_against_brute_force(spark, docs):
    pack = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], pack(x[0])))[:50]]
    rows = [(d, t, "ab"[d % 2]) for d, t in docs[:80]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    total = {"a": Counter(), "b": Counter()}
    for d, t, name in rows:
        if fold(d, 4) != 2:
            total[name].update(_grams(t))
    profile = {k: {g: i for i, g in enumerate(top(c))} for k, c in total.items()}
    for r in langid.identify(df, profile_size=50).collect():
        own = top(_grams(dict(docs)[r.doc_id]))
        dist = {k: sum(abs(p[g] - i) if g in p else 50 for i, g in enumerate(own))
                for k, p in profile.items()}
        best = min(sorted(dist), key=dist.get)
        assert r.lang_pred == best and abs(r.score - (1 - dist[best] / (50 * len(own)))) < 1e-9


def test_language_edges(spark, edge, empty):
    rows = langid.identify(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r.doc_id in (1, 2, 11):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("x", "y", "z")
    assert langid.identify(empty).count() == 0
    nothing = langid.identify(edge.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_languages_in_blocks(spark):
    """Any number of languages, some at a time: the same predictions."""
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i % 10]}x common words {i}", f"l{i % 10}") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(tuple(r) for r in langid.identify(d, profile_size=40).collect())
    assert sorted(tuple(r) for r in langid.identify(d, profile_size=40, block=3).collect()) == whole
    assert len({r[2] for r in whole}) == 10
