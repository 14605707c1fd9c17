"""Operators of the pipeline against brute force."""
import random

import brute
import numpy as np
import pytest
from docket.llm import decontam, line_rules, mixing, queries, simhash, token_files

SF = "/root/testdata/sf0.01"


def test_simhash_query(spark, docs):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id)
           for r in queries.op3_simhash(spark, SF).collect()}
    fps = {d: brute.fingerprint(t) for d, t in docs}
    assert {d: f for d, (f, _) in got.items()} == fps
    root = brute.groups(fps.values())
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    assert {d: c for d, (_, c) in got.items()} == {d: least[root[f]] for d, f in fps.items()}


@pytest.mark.parametrize("crowded", [2, 8, 10_000])
def test_links_in_crowded_segments(spark, crowded):
    """Many fingerprints around a few centres, sharing segment values."""
    rnd = random.Random(crowded)
    fps = {rnd.getrandbits(64) for _ in range(30)}
    for centre in [rnd.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]:
        for _ in range(60):
            f = centre
            for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 4])):
                f ^= 1 << b
            fps.add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(df, crowded=crowded).collect()]
    u64 = (1 << 64) - 1
    assert all(((u ^ v) & u64).bit_count() <= 2 for u, v in edges)
    comp = {r.node & u64: r.root & u64 for r in
            simhash.components(simhash.links(df, crowded=crowded)).collect()}
    mine, theirs = {}, {}
    for f, r in brute.groups(fps).items():
        mine.setdefault(comp.get(f, f), set()).add(f)
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(max(a, b), min(a, b)) for a, b in zip(order, order[1:])]
    got = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 200)}


def test_simhash_edges(spark, edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(by[1]) == [1, 2, 11]  # no words: fingerprint zero
    assert sorted(by[5], key=str) == [5, 5, None]
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9]
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_decontamination_query(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet")
             .select("item_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256)
           for r in queries.op10_decontamination(spark, SF).collect()}
    assert got == brute.decontaminate(docs, items)
    assert sum(v[1] > 0 for v in got.values()) > 10


def test_decontamination_random(spark):
    """Small alphabet: overlapping windows, short items, items in blocks."""
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice(["a", "B", "é", "ß9"]) for _ in range(n))
    items = [(i, say(rnd.choice([0, 1, 3, 6, 9, 10, 11, 14]))) for i in range(6, 40)]
    items += [(None, say(12)), (3, None), (6, say(7))]
    docs = [(i, say(rnd.choice([0, 5, 12, 60]))) for i in range(60)] + [(99, None)]
    for i in range(0, 60, 7):
        docs[i] = (i, say(8) + "! " + (items[i % 30][1] or "") + "-" + say(4))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.decontaminate(docs, items)
    for block in (2_000_000, 20):
        rows = decontam.contaminated_rows(d, b, out="c", block_words=block).select(
            "doc_id", "c.*").collect()
        got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in rows}
        assert got == {k: v[:3] for k, v in expected.items()}
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in rows)


def test_winnowing_keeps_one_print_per_window():
    h = np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    prints = decontam.window_fingerprints(h, 10, 5)
    assert len(prints) == 41 and len(np.unique(prints)) < 41


def test_decontamination_edges(spark, edge, empty):
    b = spark.createDataFrame([(1, "a b c d"), (2, "")], "item_id long, text string")
    rows = decontam.contaminated_rows(edge, b, out="c").select("doc_id", "c.n_hit").collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in rows if r.n_hit) == [(0, 4), (5, 4), (5, 4)]
    assert decontam.contaminated_rows(empty, b).count() == 0
    assert decontam.contaminated_rows(edge, b.where("false"), out="c").where("c.n_hit > 0").count() == 0


def test_line_rules_query(spark, docs):
    got = {r.doc_id: tuple(r)[1:7] for r in queries.op4_line_rules(spark, SF).collect()}
    assert got == {d: brute.base_statistics(t) for d, t in docs}


def test_line_rules():
    fails = lambda s: line_rules.line_fails(s, len(s.split()))
    assert fails("BUY!! NOW!! CHEAP!!") and fails("Home | News | About | Contact")
    assert fails("We use Cookies to improve this site.") and fails("the*** of$$$ and###")
    assert not fails("A plain sentence, with (some) marks.") and not fails("Really? Yes!! " * 1 + "a" * 60)
    text = "\n".join(["A good line of words that stays here."] * 10 + ["Skip to content"])
    r = dict(zip([c.split()[0] for c in line_rules.RESULT.split(", ")], line_rules.judge(text)))
    assert r["n_bad_lines"] == 1 and r["lost_words"] == 3 and r["cleaned"] == text[:-16]


def test_line_rules_edges(spark, edge, empty):
    rows = line_rules.line_statistics(edge).collect()
    assert len(rows) == edge.count()
    assert [tuple(r)[1:7] for r in rows] == [brute.base_statistics(r.text) for r in edge.collect()]
    assert line_rules.line_statistics(empty).count() == 0
    assert line_rules.clean(edge).columns == edge.columns


def _mix_check(rows):
    sizes, target, taken, largest = {}, {}, {}, {}
    for r in rows:
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        target[r.key], sizes[r.key] = r.target, r.source_size
        taken[r.key] = taken.get(r.key, 0) + r.taken
        largest[r.key] = max(largest.get(r.key, 0), r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return sizes, target


def test_mixing_query(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op1_mixing(spark, SF).join(d.selectExpr("doc_id", "source as key", "text"), "doc_id").collect()
    assert all(r.size == len(brute.words(r.text)) for r in got) and len(got) == d.count()
    sizes, target = _mix_check(got)
    order = sorted(sizes)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    expected = brute.water_fill(sizes, weights)
    assert all(abs(target[s] - expected[s]) < 1e-3 for s in order)
    assert sorted(map(tuple, queries.op1_mixing(spark, SF).collect())) == sorted(
        (r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got)


def test_mixing_is_nested(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    less = {r.doc_id: r.copies for r in mixing.mix(d, budget=0.4).collect()}
    more = {r.doc_id: r.copies for r in mixing.mix(d, budget=0.7).collect()}
    assert sum(less.values()) < sum(more.values())
    assert all(n <= more[i] for i, n in less.items())


def test_mixing_edges(spark, edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and sum(r.taken for r in rows) > 0
    assert {r.source_size for r in rows if r.doc_id == 2} == {0}  # the null source
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_rows(edge)
    assert out.columns == edge.columns
    assert out.count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("seed", range(5))
def test_simple8b_round_trip(seed):
    rnd = np.random.default_rng(seed)
    for n in (0, 1, 2, 127, 128, 129, 5000):
        width = rnd.integers(0, 64, n).astype(np.uint64)
        for ids in (rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) >> width,
                    rnd.integers(0, 49408, n).astype(np.uint64), np.zeros(n, np.uint64),
                    np.full(n, (1 << 64) - 1, np.uint64)):
            assert (token_files.unpack(token_files.pack(ids)) == ids).all()
    small = token_files.pack(rnd.integers(0, 1024, 100_000))
    assert len(small) < 100_000 * 8 / 5.5


def test_token_files_query(spark, docs):
    got = [tuple(r) for r in queries.op6_token_files(spark, SF).orderBy("doc_id").collect()]
    assert got == brute.token_rows(docs, queries.tokenizer_path())


def test_encoder_equals_library(docs):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), token_files.Encoder(path)
    rnd = random.Random(3)
    odd = ["it's We'LL 'S x'd", "<|endoftext|> a", "é Å ﬁ İI ŉ", "a\x1cb\x85c\xa0d", "ÀÉ ÿŸ ſ ß", "12³ ½ª²"]
    odd += ["".join(chr(rnd.choice([*range(9, 14), *range(32, 127), *range(160, 384)]))
                    for _ in range(60)) for _ in range(300)]
    odd += ["".join(rnd.choice(["'", "s", "ll", "É", "7", "-", " ", "\n", "a", "re"])
                    for _ in range(40)) for _ in range(300)] + ["'", "a 'b' c'", "x\n'"]
    texts = odd + [t for _, t in docs[:200]] + ["", None]
    for size in (1, 1 << 10, 1 << 22):
        for t, ids in zip(texts, enc.encode(texts, size), strict=True):
            assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_token_files_in_shards(spark, docs, tmp_path):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    path = str(tmp_path / "tokens")
    token_files.write_tokens(d, path, queries.tokenizer_path(), shard_bytes=100_000)
    assert spark.read.parquet(path).select("shard").distinct().count() > 10
    got = queries.token_digest(token_files.read_tokens(spark, path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute.token_rows(docs, queries.tokenizer_path())


def test_token_files_edges(spark, edge, empty):
    rows = token_files.round_trip(edge, queries.tokenizer_path()).orderBy("start").collect()
    assert len(rows) == edge.count() and rows[0].doc_id is None and rows[0].start == 0
    assert [r.start for r in rows[1:]] == list(np.cumsum([r.n_tokens for r in rows])[:-1])
    assert next(r for r in rows if r.doc_id == 1).n_tokens == 1
    assert token_files.round_trip(empty, queries.tokenizer_path()).count() == 0


def test_encoder_on_words_of_any_character():
    """Curly quotes, CJK, marks that compose, odd cases: as the library encodes them."""

    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["it's “quoted” don’t 'S 've' '", "日本語 テキスト, ok", "é é İstanbul ISTANBUL ΑΣ ΣΑΣ",
             "a b c d\x85e x\x1cy\x00z", "<|endoftext|> x<|startoftext|>y < | <|", "ŉ ſ × ÷ ÉÀÖØßÿŸž ǅ",
             "😀😀 a😀b 12٣4 ½ ²", "'", "x'", "́ a", "ﬁ K Å", "tab\tnew\nline\x0bvt\x0cff\rcr", "", None]
    rng = random.Random(1)
    pool = [*"aAeEzZ019 .,'<|>!\t\n", "é", "É", "ß", "“", "’", "日", "😀", "́", " ", "İ", "ſ", "×", "Σ"]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(1500)]
    for t, ids in zip(texts, enc.encode(texts, group_chars=500)):
        assert list(ids) == tok.encode(t or "", add_special_tokens=False).ids, t


def test_a_hot_id_goes_to_several_files(spark, tmp_path):
    """Rows of one id are dealt by the hashes of their texts, in one order."""
    rows = [(7, f"text {i} of the hot id " * 5) for i in range(600)] + [(i, "another text " * 5) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    place = str(tmp_path / "files")
    token_files.write_tokens(d, place, queries.tokenizer_path(), shard_bytes=8_000)
    files = spark.read.parquet(place)
    hot = files.where("array_contains(doc_ids, 7)").select("shard").distinct().count()
    assert hot > 4
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_tokens(spark, place).collect())
    assert [g[1] for g in got] == sorted(r[0] for r in rows)
    assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]


def test_packing_skips_no_run_of_small_ids():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, top = int(rng.integers(0, 600)), int(rng.choice([1, 2, 5, 300, 70_000, 2 ** 33, 2 ** 61]))
        ids = np.where(rng.random(n) < 0.8, rng.integers(0, 3, n), rng.integers(0, top, n)).astype(np.uint64)
        packed = token_files.pack(ids)
        assert (token_files.unpack(packed) == ids).all()
        if top <= 5 and n >= 120:
            assert len(packed) < 2 * n + 200
