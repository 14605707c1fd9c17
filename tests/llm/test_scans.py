"""Co-training, licences, perspectives and the pipeline as a whole."""
import math

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from docket.llm import cotraining, licenses, perspectives, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_quality_on_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id is not null")
    got = queries.op2_quality(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(labels.selectExpr("doc_id", "quality q", "toxic t"), "doc_id").collect()
    assert sum(r.good_quality == (r.q == 1) for r in rows) / len(rows) > 0.97
    assert sum(r.toxic == (r.t == 1) for r in rows) / len(rows) > 0.95
    assert all(0 <= r.quality_score <= 1 for r in rows)


def test_quality_held_out(spark):
    """Labels of a third of the ids are withheld and predicted."""
    d, y = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    models = cotraining.fit(d, y.where("doc_id % 3 <> 0"), ["quality"])
    rows = cotraining.score(d, models).join(y, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > 0.95


def test_labelled_rows_are_bounded(spark, monkeypatch):
    """One labelled id with very many texts does not pass the sample."""
    rows = [(1, f"text number {i} of the hot id", "s", "x", 20) for i in range(3000)]
    rows += [(i, f"some text {i}", "s", "x", 10) for i in range(2, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    y = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    seen, features = [], cotraining._features
    monkeypatch.setattr(cotraining, "_features", lambda *a: seen.append(features(*a)) or seen[-1])
    cotraining.fit(d, y, ["quality"], sample=64, pool=64, rounds=1)
    assert 20 <= len(seen[0]) <= 128


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 1), (8, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    models = cotraining.fit(edge, labels, ["quality", "toxic"])
    rows = cotraining.score(edge, models).collect()
    assert len(rows) == edge.count()
    assert {r.toxic_score for r in rows} == {0.0} and all(r.quality_score == 0.5 for r in rows)
    assert cotraining.score(empty, models).count() == 0
    nothing = cotraining.fit(empty, labels.where("false"), ["quality"])
    assert {r.quality_score for r in cotraining.score(edge, nothing).collect()} == {0.5}


def test_quality_exchange_reaches_all_documents(spark):
    """Every unlabelled document may be picked, whatever ``pool`` is; a round
    draws anew, and one row per id and text is gathered."""
    rows = [(i, i * 7, f"word{i}", "s", "x", 5, None) for i in range(400)] * 3
    rows = spark.createDataFrame(rows, "i long, h long, text string, source string, lang string, "
                                       "n_chars long, y0 double")
    fits = {0: [(np.zeros(cotraining.TEXT_DIM), 5.0), (np.zeros(cotraining.META_DIM), -5.0)]}
    picked = [cotraining._confident(rows, fits, r, 1.0, 0.95, 100) for r in range(12)]
    assert all(len(p[0, 0, 0]) == len(p[0, 1, 1]) == 0 for p in picked)
    for side in ((0, 0, 1), (0, 1, 0)):
        ids = [set(p[side]["i"]) for p in picked]
        assert all(len(x) == len(p[side]) and 50 < len(x) < 150 for x, p in zip(ids, picked))
        assert len(set.union(*ids)) > 370
    none = cotraining._confident(rows.withColumn("y0", F.lit(1.0)), fits, 0, 1.0, 0.95, 100)
    assert all(len(x) == 0 for x in none.values())


def test_license_query(spark):
    got = queries.op5_licenses(spark, SF)
    counts = {r.licenses: r["count"] for r in got.groupBy("licenses").count().collect()}
    lines = duckdb.sql(f"""SELECT CASE WHEN text LIKE '%Apache License, Version 2.0.%' THEN 'Apache-2.0'
        WHEN text LIKE '%under the MIT License.%' THEN 'MIT' WHEN text LIKE '%CC BY-NC 4.0.%' THEN 'CC-BY-NC-4.0'
        WHEN text LIKE '%GNU General Public License, version 3.%' THEN 'GPL-3.0' ELSE '' END l, count(*)
        FROM '{SF}/documents.parquet' GROUP BY l""").fetchall()
    assert counts == dict(lines)


def test_license_sequences():
    mit = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
           'associated documentation files (the "Software"), to deal in it. The above copyright notice and this '
           'permission notice shall be included in all copies or substantial portions of the Software.\n'
           'The software is provided "as is", without warranty of any kind, express or implied.')
    assert licenses.match_rules(licenses.sentence_ids("Text.\n" + mit)) == (["MIT"], 0)
    apache = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
              'in compliance with the License. You may obtain a copy of the License at '
              'http://www.apache.org/licenses/LICENSE-2.0')
    assert licenses.sentence_ids(apache) == ["apache-short", "apache-comply", "apache-copy"]
    assert licenses.match_rules(["mit-notice", "apache-short", "unknown", "mit-short"]) == (
        ["Apache-2.0", "MIT"], 1)
    assert licenses.sentence_ids("Our license is a secret. Nothing else.") == ["unknown"]
    assert licenses.sentence_ids("No such word here. " * 5) == []


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the
License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by law, no more is said."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_license_wrapped_lines(mark):
    def read(text):
        ids = licenses.sentence_ids("Title\n\n" + "\n".join(mark + x for x in text.split("\n")))
        return ids, licenses.match_rules(ids)
    assert read(MIT) == (["unknown", "mit-grant", "mit-notice", "as-is"], (["MIT"], 0))
    assert read(BSD)[1] == (["BSD-3-Clause"], 0)
    assert read(APACHE) == (["apache-short", "apache-comply", "apache-copy"], (["Apache-2.0"], 0))
    assert read(GPL) == (["gpl-free"], (["GPL-3.0"], 0))
    assert read("SPDX-License-Identifier: MIT")[1] == (["MIT"], 0)
    assert read("x\nSPDX-License-Identifier: Apache-2.0\ny = 1")[1] == (["Apache-2.0"], 0)
    assert read("A heading\nLicensed under CC BY 4.0\nReleased under the MIT License")[1] == (
        ["CC-BY-4.0", "MIT"], 0)


def test_license_breaks_do_not_matter():
    for text, name in ((MIT.split("\n\n", 1)[1], "MIT"), (BSD, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0")):
        for glue in (" ", "\r\n"):
            assert licenses.match_rules(licenses.sentence_ids(text.replace("\n", glue))) == ([name], 0)


def test_license_edges(spark, edge, empty):
    rows = licenses.scan(edge).collect()
    assert len(rows) == edge.count() and all(r.licenses == [] for r in rows)
    assert licenses.scan(empty).count() == 0


def _render(turns, speaker):
    text, spans = "", []
    for _, role, body in turns:
        if role == speaker:
            head = "<|assistant|>\n"
        else:
            head = "<|system|>\n" if role == "system" else f"<|user name={role or 'unknown'}|>\n"
        text += head
        start = len(text)
        text += body + "<|end|>\n"
        if role == speaker:
            spans.append((start, len(text)))
    return text, spans


def test_repeated_half_sentences_take_linear_time():
    """First words of a known sentence on every line of a long text, with and without the rest."""
    import time
    began = time.time()
    lines = "copyright\n" + "neither the name of x\n" * 45_000
    assert set(licenses.sentence_ids(lines)) <= {"unknown"}
    ids = licenses.sentence_ids(lines + "may be used to endorse or promote products derived from it")
    assert ids[-1] == "bsd-endorse" and len(ids) <= 3
    assert time.time() - began < 10


def _dialogues(rows):
    """{(conversation, speaker): its parts in order}."""
    out = {}
    for r in sorted(rows, key=lambda r: r.part or 0):
        out.setdefault((r.conv_id, r.speaker), []).append(r)
    return out


def _joined(parts):
    """The parts put together: text and mask."""
    return "".join(r.rendered for r in parts), [tuple(m) for r in parts for m in r["mask"]]


@pytest.mark.parametrize("most_rows", [10_000, 1])
def test_perspectives(spark, most_rows):
    rows = [(1, t, r, x) for t, r, x in [(0, "system", "Be kind."), (1, "Ana", "Olá"), (2, "Bo", "Hi 😀"),
                                         (3, "Ana", None), (3, None, "?"), (1, "Ana", "Olá")]]
    rows += [(2, t, "ab"[t % 2], f"turn {t}") for t in range(150)] + [(None, None, "a", "x"), (3, 1, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = perspectives.rotate(df.withColumn("part", F.lit("clash")), most_rows=most_rows).collect()
    assert sorted((str(r.conv_id), r.speaker, r.part) for r in got) == sorted(
        [("1", "Ana", 0), ("1", "Bo", 0), ("None", "a", None)] + [("2", s, p) for s in "ab" for p in range(3)],
        key=str)
    for (c, speaker), parts in _dialogues(got).items():
        turns = sorted({(t, w, x or "") for i, t, w, x in rows if i == c},
                       key=lambda t: (t[0] or 0, t[1] or "", t[2]))
        assert _joined(parts) == _render(turns, speaker)
        assert sum(r.n_rows for r in parts) == sum(i == c for i, *_ in rows)
    assert perspectives.rotate(df.where("false")).count() == 0


def test_perspectives_sparse_turns_stay_whole(spark):
    rows = [(1, t, r, x) for t, r, x in [(None, "system", "Be kind."), (7, "Ana", "a"), (700, "Bo", "b"),
                                         (1 << 40, "Ana", "c")]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.speaker: r for r in perspectives.rotate(df).collect()}
    assert set(got) == {"Ana", "Bo"}
    for r in got.values():
        assert (r.part, r.n_rows) == (0, 4)
        assert (r.rendered, [tuple(m) for m in r["mask"]]) == _render([x[1:] for x in rows], r.speaker)


@pytest.mark.parametrize("turns", ["equal", "null", "dense"])
def test_perspectives_long_conversation(spark, turns):
    """Parts of bounded size, by rank, that together are the whole dialogue."""
    at = {"equal": lambda t: 5, "null": lambda t: None, "dense": lambda t: t}[turns]
    rows = [(1, at(t), "system" if t in (0, 15) else "ab"[t % 2], f"t{t:03}") for t in range(45)]
    df = spark.createDataFrame(rows * 3 + [(2, 90, "a", "short")], "conv_id long, turn long, role string, text string")
    got = perspectives.rotate(df, part_turns=10).collect()
    order = sorted(rows, key=lambda x: (x[1] or 0, x[2], x[3]))
    assert sorted((r.conv_id, r.speaker, r.part) for r in got) == sorted(
        [(1, s, p) for s in "ab" for p in range(5)] + [(2, "a", 0)])
    for (c, speaker), parts in _dialogues(got).items():
        if c == 1:
            assert [(r.n_rows, r.n_turns) for r in parts] == [(30, 10)] * 4 + [(15, 5)]
            assert _joined(parts) == _render([x[1:] for x in order], speaker)


def test_perspectives_of_very_many_and_very_long_turns(spark):
    """1,500 turns by the query's parameters, against its SQL; a turn of 300,000 characters."""
    import duckdb
    rows = [(1, t, "abc"[t % 3], f"turn {t} 😀") for t in range(1500)] + [(2, 0, "a", "long " * 60_000), (2, 1, "b", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = perspectives.rotate(df, part_turns=1024).collect()
    for (c, speaker), parts in _dialogues(got).items():
        assert _joined(parts) == _render([x[1:] for x in rows if x[0] == c], speaker)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    asked = con.sql(queries.ORACLES["op9_perspectives"])
    told = [tuple(dict(zip(asked.columns, r))[c] for c in ("conv_id", "speaker", "part", "n_rows", "rendered", "mask"))
            for r in asked.fetchall()]
    assert sorted(told) == sorted((r.conv_id, r.speaker, r.part, r.n_rows, r.rendered,
                                   ",".join(f"{a}-{b}" for a, b in r["mask"])) for r in got)


def test_pipeline(spark, docs, tmp_path):
    """Every stage against brute force on what its predecessor kept."""
    at = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, at, SF).write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert at.columns == before.columns
        kept[name] = at.collect()
    rules = {d for d, t in docs if not brute.base_statistics(t)[5]}
    clean = {r.doc_id: r.text for r in kept["quality_rules"]}
    assert set(clean) <= rules and len(clean) > 0.9 * len(rules)
    fps = {d: brute.fingerprint(t) for d, t in clean.items()}
    root, least = brute.groups(fps.values()), {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    alone = {r.doc_id: r.text for r in kept["near_dedup"]}
    assert set(alone) == set(least.values()) and all(clean[d] == t for d, t in alone.items())
    hits = brute.decontaminate(alone.items(), [(i, t) for i, t in items])
    safe = {d: t for d, t in alone.items() if not hits[d][1]}
    assert {r.doc_id: r.text for r in kept["decontamination"]} == safe
    assert len(kept["decontamination"]) == len(safe) < len(alone)
    mixed = [(r.doc_id, r.text) for r in kept["mix_sources"]]
    assert set(mixed) <= set(safe.items()) and max(mixed.count(m) for m in set(mixed)) <= 2
    words = lambda texts: sum(len(brute.words(t)) for t in texts)
    assert abs(words(t for _, t in mixed) / (1.5 * words(safe.values())) - 1) < 0.05
    assert sorted(tuple(r) for r in kept["token_ids"]) == sorted(
        brute.token_rows(mixed, queries.tokenizer_path()))
    assert all(math.isfinite(r.start) for r in kept["token_ids"])


def test_pipeline_stages_keep_odd_rows(spark, edge, empty):
    for name, step in corpus_pipeline.STAGES[:4]:
        assert step(spark, edge, SF).columns == edge.columns
        # No odd row passes the base rule: fewer than 50 words, or repeated ones.
        assert (step(spark, edge, SF).count() > 0) == (name != "quality_rules")
        assert step(spark, empty, SF).count() == 0
