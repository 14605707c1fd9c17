"""Ranked lexical search by bag deduplication.

The items are a stated query set; every document is ranked for each of them.
Documents are restricted to the items' vocabulary, so many of them become the
same *bag*: term frequencies of vocabulary terms and the length norm ``m``.
Documents of one bag have the same score for every item, so

1. each text is reduced to its length and its vector of vocabulary terms;
2. equal (vector, m) form a class: rows meet by a 64-bit hash of both, and the
   vector and m themselves are part of the grouping key, so a hash collision
   joins nothing;
3. each class is scored once for all items, in integers;
4. the best classes of an item are expanded to members by ascending id.

A class hands on its ``k`` least ids only: an item's list of ``k`` cannot hold
more of one class, so nothing is lost and a class of a third of all rows stays
``k`` ids.  A task hands on, for each item, its ``k`` best classes by (score,
least id): whatever a lower class holds, ``k`` documents come before it.

Items go through the driver in blocks of at most ``block_terms`` (item, term)
pairs, counted before they are collected (one item is never divided); each
block is compared with all documents.

Scores: a term's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, and a
document's ``m`` is ``100 - b + (b * n * N) div L``; the score sums
``weight * ((10^9 * tf) div (1000 * tf + 8 * m))`` over the item's terms,
repeats included.

Nulls, empty texts and texts without a term count neither in N nor in L and
are never listed; an item without a term has no list.  Rows of one item id
(null is an id of its own) are one item with the terms of all of them.  Each
document row stands for itself: a repeated row is listed as often as it
occurs.  Equal scores go by ascending id, a null id first.  A long text is cut
into parts between terms, so memory follows its distinct terms.  Extra columns
are not read; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, short_batches, stage

#: A term, in the bytes of a text whose A-Z are lower-cased.
TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
BLOCK_TERMS = 200_000


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes, A-Z lower-cased (``bytes.lower`` leaves others alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _item_terms(batches):
    for batch in batches:
        rows = batch.to_pydict()
        for item, text in zip(rows["item_id"], rows["text"]):
            held = Counter()
            for part in pieces(lowered(text), GAP):
                held.update(TERM.findall(part))
            yield pa.RecordBatch.from_pydict({
                "item_id": pa.array([item] * len(held), batch.schema.field("item_id").type),
                "term": pa.array(list(held), pa.binary()),
                "n": pa.array(list(held.values()), pa.int64())})


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, n): the terms of each item with repeats."""
    rows = items.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["item_id"], T.StructField("term", T.BinaryType()),
                           T.StructField("n", T.LongType())])
    return rows.mapInArrow(_item_terms, schema).groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def item_blocks(terms: DataFrame, block_terms: int = BLOCK_TERMS):
    """The items in blocks: each a DataFrame of at most ``block_terms`` rows
    of ``terms``, or of one item that has more."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        items = terms.groupBy(block.alias("b"), "item_id").agg(F.count("*").alias("n"))
        sizes = items.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        if sizes.where((F.col("n") > block_terms) & (F.col("items") > 1)).isEmpty() or n >= 1 << 30:
            break
        n *= 2
    for r in sizes.orderBy("b").select("b").toLocalIterator():
        yield terms.where(block == r.b)


def make_block(rows) -> dict:
    """A block of items, as plain arrays that travel with the tasks: its
    vocabulary in byte order, and for each term the items that hold it and how
    often."""
    items = list(dict.fromkeys(r.item_id for r in rows))
    number = {item: i for i, item in enumerate(items)}
    vocabulary = sorted({bytes(r.term) for r in rows})
    place = {t: i for i, t in enumerate(vocabulary)}
    term = np.array([place[bytes(r.term)] for r in rows], np.int64)
    order = np.argsort(term, kind="stable")
    return {"items": items, "vocabulary": vocabulary,
            "item": np.array([number[r.item_id] for r in rows], np.int64)[order],
            "times": np.array([r.n for r in rows], np.int64)[order],
            "first": np.searchsorted(term[order], np.arange(len(vocabulary) + 1))}


def weigh(block: dict, weight: np.ndarray) -> dict:
    """The block with the weights of its terms.  Terms that many items hold
    are scored by a matrix product, the others by their lists of items."""
    held = np.diff(block["first"])
    common = np.flatnonzero(8 * held >= len(block["items"]))
    row = np.full(len(held), -1, np.int64)
    row[common] = np.arange(len(common))
    total = np.zeros(len(block["items"]))
    np.add.at(total, block["item"], block["times"] * np.repeat(weight, held) * 1e6)
    # Doubles add integers exactly below 2^53.
    kind = np.float64 if total.max(initial=0) < 2 ** 53 else np.int64
    matrix = np.zeros((len(common), len(block["items"])), kind)
    at = np.repeat(row, held)
    matrix[at[at >= 0], block["item"][at >= 0]] = block["times"][at >= 0]
    return {**block, "weight": weight, "row": row, "matrix": matrix}


def scores(block: dict, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray,
           n: int) -> np.ndarray:
    """Scores (documents x items) of ``n`` documents given as triples of
    document, term and frequency; ``m`` by document."""
    first, matrix, n_items = block["first"], block["matrix"], len(block["items"])
    part = block["weight"][term] * ((10 ** 9 * tf) // (1000 * tf + 8 * m[doc]))
    row = block["row"][term]
    c = row >= 0
    bag = np.zeros((n, len(matrix)), matrix.dtype)
    bag[doc[c], row[c]] = part[c]
    out = bag @ matrix
    doc, term, part = doc[~c], term[~c], part[~c]
    count = first[term + 1] - first[term]
    step = np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(first[term], count) + np.arange(len(step)) - step
    cell = np.repeat(doc, count) * n_items + block["item"][at]
    np.add.at(out.reshape(-1), cell, (np.repeat(part, count) * block["times"][at]).astype(matrix.dtype))
    return out


def _encode(bag: dict[int, int], id_type: str) -> bytes:
    """Number of terms, their ascending numbers, their frequencies in the
    narrowest type: equal vectors give equal bytes."""
    ids = np.fromiter(bag, np.int64, len(bag))
    order = np.argsort(ids)
    tf = np.fromiter(bag.values(), np.int64, len(bag))[order]
    top = int(tf.max())
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u8"
    return (len(bag).to_bytes(4, "little") + ids[order].astype(id_type).tobytes()
            + tf.astype(kind).tobytes())


def _decode(bag: bytes, id_type: str) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(bag[:4], "little")
    width = np.dtype(id_type).itemsize
    kind = f"<u{(len(bag) - 4) // n - width}"
    return (np.frombuffer(bag, id_type, n, 4).astype(np.int64),
            np.frombuffer(bag, kind, n, 4 + width * n).astype(np.int64))


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def bags(docs: DataFrame, block, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, bag) of each row: all its terms counted, and its vector of
    the block's vocabulary (null: none of it).  ``block`` is a broadcast
    block."""
    short_batches()

    def run(batches):
        vocabulary = block.value["vocabulary"]
        kind = _id_type(len(vocabulary))
        place = {t: i for i, t in enumerate(vocabulary)}.get
        for batch in batches:
            sizes, out = [], []
            for t in batch.column("text"):
                n, held = 0, Counter()
                for part in pieces(lowered(t.as_py()), GAP):
                    terms = TERM.findall(part)
                    n += len(terms)
                    held.update(map(place, terms))
                held.pop(None, None)
                sizes.append(n)
                out.append(_encode(held, kind) if held else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()),
                "bag": pa.array(out, pa.binary())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, bag binary")


def document_frequencies(bagged: DataFrame, vocabulary: int) -> DataFrame:
    """(term, df) by term number: each task counts the vectors it reads."""
    kind = _id_type(vocabulary)

    def run(batches):
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for b in batch.column("bag"):
                df[_decode(b.as_py(), kind)[0]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held.astype(np.int32)),
                                          "df": pa.array(df[held])})

    found = bagged.where("bag IS NOT NULL").select("bag").mapInArrow(run, "term int, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


def classes(bagged: DataFrame, n_docs: int, n_terms: int, k: int = 10, b: int = 75) -> DataFrame:
    """(bag, m, members): the distinct pairs of vector and norm, each with its
    ``k`` least ids in ascending order."""
    norm = F.expr(f"(CAST({b} AS DECIMAL(38,0)) * n * {n_docs}L) div {max(1, n_terms)}L")
    rows = (bagged.where("bag IS NOT NULL").withColumn("m", F.lit(100 - b) + norm)
            .select("doc_id", "bag", "m", F.xxhash64("bag", "m").alias("h")))
    least = F.row_number().over(Window.partitionBy("h", "m", "bag").orderBy("doc_id"))
    ids = F.sort_array(F.collect_list(F.struct("doc_id")))["doc_id"]
    return (rows.withColumn("least", least).where(F.col("least") <= k)
            .groupBy("h", "m", "bag").agg(ids.alias("members")).drop("h"))


def best_classes(found: DataFrame, block, k: int = 10, cells: int = 1 << 21) -> DataFrame:
    """(item, score, members) of the ``k`` best classes that each task holds
    for each item, by score and least member.  ``block`` is a broadcast block
    with weights; ``cells`` bounds the scores held at a time."""
    least_id = -1 << 63

    def run(batches):
        q = block.value
        n_items, kind = len(q["items"]), _id_type(len(q["vocabulary"]))
        size = max(1, cells // (n_items + len(q["matrix"])))
        score = np.zeros((k, n_items), q["matrix"].dtype)  # the best so far, 0: none
        first = np.zeros((k, n_items), np.int64)
        which = np.full((k, n_items), -1, np.int64)
        members: dict[int, list] = {}
        seen = 0
        for batch in batches:
            rows = batch.to_pydict()
            lead = np.array([least_id if ids[0] is None else ids[0] for ids in rows["members"]],
                            np.int64)
            for at in np.array_split(np.argsort(lead, kind="stable"), -(-len(lead) // size)):
                vectors = [_decode(rows["bag"][i], kind) for i in at.tolist()]
                doc = np.repeat(np.arange(len(at)), [len(v[0]) for v in vectors])
                s = scores(q, doc, np.concatenate([v[0] for v in vectors]),
                           np.concatenate([v[1] for v in vectors]),
                           np.array(rows["m"], np.int64)[at], len(at))
                top = np.argsort(-s, axis=0, kind="stable")[:k]  # ties: rows are in order of least id
                score = np.concatenate((score, np.take_along_axis(s, top, 0)))
                first = np.concatenate((first, lead[at][top]))
                which = np.concatenate((which, seen + at[top]))
                keep = np.lexsort((first, -score), axis=0)[:k]
                score, first, which = (np.take_along_axis(x, keep, 0) for x in (score, first, which))
                used = set(np.unique(which[score > 0]).tolist())
                members = {i: ids for i, ids in members.items() if i in used} | {
                    seen + i: rows["members"][i] for i in at.tolist() if seen + i in used}
            seen += len(lead)
        place, item = np.nonzero(score > 0)
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(item.astype(np.int32)),
            "score": pa.array(score[place, item].astype(np.int64)),
            "members": pa.array([members[i] for i in which[place, item].tolist()],
                                pa.list_(pa.int64()))})

    return found.mapInArrow(run, "item int, score long, members array<long>")


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, doc_id: str = "doc_id",
           text: str = "text", item: str = "item_id", item_text: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item
    with a score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    terms = stage(item_terms(items, item, item_text), "item_terms")
    ranked = []
    for rows in item_blocks(terms, block_terms):
        block = make_block(rows.collect())  # block_terms rows at most, or one item
        sent = spark.sparkContext.broadcast(block)
        bagged = stage(bags(docs, sent, doc_id, text), "bags")
        n_docs, n_terms = bagged.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(bagged, len(block["vocabulary"]))
        ratio = (2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
        weight = np.zeros(len(block["vocabulary"]), np.int64)
        for r in df.select("term", F.floor(1000 * F.ln(ratio)).cast("long").alias("w")).collect():
            weight[r.term] = r.w
        weighed = spark.sparkContext.broadcast(weigh(block, weight))
        best = best_classes(classes(bagged, n_docs, n_terms, k, b), weighed, k)
        listed = best.select("item", "score", F.explode("members").alias("doc_id"))
        rank = F.row_number().over(
            Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
        names = spark.createDataFrame(list(enumerate(block["items"])), T.StructType(
            [T.StructField("item", T.IntegerType()), terms.schema["item_id"]]))
        ranked.append(stage(
            listed.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
        sent.destroy()
        weighed.destroy()
    if not ranked:
        return terms.where("false").select(
            "item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
            F.lit(0).cast("long").alias("score"))
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out
