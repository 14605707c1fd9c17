"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit for each of 64 votes over the hashes of a text's word
shingles.  Fingerprints of at most ``max_distance`` differing bits are linked;
linked documents form groups.  Links are found on the distinct fingerprints:

1. Each fingerprint is cut into segments.  Two fingerprints within the
   distance have a segment within that segment's radius (the pigeonhole rule:
   for 2 bits and 2 segments, 1 bit in the first or 0 in the second).
2. For every segment the small Hamming ball around its value is enumerated
   and looked up among the segment values of all fingerprints (an equi-join).
   Matches are verified on all 64 bits.
3. A segment value shared by more than ``crowded`` fingerprints would give
   pairs in the square of its size.  There the rest of the fingerprint is
   enumerated as well: a table member the ball of half the distance, a probe
   that already differs in ``d`` bits the ball smaller by ``d``.  Members that
   meet at a key are within the distance of each other, and any two within it
   meet at a key, so linking each to the least one loses no link.
4. Groups are the connected components, found by alternating star joins.

Null and empty texts have fingerprint zero and are linked like any other.
Rows with a null id take part; the group id is the least non-null id (null if
there is none).  Repeated rows fall in the same group.  An empty table gives
no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import series_udf, stage

BITS = 64


def text_fingerprint(text: str | None, shingle: int = 3, seed: int = 42,
                     piece: int = 1 << 15) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, piece):
        part = words[at:at + piece + shingle - 1]
        joined = b" ".join(part)
        end = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        start = np.concatenate(([0], end[:-1] + 1))
        m = len(part) - shingle + 1
        h = np.fromiter((digest(joined[a:b], seed) for a, b in
                         zip(start[:m].tolist(), end[shingle - 1:].tolist())), np.uint64, m)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(m, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int = 3):
    """Column function: the fingerprint's 64 bits as a signed long."""
    def run(batches):
        for texts in batches:
            yield pd.Series(np.array([text_fingerprint(t, shingle) for t in texts],
                                     np.uint64).view(np.int64))
    return series_udf(run, "long")


def _masks(width: int, radius: int) -> list[int]:
    """All bit masks of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1)
            for bits in combinations(range(width), r)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _long_array(masks: list[int]):
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` segments that cover the 64 bits."""
    cut = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def radii(max_distance: int, n: int) -> list[int]:
    """Radius to search in each segment (-1: none needed)."""
    r, rest = divmod(max_distance, n)
    return [r if i <= rest else r - 1 for i in range(n)]


def links(fingerprints: DataFrame, max_distance: int = 2, n_segments: int = 2,
          crowded: int = 64) -> DataFrame:
    """Pairs (u, v), u > v, that connect the distinct fingerprints ``fp``
    exactly as all pairs within ``max_distance`` (even) bits would."""
    if max_distance % 2 or n_segments < 2:
        raise ValueError("max_distance must be even, n_segments 2 or more")
    fp, found = F.col("fp"), []
    for seg, ((shift, width), radius) in enumerate(zip(segments(n_segments),
                                                       radii(max_distance, n_segments))):
        if radius < 0:
            continue
        mask = F.lit(_signed(((1 << width) - 1) << shift)).cast("long")
        value = fp.bitwiseAND(mask)
        rest = fp.bitwiseAND(F.bitwise_not(mask))
        members = fingerprints.select(fp, value.alias("value"), rest.alias("rest"))
        count = members.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        full = count.where(F.col("n") > crowded).select("value")
        # The ball; of two values in each other's ball one is enough to probe.
        ball = _long_array([m << shift for m in _masks(width, radius)])
        probes = members.select(
            "fp", "rest", F.col("value").alias("own"),
            F.explode(F.filter(F.transform(ball, lambda m: F.col("value").bitwiseXOR(m)),
                               lambda v: v >= F.col("value"))).alias("value"))
        plain = members.join(full, "value", "left_anti").select(
            "value", F.col("fp").alias("other"))
        pairs = probes.join(plain, "value").where(
            (F.col("fp") != F.col("other"))
            & ((F.col("own") != F.col("value")) | (F.col("fp") > F.col("other")))
            & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_distance))
        found.append(pairs.select(F.greatest("fp", "other").alias("u"),
                                  F.least("fp", "other").alias("v")))
        # Crowded values: meet in the middle on the rest of the bits.
        everywhere = members.select(
            "fp", "rest", F.col("value").alias("own"),
            F.explode(F.transform(ball, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
        near = everywhere.join(full, "value", "left_semi")
        differs = F.bit_count(F.col("own").bitwiseXOR(F.col("value")))
        others = [b for s, (a, w) in enumerate(segments(n_segments)) if s != seg
                  for b in range(a, a + w)]
        keys = None
        for d in range(radius + 1):
            masks = [sum(1 << others[b] for b in range(len(others)) if m >> b & 1)
                     for m in _masks(len(others), max_distance // 2 - d)]
            part = near.where(differs == d).select(
                "fp", "value", F.explode(F.transform(
                    _long_array(masks), lambda m: F.col("rest").bitwiseXOR(m))).alias("meet"))
            keys = part if keys is None else keys.unionByName(part)
        least = keys.groupBy("value", "meet").agg(
            F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
        found.append(keys.join(least, ["value", "meet"]).where(F.col("fp") > F.col("v"))
                     .select(F.col("fp").alias("u"), "v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each connected component, for the nodes
    of ``edges`` (u, v), u > v, that are not roots.  Alternating large and
    small stars; each round is written to the shared folder."""
    def signature(e):
        r = e.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        return r.n, r.s

    e = stage(edges, "edges")
    seen = signature(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (large.join(low, "u").where(F.col("v") > F.col("m"))
                      .select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = stage(small_star, "edges")
        now = signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = 3, max_distance: int = 2, n_segments: int = 2,
                    crowded: int = 64) -> DataFrame:
    """One row per document row: ``doc_id``, ``text_key`` (64-bit hash of the
    text), ``fp``, ``root`` (least fingerprint of the group) and
    ``component_id`` (least id of the group)."""
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"),
                             fingerprint_udf(shingle)(F.col(text)).alias("fp")), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), max_distance, n_segments, crowded))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        nodes["fp"], "least", F.coalesce("root", nodes["fp"]).alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = stage(placed.join(ids, "root").select("fp", "root", "component_id"), "groups")
    return rows.join(groups, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without all but one row of each group: the one of the least
    id (rows of a null id last, then by text hash) stays."""
    rows = stage(near_duplicates(docs, doc_id, text, **options), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("doc_id"),
                     F.col("text_key").alias("text_key"))
    keep = rows.groupBy("root").agg(F.min(order).alias("k"))
    kept = keep.select("k.doc_id", "k.text_key").withColumn("__keep", F.lit(True))
    same = (rows["doc_id"].eqNullSafe(kept["doc_id"])) & (rows["text_key"] == kept["text_key"])
    kept_rows = rows.join(kept, same, "left_semi").count()
    drop = stage(rows.join(kept, same, "left_anti").select("doc_id", "text_key").distinct(), "drop")
    key = "__text_key"
    marked = docs.withColumn(key, F.xxhash64(F.col(text)))
    out = marked.join(drop, marked[doc_id].eqNullSafe(drop["doc_id"])
                      & (marked[key] == drop["text_key"]), "left_anti")
    if kept_rows > keep.count():  # the same id and text in several rows
        out = out.dropDuplicates([doc_id, key])
    return out.drop(key)
