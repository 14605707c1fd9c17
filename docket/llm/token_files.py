"""Token ids in Simple-8b files.

``write_tokens`` encodes every text, orders documents by id and writes their
ids; ``read_tokens`` reads the files back.  A file is a Parquet part of the
output folder: Spark commits it as a whole, so a lost executor leaves nothing
half written.  Its rows are chunks of whole documents (``CHUNK_IDS`` ids, or
one longer document) in ascending id order:

``shard``, ``seq`` (order of parts and of chunks), ``first`` (ids of the part
before the chunk), ``doc_ids``, ``lengths`` and ``payload``.

A payload is, little-endian: ``S8B1``, ids per block, ids, blocks, words and
escapes (32-bit unsigned, but 64-bit for ids), the word offset of every block
(32-bit), the 64-bit words, the escapes.  A word's upper 4 bits select how
many ids it packs in how many bits each.  An id of 2^60 or more does not fit;
its word is an escape that gives its place in the escape list.  Blocks start
at a word boundary, so a decoder works on all words at once.

Null and empty texts encode to the end id alone.  Rows of a null id come
first; rows of the same id are ordered by the hash of their text; repeated
rows are written as often as they occur.  An empty table writes no rows.
"""

from __future__ import annotations

import re
import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashed_words, shared_path, short_batches, small, worker_store

BLOCK_IDS = 128
CHUNK_IDS = 1 << 16
SHARD_BYTES = 48 << 20
MAX_SHARDS = 20_000
#: Fixed values of the format: ids per word and bits per id, by selector.
#: Selector 0 is the escape.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
HEADER = "<4sIQIII"
FILE = "shard int, seq long, first long, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """Payload of an array of unsigned ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    at = np.arange(n, dtype=np.int64)
    room = np.minimum(n, (at // block + 1) * block) - at
    best = np.zeros(n, np.int8)
    top = int(ids.max()).bit_length() if n else 0
    short = ids.astype(np.uint32) if top <= 32 else ids
    for sel in range(len(COUNTS) - 1, 0, -1):  # the last that fits packs most
        count, width = COUNTS[sel], WIDTHS[sel]
        if count > block:
            continue
        if width >= top:
            fits = room >= count
        else:
            large = np.flatnonzero(short >= short.dtype.type(1 << width))
            runs = np.diff(large, prepend=-1, append=n) - 1
            if runs.max() < count:
                continue  # no run of so many small ids
            bad = np.full(n, n, np.int64)
            bad[large] = large
            clear = np.minimum.accumulate(bad[::-1])[::-1] - at
            fits = np.minimum(room, clear) >= count
        best[fits] = sel
    counts = np.array(COUNTS, np.int64)
    begin = np.arange(0, n, block, dtype=np.int64)
    stop = np.minimum(begin + block, n)
    steps, live, pos = [], [], begin.copy()
    while True:  # one word of every block at a time
        on = pos < stop
        if not on.any():
            break
        steps.append(pos.copy())
        live.append(on)
        pos = np.where(on, pos + counts[best[np.minimum(pos, n - 1)]], pos)
    if steps:
        grid, on = np.stack(steps).T, np.stack(live).T
        start = grid[on]
        offsets = np.cumsum(on.sum(axis=1)) - on.sum(axis=1)
    else:
        start, offsets = np.zeros(0, np.int64), np.zeros(0, np.int64)
    sel = best[start] if n else np.zeros(0, np.int8)
    words = sel.astype(np.uint64) << np.uint64(60)
    escaped = sel == 0
    words[escaped] |= np.arange(int(escaped.sum()), dtype=np.uint64)
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(sel == s)
        if len(rows) and WIDTHS[s]:
            for j in range(COUNTS[s]):
                words[rows] |= ids[start[rows] + j] << np.uint64(WIDTHS[s] * j)
    escapes = ids[start[escaped]]
    return b"".join([struct.pack(HEADER, b"S8B1", block, n, len(begin), len(words), len(escapes)),
                     offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
                     escapes.astype("<u8").tobytes()])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload, all words at once."""
    magic, _, n, blocks, n_words, n_escapes = struct.unpack_from(HEADER, payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b payload")
    at = struct.calcsize(HEADER) + 4 * blocks
    words = np.frombuffer(payload, "<u8", n_words, at).astype(np.uint64)
    escapes = np.frombuffer(payload, "<u8", n_escapes, at + 8 * n_words).astype(np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS, np.int64)[sel]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[start[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif WIDTHS[s]:
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for j in range(COUNTS[s]):
                out[start[rows] + j] = (words[rows] >> np.uint64(WIDTHS[s] * j)) & mask
    if len(out) != n:
        raise ValueError("damaged payload")
    return out


# ---------------------------------------------------------------------------
# Encoding with the tokenizers library

#: Units that a generation of the cache holds.
_CACHE = 150_000
#: Units that go through the library as a text; the others are one piece for
#: its model.
_WHOLE = re.compile("[^\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]|'|<\\|")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _SIGN, np.uint8)
    kind[list(b" \t\n\v\f\r")] = _SPACE
    kind[ord("a"):ord("z") + 1] = kind[0x80:] = _LETTER
    kind[ord("0"):ord("9") + 1] = _DIGIT
    return kind


def _odd(part: np.ndarray) -> np.ndarray:
    """Places whose word stays whole: apostrophes, ``<|``, control characters,
    and all that is neither ASCII nor a plain letter of U+00C0 to U+017E."""
    lead = (part >= 0xC0) & ((part < 0xC3) | (part > 0xC5))
    control = ((part < 0x20) & ((part < 0x09) | (part > 0x0D))) | (part == 0x7F)
    at = np.flatnonzero(lead | control | (part == ord("'")))
    # x and division signs; letters that lower-case or compose to two.
    first = np.flatnonzero((part[:-1] == 0x3C) | ((part[:-1] >= 0xC3) & (part[:-1] <= 0xC5)))
    pair = part[first].astype(np.int32) << 8 | part[first + 1]
    return np.concatenate((at, first[np.isin(pair, (0x3C7C, 0xC397, 0xC3B7, 0xC4B0, 0xC589, 0xC5BF))]))


def _units(part: np.ndarray, _=None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, runs of signs and single digits;
    a word with an odd place stays whole."""
    kind = _byte_classes()[part]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    cut = (kind != before) | (kind == _DIGIT)
    odd = _odd(part)
    if len(odd):
        edge = np.flatnonzero((kind == _SPACE) != (before == _SPACE))
        edge = np.append(edge, len(part))
        inner = np.zeros(len(part) + 1, np.int8)
        right = np.unique(np.searchsorted(edge, odd, side="right"))
        inner[edge[right - 1] + 1] += 1
        inner[edge[right]] -= 1
        # A word of one byte opens and closes at the same place.
        cut &= np.cumsum(inner[:-1]) == 0
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(part))
    solid = kind[start] != _SPACE
    return start[solid], end[solid]


class Encoder:
    """Ids of texts, as ``Tokenizer.encode`` gives them without special tokens.

    The vocabulary's normaliser lower-cases and composes, and its splitting
    pattern never crosses white space or, but for apostrophes, a change between
    letters, digits and signs.  So texts are cut into such units in bulk (a
    word with any other character is a unit as a whole), and the library
    encodes each distinct unit of a group of texts once; a bounded cache, ids
    as bytes, carries over to later groups.  Another kind of vocabulary goes
    through the library text by text.
    """

    def __init__(self, path: str):
        store = worker_store(f"encoder:{path}")
        if not store:
            import json

            from tokenizers import Tokenizer, pre_tokenizers
            tok = Tokenizer.from_file(path)
            to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            form = [json.loads(x.__getstate__()) if x else {} for x in (tok.normalizer, tok.pre_tokenizer)]
            steps = [x.get("type") for x in form[0].get("normalizers", [])]
            split = form[1].get("pretokenizers", [{}])[0]
            letters = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x17F)}
            store.update(tok=tok, model=tok.model, letters=letters, young={}, old={}, width=id_width(tok.get_vocab_size()),
                         plain=split.get("type") == "Split" and steps == ["NFC", "Replace", "Lowercase"])
        self.store = store

    def fresh(self, units: list[bytes]) -> list[bytes]:
        """Ids of units, from the library, as bytes."""
        store, out = self.store, []
        piece, whole, letters = store["model"].tokenize, store["tok"].encode, store["letters"]
        kind = "H" if store["width"] == "<u2" else "I"
        for u in units:
            s = u.decode()
            if not u.isalpha() and _WHOLE.search(s):  # bytes: ASCII letters
                ids = whole(s, add_special_tokens=False).ids
            else:
                ids = [t.id for t in piece(s if u.isascii() else s.lower().translate(letters))]
            out.append(array(kind, ids).tobytes())
        return out

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units; the two newest generations of units are kept."""
        store = self.store
        if len(store["young"]) >= _CACHE:
            store["old"], store["young"] = store["young"], {}
        young = store["young"]
        got = list(map(young.get, units))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            aged = [store["old"].get(units[i]) for i in missing]
            new = [units[i] for i, x in zip(missing, aged) if x is None]
            made = iter(self.fresh(new) if new else ())
            for i, x in zip(missing, aged):
                got[i] = young[units[i]] = next(made) if x is None else x
        return got

    def plain_group(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of a group of texts."""
        # Only ASCII letters are lower-cased here; the library does the others.
        raw = [t.encode().lower() for t in texts]
        buf = b"\n".join(raw)
        begin = np.cumsum([0] + [len(r) + 1 for r in raw])
        h, s, e = hashed_words(buf, _byte_classes() != _SPACE, _units)
        width = np.dtype(self.store["width"])
        if not len(h):
            return [np.zeros(0, width) for _ in texts]
        code, distinct = pd.factorize(h)
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        ids = self.ids_of([buf[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())])
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // width.itemsize
        flat = np.frombuffer(b"".join(ids), width)
        offset = np.cumsum(n) - n
        each = n[code]
        done = np.concatenate(([0], np.cumsum(each)))
        out = flat[np.repeat(offset[code] - done[:-1], each) + np.arange(done[-1])]
        bound = done[np.searchsorted(s, begin)]
        return [out[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]

    def encode(self, texts, group_chars: int = 1 << 21):
        """Ids of each text (null: none) in turn."""
        texts = (t if isinstance(t, str) else "" for t in texts)
        if not self.store["plain"]:
            for t in texts:
                yield np.array(self.store["tok"].encode(t, add_special_tokens=False).ids, self.store["width"])
            return
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= group_chars:
                yield from self.plain_group(group)
                group, size = [], 0
        if group:
            yield from self.plain_group(group)


def id_width(vocabulary: int) -> str:
    """Type of an id of a vocabulary of so many."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode_udf(tokenizer: str, end_id: int, width: str, bounds: list[tuple[int, int]]):
    """Function of (id, tie, text) columns: struct of ``shard`` (number of the
    row's range, by the least (id, tie) of all ranges but the first; a null id
    is in the first) and ``ids`` (a text's ids and the end id, as bytes of unsigned
    little-endian integers of type ``width``)."""
    short_batches()
    edges = np.array([b[0] for b in bounds], np.int64)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        enc = Encoder(tokenizer)
        end = np.array([end_id], width).tobytes()
        for doc, tie, texts in batches:
            ids = doc.fillna(0).to_numpy(np.int64)
            at = np.searchsorted(edges, ids, side="left")
            for i in np.flatnonzero(np.searchsorted(edges, ids, side="right") > at).tolist():
                at[i] = bisect_right(bounds, (int(ids[i]), int(tie.iat[i])))  # an id that ranges divide
            yield pd.DataFrame({
                "shard": np.where(doc.isna(), 0, at),
                "ids": pd.Series([ids.astype(width).tobytes() + end for ids in enc.encode(texts)],
                                 dtype=object)})
        pa.default_memory_pool().release_unused()  # the worker waits for its next task
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]],
                           "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "shard int, ids binary")


def _chunk_writer(width: str):
    """Function from sorted rows (doc_id, ids) to rows of the file format."""
    def chunks(batches):
        shard, seq, first = TaskContext.get().partitionId(), 0, 0
        size, docs, parts, held = np.dtype(width).itemsize, [], [], 0

        def row():
            payload = pack(np.frombuffer(b"".join(parts), width))
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "seq": seq, "first": first, "doc_ids": docs,
                "lengths": [len(p) // size for p in parts], "payload": payload}], schema=pa.schema([
                    ("shard", pa.int32()), ("seq", pa.int64()), ("first", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    ("payload", pa.binary())]))

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = ids.as_py()
                if parts and held + len(ids) // size > CHUNK_IDS:
                    yield row()
                    seq, first = seq + 1, first + held
                    docs, parts, held = [], [], 0
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // size
        if parts:
            yield row()
    return chunks


def shard_bounds(ids: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Least (doc_id, tie) of each of about ``shards`` ranges of equally many
    rows, but the first (two longs per file that will be written)."""
    if shards == 1:
        return []
    least = (ids.where(F.col("doc_id").isNotNull()).repartitionByRange(shards, "doc_id", "tie")
             .groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "tie")).alias("b")))
    return sorted((r.b.doc_id, r.b.tie) for r in least.select("b").collect())[1:]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                 doc_id: str = "doc_id", text: str = "text",
                 shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> None:
    """Write the ids of all texts, in ascending id order, to ``path``.

    Ranges for the files come from the ids and, as one id may hold a large part
    of all rows, the hashes of their texts; texts are encoded once and only
    their ids are shuffled.
    """
    from tokenizers import Tokenizer
    width = id_width(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(F.col(text)).alias("tie"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = min(max_shards, max(1, -(-size // shard_bytes)))
    bounds = shard_bounds(rows.select("doc_id", "tie"), shards)
    ids = rows.select("doc_id", "tie",
                      encode_udf(tokenizer, end_id, width, bounds)("doc_id", "tie", "text").alias("e"))
    ids = ids.select("doc_id", "tie", "e.*").repartitionById(len(bounds) + 1, F.col("shard"))
    (ids.sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
     .mapInArrow(_chunk_writer(width), FILE).write.parquet(path))


def _decoded(batches):
    """(shard, doc_id, offset in the shard, ids) of each document."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            raw = unpack(r["payload"]).astype("<u4")
            n = np.array(r["lengths"], np.int64)
            start = np.cumsum(n) - n
            each = [raw[a:a + k].tobytes() for a, k in zip(start.tolist(), n.tolist())]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([r["shard"]] * len(n), pa.int32()),
                "doc_id": pa.array(r["doc_ids"], pa.int64()),
                "offset": pa.array(start + r["first"], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "ids": pa.array(each, pa.binary())})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of the files; ``start``
    counts the ids of all documents before it, ``ids`` are 32-bit unsigned
    little-endian integers."""
    short_batches()
    files = spark.read.schema(FILE).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum(F.expr(
        "aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = files.mapInArrow(_decoded, "shard int, doc_id long, offset long, n_tokens long, ids binary")
    return rows.join(small(base, sizes.count()), "shard").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None,
               **columns) -> DataFrame:
    """Write the files (to a new shared folder unless ``path`` is given) and
    read them back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **columns)
    return read_tokens(spark, path)
