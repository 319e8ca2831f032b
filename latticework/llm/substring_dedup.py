"""Exact substring deduplication by fixed-block anchors.

A repeat is a window of `window` consecutive words that also starts in a document with a smaller id. Any window holds a whole block of the
document that its copy lies in, if blocks of window // 2 words stand side by side there (non-overlapping, from the first word on).
1. Blocks are the index and every rolling window of a block's length is a probe. Both go, packed, to the partition of their hash; the ones that
   are a block somewhere and lie in two documents are anchors, and each document is told its own.
2. Only around anchors, a document's windows can repeat. Their hashes, packed again, meet all others; a document is told those that a document with a
   smaller id has. Neighbouring ones make up the maximal repeats, which are removed as spans of words.
Documents with the same words throughout are settled before step 2: all but those of the smallest id lose every word (if there is a window).

Packed probes are 6 bytes a word (a 32-bit hash within a partition, 16 bits for the document and whether it is a block), so the exchange is smaller
than the text and no document, block or hash is dropped; false anchors only cost work, since step 2 compares 64-bit hashes within partitions that
an independent hash deals out. A hash that millions of documents share is as many packed entries in one partition, never pairs.

Null ids are not smaller or larger than any: such documents keep all words. Null and empty texts have no words; texts of any length are taken whole. Rows with the same id don't remove each
other's words, and equal rows get equal results. Empty tables give empty results. Further columns are left out of find_repeats() and kept by remove_repeats().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import U64, WordHash, free_name, materialize, mix, rolling, split_white, starts, texts_of, word_chunks

#: Words whose probes one partition holds, and words that a task packs at once.
PARTITION_WORDS = 2_000_000
CHUNK_WORDS = 250_000
_BASE_2 = 0xD6E8FEB86659FD93


_TOLD = "part int, ids binary, counts binary, found binary"


def _told(ids: np.ndarray, value: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """What documents are to know, packed: a row for each partition of documents."""
    order = np.lexsort((value, ids))
    ids, value = ids[order], value[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (value[1:] != value[:-1])
    ids, value = ids[fresh], value[fresh]
    part = packed.part_of(mix(ids.astype(U64)), parts)
    order = packed.by_part(part, parts)
    ids, value, part = ids[order], value[order], part[order]
    if not len(ids):
        return
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    own = np.flatnonzero(first)
    edge = packed.heads(part)
    inside = np.searchsorted(own, edge)  # a document is in one partition only
    count = np.diff(np.append(own, len(ids))).astype(np.uint32)
    columns = [pa.array(part[edge[:-1]], pa.int32()), packed.slices(ids[own], inside), packed.slices(count, inside), packed.slices(value, edge)]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "ids", "counts", "found"])


def _gathered(told: DataFrame, parts: int) -> DataFrame:
    """id and what it was told by all partitions, as binary: a row for each document."""

    def run(batches):
        ids, value = [np.empty(0, np.int64)], [np.empty(0, U64)]
        for b in batches:
            for i, n, v in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                ids.append(np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.uint32)))
                value.append(np.frombuffer(v, U64))
        ids, value = np.concatenate(ids), np.concatenate(value)
        order = np.argsort(ids, kind="stable")
        ids, value = ids[order], value[order]
        own, head = np.unique(ids, return_index=True)
        edge = np.append(head, len(ids))
        for k in range(0, len(own), 2000):
            cut = edge[k : k + 2001]
            yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 2000]), packed.slices(value[cut[0] : cut[-1]], cut - cut[0])], names=["id", "found"])

    return told.repartitionById(parts, "part").mapInArrow(run, "id long, found binary")


def _limits(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, list[bytes]]]:
    """word_chunks of at most packed.ROWS rows."""
    for i in range(0, len(texts), packed.ROWS):
        for a, b, ends, words in word_chunks(texts[i : i + packed.ROWS], split_white, CHUNK_WORDS):
            yield a + i, b + i, ends, words


def signatures(docs: DataFrame) -> DataFrame:
    """id, n_words, a 128-bit hash of the words in order, and the SHA-256 of the words joined by spaces. docs: id, text."""

    def run(batches):
        for b in batches:
            n, x, y, sha = [], [], [], []
            for t in texts_of(b, "text"):
                words = split_white(t) if t else []
                joined = b" ".join(words)
                digest = hashlib.sha256(joined).digest()
                n.append(len(words))
                x.append(int.from_bytes(digest[:8], "little", signed=True))
                y.append(int.from_bytes(digest[8:16], "little", signed=True))
                sha.append(digest.hex())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(sha)], names=["id", "n_words", "sx", "sy", "sha"])

    return docs.mapInArrow(run, "id long, n_words long, sx long, sy long, sha string")


def find_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, n_words, n_removed, removed (array of (start, length) in words), kept_sha256 (of the words left, joined by spaces)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    block = window // 2
    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = materialize(signatures(lean), "repeats-signatures")
    first = materialize(sig.where("id IS NOT NULL").groupBy("sx", "sy").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeats-copies")
    sig = materialize(sig.join(first, ["sx", "sy"], "left").withColumn("first_id", F.coalesce("first_id", "id")), "repeats-signatures")
    total = sig.agg(F.sum("n_words")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_WORDS))

    def full(words: list[bytes], cache: WordHash) -> np.ndarray:
        return rolling(cache.of(words), block)

    def probes(batches):
        cache = WordHash()
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), texts_of(b, "text")
            for lo, hi, ends, words in _limits(texts):
                at = starts(ends, block)
                n = np.diff(ends)
                row = np.searchsorted(ends[1:], at, side="right")
                at, row = at[n[row] >= window], row[n[row] >= window]
                if not len(at):
                    continue
                h = full(words, cache)[at]
                aligned = (at - ends[row]) % block == 0
                yield packed.pack(h & U64(0xFFFFFFFF), packed.part_of(h, parts), row, ids[lo:hi, None], parts, np.uint32, aligned)

    def anchors(batches):
        h, part, ids, aligned = packed.unpack(batches, np.uint32)
        ids = ids[:, 0]
        key = part.astype(U64) << U64(32) | h.astype(U64)
        order = np.argsort(key)
        key, ids, aligned = key[order], ids[order], aligned[order]
        if not len(key):
            return
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        good = np.logical_or.reduceat(aligned, head) & (np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head))
        keep = np.repeat(good, np.diff(np.append(head, len(key))))
        yield from _told(ids[keep], key[keep], parts)

    with_id = lean.where("id IS NOT NULL")
    told = with_id.mapInArrow(probes, packed.SCHEMA).repartitionById(parts, "part").mapInArrow(anchors, _TOLD)
    told = _gathered(told, parts)
    firsts = sig.where("id = first_id").select("id").distinct()  # documents whose words no smaller id has throughout
    near = materialize(with_id.join(told.join(firsts, "id", "left_semi"), "id").select("id", "text", "found"), "repeats-candidates")

    def windows(batches):
        cache = WordHash()
        for b in batches:
            ids, texts, found = b.column(0).to_numpy(zero_copy_only=False), texts_of(b, "text"), b.column(2).to_pylist()
            for lo, hi, ends, words in _limits(texts):
                raw = cache.of(words)
                h = rolling(raw, block)
                key = packed.part_of(h, parts).astype(U64) << U64(32) | h & U64(0xFFFFFFFF)
                cover = np.zeros(len(words) + 1, np.int64)
                for r in range(hi - lo):
                    s, e = int(ends[r]), int(ends[r + 1])
                    if e - s < window:
                        continue
                    own = np.sort(np.frombuffer(found[lo + r], U64))
                    mine = key[s : e - block + 1]
                    at = np.flatnonzero(own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine) + s
                    np.add.at(cover, np.maximum(at - (window - block), s), 1)
                    np.add.at(cover, np.minimum(at, e - window) + 1, -1)
                at = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                if not len(at):
                    continue
                row = np.searchsorted(ends[1:], at, side="right")
                yield packed.pack(rolling(raw, window)[at], packed.part_of(rolling(raw, window, _BASE_2)[at], parts), row, ids[lo:hi, None], parts, U64)

    def later(batches):
        h, part, ids, _ = packed.unpack(batches, U64)
        ids = ids[:, 0]
        order = np.lexsort((h, part))
        h, part, ids = h[order], part[order], ids[order]
        if not len(h):
            return
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])]))
        smallest = np.repeat(np.minimum.reduceat(ids, head), np.diff(np.append(head, len(h))))
        keep = ids > smallest
        yield from _told(ids[keep], h[keep], parts)

    repeats = near.mapInArrow(windows, packed.SCHEMA).repartitionById(parts, "part").mapInArrow(later, _TOLD)
    repeats = _gathered(repeats, parts).withColumnRenamed("found", "repeats")

    def removal(batches):
        cache = WordHash()
        for b in batches:
            out = []
            for i, t, found in zip(b.column(0).to_pylist(), texts_of(b, "text"), b.column(2).to_pylist(), strict=True):
                words = split_white(t) if t else []
                raw = cache.of(words)
                h = rolling(raw, window)
                own = np.sort(np.frombuffer(found, U64))
                at = np.flatnonzero(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h)
                gone = np.zeros(len(words) + 1, np.int64)
                gone[at] += 1
                np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"start": s, "length": e - s} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                digest = hashlib.sha256(b" ".join(words)).digest()
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((i, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["id", "sx", "sy", "n", "spans", "kept"])

    removed = near.select("id", "text").join(repeats, "id").select("id", "text", "repeats").mapInArrow(removal, "id long, sx long, sy long, n long, spans array<struct<start:int,length:int>>, kept string")
    removed = removed.dropDuplicates(["id", "sx", "sy"])
    whole = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= window)
    none = F.array().cast("array<struct<start:int,length:int>>")
    return sig.join(removed, ["id", "sx", "sy"], "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length")))).otherwise(F.coalesce("spans", none)).alias("removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of repeats removed; a text that loses some has its other words joined by single spaces. Ids must be unique for this."""
    found = find_repeats(docs, window=window, id_col=id_col, text_col=text_col).where("n_removed > 0").select(id_col, F.col("removed").alias(gone := free_name(docs.columns, "removed")))

    def cut(batches):
        for b in batches:
            k = b.schema.get_field_index(text_col)
            out = []
            for t, spans in zip(b.column(k).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    words = t.encode().split()
                    for s in reversed(spans):
                        del words[s["start"] : s["start"] + s["length"]]
                    t = b" ".join(words).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(out, pa.string()), *b.columns[k + 1 : -1]], names=b.schema.names[:-1])

    joined = docs.join(found, id_col, "left").select(*docs.columns, gone)
    return joined.mapInArrow(cut, docs.schema)
