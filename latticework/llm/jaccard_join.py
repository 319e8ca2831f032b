"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams. Each n-gram's hash flips one bit of a very wide sketch, so the Hamming distance of two
sketches is at most the sets' symmetric difference, and sets that are similar enough differ in at most d bits, d following from their sizes.
Sizes fall into bands. A band's sketches have d + 1 + x segments: two similar documents agree on 1 + x of them at least. A segment is known by the XOR of a
64-bit number for each of its set bits, and (band, segment, XOR) is a bucket. Segments of few n-grams tell little, so a document leaves out those of at most t,
with the largest t for which these are x at most. Of two similar documents' 1 + x equal segments (which have equally many n-grams in both), the one with the larger t leaves
out x at most, and whatever it keeps the other one keeps too: so they meet. Documents also join the next larger band if something there can be similar.

What is asked for is the connection of documents, so a bucket's documents aren't paired with each other:
1. equal sets are one class, found by a 128-bit hash; a bucket holds each class once, by its smallest id;
2. each document meets its buckets' pivots (their smallest ids); folded sketches of two to four bits for each n-gram, whose Hamming distance is a lower bound too, exclude
   nearly all pairs that aren't similar; of the rest, each document is verified against its smallest pivot, then against those that aren't connected with it yet;
3. buckets that still hold unconnected documents, one of those with the same documents, are compared by the folded sketches in blocks of bounded size; pairs that these can't
   exclude are verified, the nearest of each document and component first, until none is left.
Verification is exact on the sets of 64-bit n-gram hashes. No bucket is capped or dropped, and texts of any length are taken whole.

Null and empty texts are empty sets, linked with nothing; null ids are linked with nothing and get no component. Repeated rows are equal sets. Rows that
have one id but different texts are judged each for itself. Empty tables give empty results; further columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import U64, Scratch, WordHash, mix, split_white_lower, texts_of, word_chunks
from .components import components

CHUNK_WORDS = 250_000
#: Entries that one partition of the buckets' exchange is to hold.
PARTITION_ENTRIES = 4_000_000
BLOCK = 2048
#: Folded sketches have twice as many bits as n-grams, rounded up to a power of two, and this many at least.
LEAST_FOLD = 256


def shingle_sets(texts: list[bytes | None], n: int, cache: WordHash) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For runs of rows: first row, row after the last, and each row's sorted distinct n-gram hashes. Shorter texts are one gram."""
    for i in range(0, len(texts), packed.ROWS):
        for lo, hi, ends, words in word_chunks(texts[i : i + packed.ROWS], split_white_lower, CHUNK_WORDS):
            h = cache.of(words)
            out = []
            e = ends.tolist()
            grams = np.zeros(max(0, len(h) - n + 1), U64)
            for k in range(n):
                grams = mix(grams * U64(0x9E3779B97F4A7C15) + h[k : k + len(grams)])
            for s, t in zip(e[:-1], e[1:], strict=True):
                if t - s >= n:
                    own = np.sort(grams[s : t - n + 1])
                    fresh = np.ones(len(own), bool)
                    fresh[1:] = own[1:] != own[:-1]
                    out.append(own[fresh])
                elif t > s:
                    own = np.full(1, t - s, U64)
                    for k in range(s, t):
                        own = mix(own * U64(0xD6E8FEB86659FD93) + h[k : k + 1])
                    out.append(own)
                else:
                    out.append(np.empty(0, U64))
            yield lo + i, hi + i, out


class Bands:
    """Size bands for a similarity of percent / 100. Band j holds sizes from low[j] up to low[j + 1] - 1."""

    def __init__(self, percent: int, most: int):
        self.percent = percent
        self.low = [1]
        while self.low[-1] <= most:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * 10_000 / percent**2)))
        high = np.array(self.low[1:]) - 1
        self.differ = 2 * high * (100 - percent) // (100 + percent)
        self.spare = 2 + self.differ // 5
        self.segments = np.where(self.differ > 0, self.differ + 1 + self.spare, 0)

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each size's band, and whether it joins the next one too."""
        low = np.array(self.low)
        band = np.searchsorted(low, size, side="right") - 1
        guest = (band + 1 < len(self.segments)) & (100 * size >= self.percent * low[np.minimum(band + 1, len(low) - 1)])
        return band, guest

    def entries(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket hashes of the sets, and whose they are."""
        size = np.array([len(s) for s in sets], np.int64)
        keys, docs = [np.empty(0, U64)], [np.empty(0, np.int64)]
        band, guest = self.of(size)
        own = np.flatnonzero(size > 0)
        who = np.concatenate([own, own[guest[own]]])
        where = np.concatenate([band[own], band[own[guest[own]]] + 1])
        seg = self.segments[where]
        who, where, seg = who[seg > 0], where[seg > 0], seg[seg > 0]
        if not len(who):
            return keys[0], docs[0]
        base = np.cumsum(seg) - seg
        flat = np.concatenate([sets[d] for d in who.tolist()])
        of = np.repeat(np.arange(len(who)), size[who])
        slot = base[of] + packed.part_of(mix(flat ^ U64(0x5851F42D4C957F2D)), 1 << 31).astype(np.int64) * seg[of] // (1 << 31)
        xor = np.zeros(int(seg.sum()), U64)
        np.bitwise_xor.at(xor, slot, mix(flat + U64(0x14057B7EF767814F)))
        count = np.bincount(slot, minlength=len(xor))
        whose = np.repeat(np.arange(len(who)), seg)
        most = 31  # no document leaves out segments of so many
        upto = np.bincount(whose * (most + 1) + np.minimum(count, most), minlength=len(who) * (most + 1)).reshape(-1, most + 1).cumsum(1)
        keep = count >= (upto[:, :most] <= self.spare[where][:, None]).sum(1)[whose]
        number = np.arange(len(xor)) - base[whose]
        key = mix(xor ^ mix((where[whose].astype(U64) << U64(32)) | number.astype(U64)))
        key, doc = key[keep], who[whose[keep]]
        order = np.argsort(doc, kind="stable")
        return key[order], doc[order]


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """id, size, a 128-bit hash of the set. docs: id, text."""

    def run(batches):
        cache = WordHash()
        for b in batches:
            size, x, y = [], [], []
            for _, _, sets in shingle_sets(texts_of(b, "text"), n, cache):
                for s in sets:
                    size.append(len(s))
                    x.append(int(np.bitwise_xor.reduce(mix(s ^ U64(0x2545F4914F6CDD1D)))) if len(s) else 0)
                    y.append(int(np.add.reduce(mix(s + U64(0x9E3779B97F4A7C15)))) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(np.array(x, U64).view(np.int64)), pa.array(np.array(y, U64).view(np.int64))], names=["id", "size", "sx", "sy"])

    return docs.mapInArrow(run, "id long, size long, sx long, sy long")


def _buckets(docs: DataFrame, n: int, bands: Bands, parts: int) -> DataFrame:
    """bucket, id, pivot (the bucket's smallest id), mx, ms (a 128-bit hash of its members): buckets of three classes at least, each class by its smallest id.
    Of buckets of two, the pair of classes is given, once for a task, without a bucket.
    """

    def entries(batches):
        cache = WordHash()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, sets in shingle_sets(texts_of(b, "text"), n, cache):
                key, doc = bands.entries(sets)
                if len(key):
                    sx = np.array([np.bitwise_xor.reduce(mix(s ^ U64(0x2545F4914F6CDD1D))) if len(s) else 0 for s in sets], U64)
                    own = np.stack([ids[lo:hi], sx.view(np.int64)], 1)
                    yield packed.pack(key & U64(0xFFFFFFFF), packed.part_of(key, parts), doc, own, parts, np.uint32)

    def group(batches):
        h, part, own, _ = packed.unpack(batches, np.uint32, 2)
        key = part.astype(np.int64) << 32 | h.astype(np.int64)
        order = np.lexsort((own[:, 0], own[:, 1], key))
        key, ids, sx = key[order], own[order, 0], own[order, 1]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sx[1:] != sx[:-1])
        key, ids = key[fresh], ids[fresh]
        if not len(key):
            return
        edge = packed.heads(key)
        head, count = edge[:-1], np.diff(edge)
        low, high = np.minimum.reduceat(ids, head), np.maximum.reduceat(ids, head)
        two = (count == 2) & (low != high)
        pairs = np.unique(np.stack([low[two], high[two]], 1), axis=0)
        for i in range(0, len(pairs), 50_000):
            p = pairs[i : i + 50_000]
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(p[:, 1]), pa.array(p[:, 0]), none, none], names=names)
        mx, ms = np.bitwise_xor.reduceat(mix(ids.astype(U64) ^ U64(0x632BE59BD9B4E019)), head), np.add.reduceat(mix(ids.astype(U64) + U64(0x9E3779B97F4A7C15)), head)
        many = np.repeat((count > 2) & (low != high), count)
        pivot, mx, ms = (np.repeat(x, count)[many] for x in (low, mx.view(np.int64), ms.view(np.int64)))
        key, ids = key[many], ids[many]
        for i in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (key, ids, pivot, mx, ms)], names=names)

    names = ["bucket", "id", "pivot", "mx", "ms"]
    return docs.mapInArrow(entries, packed.SCHEMA).repartitionById(parts, "part").mapInArrow(group, "bucket long, id long, pivot long, mx long, ms long")


def _verified(pairs: DataFrame, near: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar. A text travels once with each pair of its document, first to the pair, then to its pivot a."""
    left = near.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = near.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def check(batches):
        cache = WordHash()
        for batch in batches:
            a, b = texts_of(batch, "text_a"), texts_of(batch, "text_b")
            distinct: dict[bytes, int] = {}
            at = [(distinct.setdefault(x or b"", len(distinct)), distinct.setdefault(y or b"", len(distinct))) for x, y in zip(a, b, strict=True)]
            sets = [s for _, _, part in shingle_sets(list(distinct), n, cache) for s in part]
            ok = [similar(len(x := sets[i]), len(y := sets[j]), len(np.intersect1d(x, y, assume_unique=True)), percent) and len(x) > 0 for i, j in at]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def _labelled(ids: DataFrame, comp: DataFrame, column: str, name: str) -> DataFrame:
    known = comp.select(F.col("node").alias(column), F.col("comp").alias("__c"))
    return ids.join(known, column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")


def fold(s: np.ndarray) -> np.ndarray:
    """The set's sketch in 64-bit words."""
    bits = max(LEAST_FOLD, 1 << (2 * len(s) - 1).bit_length()) if len(s) else LEAST_FOLD
    at = (mix(s ^ U64(0xDA942042E4DD58B5)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(U64)


def narrowed(folds: np.ndarray, words: int) -> np.ndarray:
    """Sketches (documents, words), folded on to fewer words: the upper half's bits flip those of the lower half."""
    while folds.shape[1] > words:
        half = folds.shape[1] // 2
        folds = folds[:, :half] ^ folds[:, half:]
    return folds


def _folded(near: DataFrame, n: int) -> DataFrame:
    """id, size and the folded sketch of each document."""

    def run(batches):
        cache = WordHash()
        for b in batches:
            at = 0
            for lo, hi, sets in shingle_sets(texts_of(b, "text"), n, cache):
                size, folds = [len(s) for s in sets], [fold(s).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, hi - lo), pa.array(size, pa.int64()), pa.array(folds, pa.binary())], names=["id", "size", "fold"])
                at += hi - lo

    return near.select("id", "text").mapInArrow(run, "id long, size long, fold binary")


def _possible(pairs: DataFrame, folded: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that sizes and folded sketches don't exclude; only these need their texts."""
    x = folded.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("fold").alias("fa"))
    y = folded.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("fold").alias("fb"))

    def check(batches):
        for whole in batches:
            for t in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                na, nb = t.column(2).to_numpy(), t.column(3).to_numpy()
                fa, fb = ([np.frombuffer(v, U64) for v in t.column(k).to_pylist()] for k in (4, 5))
                far = np.array([np.bitwise_count(narrowed(p[None], w) ^ narrowed(q[None], w)).sum(dtype=np.int64) for p, q in zip(fa, fb, strict=True) for w in [min(len(p), len(q))]], np.int64)
                ok = far <= (na + nb) * (100 - percent) // (100 + percent)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in t.columns[:2]], names=["a", "b"])

    fit = pairs.join(y, "b").join(x, "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return fit.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(check, "a long, b long").distinct()


def _block_candidates(active: DataFrame, folded: DataFrame, percent: int, top: int) -> DataFrame:
    """a, b, cut: pairs of unconnected documents in one bucket, a of them outside the pivot's component, that sketches can't exclude.

    active: bucket, id, comp, odd (outside the pivot's component). For each odd document, block and other component the `top` nearest are given; cut tells of more.
    Blocks are BLOCK odd documents by BLOCK documents of a bucket, so that neither a task nor a group holds a whole bucket.
    """
    sizes = active.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nm"), F.ceil(F.sum(F.col("odd").cast("int")) / BLOCK).cast("int").alias("no"))
    rows = active.join(sizes, "bucket").join(folded, "id")
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    members = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("o"), slot("nm").alias("m"), "id", "comp", "size", "fold", F.lit(False).alias("left"))
    odd = rows.where("odd").select("bucket", slot("no").alias("o"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"), "id", "comp", "size", "fold", F.lit(True).alias("left"))

    def compare(t: pa.Table) -> pa.Table:
        left = t.column("left").to_numpy(zero_copy_only=False).astype(bool)
        ids, comp, size = (t.column(c).to_numpy() for c in ("id", "comp", "size"))
        folds = [np.frombuffer(v, U64) for v in t.column("fold").to_pylist()]
        words = np.array([len(v) for v in folds])
        out: list[tuple[int, int, bool]] = []
        # A bucket's sizes are similar, so its sketches are of few lengths: the odd documents of one length meet the others, folded to the shorter of both.
        for w in np.unique(words[left]).tolist():
            who = np.flatnonzero(left & (words == w))
            mem = np.flatnonzero(~left)
            short = np.minimum(words[mem], w)
            for v in np.unique(short).tolist():
                other = mem[short == v]
                there = np.concatenate([narrowed(folds[j][None], v) for j in other.tolist()])
                for i in who.tolist():
                    fit = np.flatnonzero((comp[other] != comp[i]) & (100 * np.minimum(size[i], size[other]) >= percent * np.maximum(size[i], size[other])))
                    apart = np.bitwise_count(there[fit] ^ narrowed(folds[i][None], v)).sum(1, dtype=np.int64)
                    good = apart <= (size[i] + size[other[fit]]) * (100 - percent) // (100 + percent)
                    fit, apart = other[fit[good]], apart[good]
                    order = np.lexsort((ids[fit], apart, comp[fit]))
                    fit = fit[order]
                    edge = packed.heads(comp[fit])
                    rank = np.arange(len(fit)) - np.repeat(edge[:-1], np.diff(edge))
                    cut = bool((rank >= top).any())
                    out += [(min(int(ids[i]), int(j)), max(int(ids[i]), int(j)), cut) for j in ids[fit[rank < top]].tolist()]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "cut": pa.array([x[2] for x in out], pa.bool_())})

    found = members.union(odd).groupBy("bucket", "o", "m").applyInArrow(lambda t: compare(t), "a long, b long, cut boolean")
    return found.groupBy("a", "b").agg(F.max("cut").alias("cut"))


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, n_shingles, component_id: the smallest id that links reach, a link being a Jaccard similarity of percent / 100 or more of
    the sets of n-word shingles of the lower-cased (A-Z) text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with_id = lean.where("id IS NOT NULL")
    sig = scratch.write(signatures(lean, n), "signatures")
    largest = sig.agg(F.max("size").alias("most"), F.sum("size").alias("all")).first()
    bands = Bands(percent, int(largest.most or 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((largest["all"] or 0) * 0.5 / PARTITION_ENTRIES))
    classes = sig.where("id IS NOT NULL AND size > 0").groupBy("sx", "sy").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = scratch.write(classes, "classes")
    bucketed = scratch.write(_buckets(with_id, n, bands, parts), "buckets")
    inside = bucketed.select("id").union(bucketed.select("pivot")).distinct()
    near = scratch.write(with_id.join(inside, "id", "left_semi"), "near")

    folded = scratch.write(_folded(near, n), "sketches")
    met = bucketed.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = scratch.write(_possible(met, folded, percent), "pairs")
    first = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = scratch.write(_verified(first, near, n, percent), "links")
    comp = components(links)
    rest = _labelled(_labelled(star.join(first, ["a", "b"], "left_anti"), comp, "a", "ca"), comp, "b", "cb").where("ca <> cb").select("a", "b")
    links = links.union(scratch.write(_verified(rest, near, n, percent), "links"))
    comp = scratch.write(components(links), "components")

    tested, top, bucketed = star, 32, bucketed.where("bucket IS NOT NULL")
    while True:
        marked = _labelled(_labelled(bucketed, comp, "id", "comp"), comp, "pivot", "pivot_comp").withColumn("odd", F.expr("comp <> pivot_comp"))
        mixed = marked.groupBy("bucket", "mx", "ms").agg(F.max("odd").alias("any")).where("any").groupBy("mx", "ms").agg(F.min("bucket").alias("bucket")).select("bucket")
        active = scratch.write(marked.join(mixed, "bucket", "left_semi").select("bucket", "id", "comp", "odd"), "active")
        if active.isEmpty():
            break
        found = scratch.write(_block_candidates(active, folded, percent, top), "pairs")
        fresh = scratch.write(found.join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b"), "pairs")
        if not fresh.isEmpty():
            tested = tested.union(fresh)
            links = links.union(scratch.write(_verified(fresh, near, n, percent), "links"))
            comp = scratch.write(components(links), "components")
        if found.where("cut").isEmpty():  # every pair that the sketches leave has been verified
            break
        top *= 8
    scratch.drop("buckets", "near", "sketches", "pairs", "links", "active")

    known = comp.select(F.col("node").alias("class_id"), "comp")
    return (
        sig.join(classes, ["sx", "sy"], "left").withColumn("class_id", F.coalesce("class_id", "id")).join(known, "class_id", "left")
        .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull() & (F.col("size") > 0), F.coalesce("comp", "class_id")).otherwise(F.col("id")).alias("component_id"))
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without all but the smallest id of each component; ids must be unique. Rows without an id stay."""
    gone = near_duplicates(docs, id_col=id_col, **options).where(f"`{id_col}` <> component_id").select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
