"""Removal of byte strings that occur more than once anywhere, by enhanced suffix arrays of the places where texts can repeat.

A window is `window` consecutive bytes of one text (400). Every byte of a window that also starts at another place, in the same text or another, goes.
1. Each window names its anchor: among its `gram`-byte strings the one with the least hash, the first of equals. Equal windows have equal anchors, so neighbouring windows with one anchor are
   a stretch of text that need be held against stretches with an equal anchor only. A stretch is written as its place, its anchor's hash and a hash of its bytes, never as text.
2. Stretches whose anchor is at one place only are done. Equal stretches (copies, however many) repeat as a whole and one of them stands for all. So a group is a set of different stretches
   around one anchor, and only their bytes are cut from texts and move.
3. The suffixes of a group's windows are sorted (of those windows that have an equal hash and another left byte somewhere; no others begin a maximal repeat), with the lengths of the prefixes that neighbours share: an enhanced suffix array. A stack scan over it finds its intervals, the nodes of the
   common-prefix tree, and keeps those whose occurrences have different bytes on the left (or begin a stretch): maximal repeats, each with all of its occurrences.
   Groups of over MOST stretches (a passage in many surroundings) don't meet in one task: stretches are parted into ranges of RANGE windows by their distance from the anchor, and ranges are
   grouped by the bytes that all of their windows hold. Where over MOST different ranges are left in a group, their windows are dealt out by a hash of all their bytes, and equal ones counted.
4. Each text is told its repeats and gives up their bytes. Texts move compressed.

Places in an anchor's group are byte-exact. Stretches are taken for equal by anchor and 64-bit hash together, windows of large groups by two 64-bit hashes.

Null and empty texts have no bytes, and shorter ones than a window lose none. Texts of any length are taken whole. Every row is a text of its own, whatever its id, so repeated rows remove each
other's bytes and get equal results; null ids are like others. Kept bytes may cut a character; the operator therefore returns spans and hashes, and strip_repeats() drops broken characters.
Empty tables give empty results, and further columns, whatever their names, are left out of find_repeats() and repeat_groups() and kept by strip_repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, free_name, rolling, spans_of, starts, texts_of

GRAM = 48
#: Different stretches of one anchor that a suffix array takes, windows of a range, bytes of stretches in one array, bytes that are hashed at once.
MOST, RANGE, ARRAY_BYTES, CHUNK = 400, 32, 200_000, 1 << 20
_PLACE = U64((1 << 22) - 1)
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE_2 = 0xD6E8FEB86659FD93

_STRETCHES = "id long, sx long, at array<int>, m int, anchor long, c long"
_NODES = "node long, above array<long>, size int, own array<struct<id:long,sx:long,at:int,anchor:long,c:long,off:int>>"
_SPANS = "array<struct<start:long,length:long>>"


def _segments(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, list[int]]]:
    """Rows, places in their texts, joined bytes, and where each part of a text ends in these. Long texts come in parts that overlap by a window less one byte."""
    rows, at, parts, ends = [], [], [], [0]
    for row, t in enumerate(texts):
        for a in range(0, max(1, len(t) - window + 1), CHUNK):
            parts.append(t[a : a + CHUNK + window - 1])
            rows.append(row)
            at.append(a)
            ends.append(ends[-1] + len(parts[-1]))
            if ends[-1] >= CHUNK:
                yield np.array(rows), np.array(at), b"".join(parts), ends
                rows, at, parts, ends = [], [], [], [0]
    if rows:
        yield np.array(rows), np.array(at), b"".join(parts), ends


def _least(key: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive keys."""
    k = 1
    while 2 * k <= n:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    return np.minimum(key[: len(key) - (n - k)], key[n - k :]) if n > k else key


def _stretches_of(joined: bytes, ends: list[int], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where stretches begin in the joined bytes, their windows, and the hash of their anchors."""
    edge = np.array(ends)
    at = starts(edge, window)
    if not len(at):
        return at, at, np.empty(0, U64)
    h = rolling(_BYTE[np.frombuffer(joined, np.uint8)], gram)
    anchor = (_least(h & ~_PLACE | np.arange(len(h), dtype=U64), window - gram + 1)[at] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    return at[head], np.diff(np.append(head, len(at))), h[anchor[head]]


def stretches(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each different stretch of a text, or of a part of it, with its places. texts: id, sx, text."""

    def run(batches):
        for b in batches:
            ids, sx = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for rows, base, joined, ends in _segments(texts_of(b, "text"), window):
                lo, m, anchor = _stretches_of(joined, ends, window, gram)
                view, part = memoryview(joined), np.searchsorted(np.array(ends)[1:], lo, side="right")
                c = [xxhash.xxh3_64_intdigest(view[a:e]) for a, e in zip(lo.tolist(), (lo + m + window - 1).tolist(), strict=True)]
                if not len(lo):
                    continue
                place, row, c = lo - np.array(ends)[part] + base[part], rows[part], np.array(c, U64)
                order = np.lexsort((place, c, row))
                fresh = np.ones(len(lo), bool)
                fresh[1:] = (row[order][1:] != row[order][:-1]) | (c[order][1:] != c[order][:-1])
                one = order[fresh]
                places = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(fresh), len(lo)), pa.int32()), pa.array(place[order].astype(np.int32)))
                columns = [ids[row[one]], sx[row[one]], None, m[one].astype(np.int32), anchor[one].view(np.int64), c[one].view(np.int64)]
                yield pa.RecordBatch.from_arrays([places if x is None else pa.array(x) for x in columns], names=["id", "sx", "at", "m", "anchor", "c"])

    return texts.mapInArrow(run, _STRETCHES)


def _common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def intervals(shared: list[int], differ: list[bool]) -> list[tuple[int, int, list[int], int]]:
    """Nodes of the common-prefix tree of a run of sorted suffixes: (length, parent or -1, suffixes directly below, which are no child's). shared[i]: what suffixes i and i + 1 have in common;
    differ[i]: their left bytes differ. Nodes whose occurrences all have one left byte are passed over; what hangs below them goes to the next node above.
    """
    before = [0, *accumulate(differ)]
    out: list[tuple[int, int, list[int], int]] = []
    stack: list[tuple[int, int, list[int], list[int]]] = []  # length, first suffix, suffixes below, nodes below
    last = 0
    for i, size in enumerate([*shared, 0]):
        if size > last:
            stack.append((size, i, [i], []))
        else:
            stack[-1][2].append(i)  # a suffix belongs to the deeper of its two neighbours' intervals
        while stack and stack[-1][0] > size:
            length, first, own, nodes = stack.pop()
            if before[i] != before[first]:
                for k in nodes:
                    out[k] = (out[k][0], len(out), *out[k][2:])
                out.append((length, -1, own, first))
                own, nodes = [], [len(out) - 1]
            if stack and stack[-1][0] >= size:
                stack[-1][2].extend(own)
                stack[-1][3].extend(nodes)
            elif size:
                stack.append((size, first, own, nodes))
        last = size
    return out


def _varied(text: np.ndarray, begin: np.ndarray, size: np.ndarray, copies: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Stretch and offset of the windows that a maximal repeat may start with: of equal hashes, not all with one left byte. Others have no node: equal windows have equal hashes.
    begin, size: stretches in text; copies: whether a stretch stands for copies, too.
    """
    m = np.maximum(size - window + 1, 0)
    place, row = spans_of(begin, m), np.repeat(np.arange(len(m)), m)
    if not len(place):
        return iter(())
    first = place == begin[row]
    left = np.where(first, -1 - place, text[place - 1])  # where a stretch begins, its left byte is like no other
    h = rolling(_BYTE[text], window)[place]
    order = np.argsort(h)
    head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    varied = np.minimum.reduceat(left[order], head) != np.maximum.reduceat(left[order], head)
    varied |= np.logical_or.reduceat((first & copies[row])[order], head)
    keep = np.empty(len(place), bool)
    keep[order] = np.repeat(varied, np.diff(np.append(head, len(place))))
    return zip(row[keep].tolist(), (place - begin[row])[keep].tolist(), strict=True)


def _array(rows: list[tuple], window: int) -> Iterator[dict]:
    """Maximal repeats among different stretches. rows: anchor, c, id, sx, at, piece, whether it stands for copies, too (then its suffixes are there twice)."""
    text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    size = np.array([len(r[5]) for r in rows])
    begin = np.cumsum(size) - size
    where = [(j, o) for j, o in _varied(text, begin, size, np.array([r[6] for r in rows]), window) for _ in range(1 + rows[j][6])]
    suffix = [rows[j][5][o:] for j, o in where]
    order = sorted(range(len(suffix)), key=suffix.__getitem__)
    place = np.array([begin[j] + o for j, o in where], np.int64)[order]
    views = np.lib.stride_tricks.sliding_window_view(text, window)
    equal = np.concatenate([(views[place[k : k + 20_001][1:]] == views[place[k : k + 20_001][:-1]]).all(axis=1) for k in range(0, len(place), 20_000)]) if len(place) > 1 else np.empty(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        run = order[a : b + 1]
        shared = [window + _common(suffix[x][window:], suffix[y][window:]) for x, y in zip(run, run[1:], strict=False)]
        left = [rows[j][5][o - 1] if o else -1 - k for k, (j, o) in enumerate(where[x] for x in run)]
        yield from _nodes(run, where, rows, intervals(shared, [x != y for x, y in zip(left, left[1:], strict=False)]))


def _nodes(run: list[int], where: list[tuple[int, int]], rows: list[tuple], found: list[tuple[int, int, list[int], int]]) -> Iterator[dict]:
    names = []
    for size, _, _, first in found:
        j, o = where[run[first]]
        names.append(xxhash.xxh3_64_intdigest(rows[j][5][o : o + size]) - (1 << 63))
    for k, (size, parent, own, _) in enumerate(found):
        above, at = [names[k]], parent
        while at >= 0:
            above.append(names[at])
            at = found[at][1]
        places = []
        for i in own:
            j, o = where[run[i]]
            anchor, c, id_, sx, start, *_ = rows[j]
            if not places or places[-1] != (now := {"id": id_, "sx": sx, "at": start + o, "anchor": anchor, "c": c, "off": o}):  # copies come next to each other
                places.append({"id": id_, "sx": sx, "at": start + o, "anchor": anchor, "c": c, "off": o})
        yield {"node": names[k], "above": above, "size": size, "own": places}


def _arrays(window: int):
    schema = pa.schema([("node", pa.int64()), ("above", pa.list_(pa.int64())), ("size", pa.int32()), ("own", pa.list_(pa.struct([("id", pa.int64()), ("sx", pa.int64()), ("at", pa.int32()), ("anchor", pa.int64()), ("c", pa.int64()), ("off", pa.int32())])))])

    def run(batches):
        held: dict[tuple[int, int], tuple] = {}
        size, last = 0, None

        def done():
            found = list(_array(list(held.values()), window))
            for k in range(0, len(found), 5000):
                yield pa.RecordBatch.from_pylist(found[k : k + 5000], schema)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != last and size >= ARRAY_BYTES:
                    yield from done()
                    held, size = {}, 0
                last = r[0]
                if r[:2] not in held:  # repeated rows bring a stretch more than once
                    held[r[:2]] = r
                    size += len(r[5])
        if held:
            yield from done()

    return run


class _Found:
    """What the steps up to 3 give. told: texts (id, sx) with their stretches that repeat as a whole or were cut; nodes: maximal repeats; places: repeated stretches."""

    def __init__(self, docs: DataFrame, window: int, gram: int, id_col: str, text_col: str):
        gram = min(gram, window)
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "suffixes")
        text = F.col(text_col)
        self.lean = docs.select(F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("id"), F.xxhash64(F.lit(window), text).alias("sx"), text.alias("text"), F.col(id_col).alias("doc"))
        long = self.lean.where(F.octet_length("text") >= window).select("id", "sx", "text")
        every = self.scratch.write(stretches(long, window, gram), "stretches")
        anchors = self.scratch.write(every.groupBy("anchor").agg(F.sum(F.size("at")).alias("total")).where("total > 1").select("anchor"), "anchors")
        self.places = self.scratch.write(every.join(anchors, "anchor"), "places")
        self.scratch.drop("stretches", "anchors")
        kinds = self._kinds(self.places.select("anchor", "c", F.struct("id", "sx", "at").alias("who"), F.size("at").alias("n")), "kinds")
        cut = (F.col("kinds") > 1) & (F.col("first") == F.struct("id", "sx", "at"))
        told = self.places.join(kinds, ["anchor", "c"]).select("id", "sx", "at", "m", "anchor", "c", (F.col("n") > 1).alias("whole"), cut.alias("cut"), (F.col("kinds") > MOST).alias("large")).where("whole OR cut")
        told = told.groupBy("id", "sx").agg(F.collect_set(F.struct("at", "m", "anchor", "c", "whole", "cut", "large")).alias("told"))

        def packed(batches):
            z = zstandard.ZstdCompressor(level=1)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t) for t in texts_of(b, "text")], pa.binary())], names=["id", "sx", "z"])

        self.near = self.scratch.write(long.mapInArrow(packed, "id long, sx long, z binary").join(told, ["id", "sx"]), "near")

        def pieces(batches):
            z = zstandard.ZstdDecompressor()
            for b in batches:
                out = []
                for i, sx, t, own in zip(*b.columns, strict=True):
                    t = z.decompress(t.as_py())
                    for s in own.as_py():
                        a = s["at"][0]
                        out.append((s["anchor"], s["c"], i.as_py(), sx.as_py(), a, t[a : a + s["m"] + window - 1], s["whole"], s["large"]))
                    if len(out) >= 2000:
                        yield _rows(out, _CUTS)
                        out = []
                yield _rows(out, _CUTS)

        cuts = self.near.where(F.exists("told", lambda s: s["cut"])).select("id", "sx", "z", F.filter("told", lambda s: s["cut"]).alias("told"))
        cuts = self.scratch.write(cuts.mapInArrow(pieces, ", ".join(f"{n} {k}" for n, k in _CUTS.items())), "cuts")
        self.nodes = self.scratch.write(_sorted_arrays(cuts.where("NOT large").drop("large"), window), "nodes")
        large = cuts.where("large").drop("large")
        if not large.isEmpty():
            for found in self._ranges(large.dropDuplicates(["anchor", "c"]), window, gram):
                self.nodes = self.nodes.unionByName(self.scratch.write(found, "nodes"))
        self.scratch.drop("cuts", "ranges", "windows")

    def _kinds(self, rows: DataFrame, label: str) -> DataFrame:
        """anchor, c, n, first, kinds: how often each kind (c) is there, the first row that it comes from, and how many kinds its anchor has. rows: anchor, c, who, n."""
        kinds = self.scratch.write(rows.groupBy("anchor", "c").agg(F.sum("n").alias("n"), F.min("who").alias("first")), label)
        several = self.scratch.write(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")), label)
        return self.scratch.write(kinds.join(several, "anchor"), label)

    def _ranges(self, large: DataFrame, window: int, gram: int) -> Iterator[DataFrame]:
        """Maximal repeats of groups of many stretches, as nodes with one occurrence each."""

        def parted(batches):
            for b in batches:
                out = []
                for anchor, c, i, sx, at, piece, whole in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    m = len(piece) - window + 1
                    h = rolling(_BYTE[np.frombuffer(piece, np.uint8, window)], gram)
                    s = int(((h & ~_PLACE) | np.arange(len(h), dtype=U64)).min() & _PLACE)
                    for r in range((s - m + 1) // RANGE, s // RANGE + 1):
                        lo, hi = max(0, s - r * RANGE - RANGE + 1), min(m - 1, s - r * RANGE)
                        core = s - r * RANGE
                        key = xxhash.xxh3_64_intdigest(piece[core : core + window - RANGE + 1], r) - (1 << 63)
                        part = piece[lo : hi + window]
                        out.append((key, xxhash.xxh3_64_intdigest(part) - (1 << 63), i, sx, at + lo, part, anchor, c, lo, 1 + whole))
                    if len(out) >= 2000:
                        yield _rows(out, _PARTS)
                        out = []
                yield _rows(out, _PARTS)

        def windows(batches):
            for b in batches:
                out = []
                for k, c, piece, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    data = _BYTE[np.frombuffer(piece, np.uint8)]
                    m = len(data) - window + 1
                    out.append([rolling(data, window).view(np.int64), rolling(data, window, _BASE_2).view(np.int64), np.full(m, k), np.full(m, c), np.arange(m, dtype=np.int32), np.full(m, n)])
                    if len(out) >= 200:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

        each = self.scratch.write(large.mapInArrow(parted, ", ".join(f"{n} {k}" for n, k in _PARTS.items())), "ranges")
        kinds = self._kinds(each.select("anchor", "c", F.struct("id", "sx", "at").alias("who"), "n"), "ranges")
        chosen = each.join(kinds.drop("n").join(kinds.select("anchor", "c", F.col("n").alias("total")), ["anchor", "c"]), ["anchor", "c"]).where(F.col("first") == F.struct("id", "sx", "at"))
        chosen = self.scratch.write(chosen.where("kinds > 1").select("anchor", "c", "id", "sx", "at", "piece", (F.col("total") > 1).alias("whole"), "total", "kinds").dropDuplicates(["anchor", "c"]), "ranges")
        of = each.select(F.col("anchor").alias("k"), F.col("c").alias("kc"), "id", "sx", F.col("at").alias("start"), F.col("anchor0").alias("anchor"), F.col("c0").alias("c"), F.col("off0"))

        def spread_out(nodes: DataFrame) -> DataFrame:
            """nodes: node, above, size, k, kc, o (a place in a range); gives every stretch that has the range."""
            own = F.array(F.struct("id", "sx", (F.col("start") + F.col("o")).cast("int").alias("at"), "anchor", "c", (F.col("off0") + F.col("o")).cast("int").alias("off")))
            return nodes.join(of, ["k", "kc"]).select("node", "above", "size", own.alias("own"))

        arrays = self.scratch.write(_sorted_arrays(chosen.where(F.col("kinds") <= MOST).drop("total", "kinds"), window), "windows")
        yield spread_out(arrays.select("node", "above", "size", F.explode("own").alias("p")).select("node", "above", "size", F.col("p.anchor").alias("k"), F.col("p.c").alias("kc"), F.col("p.off").alias("o")))
        alike = kinds.where("kinds = 1 AND n > 1").select(F.xxhash64("anchor", "c").alias("node"), F.col("anchor").alias("k"), F.col("c").alias("kc"))
        yield spread_out(alike.join(each.groupBy("anchor", "c").agg(F.max(F.length("piece")).alias("size")).select(F.col("anchor").alias("k"), F.col("c").alias("kc"), "size"), ["k", "kc"]).select("node", F.array("node").alias("above"), "size", "k", "kc", F.lit(0).alias("o")))
        many = chosen.where(F.col("kinds") > MOST).select("anchor", "c", "piece", "total").mapInArrow(windows, "w1 long, w2 long, k long, kc long, o int, n long")
        many = self.scratch.write(many, "windows")
        again = self.scratch.write(many.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").drop("n"), "windows")
        yield spread_out(many.join(again, ["w1", "w2"]).select(F.col("w1").alias("node"), F.array("w1").alias("above"), F.lit(window).cast("int").alias("size"), "k", "kc", "o"))


_CUTS = {"anchor": "long", "c": "long", "id": "long", "sx": "long", "at": "int", "piece": "binary", "whole": "boolean", "large": "boolean"}
_PARTS = {"anchor": "long", "c": "long", "id": "long", "sx": "long", "at": "int", "piece": "binary", "anchor0": "long", "c0": "long", "off0": "int", "n": "int"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _rows(out: list[tuple], kinds: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _ARROW[kind]) for k, kind in enumerate(kinds.values())], names=list(kinds))


def _sorted_arrays(rows: DataFrame, window: int) -> DataFrame:
    """Nodes of rows' suffix arrays, by anchor. rows: anchor, c, id, sx, at, piece, whole."""
    return rows.repartition("anchor").sortWithinPartitions("anchor", "c").mapInArrow(_arrays(window), _NODES)


def _batch(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["w1", "w2", "k", "kc", "o", "n"])


def repeat_groups(docs: DataFrame, *, window: int = 400, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeat (a name for the string), length, id_col, start: every occurrence of every maximal repeat, a row each, as seen from one anchor's windows; a repeat that is longer than a
    stretch comes as several that overlap.
    """
    f = _Found(docs, window, gram, id_col, text_col)
    member = f.nodes.select("node", "above", "size", F.explode("own").alias("o")).select("size", "above", "o.anchor", "o.c", "o.off")
    size = f.nodes.select(F.col("node").alias("repeat"), F.col("size").alias("length")).distinct()
    member = member.select(F.explode("above").alias("repeat"), "anchor", "c", "off").join(size, "repeat")
    alike = f.places.groupBy("anchor").agg(F.min("c").alias("c"), F.max("c").alias("c2"), F.first("m").alias("m")).where("c = c2")  # all of an anchor's stretches are equal
    whole = alike.select(F.xxhash64("anchor", "c").alias("repeat"), "anchor", "c", F.lit(0).alias("off"), (F.col("m") + (window - 1)).alias("length"))
    at = member.unionByName(whole).join(f.places.select("id", "sx", F.explode("at").alias("at"), "anchor", "c"), ["anchor", "c"]).select("repeat", "length", "id", "sx", (F.col("at") + F.col("off")).alias("start"))
    ids = f.lean.select("id", "sx", "doc")
    return at.join(ids, ["id", "sx"]).select("repeat", "length", F.col("doc").alias(id_col), "start").distinct()


def find_repeats(docs: DataFrame, *, window: int = 400, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, n_bytes, n_removed, removed (array of (start, length) in bytes: maximal runs), kept_sha256."""
    f = _Found(docs, window, gram, id_col, text_col)
    hits = f.nodes.select("size", F.explode("own").alias("o")).select("o.id", "o.sx", F.col("o.at").alias("start"), "size")
    hits = hits.groupBy("id", "sx").agg(F.collect_set(F.struct("start", "size")).alias("hits"))
    cut = F.exists("told", lambda s: s["cut"])
    whole = F.flatten(F.transform(F.filter("told", lambda s: s["whole"]), lambda s: F.transform(s["at"], lambda a: F.struct(a.alias("start"), (s["m"] + (window - 1)).alias("size")))))
    lean = f.near.select("id", "sx", "z", whole.alias("whole"), cut.alias("cut"))
    none = F.array().cast("array<struct<start:int,size:int>>")
    both = lean.where("cut").join(hits, ["id", "sx"], "left").unionByName(lean.where("NOT cut").withColumn("hits", none)).select("id", "sx", "z", F.concat("whole", F.coalesce("hits", none)).alias("hits"))

    def removal(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i, sx, t, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not own:
                    continue
                t, spans = z.decompress(t), []
                for a, e in sorted((h["start"], h["start"] + h["size"]) for h in own):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([a, e])
                kept, last = hashlib.sha256(), 0
                for a, e in spans:
                    kept.update(t[last:a])
                    last = e
                kept.update(t[last:])
                out.append((i, sx, [{"start": a, "length": e - a} for a, e in spans], kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["id", "sx", "removed", "kept"])

    removed = both.mapInArrow(removal, f"id long, sx long, removed {_SPANS}, kept string").dropDuplicates(["id", "sx"])
    text = F.coalesce("text", F.lit(""))
    every = f.lean.select("id", "sx", "doc", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")).join(removed, ["id", "sx"], "left")
    spans = F.coalesce("removed", F.array().cast(_SPANS))
    n = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return every.select(F.col("doc").alias(id_col), "n_bytes", n.alias("n_removed"), spans.alias("removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def strip_repeats(docs: DataFrame, *, window: int = 400, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the bytes of repeats removed; a character that a span cuts goes, too. Ids must be unique for this."""
    gone = free_name(docs.columns, "removed")
    found = find_repeats(docs, window=window, gram=gram, id_col=id_col, text_col=text_col).where("n_removed > 0").select(id_col, F.col("removed").alias(gone))

    def cut(batches):
        for b in batches:
            k, out = b.schema.get_field_index(text_col), []
            for t, spans in zip(b.column(k).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    data = bytearray(t.encode())
                    for s in reversed(spans):
                        del data[s["start"] : s["start"] + s["length"]]
                    t = data.decode(errors="ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(out, pa.string()), *b.columns[k + 1 : -1]], names=b.schema.names[:-1])

    return docs.join(found, id_col, "left").select(*docs.columns, gone).mapInArrow(cut, docs.schema)
