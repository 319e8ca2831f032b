"""Benchmark decontamination with suffix arrays over the training side.

Each shard (a run of whole documents) becomes one array of word codes. Its suffix array is built by sorting three words at a time, and then three ranks at a
time of those suffixes that are still equal, until no more can be told apart: it is sorted to any depth. Every suffix of every benchmark item is looked up by binary search, all of
them in step; suffixes of the shard that share its first window are its places, and places of neighbouring suffixes are joined to the longest verbatim matches. So a long match
takes time in proportion to its length, not to its square.

Only words of the benchmark have codes of their own: any other word ends every match, so all of them share one code, and
suffixes that begin with one are left out of the array. Documents are read once and never shuffled. A benchmark of more than BLOCK_WORDS is searched in blocks, which leave the driver one
after the other and are in a worker's memory one at a time.

Nulls and empty texts have no words: nothing is found in them, or by them. Texts and items of any length are taken whole: a longer one is a shard, or block, of its own. Repeated documents are judged
each for itself; repeated items count once by item_id. An empty benchmark contaminates nothing, and no documents give no rows. A null item_id is written "null". Further columns of
either table are passed by, whatever their names; those named as the output (n_words, matches) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bound_batches, free_name, spans_of, texts_of, word_chunks

#: ASCII but for letters and digits parts words; A-Z become a-z.
_TABLE = bytes(0x20 if c < 0x80 and not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A) else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

#: Words of shards, and of benchmark blocks, at once. A block is what goes to the executors together.
SHARD_WORDS = 150_000
BLOCK_WORDS = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Block:
    """Some of the benchmark's items: their words' codes from 2 and, joined with a -1 after each item, the suffixes that begin a window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.codes: dict[bytes, int] = {}
        self.names = [n for n, _ in items]
        size = np.array([len(w) for _, w in items], np.int64)
        first = np.cumsum(size + 1) - (size + 1)
        self.text = np.full(int((size + 1).sum()), -1, np.int64)
        self.text[spans_of(first, size)] = [self.codes.setdefault(w, len(self.codes) + 2) for _, words in items for w in words]
        windows = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        self.item = np.repeat(np.arange(len(items)), windows)
        self.at = spans_of(first, windows)
        self.offset = self.at - first[self.item]
        self.need = np.minimum(window, size[self.item])


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Positions with a code over 1, sorted by the codes from there on; codes 0 and 1 part, and what follows them may be in any order."""
    at = np.flatnonzero(codes > 1)
    if not len(at):
        return at
    rank = np.append(codes, 0).astype(np.int64)  # a last 0 for what lies beyond
    sa, slots, step = at, np.arange(len(at)), 1
    while len(slots):
        # Positions in slots aren't told apart yet: those of one rank stand side by side.
        p = sa[slots]
        keys = [rank[p], rank[np.minimum(p + step, len(codes))], rank[np.minimum(p + 2 * step, len(codes))]]
        wide = max(int(k.max()) for k in keys).bit_length()
        if wide <= 21:
            keys = [(keys[0] << (2 * wide)) | (keys[1] << wide) | keys[2]]
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        fresh = np.zeros(len(p), bool)
        fresh[0] = True
        for key in keys:
            key = key[order]
            fresh[1:] |= key[1:] != key[:-1]
        p = p[order]
        sa[slots] = p
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(p)))
        before = 1 if step == 1 else len(np.unique(rank[p]))
        rank[p] = np.repeat(slots[head], size) + 2  # the first place of its group
        if step > 1 and len(head) == before:
            break  # a step that parts no group is followed by none that does
        slots = slots[np.repeat(size > 1, size)]
        step *= 3
    return sa


def _common(codes: np.ndarray, pos: np.ndarray, text: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from pos and from at are equal, up to most."""
    same = np.zeros(len(pos), np.int64)
    live, step = np.flatnonzero(most > 0), 2
    while len(live):
        j = same[live][:, None] + np.arange(step)
        equal = (j < most[live][:, None]) & (codes[np.minimum(pos[live][:, None] + j, len(codes) - 1)] == text[np.minimum(at[live][:, None] + j, len(text) - 1)])
        run = np.where(equal.all(1), step, equal.argmin(1))
        same[live] += run
        live = live[run == step]
        step = max(2, min(2 * step, 2_000_000 // max(1, len(live))))
    return same


def _bound(codes: np.ndarray, sa: np.ndarray, text: np.ndarray, at: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
    """Where text[at:at + length] would go in the suffix array: before the suffixes that begin with it, or after them. codes ends with a 0."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) >> 1
        pos = sa[mid]
        same = _common(codes, pos, text, at[live], length[live])
        whole = same == length[live]
        less = codes[np.minimum(pos + same, len(codes) - 1)] < text[np.minimum(at[live] + same, len(text) - 1)]
        right = np.where(whole, after, less)
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return lo


def matches(codes: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Each place in the shard where a window begins: the suffix that begins with it, and the place."""
    codes = np.append(codes, 0)
    sa = suffix_array(codes)
    if not len(sa) or not len(block.at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo = _bound(codes, sa, block.text, block.at, block.need, False)
    found = np.flatnonzero(lo < len(sa))
    found = found[_common(codes, sa[lo[found]], block.text, block.at[found], block.need[found]) == block.need[found]]
    lo, hi = lo[found], _bound(codes, sa, block.text, block.at[found], block.need[found], True)
    return np.repeat(found, hi - lo), sa[spans_of(lo, hi - lo)]


def _search_rows(texts: list[bytes | None], block: Block) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """For each text its number of words and its longest verbatim matches (item, first word, words), by item and place."""
    for first, last, ends, words in word_chunks(texts, words_of, SHARD_WORDS):
        rows = last - first
        codes = np.zeros(len(words) + rows, np.int64)  # a 0 after each document
        n = np.diff(ends)
        place = np.arange(len(words)) + np.repeat(np.arange(rows), n)
        codes[place] = np.fromiter(map(block.codes.get, words, repeat(1)), np.int64, len(words))
        suffix, pos = matches(codes, block)
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(rows)]
        if len(suffix):
            row = np.searchsorted(ends[1:] + np.arange(1, rows + 1), pos, side="right")
            begin, item = pos - (ends[:-1] + np.arange(rows))[row], block.item[suffix]
            diagonal = begin - block.offset[suffix]
            order = np.lexsort((begin, diagonal, item, row))
            row, item, diagonal, begin, length = row[order], item[order], diagonal[order], begin[order], block.need[suffix][order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (begin[1:] > begin[:-1] + 1)
            head = np.flatnonzero(fresh)
            tail = np.concatenate([head[1:], [len(row)]]) - 1
            for r, k, b, e in zip(row[head].tolist(), item[head].tolist(), begin[head].tolist(), (begin[tail] + length[tail]).tolist(), strict=True):
                out[r].append((block.names[k], b, e - b))
        yield from zip(n.tolist(), out, strict=True)


def blocks_of(benchmark: DataFrame, window: int, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark streams through the driver, a stated query set, and leaves it in blocks of bounded size."""
    held, words = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.encode(text_col, "UTF-8")).toLocalIterator():
        w = words_of(bytes(text)) if text is not None else []
        if w:
            held.append((item, w))
            words += len(w)
        if words >= block_words:
            yield Block(held, window)
            held, words = [], 0
    if held:
        yield Block(held, window)


def find_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs' columns (or those in keep) with n_words and matches: array of (item, start, length), the longest verbatim matches that
    benchmark windows of `window` words seed; an item with fewer words is one window. A benchmark of several blocks is searched block by block within one stage.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "matches")]
    df = docs.select(*kept, F.col(text_col).alias(free_name(kept, "text")))
    schema = StructType([*df.schema.fields[:-1], *StructType.fromDDL("n_words long, matches array<struct<item:string,start:int,length:int>>").fields])
    #: A benchmark without words still lets the documents' words be counted.
    sent = [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark, window, item_id, item_text, block_words)] or [spark.sparkContext.broadcast(Block([], window))]

    def search(batches):
        want = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for b in batches:
            texts = texts_of(b, b.schema.names[-1])
            words, found = [], [[] for _ in texts]
            for block in sent:
                got = list(_search_rows(texts, block.value))
                words = [n for n, _ in got]
                for row, (_, m) in zip(found, got, strict=True):
                    row += [{"item": i, "start": s, "length": n} for i, s, n in m]
                if len(sent) > 1:
                    block.__dict__.pop("_value", None)  # the next one takes its place in memory; it is read again from the local copy
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words, pa.int64()), pa.array(found, want)], names=[*b.schema.names[:-1], "n_words", "matches"])

    return df.mapInArrow(search, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those in which a benchmark window occurs."""
    text = options.get("text_col", "text")
    whole = docs.select(F.struct("*").alias("row"), F.col(text).alias(text))
    return find_matches(whole, benchmark, keep=["row"], **options).where(F.size("matches") == 0).select("row.*")


def digest(found: DataFrame, id_col: str) -> DataFrame:
    """The matches of each document as counts and a digest of the items."""

    def per_doc(batches):
        for b in batches:
            n_hit, n_items, sha = [], [], []
            for m in b.column(2).to_pylist():
                end = hit = 0
                for s, e in sorted((x["start"], x["start"] + x["length"]) for x in m):
                    hit += max(0, e - max(s, end))
                    end = max(end, e)
                names = sorted({x["item"] for x in m})
                n_hit.append(hit)
                n_items.append(len(names))
                sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            hit = np.array(n_hit, np.int64)
            longest = [max((x["length"] for x in m), default=0) for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit), pa.array(n_items, pa.int64()), pa.array(sha), pa.array(hit > 0), pa.array(longest, pa.int64())], names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"])

    return found.select(id_col, "n_words", "matches").mapInArrow(per_doc, f"`{id_col}` {found.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")
