"""Byte-pair encoding and decoding with a public word-level vocabulary (merges end at words; lower case; white space is dropped).

Each word's adjacent pairs are the leaves of a segment tree that holds (rank, place) minima: its root is the leftmost pair of lowest rank.
A merge changes three leaves and the nodes above them, a logarithmic number, and the word is done when no pair at the root can merge. Trees
of many words of like size stand in one numpy array and merge in step, so a word of any length takes O(n log n) and short ones share the work.
Words' tokens are cached in each task up to a bound.

Text is prepared as the vocabulary file says: special tokens' own strings are cut out first, then NFC, lower case of each character, and the file's
pattern for words. Null texts count as empty: no ids, and empty text when decoded. Repeated rows, long texts and clashing column names don't matter; a
column named as the output is replaced. Of pairs of one rank the leftmost merges first. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import free_name, spans_of

#: The vocabulary's pattern of words, with white space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
_NONE = np.int64(1) << 40
CACHE_WORDS = 300_000
CHUNK_CHARS = 1_000_000


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it is printable in Latin-1, else one of the characters from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        size = 1 << 18
        self.shift = np.uint64(64 - 18)
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        for rank, (k, s) in enumerate(zip(key.tolist(), self._slot(key).tolist(), strict=True)):
            while self.keys[s] not in (-1, k):
                s = (s + 1) % size
            if self.keys[s] == -1:
                self.keys[s], self.ranks[s] = k, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each pair's rank; _NONE if it never merges. Open addressing."""
        key = a << 16 | b
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], _NONE)
        left = np.flatnonzero((held != key) & (held != -1))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            held = self.keys[slot[left]]
            out[left] = np.where(held == key[left], self.ranks[slot[left]], _NONE)
            left = left[(held != key[left]) & (held != -1)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word (not empty), joined, and their number."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        data, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        ids = self.inner[data]
        ids[first + n - 1] = self.last[data[first + n - 1]]
        alive = np.ones(len(ids), bool)
        wide = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
        for w in np.unique(wide[n > 1]).tolist():
            rows = np.flatnonzero((wide == w) & (n > 1))
            step = max(1, (1 << 19) // w)
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                flat = spans_of(first[r], n[r])
                ids[flat], alive[flat] = self._lockstep(ids[flat], n[r], w)
        count = np.add.reduceat(alive.astype(np.int64), first) if len(words) else n
        return ids[alive], count

    def _lockstep(self, ids: np.ndarray, n: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges words of n <= w symbols each; gives all symbols and which of them are left."""
        rows = len(n)
        inside = np.arange(w) < n[:, None]
        sym = np.zeros((rows, w + 1), np.int64)  # one more place, for what there isn't
        sym[:, :w][inside] = ids
        after = np.minimum(np.arange(1, w + 2), n[:, None])
        after = np.where(after >= n[:, None], w, after)
        before = np.broadcast_to(np.arange(-1, w), (rows, w + 1)).copy()
        before[:, 0] = w
        live = np.zeros((rows, w + 1), bool)
        live[:, :w] = inside
        shift, none = 40, np.int64(1) << 62
        tree = np.full((rows, 2 * w), none, np.int64)
        pair = inside.copy()
        pair[np.arange(rows), n - 1] = False
        rr, pp = np.nonzero(pair)
        rank = self.rank(sym[rr, pp], sym[rr, pp + 1])
        tree[rr, w + pp] = np.where(rank < _NONE, rank << shift | pp, none)
        level = w
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        S, A, P, L, T = sym.reshape(-1), after.reshape(-1), before.reshape(-1), live.reshape(-1), tree.reshape(-1)
        row = np.flatnonzero(tree[:, 1] < none)
        depth = w.bit_length() - 1
        while len(row):
            root = T[row * 2 * w + 1]
            at, rank = root & ((1 << shift) - 1), root >> shift
            base = row * (w + 1)
            gone = A[base + at]
            then, prev = A[base + gone], P[base + at]
            S[base + at] = self.made[rank]
            L[base + gone] = False
            A[base + at] = then
            P[base + then] = at
            has_next, has_prev = then < w, prev < w
            right = np.where(has_next, self.rank(S[base + at], S[base + then]), _NONE)
            left = np.where(has_prev, self.rank(S[base + prev], S[base + at]), _NONE)
            put = lambda r, p: np.where(r < _NONE, r << shift | p, none)
            top = row * 2 * w
            T[top + w + gone] = none
            T[top + w + at] = put(right, at)
            T[(top + w + prev)[has_prev]] = put(left, prev)[has_prev]
            nodes, tops = np.concatenate([w + gone, w + at, (w + prev)[has_prev]]), np.concatenate([top, top, top[has_prev]])
            for _ in range(depth):
                nodes >>= 1
                T[tops + nodes] = np.minimum(T[tops + 2 * nodes], T[tops + 2 * nodes + 1])
            row = row[T[top + 1] < none]
        return sym[:, :w][inside], live[:, :w][inside]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder(dict):
    """Texts to ids. As a dict: a word to its number among the cached words."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.find = regex.compile(_WORDS).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.marks = {s[:2] for s in vocab.special}
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.first, self.count, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.fresh.append(word)
        return k

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return self.find(text.lower())

    def words(self, text: str) -> list[str]:
        if self.cut is None or not any(m in text for m in self.marks):
            return self._words(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self._words(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's number of them."""
        if len(self) > CACHE_WORDS:
            self._empty()
        words, ends = [], []
        for t in texts:
            if t:
                words += self.words(t)
            ends.append(len(words))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            special = [self.vocab.special.get(w) if w[0] == "<" else None for w in self.fresh]
            ids, count = self.vocab.merge([w.encode() for w in self.fresh])
            if any(s is not None for s in special):
                parts = np.split(ids, np.cumsum(count)[:-1])
                parts = [np.array([s]) if s is not None else p for p, s in zip(parts, special, strict=True)]
                ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
            self.count, self.flat, self.fresh = np.concatenate([self.count, count]), np.concatenate([self.flat, ids]), []
        n = self.count[at]
        total = np.concatenate([[0], np.cumsum(n)])[np.array(ends, np.int64)]
        return self.flat[spans_of(self.first[at], n)], np.diff(total, prepend=0)


def _chunks(texts: list[str | None]):
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    yield texts[first:]


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with ids, an array of ints. path: the vocabulary file, at the same place on every executor."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != ids_col]
    df = docs.select(*kept, F.col(text_col).alias(free_name(kept, "text")))

    def run(batches):
        coder = Encoder(vocabulary(path))
        for b in batches:
            ids, counts = [], []
            for part in _chunks(b.column(b.num_columns - 1).to_pylist()):
                i, n = coder.encode(part)
                ids.append(i.astype(np.int32))
                counts.append(n)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*b.schema.names[:-1], ids_col])

    return df.mapInArrow(run, StructType([*df.schema.fields[:-1], StructField(ids_col, ArrayType(IntegerType(), False))]))


def decode(docs: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the ids' text. The vocabulary names no decoder: tokens are joined by spaces as they are."""
    kept = [c for c in docs.columns if c != text_col]
    df = docs.select(*kept)
    at = kept.index(ids_col)

    def run(batches):
        names = vocabulary(path).names
        for b in batches:
            text = pa.array([" ".join([names[i] for i in x]) if x is not None else None for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, text_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(text_col, StringType())]))


def digests(encoded: DataFrame, path: str, id_col: str, *, ids_col: str = "ids") -> DataFrame:
    """For each row: number of ids, SHA-256 of the ids as little-endian 32-bit integers, SHA-256 of the decoded text."""
    df = encoded.select(id_col, ids_col)

    def run(batches):
        names = [n.encode() for n in vocabulary(path).names]
        for b in batches:
            col = b.column(1)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(np.array(col.value_lengths()))])
            n, a, d = [], [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = flat[s:e]
                n.append(e - s)
                a.append(hashlib.sha256(part.tobytes()).hexdigest())
                d.append(hashlib.sha256(b" ".join(map(names.__getitem__, part.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
