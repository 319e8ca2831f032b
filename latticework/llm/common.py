"""Pieces the corpus operators share: tables, the shared folder, and word arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.storage import new_path, written

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, with df's schema even when it is empty."""
    return written(df, label)


def spread(groups: DataFrame, most: int = 20_000) -> DataFrame:
    """groups (a written table), to be broadcast if it has few rows; else a join with it shuffles."""
    return F.broadcast(groups) if groups.limit(most + 1).count() <= most else groups


_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on the session hands rows to Python in batches of about `most` bytes, unless it has a lower limit: long texts then don't come by the ten thousand."""
    now = spark.conf.get(_BATCHES, None)
    digits = "".join(c for c in now or "" if c.isdigit())
    if now and (now.startswith("-") or int(digits or 0) > most):
        spark.conf.set(_BATCHES, str(most))


def free_name(columns: list[str], name: str) -> str:
    """name, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables that one run of an operator writes to the shared folder, to cut lineage; drop() removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths = spark, new_path(spark, name), {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        paths = self.paths.setdefault(label, [])
        path = f"{self.base}/{label}-{len(paths)}"
        df.write.parquet(path)
        paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Remove what was written under labels so far."""
        for label in labels:
            for k, path in enumerate(self.paths.get(label, [])):
                if path:
                    p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
                    self.paths[label][k] = ""


class WordHash(dict):
    """Word (bytes) to its 64-bit hash. The cache is emptied when it is full, so memory stays bounded on any vocabulary."""

    def __init__(self, seed: int = 0, most: int = 150_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes; nulls stay None."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def split_white(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+: what bytes.split() parts at."""
    return text.split()


def split_white_lower(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_chunks(texts: list[bytes | None], split: Callable[[bytes], list[bytes]], most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, list[bytes]]]:
    """Runs of rows with about `most` words together (one row may have more): first row, row after the last, offsets of the rows' words, words."""
    first, words, ends = 0, [], [0]
    for i, t in enumerate(texts):
        if t:
            words += split(t)
        ends.append(len(words))
        if len(words) >= most:
            yield first, i + 1, np.array(ends), words
            first, words, ends = i + 1, [], [0]
    if len(ends) > 1:
        yield first, len(texts), np.array(ends), words


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); wraps."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def rolling(h: np.ndarray, k: int, base: int = _R) -> np.ndarray:
    """Hash of each k consecutive entries of h, len(h) - k + 1 of them, by prefix sums of a polynomial modulo 2**64."""
    n = len(h)
    if n < k:
        return np.empty(0, U64)
    up = np.empty(n, U64)
    up[0] = 1
    up[1:] = base & (2**64 - 1)
    up = np.cumprod(up, dtype=U64)
    down = np.empty(n - k + 1, U64)
    down[0] = 1
    down[1:] = pow(base, -1, 1 << 64)
    down = np.cumprod(down, dtype=U64)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * up, dtype=U64, out=total[1:])
    return mix((total[k:] - total[:-k]) * down)


def starts(ends: np.ndarray, k: int) -> np.ndarray:
    """Positions in the joined words where k consecutive words of one row begin. ends: offsets, one more than rows."""
    n = int(ends[-1])
    if n < k:
        return np.empty(0, np.int64)
    row_end = np.repeat(ends[1:], np.diff(ends))
    return np.flatnonzero(np.arange(n) + k <= row_end)


def spans_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] of them, for each i, in one array."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    begin = np.cumsum(count) - count
    return np.arange(total) - np.repeat(begin, count) + np.repeat(first, count)

