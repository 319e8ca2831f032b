"""An exchange of many small numbers between documents and hash partitions, as one binary row for each task chunk and partition.

An entry is a hash and the document it is from. Entries of a chunk that go to one partition travel as: hashes, 15-bit document numbers (the uppermost
bit is a flag), and the 64-bit values of the documents there are. Nothing is capped: a hash that many documents share is that many entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import U64

SCHEMA = "part int, h binary, d binary, own binary"
#: Rows of a chunk, at most, that 15 bits can number.
ROWS = 30_000


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each hash, by its upper 32 bits."""
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """Positions in the order of partitions, ties as they are."""
    return np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")


def heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length of x at the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def slices(data: np.ndarray, edge: np.ndarray) -> pa.Array:
    """data's bytes cut at edge (rows of data), as binary values; no copy for each of them."""
    width = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pack(h: np.ndarray, part: np.ndarray, doc: np.ndarray, own: np.ndarray, parts: int, bits: type, flag: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each partition. doc: the entries' documents, rows of own, in rising order; own: (documents, k) of 64-bit integers."""
    order = by_part(part, parts)
    h, doc, part = h[order].astype(bits), doc[order], part[order]
    edge = heads(part)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    fresh[edge[:-1]] = True
    place = np.cumsum(fresh)
    first = place[edge[:-1]] - 1
    number = (place - 1 - np.repeat(first, np.diff(edge))).astype(np.uint16)
    if flag is not None:
        number |= flag[order].astype(np.uint16) << 15
    there = own[doc[fresh]].astype(np.int64)
    columns = [pa.array(part[edge[:-1]], pa.int32()), slices(h, edge), slices(number, edge), slices(there, np.append(first, len(there)))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "h", "d", "own"])


def unpack(batches: Iterator[pa.RecordBatch], bits: type, k: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Everything that a task got: hash, partition, the documents' values (entries, k), flag. It is held packed until its size is known."""
    got = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    total = sum(len(d) // 2 for _, _, d, _ in got)
    h, part, own, flag = np.empty(total, bits), np.empty(total, np.int32), np.empty((total, k), np.int64), np.empty(total, bool)
    at = 0
    got.reverse()
    while got:
        p, x, d, values = got.pop()
        d = np.frombuffer(d, np.uint16)
        to = slice(at, at := at + len(d))
        h[to], part[to], flag[to] = np.frombuffer(x, bits), p, d >= 0x8000
        own[to] = np.frombuffer(values, np.int64).reshape(-1, k)[d & 0x7FFF]
    return h, part, own, flag
