"""One-band GeoTIFF rasters as rows (row, col, value) by a Python data source: uncompressed, deflate or LZW strips and tiles, 8 to 64-bit numbers.

Each strip or tile is a unit of reading, so a partition takes a run of them; no-data pixels (and NaN) are null. write_tiff() makes a file of 8-bit LZW strips, which tasks compress.
Files may be in any store that pyarrow's file systems open.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from latticework.storage import written

from .files import created, opened

_SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 11: ("f", 4), 16: ("Q", 8)}


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's tags. data: the whole file, or enough of it."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in _SIZES:
            code, size = _SIZES[kind]
            where = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            out[tag] = (data[where : where + count],) if kind == 2 else struct.unpack_from(f"{order}{count}{code}", data, where)
    return order, out


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, table, width, bits, have, before = bytearray(), {}, 9, 0, 0, None
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            table, width, before = {}, 9, None
            continue
        if code == 257:
            break
        entry = bytes([code]) if code < 256 else table.get(code) or before + before[:1]
        out += entry
        if before is not None:
            table[258 + len(table)] = before + entry[:1]
        before = entry
        width = 9 if len(table) < 253 else 10 if len(table) < 765 else 11 if len(table) < 1789 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The reverse of unpack_lzw; the table starts anew before codes would need 13 bits."""
    bits = have = 0
    out, table, width = bytearray(), {}, 9

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 0xFF)
            bits &= (1 << have) - 1

    put(256)
    known = b""
    code_of = lambda s: s[0] if len(s) == 1 else table[s]
    for k in range(len(data)):
        longer = known + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            known = longer
            continue
        put(code_of(known))
        table[longer] = 258 + len(table)
        width = 9 if len(table) < 254 else 10 if len(table) < 766 else 11 if len(table) < 1790 else 12
        if len(table) >= 3800:
            put(256)
            table, width = {}, 9
        known = data[k : k + 1]
    if known:
        put(code_of(known))
        n = len(table) + 1
        width = 9 if n < 254 else 10 if n < 766 else 11 if n < 1790 else 12
    put(257)
    if have:
        out.append(bits << (8 - have) & 0xFF)
    return bytes(out)


def write_tiff(pixels: DataFrame, path: str, width: int, height: int, *, rows: int = 64, x0: float | None = None, y0: float | None = None, size: float = 1.0) -> None:
    """One 8-bit band of pixels (row, col, value; 0 where there is none), in strips of `rows` rows. Tasks make the strips; the driver lays them side by side, one at a time.
    With x0 and y0 (the upper left corner) and the size of a pixel the file is placed on a map.
    """

    def strip(t: pa.Table) -> pa.Table:
        k = t.column("strip")[0].as_py()
        grid = np.zeros((min(rows, height - k * rows), width), np.uint8)
        grid[t.column("row").to_numpy() - k * rows, t.column("col").to_numpy()] = t.column("value").to_numpy()
        return pa.table({"strip": pa.array([k], pa.int64()), "data": pa.array([pack_lzw(grid.tobytes())], pa.binary())})

    inside = pixels.where(f"value IS NOT NULL AND row >= 0 AND row < {height} AND col >= 0 AND col < {width}").select(F.floor(F.col("row") / rows).alias("strip"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("long").alias("value"))
    made = written(inside.groupBy("strip").applyInArrow(strip, "strip long, data binary"), "strips")
    have = {r.strip: r.n for r in made.select("strip", F.octet_length("data").alias("n")).collect()}
    count = -(-height // rows)
    empty = {n: pack_lzw(bytes(width * n)) for n in {min(rows, height - k * rows) for k in range(count)}}
    blank = lambda k: empty[min(rows, height - k * rows)]
    sizes = [have.get(k) or len(blank(k)) for k in range(count)]
    offsets = np.cumsum([8, *sizes])
    end = int(offsets[-1]) + int(offsets[-1]) % 2
    tags_ = [(256, "I", [width]), (257, "I", [height]), (258, "H", [8]), (259, "H", [5]), (262, "H", [1]), (273, "I", offsets[:-1].tolist()), (277, "H", [1]), (278, "I", [rows]), (279, "I", sizes), (339, "H", [1])]
    if x0 is not None and y0 is not None:
        tags_ += [(33550, "d", [size, size, 0.0]), (33922, "d", [0.0, 0.0, 0.0, x0, y0, 0.0])]
    directory, rest, at = struct.pack("<H", len(tags_)), b"", end + 2 + 12 * len(tags_) + 4
    for tag, kind, values in tags_:
        raw = struct.pack(f"<{len(values)}{kind}", *values)
        directory += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12}[kind], len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(rest)))
        rest += raw if len(raw) > 4 else b""
    with created(path) as f:
        f.write(b"II*\0" + struct.pack("<I", end))
        following = ((r.strip, bytes(r.data)) for r in made.orderBy("strip").toLocalIterator())
        here = next(following, None)
        for k in range(count):
            if here and here[0] == k:
                f.write(here[1])
                here = next(following, None)
            else:
                f.write(blank(k))
        f.write(b"\0" * (end - int(offsets[-1])) + directory + struct.pack("<I", 0) + rest)


class Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class TiffReader(DataSourceReader):
    def __init__(self, path: str, blocks: int):
        self.path, self.blocks = path, blocks

    def _head(self):
        with opened(self.path) as f:
            data = f.read()
        return data, *tags(data)

    def partitions(self):
        _, _, t = self._head()
        n = len(t.get(273) or t[324])
        return [Blocks(i, min(n, i + self.blocks)) for i in range(0, n, self.blocks)]

    def read(self, p: Blocks) -> Iterator[pa.RecordBatch]:
        data, order, t = self._head()
        width, height = t[256][0], t[257][0]
        kind = {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]]
        dtype = np.dtype(f"{order}{kind}{t[258][0] // 8}")
        tiled = 324 in t
        offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
        bw, bh = (t[322][0], t[323][0]) if tiled else (width, t.get(278, (height,))[0])
        across = -(-width // bw)
        missing = float(t[42113][0].rstrip(b"\0 ")) if 42113 in t else None
        for k in range(p.first, p.last):
            raw = data[offsets[k] : offsets[k] + sizes[k]]
            raw = {1: lambda b: b, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}[t.get(259, (1,))[0]](raw)
            r0, c0 = k // across * bh, k % across * bw
            grid = np.frombuffer(raw, dtype, len(raw) // dtype.itemsize)
            grid = grid[: len(grid) // bw * bw].reshape(-1, bw)
            if t.get(317, (1,))[0] == 2:
                grid = np.cumsum(grid, axis=1, dtype=grid.dtype)
            rows, cols = np.mgrid[r0 : r0 + len(grid), c0 : c0 + bw]
            inside = (rows < height) & (cols < width)
            value = grid.astype(float)[inside]
            gone = np.isnan(value) | (value == missing if missing is not None else False)
            yield pa.RecordBatch.from_arrays([pa.array(rows[inside].astype(np.int64)), pa.array(cols[inside].astype(np.int64)), pa.array(value, mask=gone)], names=["row", "col", "value"])


class TiffDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema):
        return TiffReader(self.options["path"], int(self.options.get("blocks", 64)))
