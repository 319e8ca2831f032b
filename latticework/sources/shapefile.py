"""Shapefiles (points and polygons with their DBF attributes) as a Python data source, read and write.

    spark.dataSource.register(ShapefileDataSource)
    spark.read.format("shapefile").option("schema_from", path).load(path)

Columns are the DBF's fields (numbers as doubles or longs, the rest as strings) and geometry: struct of kind, rings (array of arrays of (x, y)). path is a .shp file or a folder of some with
the same fields, in any store that pyarrow's file systems open. Reading plans a partition for each run of records, which fixed-length DBF records and the .shx index make possible. Writing makes
one file for each task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .files import created, listed, opened

_POINT, _POLYGON = 1, 5
GEOMETRY = StructType([StructField("kind", StringType()), StructField("rings", ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))))])


def _base(path: str) -> str:
    return path[:-4] if path.lower().endswith(".shp") else path


def dbf_fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, header size, record size, and (name, type, length, decimals) of the fields."""
    with opened(path) as f:
        head = f.read(32)
        n, start, size = struct.unpack("<4xIHH", head[:12])
        fields = []
        while (d := f.read(32)) and d[0] != 0x0D:
            fields.append((d[:11].split(b"\0")[0].decode("latin-1"), chr(d[11]), d[16], d[17]))
    return n, start, size, fields


def _type(kind: str, decimals: int):
    return DoubleType() if kind == "F" or kind == "N" and decimals else LongType() if kind == "N" else StringType()


def _value(raw: bytes, kind: str, decimals: int):
    text = raw.decode("utf-8", "replace").strip().strip("\0")
    if not text or set(text) == {"*"}:
        return None
    return (float(text) if kind == "F" or decimals else int(float(text))) if kind in "NF" else text


def _shape(raw: bytes):
    kind = struct.unpack_from("<i", raw)[0]
    if kind == _POINT:
        return ("point", [[struct.unpack_from("<2d", raw, 4)]])
    if kind == _POLYGON:
        parts, points = struct.unpack_from("<2i", raw, 36)
        first = [*struct.unpack_from(f"<{parts}i", raw, 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", raw, 44 + 4 * parts)
        xy = list(zip(flat[::2], flat[1::2], strict=True))
        return ("polygon", [xy[a:b] for a, b in zip(first, first[1:], strict=False)])
    if kind == 0:
        return None
    raise ValueError(f"shape type {kind} isn't supported")


class Records(InputPartition):
    def __init__(self, base: str, first: int, last: int):
        self.base, self.first, self.last = base, first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.bases, self.rows = [_base(f) for f in listed(path, ".shp")], rows

    def partitions(self):
        size = {b: dbf_fields(b + ".dbf")[0] for b in self.bases}
        return [Records(b, i, min(n, i + self.rows)) for b, n in size.items() for i in range(0, n, self.rows)] or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        count, base = partition.last - partition.first, partition.base
        if not count:
            return
        _, start, size, fields = dbf_fields(base + ".dbf")
        with opened(base + ".dbf") as d, opened(base + ".shx") as x, opened(base + ".shp") as s:
            d.seek(start + partition.first * size)
            x.seek(100 + 8 * partition.first)
            index = struct.unpack(f">{2 * count}i", x.read(8 * count))
            for k in range(count):
                raw = d.read(size)
                s.seek(2 * index[2 * k] + 8)
                geometry = _shape(s.read(2 * index[2 * k + 1]))
                if raw[:1] == b"*":  # deleted
                    continue
                values, at = [], 1
                for _, kind, length, decimals in fields:
                    values.append(_value(raw[at : at + length], kind, decimals))
                    at += length
                yield (*values, geometry)


class Done(WriterCommitMessage):
    pass


class ShapefileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        self.base, self.fields = path.rstrip("/") + "/part" if _base(path) == path else _base(path), [f for f in schema.fields if f.name != "geometry"]
        self.at = schema.fieldNames().index("geometry")

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        rows = list(rows)
        base = f"{self.base}-{TaskContext.get().partitionId():05d}"
        shapes, records = [], []
        kinds = [("N", 20, 8) if isinstance(f.dataType, DoubleType) else ("N", 18, 0) if isinstance(f.dataType, LongType) else ("C", 80, 0) for f in self.fields]
        for r in rows:
            g = r[self.at]
            rings = [[(p[0], p[1]) for p in ring] for ring in g[1]] if g else []
            flat = [c for ring in rings for p in ring for c in p]
            if not g:
                shapes.append(struct.pack("<i", 0))
            elif g[0] == "point":
                shapes.append(struct.pack("<i2d", _POINT, *flat))
            else:
                xs, ys = flat[::2], flat[1::2]
                first = [sum(map(len, rings[:k])) for k in range(len(rings))]
                shapes.append(struct.pack(f"<i4d2i{len(rings)}i{len(flat)}d", _POLYGON, min(xs), min(ys), max(xs), max(ys), len(rings), len(xs), *first, *flat))
            out = b" "
            for f, (k, n, dec) in zip(self.fields, kinds, strict=True):
                v = r[f.name]
                text = "" if v is None else f"{v:.{dec}f}" if k == "N" else str(v)
                raw = text.encode()[:n]
                out += raw.rjust(n) if k == "N" else raw.ljust(n)
            records.append(out)
        size = 1 + sum(n for _, n, _ in kinds)
        kind = _POINT if any(r[self.at] and r[self.at][0] == "point" for r in rows) else _POLYGON
        header = lambda length: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
        with created(base + ".shp") as s, created(base + ".shx") as x, created(base + ".dbf") as d:
            s.write(header(100 + sum(8 + len(b) for b in shapes)))
            x.write(header(100 + 8 * len(shapes)))
            at = 100
            for k, b in enumerate(shapes):
                s.write(struct.pack(">2i", k + 1, len(b) // 2) + b)
                x.write(struct.pack(">2i", at // 2, len(b) // 2))
                at += 8 + len(b)
            d.write(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(records), 33 + 32 * len(kinds), size))
            for f, (k, n, dec) in zip(self.fields, kinds, strict=True):
                d.write(f.name.encode()[:10].ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([n, dec]) + b"\0" * 14)
            d.write(b"\r" + b"".join(records) + b"\x1a")
        return Done()


class ShapefileDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        fields = dbf_fields(_base(listed(self.options["path"], ".shp")[0]) + ".dbf")[3]
        return StructType([*(StructField(n, _type(k, d)) for n, k, _, d in fields), StructField("geometry", GEOMETRY)])

    def reader(self, schema):
        return ShapefileReader(self.options["path"], int(self.options.get("records", 100_000)))

    def writer(self, schema, overwrite: bool):
        return ShapefileWriter(self.options["path"], schema)
