"""GeoJSON feature collections, plain or in a zip archive (told by its first bytes), as rows."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def documents(content: bytes) -> list[dict]:
    if content[:4] != b"PK\x03\x04":
        return [json.loads(content)]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [json.loads(z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith((".geojson", ".json"))]


def rings(geometry: dict | None) -> list[list[dict]] | None:
    """A geometry's points, lines or rings as lists of points, whatever its kind; holes follow their outer ring."""
    if not geometry:
        return None
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}[geometry["type"]]
    at = geometry["coordinates"]
    for _ in range(depth, 2):
        at = [at]
    parts = at if depth < 3 else [r for polygon in at for r in polygon]
    return [[{"x": float(p[0]), "y": float(p[1])} for p in part] for part in parts]


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """file, feature (its number), kind, rings, properties (a JSON string, for from_json). A file is read by one task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [f for d in documents(content) for f in (d["features"] if d.get("type") == "FeatureCollection" else [d])]
                geometry = [f.get("geometry") for f in found]
                columns = [pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([g and g["type"] for g in geometry], pa.string()), pa.array(map(rings, geometry), _RINGS), pa.array([json.dumps(f.get("properties") or {}) for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "feature", "kind", "rings", "properties"])

    schema = "file string, feature long, kind string, rings array<array<struct<x:double,y:double>>>, properties string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def write_geojson(df: DataFrame, path: str, zipped: bool = False) -> None:
    """df (kind, rings, properties: as read_geojson gives them) as feature collections in a folder, plain or each in a zip archive. A task writes a file for each batch, under its number, so
    that a repeated task writes the same files again.
    """
    from .files import created

    def feature(kind: str | None, parts: list | None, properties: str | None) -> dict:
        at = [[[p["x"], p["y"]] for p in part] for part in parts or []]
        shape = {"Point": lambda: at[0][0], "MultiPoint": lambda: at[0], "LineString": lambda: at[0], "MultiLineString": lambda: at, "Polygon": lambda: at, "MultiPolygon": lambda: [[r] for r in at]}
        return {"type": "Feature", "geometry": kind and {"type": kind, "coordinates": shape[kind]()}, "properties": json.loads(properties or "{}")}

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            text = json.dumps({"type": "FeatureCollection", "features": [feature(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]}).encode()
            name = f"part-{part:05d}-{k:05d}"
            with created(f"{path}/{name}{'.zip' if zipped else '.geojson'}") as f:
                if zipped:
                    out = io.BytesIO()
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr(zipfile.ZipInfo(f"{name}.geojson"), text, zipfile.ZIP_DEFLATED)
                    text = out.getvalue()
                f.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    df.select("kind", "rings", "properties").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
