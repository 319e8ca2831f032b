from __future__ import annotations

import json
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from latticework.operators import stats
from latticework.sources import arrays, tables
from latticework.sources.geojson import read_geojson
from latticework.sources.paged import PagedDataSource
from latticework.sources.shapefile import GEOMETRY, ShapefileDataSource
from latticework.sources.tiff import TiffDataSource, pack_lzw, unpack_lzw, write_tiff
from latticework.streaming import windows


def pages(offset, limit):
    return [{"id": k, "name": f"n{k}"} for k in range(offset, min(25, offset + limit))]


def total():
    return 25


def test_shapefile_round_trip(spark, tmp_path):
    spark.dataSource.register(ShapefileDataSource)
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [(1, 2.5, "a", ("polygon", [ring, ring])), (2, None, None, ("polygon", [ring])), (3, -1.25, "é", None)]
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", LongType()), StructField("v", DoubleType()), StructField("name", StringType()), StructField("geometry", GEOMETRY)])
    spark.createDataFrame(rows, schema).coalesce(1).write.format("shapefile").mode("append").save(str(tmp_path / "x.shp"))
    for n in (100, 2):
        got = spark.read.format("shapefile").option("records", n).load(str(tmp_path / "x-00000.shp")).orderBy("id").collect()
        assert [(r.id, r.v, r.name) for r in got] == [r[:3] for r in rows]
        assert [tuple(p) for p in got[0].geometry.rings[1]] == ring and len(got[0].geometry.rings) == 2 and got[2].geometry is None


def tiff(path, grid, compress, nodata):
    raw = grid.tobytes()
    body = zlib.compress(raw) if compress == 8 else raw
    tag = [(256, 3, grid.shape[1]), (257, 3, grid.shape[0]), (258, 3, 32), (259, 3, compress), (273, 4, 8), (277, 3, 1), (278, 3, grid.shape[0]), (279, 4, len(body)), (339, 3, 3)]
    directory = struct.pack("<H", len(tag) + 1) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tag) + struct.pack("<HHI4s", 42113, 2, 3, nodata)
    path.write_bytes(b"II*\0" + struct.pack("<I", 8 + len(body)) + body + directory + struct.pack("<I", 0))


def test_tiff(spark, tmp_path):
    spark.dataSource.register(TiffDataSource)
    grid = np.arange(12, dtype="<f4").reshape(3, 4)
    grid[0, 0], grid[2, 3] = np.nan, -9
    for compress in (1, 8):
        tiff(tmp_path / "x.tif", grid, compress, b"-9\0\0")
        got = {(r.row, r.col): r.value for r in spark.read.format("tiff").load(str(tmp_path / "x.tif")).collect()}
        assert got == {(r, c): None if (r, c) in ((0, 0), (2, 3)) else float(grid[r, c]) for r in range(3) for c in range(4)}


def test_lzw():
    codes = [256, 7, 258, 8, 8, 258, 6, 257]  # 7, 7 7, 8, 8, 7 7, 6
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert unpack_lzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6])


def test_lzw_of_long_data():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", bytes(5000), rng.integers(0, 4, 60_000, np.uint8).tobytes(), rng.integers(0, 256, 30_000, np.uint8).tobytes(), b"abcabcab" * 3000):
        for cut in {len(data), len(data) // 2, min(254, len(data)), min(255, len(data)), min(256, len(data))}:
            assert unpack_lzw(pack_lzw(data[:cut])) == data[:cut]


def test_tiff_written(spark, tmp_path):
    spark.dataSource.register(TiffDataSource)
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 6, (70, 33))
    grid[20:40] = 0  # strips without pixels
    px = spark.createDataFrame([(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(grid) if v], "row long, col long, value long")
    write_tiff(px, f"file://{tmp_path}/x.tif", 33, 70, rows=8, x0=1.0, y0=2.0, size=10.0)
    got = np.zeros((70, 33), int)
    for r in spark.read.format("tiff").option("blocks", 3).load(f"file://{tmp_path}/x.tif").collect():
        got[r.row, r.col] = r.value
    assert (got == grid).all()


def test_geojson(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [{"type": "Feature", "properties": {"name": "é", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [square, square]}}, {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [2, 3]}}, {"type": "Feature", "properties": {}, "geometry": None}]
    text = json.dumps({"type": "FeatureCollection", "features": features})
    (tmp_path / "a.geojson").write_text(text)
    with zipfile.ZipFile(tmp_path / "b.bin", "w") as z:
        z.writestr("x/y.geojson", text)
        z.writestr("readme.txt", "no")
    for name in ("a.geojson", "b.bin"):
        rows = read_geojson(spark, str(tmp_path / name)).orderBy("feature").collect()
        assert [(r.kind, r.rings and [len(x) for x in r.rings]) for r in rows] == [("Polygon", [4, 4]), ("MultiPolygon", [4, 4]), ("Point", [1]), (None, None)]
        assert tuple(rows[2].rings[0][0]) == (2.0, 3.0) and json.loads(rows[0].properties)["name"] == "é"


def test_arrays(spark, tmp_path):
    a = np.arange(30, dtype="f4").reshape(10, 3)
    np.save(tmp_path / "a.npy", a)
    rows = arrays.read_npy(spark, str(tmp_path / "a.npy")).orderBy("row").collect()
    assert np.array_equal(np.array([r.values for r in rows]), a)
    arrays.write_parameters(spark, {"w": a, "b": np.array([1.5]), "s": np.array(2.0)}, str(tmp_path / "p"))
    back = arrays.read_parameters(spark, str(tmp_path / "p"))
    assert np.array_equal(back["w"], a) and back["b"].tolist() == [1.5] and back["s"] == 2.0


def test_paged(spark):
    spark.dataSource.register(PagedDataSource)
    for extra in ({}, {"total": f"{__name__}:total"}):
        df = spark.read.format("paged").schema("id long, name string, none string").options(fetch=f"{__name__}:pages", limit=10, **extra).load()
        assert sorted(tuple(r) for r in df.collect()) == [(k, f"n{k}", None) for k in range(25)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(float(k), float(k * k % 7), float(-k)) for k in range(20)], "a double, b double, c double")
    m = {r.feature: r for r in tables.matrix(stats.correlation_pairs(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    assert m["a"].a == 1.0 and abs(m["c"].a + 1) < 1e-12 and m["a"].b == m["b"].a
    made = []
    make = lambda: made.append(1) or spark.range(5)
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "t"), make, least=3).count() == 5
    assert len(made) == 1
    tables.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert tables.read_csv(spark, str(tmp_path / "c"), "a double, b double, c double").count() == 20
    nested = spark.createDataFrame([("p", [(1, "x"), (2, "y")]), ("q", [])], "project string, t array<struct<price:long,kind:string>>")
    assert sorted(map(tuple, tables.flatten(nested, "t").collect()), key=repr) == sorted([("p", 1, "x"), ("p", 2, "y"), ("q", None, None)], key=repr)


def test_stream_equals_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").limit(500)
    table.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling_counts(windows.read_events(spark, str(tmp_path / "in"), table.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = windows.tumbling_counts(spark.read.parquet(str(tmp_path / "in")))
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("counts")) == key(want)
    assert windows.sessions(table).agg(F.sum("n")).first()[0] == table.count()
    assert windows.sliding_mean(table).count() > 0
