from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions.geodesy import SVY21, TransverseMercator
from latticework.sources import arrays, geojson, paged

#: Airy's ellipsoid and the British national grid.
BRITISH = TransverseMercator(49.0, -2.0, 0.9996012717, 400000.0, -100000.0, 6377563.396, 299.3249646)


def degrees(d, m, s):
    return d + m / 60 + s / 3600


def projected(spark, grid, places):
    df = spark.createDataFrame(places, "lat double, lon double")
    x, y = grid.project(F.col("lat"), F.col("lon"))
    df = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = grid.locate(F.col("x"), F.col("y"))
    return df.select("*", lat.alias("lat2"), lon.alias("lon2")).collect()


def test_the_published_example_of_the_british_grid(spark):
    """The national survey's worked example, in both directions."""
    (r,) = projected(spark, BRITISH, [(degrees(52, 39, 27.2531), degrees(1, 43, 4.5177))])
    assert (r.x, r.y) == (pytest.approx(651409.903, abs=2e-3), pytest.approx(313177.270, abs=2e-3))
    assert (r.lat2, r.lon2) == (pytest.approx(r.lat, abs=1e-9), pytest.approx(r.lon, abs=1e-9))


def test_origin_meridian_and_equator(spark):
    rows = projected(spark, SVY21, [(SVY21.latitude, SVY21.longitude), (0.0, SVY21.longitude), (1.3, 103.6), (1.3, 104.0666666666666)])
    assert (rows[0].x, rows[0].y) == (pytest.approx(28001.642, abs=1e-6), pytest.approx(38744.572, abs=1e-6))
    assert rows[1].y == pytest.approx(38744.572 - 151111.9, abs=20) and rows[1].x == pytest.approx(28001.642, abs=1e-6)
    assert rows[2].x - 28001.642 == pytest.approx(28001.642 - rows[3].x, abs=1e-3) and rows[2].y == pytest.approx(rows[3].y, abs=1e-3)


def test_the_meridian_arc_equals_numerical_integration(spark):
    """Along the central meridian the projection is the ellipsoid's arc."""
    utm = TransverseMercator(0.0, 9.0, 0.9996, 500000.0, 0.0)
    f = 1 / utm.flattening
    e2 = f * (2 - f)
    for r in projected(spark, utm, [(k, 9.0) for k in (10.0, 48.0, 80.0, -35.0)]):
        t = np.linspace(0, np.radians(r.lat), 200_001)
        arc = np.trapezoid(utm.radius * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5, t)
        assert r.y == pytest.approx(0.9996 * arc, abs=1e-3) and r.x == pytest.approx(500000, abs=1e-6)


def test_there_and_back_far_from_the_meridian_and_missing_places(spark):
    rng = np.random.default_rng(1)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-80, 80, 40), rng.uniform(-5, 23, 40), strict=True)]
    for r in projected(spark, TransverseMercator(0.0, 9.0, 0.9996, 500000.0, 0.0), places):
        assert (r.lat2, r.lon2) == (pytest.approx(r.lat, abs=1e-8), pytest.approx(r.lon, abs=1e-8))
    (r,) = projected(spark, SVY21, [(None, 103.8)])
    assert r.x is None and r.lat2 is None


def test_geojson_of_all_kinds_there_and_back(spark, tmp_path):
    p = lambda *xs: [{"x": float(x), "y": float(x) / 2} for x in xs]
    rows = [("Point", [p(1)], '{"a": 1}'), ("MultiPoint", [p(1, 2)], "{}"), ("LineString", [p(1, 2, 3)], None), ("MultiLineString", [p(1, 2), p(3, 4)], "{}"), ("Polygon", [p(1, 2, 3, 1), p(4, 5, 6, 4)], '{"n": "é"}'), ("MultiPolygon", [p(1, 2, 3, 1), p(7, 8, 9, 7)], "{}"), (None, None, '{"b": null}')]
    df = spark.createDataFrame(rows, "kind string, rings array<array<struct<x:double,y:double>>>, properties string")
    for zipped in (False, True):
        path = f"file://{tmp_path}/{zipped}"
        geojson.write_geojson(df.repartition(3), path, zipped)
        got = {(r.kind, json.dumps(r.rings and [[(q.x, q.y) for q in part] for part in r.rings]), json.dumps(json.loads(r.properties))) for r in geojson.read_geojson(spark, path).collect()}
        assert got == {(k, json.dumps(v and [[(q["x"], q["y"]) for q in part] for part in v]), json.dumps(json.loads(q or "{}"))) for k, v, q in rows}


def test_stored_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "STORED", 500)
    path = f"file://{tmp_path}/pages"
    paged.write_pages(spark.range(1234).select("id", F.concat(F.lit("n"), "id").alias("name")), ["id"], path)
    assert paged.stored_total(path) == 1234
    assert [r["id"] for r in paged.stored_page(490, 20, path)] == list(range(490, 510))
    assert [r["id"] for r in paged.stored_page(1230, 700, path)] == list(range(1230, 1234)) and paged.stored_page(5000, 10, path) == []
    spark.dataSource.register(paged.PagedDataSource)
    name = "latticework.sources.paged:stored_"
    for extra in ({}, {"total": f"{name}total"}):
        df = spark.read.format("paged").schema("id long, name string").options(fetch=f"{name}page", source=path, limit=300, **extra).load()
        assert df.rdd.getNumPartitions() == (5 if extra else 1) and sorted(r.id for r in df.collect()) == list(range(1234))


def test_parameters_as_a_table(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    m, v = np.arange(6.0).reshape(2, 3), np.array([7.0, 8.0])
    arrays.write_parameters(spark, {"m": m, "v": v}, path)
    got = {(r.name, r.row, r.col): r.value for r in arrays.parameter_table(spark, path).collect()}
    assert got == {("m", i, j): m[i, j] for i in range(2) for j in range(3)} | {("v", 0, j): v[j] for j in range(2)}
    assert {k: x.tolist() for k, x in arrays.read_parameters(spark, path).items()} == {"m": m.tolist(), "v": v.tolist()}
