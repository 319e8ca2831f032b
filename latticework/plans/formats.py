"""Tables written in a format and read back from it; the folder is the one that driver and executors share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from latticework.functions.geodesy import SVY21
from latticework.operators import stats
from latticework.sources import arrays, geojson, paged, tables
from latticework.sources.shapefile import ShapefileDataSource
from latticework.sources.tiff import TiffDataSource, write_tiff
from latticework.storage import shared_dir

from .aggregates import _K, _NUM, numeric
from .graphs import pixels
from .network import _CELL_NUM
from .registry import GRID_SQL, cells, grid, query, rounded, table


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {GRID_SQL} SELECT id, kind, round(bal, 2) AS bal FROM grid")
def csv_round_trip(spark, sf):
    path = _path(spark, "csv")
    tables.write_csv(grid(spark, sf).select("id", "kind", "bal"), path)
    return rounded(tables.read_csv(spark, path, "id long, kind string, bal double"), 2)


_CELLS = " UNION ALL ".join(f"SELECT '{a}' AS feature, " + ", ".join(f"round({'max(1.0)' if a == b else f'corr({min(a, b)}, {max(a, b)})'}, 6) + 0.0 AS {b}" for b in _NUM) + " FROM k" for a in _NUM)


@query(f"{_K} {_CELLS}")
def matrix_csv(spark, sf):
    """A correlation matrix as CSV, its rows named in the first column."""
    path = _path(spark, "matrix")
    tables.write_csv(tables.matrix(stats.correlation_pairs(numeric(spark, sf), _NUM), _NUM), path, one_file=True)
    return rounded(tables.read_csv(spark, path, "feature string, " + ", ".join(f"`{c}` double" for c in _NUM)), 6)


@query(f"WITH {GRID_SQL} SELECT id, round(bal, 2) AS bal, kind, CAST(5 AS INT) AS corners, round(x, 2) AS x, round(y, 2) AS y FROM grid")
def shapefile_round_trip(spark, sf):
    """Cells as squares with attributes; the centre is worked out from the ring that is read."""
    spark.dataSource.register(ShapefileDataSource)
    path = _path(spark, "shapes")
    x, y = F.col("x"), F.col("y")
    corner = lambda i, j: F.struct((x + 100.0 * i).alias("x"), (y + 100.0 * j).alias("y"))
    ring = F.array(*(corner(i, j) for i, j in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))))
    cells = grid(spark, sf).select("id", "bal", "kind", F.struct(F.lit("polygon").alias("kind"), F.array(ring).alias("rings")).alias("geometry"))
    cells.write.format("shapefile").mode("append").save(path)
    back = spark.read.format("shapefile").load(path)
    mid = lambda c: ((F.array_min(F.transform("ring", lambda p: p[c])) + F.array_max(F.transform("ring", lambda p: p[c]))) / 2).alias(c)
    return rounded(back.withColumn("ring", F.col("geometry.rings")[0]).select("id", "bal", "kind", F.size("ring").alias("corners"), mid("x"), mid("y")), 2)


@query("SELECT p_partkey // 45 AS row, p_partkey % 45 AS col, CAST(p_size % 5 AS DOUBLE) AS value FROM part")
def tiff_round_trip(spark, sf):
    spark.dataSource.register(TiffDataSource)
    path = _path(spark, "raster") + ".tif"
    px = pixels(spark, sf)
    write_tiff(px, path, 45, px.agg(F.max("row")).first()[0] + 1, rows=16)
    return spark.read.format("tiff").load(path).join(px.select("row", "col"), ["row", "col"], "left_semi").select("row", "col", "value")


@query(f"""{_CELL_NUM}, l AS (SELECT y1 - p1 * m1 - p2 * m2 AS p0, p1, p2, y2 - q1 * m1 - q2 * m2 AS q0, q1, q2 FROM w)
SELECT id, round(p0 + p1 * f1 + p2 * f2, 4) + 0.0 AS t1, round(q0 + q1 * f1 + q2 * f2, 4) + 0.0 AS t2 FROM (SELECT id, spend / 1000000 AS f1, n_orders / 10.0 AS f2 FROM cells WHERE spend IS NOT NULL), l""")
def parameters_round_trip(spark, sf):
    """Lines fitted to the cells' orders, stored as parameters, read back and applied as a join."""
    path = _path(spark, "parameters")
    c = cells(spark, sf).select("id", (F.col("spend") / 1000000).alias("f1"), (F.col("n_orders") / 10.0).alias("f2"), (F.col("bal") / 1000).alias("t1"), (F.col("qty") / 10).alias("t2"))
    known = c.where("f1 IS NOT NULL AND t2 IS NOT NULL")
    arrays.write_parameters(spark, {t: np.asarray(stats.least_squares(known, ["f1", "f2"], t)) for t in ("t1", "t2")}, path)
    terms = c.where("f1 IS NOT NULL").select("id", F.posexplode(F.array(F.lit(1.0), "f1", "f2")).alias("col", "x"))
    fitted = terms.join(F.broadcast(arrays.parameter_table(spark, path)), "col").groupBy("id").pivot("name", ["t1", "t2"]).agg(F.sum(F.col("x") * F.col("value")))
    return rounded(fitted)


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def paged_source(spark, sf):
    """Orders stored as pages of JSON records, and read from these by offset, a page for each task."""
    spark.dataSource.register(paged.PagedDataSource)
    path = _path(spark, "pages")
    paged.write_pages(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"], path)
    name = "latticework.sources.paged:stored_"
    read = spark.read.format("paged").schema("o_orderkey long, o_orderstatus string, o_totalprice double").options(fetch=f"{name}page", total=f"{name}total", source=path, limit=2000)
    return rounded(read.load(), 2)


@query(f"WITH {GRID_SQL} SELECT id, kind, CAST(5 AS INT) AS corners, round(x, 2) AS x, round(y, 2) AS y, round(bal, 2) AS bal FROM grid")
def geojson_round_trip(spark, sf):
    """Cells as zipped feature collections of squares with properties; the centre is worked out from the ring that is read."""
    path = _path(spark, "geojson")
    corner = lambda i, j: F.struct((F.col("x") + 100.0 * i).alias("x"), (F.col("y") + 100.0 * j).alias("y"))
    ring = F.array(*(corner(i, j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    geojson.write_geojson(grid(spark, sf).select(F.lit("Polygon").alias("kind"), F.array(ring).alias("rings"), F.to_json(F.struct("id", "kind", "bal")).alias("properties")), path, zipped=True)
    back = geojson.read_geojson(spark, path).withColumn("p", F.from_json("properties", "id long, kind string, bal double")).withColumn("ring", F.col("rings")[0])
    mid = lambda c: ((F.array_min(F.transform("ring", lambda p: p[c])) + F.array_max(F.transform("ring", lambda p: p[c]))) / 2).alias(c)
    return rounded(back.select("p.id", "p.kind", F.size("ring").alias("corners"), mid("x"), mid("y"), "p.bal"), 2)


def _projection_sql() -> str:
    """The same series, written out for a table p(id, lat, lon)."""
    t = SVY21
    e = 2 * np.sqrt(t._n) / (1 + t._n)
    many = lambda cs, f, g, a, b: " + ".join(f"({float(c)!r}) * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, c in enumerate(cs, 1))
    return f"""q AS (SELECT id, lat, lon, sinh(atanh(sin(radians(lat))) - {float(e)!r} * atanh({float(e)!r} * sin(radians(lat)))) AS t, radians(lon - {t.longitude!r}) AS l FROM p),
r AS (SELECT id, lat, lon, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM q),
s AS (SELECT id, lat, lon, {t.east!r} + {t._unit!r} * (eta + {many(t._forward, 'cos', 'sinh', 'xi', 'eta')}) AS x, {t.north!r} + {t._unit!r} * (xi + {many(t._forward, 'sin', 'cosh', 'xi', 'eta')} - {t._origin!r}) AS y FROM r)"""


@query(f"WITH {GRID_SQL}, p AS (SELECT id, 1.2 + cy / 2000.0 + bal / 12345678.9 AS lat, 103.6 + cx / 100.0 AS lon FROM grid), {_projection_sql()} SELECT id, round(x, 3) AS x, round(y, 3) AS y, CAST(floor(x / 200) AS BIGINT) AS cell_x, CAST(floor(y / 200) AS BIGINT) AS cell_y, round(lat, 7) AS lat, round(lon, 7) AS lon FROM s")
def reprojected_places(spark, sf):
    """Places in degrees brought to metres of a national grid, the 200 m square that each falls in, and degrees worked out from the metres again."""
    places = grid(spark, sf).select("id", (1.2 + F.col("cy") / 2000.0 + F.col("bal") / 12345678.9).alias("lat"), (103.6 + F.col("cx") / 100.0).alias("lon"))
    x, y = SVY21.project(F.col("lat"), F.col("lon"))
    metres = places.select("id", x.alias("x"), y.alias("y"))
    lat, lon = SVY21.locate(F.col("x"), F.col("y"))
    square = lambda c: F.floor(F.col(c) / 200).cast("long").alias(f"cell_{c}")
    return metres.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), square("x"), square("y"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("SELECT l_orderkey AS project, l_partkey AS part, round(l_extendedprice, 2) AS price FROM lineitem UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def nested_transactions(spark, sf):
    """Projects as JSON documents with an array of transactions, flattened to a row for each; projects without any stay."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("project")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.round("l_extendedprice", 2).alias("price"))).alias("transaction"))
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("project")).join(li, "project", "full").select(F.to_json(F.struct("project", "transaction")).alias("doc"))
    nested = docs.select(F.from_json("doc", "project long, transaction array<struct<part:long,price:double>>").alias("d")).select("d.*")
    return tables.flatten(nested, "transaction")


@query("SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) + 0.0 AS total FROM embeddings")
def npy_round_trip(spark, sf):
    """Vectors as .npy files, an id before each."""
    path = _path(spark, "npy")
    v = table(spark, sf, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("v"))
    arrays.write_npy(v, "v", path)
    back = arrays.read_npy(spark, path)
    total = F.aggregate(F.slice("values", F.lit(2), F.size("values") - 1), F.lit(0.0), lambda a, x: a + x)
    return rounded(back.select(F.col("values")[0].cast("long").alias("id"), total.alias("total")))


@query("SELECT p_partkey, p_brand FROM part")
def cached_source(spark, sf):
    """A table that is made once and then read from its cache."""
    path = _path(spark, "cache")
    make = lambda: table(spark, sf, "part").select("p_partkey", "p_brand")
    tables.cached(spark, path, make, least=100)
    return tables.cached(spark, path, lambda: make().limit(0), least=100)
