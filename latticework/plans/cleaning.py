"""Cleaning and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import expr as E
from latticework.operators import clean

from .registry import CELLS_SQL, GRID_SQL, cells, grid, query, rounded, table

_HOLES = "SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE bal END AS bal, CASE WHEN id % 5 = 0 THEN NULL ELSE spend END AS spend FROM cells"


def holes(spark, sf):
    """Cells with missing values in two indicators."""
    return cells(spark, sf).select("id", F.when(F.col("id") % 7 != 0, F.col("bal")).alias("bal"), F.when(F.col("id") % 5 != 0, F.col("spend")).alias("spend"))


def _zeros(spark, sf):
    i = F.col("id")
    return grid(spark, sf).select("id", (i % 5).cast("double").alias("u"), F.when(i % 7 != 0, (i % 3).cast("double")).alias("v"))


_ZEROS = f"WITH {GRID_SQL}, z AS (SELECT id, CAST(id % 5 AS DOUBLE) AS u, CASE WHEN id % 7 <> 0 THEN CAST(id % 3 AS DOUBLE) END AS v FROM grid)"


@query(f"{_ZEROS} SELECT * FROM z WHERE NOT (coalesce(u = 0, false) OR coalesce(v = 0, false))")
def zero_filter_negated(spark, sf):
    return clean.drop_zero_rows(_zeros(spark, sf), ["u", "v"])


@query(f"{_ZEROS} SELECT count(*) AS n, CAST(sum(CASE WHEN coalesce(u = 0, false) OR coalesce(v = 0, false) THEN 1 ELSE 0 END) AS BIGINT) AS excluded FROM z")
def excluded_count(spark, sf):
    return _zeros(spark, sf).agg(F.count("*").alias("n"), F.sum(E.any_zero(F.col("u"), F.col("v")).cast("long")).alias("excluded"))


@query("SELECT p_partkey AS id, p_size AS size, p_brand AS brand FROM part")
def rename_project(spark, sf):
    df = clean.rename_known(table(spark, sf, "part"), {"p_partkey": "id", "p_size": "size", "p_brand": "brand", "absent": "x"})
    return clean.select_available(df, ["id", "size", "brand", "missing"])


@query(f"WITH {CELLS_SQL}, h AS ({_HOLES}) SELECT id, round(coalesce(bal, (SELECT avg(bal) FROM h)), 4) + 0.0 AS bal, round(coalesce(spend, (SELECT avg(spend) FROM h)), 3) AS spend FROM h")
def mean_impute(spark, sf):
    df = clean.impute_mean(holes(spark, sf), ["bal", "spend"])
    return df.select("id", (F.round("bal", 4) + F.lit(0.0)).alias("bal"), F.round("spend", 3).alias("spend"))


@query(f"WITH {CELLS_SQL}, h AS ({_HOLES}) SELECT id, round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM h)), 4) + 0.0 AS bal, round(coalesce(spend, (SELECT quantile_cont(spend, 0.5) FROM h)), 3) AS spend FROM h")
def median_impute(spark, sf):
    df = clean.impute_median(holes(spark, sf), ["bal", "spend"])
    return df.select("id", (F.round("bal", 4) + F.lit(0.0)).alias("bal"), F.round("spend", 3).alias("spend"))


@query(f"WITH {CELLS_SQL}, h AS ({_HOLES}) SELECT id, coalesce(bal, 0.0) AS bal, round(coalesce(spend, 0.0), 2) AS spend FROM h")
def zero_impute(spark, sf):
    return holes(spark, sf).fillna(0.0, ["bal", "spend"]).withColumn("spend", F.round("spend", 2))


@query(f"WITH {GRID_SQL}, q AS (SELECT quantile_cont(bal, 0.01) AS a, quantile_cont(bal, 0.99) AS b FROM grid) SELECT id, round(least(greatest(bal, a), b), 4) + 0.0 AS bal FROM grid, q")
def winsor_q01_q99(spark, sf):
    return rounded(clean.winsorise(grid(spark, sf).select("id", "bal"), ["bal"]))


@query(f"WITH {GRID_SQL}, g AS (SELECT id, CASE WHEN id % 50 = 0 THEN bal * 30 ELSE bal END AS bal FROM grid), q AS (SELECT avg(bal) AS m, stddev_samp(bal) AS s FROM g) SELECT id, round(least(greatest(bal, m - 3 * s), m + 3 * s), 4) + 0.0 AS bal FROM g, q")
def winsor_3sigma(spark, sf):
    df = grid(spark, sf).select("id", F.when(F.col("id") % 50 == 0, F.col("bal") * 30).otherwise(F.col("bal")).alias("bal"))
    return rounded(clean.winsorise_sigma(df, ["bal"]))


@query(f"WITH {GRID_SQL}, q AS (SELECT avg(bal) AS m, stddev_pop(bal) AS s FROM grid) SELECT id, round((bal - m) / s, 6) + 0.0 AS z, 0.0 AS flat FROM grid, q")
def zscore_pop(spark, sf):
    df = grid(spark, sf).select("id", F.col("bal").alias("z"), F.lit(5.0).alias("flat"))
    return rounded(clean.zscore(df, ["z", "flat"]), 6)


@query(f"WITH {GRID_SQL}, q AS (SELECT avg(bal) AS m, stddev_samp(bal) AS s FROM grid) SELECT id, round((bal - m) / s, 6) + 0.0 AS z FROM grid, q")
def zscore_samp(spark, sf):
    return rounded(clean.zscore(grid(spark, sf).select("id", F.col("bal").alias("z")), ["z"], sample=True), 6)


@query(f"WITH {GRID_SQL} SELECT id, round(bal, 4) + 0.0 AS back FROM grid")
def inverse_scale(spark, sf):
    """Scaling and its inverse, by the same statistics."""
    wide = clean.with_statistics(grid(spark, sf).select("id", "bal"), ["bal"], {"m": F.avg, "s": F.stddev_pop})
    z = wide.withColumn("z", (F.col("bal") - F.col("bal__m")) / F.col("bal__s"))
    return rounded(z.select("id", (F.col("z") * F.col("bal__s") + F.col("bal__m")).alias("back")))


@query(f"WITH {GRID_SQL}, q AS (SELECT min(bal) AS a, max(bal) AS b FROM grid) SELECT id, round((bal - a) / (b - a), 6) AS bal, 0.0 AS flat FROM grid, q")
def minmax_scale(spark, sf):
    return rounded(clean.minmax(grid(spark, sf).select("id", "bal", F.lit(3.0).alias("flat")), ["bal", "flat"]), 6)


@query(f"WITH {CELLS_SQL}, q AS (SELECT min(bal) AS a, max(bal) AS b, min(qty) AS c, max(qty) AS d FROM cells) SELECT id, round((bal - a) / (b - a), 6) AS bal, round(1 - (qty - c) / (d - c), 6) AS qty FROM cells, q WHERE qty IS NOT NULL")
def minmax_direction(spark, sf):
    df = cells(spark, sf).select("id", "bal", "qty")
    return rounded(clean.directed_minmax(df, {"bal": True, "qty": False}).where("qty IS NOT NULL"), 6)


@query(f"WITH {GRID_SQL}, q AS (SELECT min(bal) AS a, max(bal) AS b FROM grid) SELECT id, round((bal - a) / (b - a + 1e-9), 6) AS up, round(1 - (bal - a) / (b - a + 1e-9), 6) AS down FROM grid, q")
def chart_scale(spark, sf):
    wide = clean.with_statistics(grid(spark, sf).select("id", "bal"), ["bal"], {"a": F.min, "b": F.max})
    a, b = F.col("bal__a"), F.col("bal__b")
    return rounded(wide.select("id", E.chart_scale(F.col("bal"), a, b).alias("up"), E.chart_scale(F.col("bal"), a, b, invert=True).alias("down")), 6)


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS price, CASE WHEN l_linenumber % 4 = 0 THEN '0' ELSE CAST(l_quantity AS VARCHAR) END AS area, CASE WHEN l_linenumber % 5 = 0 THEN '12.5' END AS unit FROM lineitem)
SELECT l_orderkey, l_linenumber, round(u, 9) AS unit_price FROM (SELECT *, coalesce(try_cast(unit AS DOUBLE), try_cast(price AS DOUBLE) / nullif(try_cast(area AS DOUBLE), 0)) AS u FROM v) WHERE u > 0""")
def safe_parse_fallback(spark, sf):
    n = F.col("l_linenumber")
    v = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(n % 3 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("price"), F.when(n % 4 == 0, "0").otherwise(F.col("l_quantity").cast("string")).alias("area"), F.when(n % 5 == 0, "12.5").alias("unit"))
    df = v.withColumn("unit_price", E.unit_price(F.col("unit"), F.col("price"), F.col("area"))).where("unit_price IS NOT NULL")
    return rounded(df.select("l_orderkey", "l_linenumber", "unit_price"), 9)


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate + INTERVAL 8 YEAR, '%m%y') WHEN 1 THEN strftime(o_orderdate + INTERVAL 8 YEAR, '%m/%y') WHEN 2 THEN strftime(o_orderdate + INTERVAL 8 YEAR, '%m/%Y') ELSE 'unknown' END AS c FROM orders)
SELECT o_orderkey, CAST(CASE WHEN c = 'unknown' THEN NULL WHEN length(c) = 4 THEN 2000 + CAST(substr(c, 3, 2) AS INT) WHEN length(c) = 5 THEN 2000 + CAST(substr(c, 4, 2) AS INT) ELSE CAST(substr(c, 4, 4) AS INT) END AS INT) AS year FROM d""")
def year_from_mmyy(spark, sf):
    """Two digits mean a year from 2000 on, so dates are moved there."""
    k, d = F.col("o_orderkey") % 4, F.add_months("o_orderdate", 96)
    c = F.when(k == 0, F.date_format(d, "MMyy")).when(k == 1, F.date_format(d, "MM/yy")).when(k == 2, F.date_format(d, "MM/yyyy")).otherwise("unknown")
    return table(spark, sf, "orders").select("o_orderkey", E.contract_year(c).alias("year"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1998)")
def year_filter(spark, sf):
    df = table(spark, sf, "orders").withColumn("year", E.month_year(F.date_format("o_orderdate", "yyyy-MM")))
    return df.where(F.col("year").isin(1996, 1997, 1998)).select("o_orderkey", "year")


_AMENITIES = [*E.FOOD, *E.RETAIL, *E.CIVIC, *E.LEISURE, *E.NO_PLACES, "School", None]
_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_PLACES = f"SELECT event_id, ([{', '.join('NULL' if v is None else repr(v) for v in _AMENITIES)}])[event_id % {len(_AMENITIES)} + 1] AS amenity, CASE user_id % 5 WHEN 0 THEN 'books' WHEN 1 THEN 'None' WHEN 2 THEN '' END AS shop, CASE WHEN user_id % 3 = 0 THEN 'museum' END AS tourism FROM events"


def _places(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    amenity = F.get(F.array(*map(F.lit, _AMENITIES)), (i % len(_AMENITIES)).cast("int"))
    shop = F.when(u % 5 == 0, "books").when(u % 5 == 1, "None").when(u % 5 == 2, "")
    return table(spark, sf, "events").select("event_id", amenity.alias("amenity"), shop.alias("shop"), F.when(u % 3 == 0, "museum").alias("tourism"))


@query(f"""SELECT event_id, CASE WHEN lower(amenity) IN ({_IN(E.FOOD)}) THEN 'F&B' WHEN shop = 'books' THEN 'Retail' WHEN lower(amenity) IN ({_IN(E.RETAIL)}) THEN 'Retail' WHEN lower(amenity) IN ({_IN(E.CIVIC)}) THEN 'Civic' WHEN lower(amenity) IN ({_IN(E.LEISURE)}) THEN 'Leisure' WHEN tourism IS NOT NULL THEN 'Tourism' ELSE 'Drop' END AS category FROM ({_PLACES})""")
def category_cascade(spark, sf):
    return _places(spark, sf).select("event_id", E.place_category(F.col("amenity"), F.col("shop"), F.col("tourism")).alias("category"))


@query(f"SELECT event_id, amenity FROM ({_PLACES}) WHERE amenity IS NULL OR amenity NOT IN ({_IN(E.NO_PLACES)})")
def exclusion_not_in(spark, sf):
    return _places(spark, sf).where(E.not_in(F.col("amenity"), E.NO_PLACES)).select("event_id", "amenity")


#: Whether a group of features keeps its meaning at any scale; groups that aren't listed do.
_SCALE_INVARIANT = {
    "DIS_CBD": True, "NDVI": True, "Landscape (LSI+LPI+SHDI)": True, "BCR (local+nbr)": False, "FAR": False, "SVF": False, "BHD": False, "Albedo": True, "AHI (local+nbr)": False, "MENN": True, "DIS_MRT": True,
}
_GROUP_NAMES = [*_SCALE_INVARIANT, "POI", "Road"]


@query(f"WITH g AS (SELECT ([{', '.join(map(repr, _GROUP_NAMES))}])[p_partkey % {len(_GROUP_NAMES)} + 1] AS feature, p_partkey FROM part) SELECT p_partkey, feature, feature NOT IN ({_IN([k for k, v in _SCALE_INVARIANT.items() if not v])}) AS scale_invariant FROM g")
def scale_invariance(spark, sf):
    feature = F.get(F.array(*map(F.lit, _GROUP_NAMES)), (F.col("p_partkey") % len(_GROUP_NAMES)).cast("int"))
    df = table(spark, sf, "part").select("p_partkey", feature.alias("feature"))
    return df.withColumn("scale_invariant", E.lookup(F.col("feature"), _SCALE_INVARIANT, True))


@query("SELECT p_partkey, CASE upper(trim(p_type)) WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 ELSE 0 END AS class FROM part")
def map_lookup_default(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.lookup(F.upper(F.trim("p_type")), {"ECONOMY": 1, "STANDARD": 2, "PROMO": 3}, 0).alias("class"))


@query("""WITH d AS (SELECT p_partkey AS id, CAST(p_size % 7 AS DOUBLE) AS euc, round(p_retailprice % 40, 2) AS net FROM part)
SELECT id, round(CASE WHEN euc > 0 AND net / euc <= 3 THEN net ELSE euc END, 4) AS dist, CASE WHEN euc > 0 AND net / euc <= 3 THEN 'network' ELSE 'straight' END AS method FROM d""")
def detour_cap(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7).cast("double").alias("euc"), F.round(F.col("p_retailprice") % 40, 2).alias("net"))
    dist = E.capped_detour(F.col("net"), F.col("euc"))
    used = (F.col("euc") > 0) & (F.col("net") / F.nullif(F.col("euc"), F.lit(0.0)) <= 3)
    return rounded(d.select("id", dist.alias("dist"), F.when(used, "network").otherwise("straight").alias("method")))


@query(f"WITH {GRID_SQL} SELECT id, round(CASE WHEN abs(bal) > 100 THEN 100 * (x - bal) / abs(bal) ELSE 0 END, 4) + 0.0 AS change FROM grid")
def percent_change(spark, sf):
    return rounded(grid(spark, sf).select("id", E.percent_change(F.col("x"), F.col("bal"), 100.0).alias("change")))


@query(f"WITH {GRID_SQL} SELECT id, CAST(floor((y - (SELECT min(y) FROM grid)) / 400) AS BIGINT) * 10000 + CAST(floor((x - (SELECT min(x) FROM grid)) / 400) AS BIGINT) AS key FROM grid")
def coarse_grid_key(spark, sf):
    wide = clean.with_statistics(grid(spark, sf), ["x", "y"], {"a": F.min})
    return wide.select("id", E.grid_key(F.col("x"), F.col("y"), F.col("x__a"), F.col("y__a"), 400.0).alias("key"))


@query("SELECT p_partkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, CASE WHEN r >= 0.85 THEN 'very high' WHEN r >= 0.7 THEN 'high' ELSE 'moderate' END AS level FROM (SELECT p_partkey, (p_partkey % 100) / 1000.0 AS p, (p_size * 2) / 100.0 AS r FROM part)")
def significance(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.stars((F.col("p_partkey") % 100) / 1000.0).alias("stars"), E.level(-(F.col("p_size") * 2) / 100.0).alias("level"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def nan_to_null(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", E.finite(v).alias("value"))


_ADVICE = "f AS (SELECT p_partkey, p_name AS feature, p_size * 0.4 AS vif, (p_partkey % 50) / 50.0 AS importance, (p_partkey % 7 = 0) AS has_twin FROM part)"


@query(f"WITH {_ADVICE}, d AS (SELECT *, CASE WHEN vif > 10 AND has_twin THEN 'DROP' WHEN vif > 5 AND importance < 0.1 OR vif > 10 THEN 'CONSIDER DROP' ELSE 'KEEP' END AS decision FROM f) SELECT p_partkey, decision, CASE decision WHEN 'KEEP' THEN printf('VIF=%.1f. Ablation total=%.3f.', vif, importance) WHEN 'DROP' THEN printf('VIF=%.1f, and a twin carries the same.', vif) ELSE printf('VIF=%.1f against an ablation total of %.3f.', vif, importance) END AS reason FROM d")
def recommendations(spark, sf):
    """Keep, drop or consider to drop a feature, by its collinearity, its importance, and whether another one carries the same."""
    i = F.col("p_partkey")
    f = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 0.4).alias("vif"), ((i % 50) / 50.0).alias("importance"), (i % 7 == 0).alias("has_twin"))
    return E.advice(f, "vif", "importance", "has_twin").select("p_partkey", "decision", "reason")


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def nested_json(spark, sf):
    return table(spark, sf, "events").select("user_id", F.from_json("props", "k long")["k"].alias("k")).groupBy("user_id", "k").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, upper(replace(trim(c_name), ' ', '_')) || '-' || lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS code, split_part(c_name, '#', 2) AS tail FROM customer")
def string_functions(spark, sf):
    code = F.concat_ws("-", F.upper(F.translate(F.trim("c_name"), " ", "_")), F.lpad(F.col("c_nationkey").cast("string"), 6, "0"))
    return table(spark, sf, "customer").select("c_custkey", code.alias("code"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"))


@query(f"WITH {GRID_SQL}, q AS (SELECT quantile_cont(bal, 1.0/3) AS a, quantile_cont(bal, 2.0/3) AS b FROM grid) SELECT id, CASE WHEN bal <= a THEN 'low' WHEN bal <= b THEN 'middle' ELSE 'high' END AS tercile FROM grid, q")
def tercile_labels(spark, sf):
    """Ties stay together, as cut points do and ntile doesn't."""
    wide = clean.with_statistics(grid(spark, sf).select("id", "bal"), ["bal"], {"q": lambda c: F.percentile(c, F.array(F.lit(1 / 3), F.lit(2 / 3)))})
    q = F.col("bal__q")
    return wide.select("id", F.when(F.col("bal") <= q[0], "low").when(F.col("bal") <= q[1], "middle").otherwise("high").alias("tercile"))
