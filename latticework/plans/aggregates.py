"""Aggregates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import spatial, stats

from .registry import CELLS_SQL, GRID_SQL, cells, grid, query, rounded, table


@query(f"WITH {GRID_SQL} SELECT kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM grid), 1) AS pct, round(avg(bal), 4) + 0.0 AS mean_bal FROM grid GROUP BY 1")
def archetype_summary(spark, sf):
    g = grid(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.avg("bal").alias("mean_bal"))
    total = F.broadcast(g.agg(F.sum("n").alias("all")))
    return g.crossJoin(total).select("kind", "n", F.round(F.lit(100.0) * F.col("n") / F.col("all"), 1).alias("pct"), (F.round("mean_bal", 4) + F.lit(0.0)).alias("mean_bal"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT p_brand AS brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS std, min(p_retailprice) AS min, round(quantile_cont(p_retailprice, 0.5), 4) AS median, max(p_retailprice) AS max FROM part GROUP BY 1")
def column_summary(spark, sf):
    return rounded(stats.summary(table(spark, sf, "part").withColumnRenamed("p_brand", "brand"), "p_retailprice", ["brand"]))


@query("""WITH g AS (SELECT l_orderkey AS cell, quantile_cont(CASE WHEN l_returnflag = 'N' THEN l_extendedprice / l_quantity END, 0.5) AS m1, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n1,
  quantile_cont(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / l_quantity END, 0.5) AS m2, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS n2 FROM lineitem GROUP BY 1)
SELECT cell, n1, n2, round(CASE WHEN n1 + n2 >= 3 THEN (n1 * coalesce(m1, 0) + n2 * coalesce(m2, 0)) / (n1 + n2) END, 10) AS price FROM g""")
def weighted_median_price(spark, sf):
    """Medians of two sources, combined by counts; null with fewer than three rows. One pass."""
    df = table(spark, sf, "lineitem")
    unit, new = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_returnflag") == "N"
    g = df.groupBy(F.col("l_orderkey").alias("cell")).agg(F.median(F.when(new, unit)).alias("m1"), F.count(F.when(new, 1)).alias("n1"), F.median(F.when(~new, unit)).alias("m2"), F.count(F.when(~new, 1)).alias("n2"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    price = (F.col("n1") * zero("m1") + F.col("n2") * zero("m2")) / (F.col("n1") + F.col("n2"))
    return rounded(g.select("cell", "n1", "n2", F.when(F.col("n1") + F.col("n2") >= 3, price).alias("price")), 10)


@query("WITH g AS (SELECT l_orderkey AS cell, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS a, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS b FROM lineitem GROUP BY 1) SELECT CAST(sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(sum(CASE WHEN a > 0 AND b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS mixed FROM g")
def source_mix(spark, sf):
    new = F.col("l_returnflag") == "N"
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(new, 1)).alias("a"), F.count(F.when(~new, 1)).alias("b"))
    n = lambda c: F.sum(c.cast("long"))
    return g.agg(n(F.col("b") == 0).alias("only_a"), n(F.col("a") == 0).alias("only_b"), n((F.col("a") > 0) & (F.col("b") > 0)).alias("mixed"))


@query("SELECT 'new' AS source, count(*) AS n, round(avg(l_quantity), 4) AS qty FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT 'old', count(*), round(avg(l_quantity), 4) FROM lineitem WHERE l_returnflag <> 'N'")
def union_sources(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.where("l_returnflag = 'N'").select(F.lit("new").alias("source"), "l_quantity")
    b = li.where("l_returnflag <> 'N'").select("l_quantity", F.lit("old").alias("source"))
    return rounded(a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("qty")))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2), n AS (SELECT user_id, sum(k) AS n FROM c GROUP BY 1) SELECT user_id, CAST(n.n AS BIGINT) AS n, round(-sum(k / n.n * ln(k / n.n)), 6) + 0.0 AS entropy FROM c JOIN n USING (user_id) GROUP BY user_id, n.n")
def category_entropy(spark, sf):
    return rounded(stats.shannon(table(spark, sf, "events"), ["user_id"], "event_type"), 6)


_NUM = ["bal", "spend", "qty", "price", "n_orders"]
_NEW = ["price", "n_orders"]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM k" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :])
_K = f"WITH {CELLS_SQL}, k AS (SELECT id, {', '.join(_NUM)} FROM cells WHERE spend IS NOT NULL AND qty IS NOT NULL)"


def numeric(spark, sf):
    return cells(spark, sf).where("spend IS NOT NULL AND qty IS NOT NULL").select("id", *_NUM)


@query(f"{_K} SELECT a, b, round(r, 6) + 0.0 AS r FROM ({_PAIRS})")
def pearson_pairs(spark, sf):
    return rounded(stats.correlation_pairs(numeric(spark, sf), _NUM), 6)


@query(f"{_K} SELECT a, b, round(r, 6) + 0.0 AS r, CASE WHEN abs(r) >= 0.85 THEN 'very high' WHEN abs(r) >= 0.7 THEN 'high' ELSE 'moderate' END AS level FROM ({_PAIRS}) WHERE abs(r) >= 0.6")
def high_corr_pairs(spark, sf):
    from latticework.functions.expr import level

    return rounded(stats.correlation_pairs(numeric(spark, sf), _NUM).where("abs(r) >= 0.6").withColumn("level", level(F.col("r"))), 6)


_ISNEW = lambda c: f"{c} IN ({', '.join(repr(n) for n in _NEW)})"


@query(f"{_K} SELECT a, b, round(r, 6) + 0.0 AS r, CASE WHEN {_ISNEW('a')} AND {_ISNEW('b')} THEN 'new x new' WHEN {_ISNEW('a')} OR {_ISNEW('b')} THEN 'new x orig' ELSE 'orig x orig' END AS pair_type FROM ({_PAIRS}) WHERE abs(r) >= 0.02")
def pair_types(spark, sf):
    """Which of a pair's features are new ones."""
    pairs = stats.correlation_pairs(numeric(spark, sf), _NUM).where("abs(r) >= 0.02")
    return rounded(stats.pair_type(pairs, _NEW), 6)


_VIFS = "SELECT 'f1' AS feature, (1 - c * c) / det AS vif FROM d UNION ALL SELECT 'f2', (1 - b * b) / det FROM d UNION ALL SELECT 'f3', (1 - a * a) / det FROM d"
_TWINS = "t AS (SELECT spend / 100000 AS f1, bal / 1000 AS f2, spend / 100000 + bal / 9000 + (id % 7) / 10.0 AS f3 FROM k), r AS (SELECT corr(f1, f2) AS a, corr(f1, f3) AS b, corr(f2, f3) AS c FROM t), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)"


def twins(spark, sf):
    """Two features, and one that is nearly a sum of both."""
    k = numeric(spark, sf)
    f1, f2 = F.col("spend") / 100000, F.col("bal") / 1000
    return k.select(f1.alias("f1"), f2.alias("f2"), (f1 + F.col("bal") / 9000 + (F.col("id") % 7) / 10.0).alias("f3"))


@query(f"{_K}, {_TWINS} SELECT feature, round(vif, 4) AS vif, CAST(row_number() OVER (ORDER BY round(vif, 6) DESC, feature) AS INT) AS pos FROM ({_VIFS}) WHERE vif > 10")
def vif_report(spark, sf):
    """Collinear features, the worst first."""
    return rounded(stats.vif_report(stats.vif(twins(spark, sf), ["f1", "f2", "f3"])))


@query(f"{_K}, {_TWINS}, v AS ({_VIFS}) SELECT CAST(sum(CASE WHEN abs(r) >= 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS very_high, CAST(sum(CASE WHEN abs(r) >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN abs(r) >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS moderate, round(max(abs(r)), 6) AS most, round((SELECT max(vif) FROM v), 4) AS most_vif, coalesce(string_agg(CASE WHEN abs(r) >= 0.02 AND ({_ISNEW('a')}) <> ({_ISNEW('b')}) THEN a || ' x ' || b END, ', ' ORDER BY a, b), '') AS across FROM ({_PAIRS})")
def pair_summary(spark, sf):
    """Counts of high correlations, the greatest correlation and VIF, and pairs of a new and an old feature."""
    pairs = stats.pair_type(stats.correlation_pairs(numeric(spark, sf), _NUM), _NEW)
    worst = stats.vif(twins(spark, sf), ["f1", "f2", "f3"]).agg(F.round(F.max("vif"), 4).alias("most_vif"))
    r = F.abs("r")
    n = lambda t: F.sum((r >= t).cast("long"))
    name = F.when((r >= 0.02) & (F.col("pair_type") == "new x orig"), F.concat_ws(" x ", "a", "b"))
    across = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(name.isNotNull(), F.struct("a", "b")))), lambda s: F.concat_ws(" x ", s["a"], s["b"])), ", ")
    summary = pairs.agg(n(0.85).alias("very_high"), n(0.7).alias("high"), n(0.6).alias("moderate"), F.round(F.max(r), 6).alias("most"), across.alias("across"))
    return summary.crossJoin(F.broadcast(worst))


@query(f"{_K}, r AS (SELECT corr(bal, spend) AS a, corr(bal, qty) AS b, corr(spend, qty) AS c FROM k), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r) SELECT 'bal' AS feature, round((1 - c * c) / det, 6) AS vif FROM d UNION ALL SELECT 'spend', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'qty', round((1 - a * a) / det, 6) FROM d")
def vif_small(spark, sf):
    return rounded(stats.vif(numeric(spark, sf), ["bal", "spend", "qty"]), 6)


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"WITH r AS (SELECT {_RANK.format('p_size')} AS a, {_RANK.format('p_retailprice')} AS b FROM part) SELECT round(corr(a, b), 6) AS r, count(*) AS n FROM r")
def spearman_avg_rank(spark, sf):
    return rounded(stats.spearman(table(spark, sf, "part"), "p_size", "p_retailprice"), 6)


@query("SELECT l_returnflag AS split, round(sqrt(avg(power(l_extendedprice - 1500 * l_quantity, 2))), 4) AS rmse, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) AS mae, round(1 - sum(power(l_extendedprice - 1500 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1")
def regression_metrics(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p"))
    m = stats.regression_metrics(df, "y", "p", ["split"])
    return m.select("split", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


_MEMBERS = ["p_size", "p_retailprice", "p_key"]
_PART_RANKS = "k AS (SELECT p_size, p_retailprice, p_partkey * 37 % 101 AS p_key FROM part), r AS (SELECT " + ", ".join(f"{_RANK.format(c)} AS {c}" for c in _MEMBERS) + " FROM k)"
_SPEARMAN = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM r" for i, a in enumerate(_MEMBERS) for b in _MEMBERS[i + 1 :])


@query(f"WITH {_PART_RANKS}, c AS ({_SPEARMAN}), t AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c WHERE abs(r) < 1) SELECT a, b, round(r, 6) + 0.0 AS r, n, CASE WHEN t > 3.3 THEN '***' WHEN t > 1.97 THEN '*' ELSE 'ns' END AS stars FROM t")
def spearman_significance(spark, sf):
    """Rank correlations of all pairs with their significance."""
    from latticework.functions.expr import stars

    part = table(spark, sf, "part").select("p_size", "p_retailprice", (F.col("p_partkey") * 37 % 101).alias("p_key"))
    s = stats.with_p(stats.spearman_pairs(part, _MEMBERS)).withColumn("stars", stars(F.col("p")))
    return rounded(s.select("a", "b", "r", "n", F.when(F.col("stars") == "**", "*").otherwise(F.col("stars")).alias("stars")), 6)


@query(f"{_K}, m AS (SELECT * FROM k WHERE id % 3 <> 0) SELECT '0' AS subset, round(corr(bal, spend), 6) + 0.0 AS r, count(*) AS n FROM k UNION ALL SELECT '1', round(corr(bal, spend), 6) + 0.0, count(*) FROM m")
def pearson_subset(spark, sf):
    """A correlation over all cells, and over a subset of them."""
    k = numeric(spark, sf)
    own = F.when(F.col("id") % 3 != 0, 1)
    row = k.agg(F.corr("bal", "spend").alias("r0"), F.count("*").alias("n0"), F.corr(F.col("bal") * own, F.col("spend") * own).alias("r1"), F.count(own).alias("n1"))
    return rounded(row.select(F.explode(F.array(*(F.struct(F.lit(str(k)).alias("subset"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k in (0, 1)))).alias("e")).select("e.*"), 6)


@query("WITH s AS (SELECT l_extendedprice / 1000 - 1.5 * l_quantity AS e FROM lineitem UNION ALL SELECT l_tax - 0.04 FROM lineitem) SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM s")
def pooled_metrics(spark, sf):
    """Errors of two targets together."""
    li = table(spark, sf, "lineitem")
    e = li.select(F.explode(F.array(F.col("l_extendedprice") / 1000 - 1.5 * F.col("l_quantity"), F.col("l_tax") - 0.04)).alias("e"))
    return rounded(e.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae")), 6)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def residual_trend(spark, sf):
    return rounded(stats.ols_line(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"))


@query("SELECT CAST(least(floor((value - 0) * 20 / 100), 19) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def histogram(spark, sf):
    return stats.histogram(table(spark, sf, "events"), "value", 0.0, 100.0, 20)


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o_custkey = c_custkey")
def left_join_fill(spark, sf):
    n = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def inner_join(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey").join(table(spark, sf, "nation"), "n_nationkey").select("o_orderkey", "c_mktsegment", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join_ids(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join_ids(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("SELECT p_partkey, coalesce(new, p_retailprice) AS price FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS new FROM lineitem WHERE l_tax = 0.08 GROUP BY 1) ON l_partkey = p_partkey")
def lookup_join_coalesce(spark, sf):
    new = table(spark, sf, "lineitem").where("l_tax = 0.08").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("new"))
    return table(spark, sf, "part").join(new, "p_partkey", "left").select("p_partkey", F.coalesce("new", "p_retailprice").alias("price"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_custkey % 60 = 0")
def set_difference(spark, sf):
    rich = table(spark, sf, "customer").where("c_custkey % 60 = 0").select(F.col("c_nationkey").alias("nation"))
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).distinct().join(rich, "nation", "left_anti")


def points(spark, sf):
    """Events as points scattered over the grid."""
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", "event_type", ((i * 7919) % 8000).cast("double").alias("x"), ((i * 104729) % 8000).cast("double").alias("y"))


_POINTS = "points AS (SELECT event_id, event_type, CAST((event_id * 7919) % 8000 AS DOUBLE) AS x, CAST((event_id * 104729) % 8000 AS DOUBLE) AS y FROM events)"


@query(f"WITH {GRID_SQL}, {_POINTS} SELECT event_id, id AS cell FROM points p LEFT JOIN grid g ON p.x >= g.x - 100 AND p.x < g.x + 100 AND p.y >= g.y - 100 AND p.y < g.y + 100")
def point_in_cell(spark, sf):
    return spatial.point_in_cell(points(spark, sf), grid(spark, sf), 200.0).select("event_id", "cell")


@query(f"WITH {GRID_SQL}, {_POINTS} SELECT id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM grid g JOIN points p ON power(g.x - p.x, 2) + power(g.y - p.y, 2) <= 360000 GROUP BY 1")
def radius_join_count(spark, sf):
    """Points within 600 m of each cell, as an equi-join on bins."""
    pts = points(spark, sf).select(F.col("event_id").alias("id"), "x", "y", "event_type")
    return spatial.kinds_around(grid(spark, sf).select("id", "x", "y"), pts, 600.0, "event_type")


#: Districts: stars of ten corners around every 53rd cell, in no order of size; they overlap.
_DISTRICTS = """d AS (SELECT id, x, y FROM grid WHERE id % 53 = 0), c AS (SELECT id, k, x + (CASE k % 2 WHEN 0 THEN 900 ELSE 350 + id % 100 END) * cos(0.628318530717958 * k + 0.1) AS px, y + (CASE k % 2 WHEN 0 THEN 900 ELSE 350 + id % 100 END) * sin(0.628318530717958 * k + 0.1) AS py FROM d, range(10) t(k)),
s AS (SELECT a.id, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM c a JOIN c b ON a.id = b.id AND b.k = (a.k + 1) % 10)"""


def districts(spark, sf):
    corner = lambda k: F.when(k % 2 == 0, 900).otherwise(350 + F.col("id") % 100)
    ring = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct((F.col("x") + corner(k % 10) * F.cos(0.628318530717958 * (k % 10) + 0.1)).alias("x"), (F.col("y") + corner(k % 10) * F.sin(0.628318530717958 * (k % 10) + 0.1)).alias("y")))
    return grid(spark, sf).where("id % 53 = 0").select("id", ring.alias("ring"))


_CROSS = "SELECT {point}, s.id AS district FROM {points} p JOIN s ON (s.y1 > p.y) <> (s.y2 > p.y) AND p.x < (s.x2 - s.x1) * (p.y - s.y1) / (s.y2 - s.y1) + s.x1 GROUP BY ALL HAVING count(*) % 2 = 1"


@query(f"WITH {GRID_SQL}, {_POINTS}, {_DISTRICTS} {_CROSS.format(point='event_id', points='points')}")
def point_in_polygon(spark, sf):
    """Events and the districts that hold them, of any shape: an equi-join on bins, and the exact test."""
    pts = points(spark, sf).select(F.col("event_id").alias("id"), "x", "y")
    return spatial.points_in_polygons(pts, districts(spark, sf), 400.0).select(F.col("point").alias("event_id"), F.col("polygon").alias("district"))


_PIXELS = "px AS (SELECT p_partkey AS id, (p_partkey % 45 + 0.5) * 160.0 AS x, (p_partkey // 45 + 0.5) * 160.0 AS y FROM part)"


@query(f"WITH {GRID_SQL}, {_DISTRICTS}, {_PIXELS}, h AS ({_CROSS.format(point='p.id', points='px')}) SELECT px.id AS pixel, coalesce(max(district), 0) AS district FROM px LEFT JOIN h ON h.id = px.id GROUP BY 1")
def rasterise_polygons(spark, sf):
    """Each pixel's district by its centre, the last one if there are several, else 0."""
    i = F.col("p_partkey")
    px = table(spark, sf, "part").select(i.alias("id"), ((i % 45 + 0.5) * 160.0).alias("x"), ((F.floor(i / 45) + 0.5) * 160.0).alias("y"))
    held = spatial.points_in_polygons(px, districts(spark, sf), 400.0).groupBy(F.col("point").alias("id")).agg(F.max("polygon").alias("district"))
    return px.join(held, "id", "left").select(F.col("id").alias("pixel"), F.coalesce("district", F.lit(0)).alias("district"))


@query(f"WITH {GRID_SQL} SELECT a.id AS src, b.id AS dst FROM grid a JOIN grid b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1")
def rook_edges(spark, sf):
    return spatial.rook_edges(grid(spark, sf))


_NEAR = f"WITH {GRID_SQL}, d AS (SELECT a.id AS src, b.id AS dst, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM grid a JOIN grid b ON a.id <> b.id AND abs(a.cx - b.cx) <= 12 AND abs(a.cy - b.cy) <= 12), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS pos FROM d)"


@query(f"{_NEAR} SELECT src, dst, round(d, 4) AS d, CAST(pos AS INT) AS pos FROM k WHERE pos <= 8")
def knn_xy(spark, sf):
    return rounded(spatial.nearest(grid(spark, sf), 8, 600.0))


@query(f"WITH {GRID_SQL} SELECT CAST(floor((y - (SELECT min(y) FROM grid)) / 400) AS BIGINT) * 10000 + CAST(floor((x - (SELECT min(x) FROM grid)) / 400) AS BIGINT) AS key, count(*) AS n, round(avg(bal), 4) + 0.0 AS bal FROM grid GROUP BY 1 HAVING count(*) >= 2")
def coarse_grid_mean(spark, sf):
    return rounded(spatial.coarse_means(grid(spark, sf), ["bal"], 400.0, 2))


_SCALE = "SELECT {t} AS scale, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v), 4) AS std, round(stddev_samp(v) / avg(v), 4) AS cv, count(*) AS n FROM (SELECT avg(bal) AS v FROM grid GROUP BY floor((y - 100) / {t}), floor((x - 100) / {t}))"


@query(f"WITH {GRID_SQL} " + " UNION ALL ".join(_SCALE.format(t=t) for t in (400, 800)))
def scale_stats_cv(spark, sf):
    out = None
    for t in (400, 800):
        m = spatial.coarse_means(grid(spark, sf), ["bal"], float(t)).agg(F.avg("bal").alias("mean"), F.stddev_samp("bal").alias("std"), (F.stddev_samp("bal") / F.avg("bal")).alias("cv"), F.count("*").alias("n")).withColumn("scale", F.lit(t))
        out = m if out is None else out.unionByName(m)
    return rounded(out)


@query(f"WITH {GRID_SQL}, c AS (SELECT id, bal, avg(bal) OVER (PARTITION BY floor((y - 100) / 400), floor((x - 100) / 400)) AS parent FROM grid) SELECT round(corr(bal, parent), 6) AS r FROM c")
def cross_scale(spark, sf):
    """Each fine cell against its coarse parent's mean."""
    from latticework.functions.expr import grid_key

    g = grid(spark, sf).withColumn("key", grid_key(F.col("x"), F.col("y"), F.lit(100.0), F.lit(100.0), 400.0))
    means = g.groupBy("key").agg(F.avg("bal").alias("parent"))
    return rounded(g.join(means, "key").agg(F.corr("bal", "parent").alias("r")), 6)
