"""Order, frontiers, interventions and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latticework.operators import gat, policy, rank, stats

from .registry import CELLS_SQL, GRID_SQL, cells, grid, query, rounded, table


@query(f"WITH {GRID_SQL} SELECT id, CAST(row_number() OVER (ORDER BY bal, id) - 1 AS BIGINT) AS idx FROM grid")
def dense_index(spark, sf):
    return rank.dense_index(grid(spark, sf).select("id", "bal"), ["bal", "id"]).select("id", F.col("idx").cast("long").alias("idx"))


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2")
def topn_per_group(spark, sf):
    return rank.top_per_group(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 2).select("p_brand", "p_partkey")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size < 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def topn_global(spark, sf):
    return table(spark, sf, "part").where("p_size < 10").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_retailprice")


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS mean, CAST(row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_brand) AS INT) AS pos FROM part GROUP BY 1")
def rank_by_metric(spark, sf):
    from pyspark.sql import Window

    m = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"))
    return rounded(m.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("mean"), "p_brand"))))


@query("WITH f AS (SELECT o_orderkey, o_totalprice % 1000 AS cost, o_totalprice AS gain FROM orders), m AS (SELECT *, max(gain) OVER (ORDER BY cost, gain DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f) SELECT o_orderkey, gain FROM m WHERE best IS NULL OR gain > best")
def pareto_frontier(spark, sf):
    f = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") % 1000).alias("cost"), F.col("o_totalprice").alias("gain"))
    return rank.pareto_frontier(f, "cost", "gain", "o_orderkey").select("o_orderkey", "gain")


@query("WITH q AS (SELECT min(value) AS a, max(value) AS b FROM events), e AS (SELECT CAST(floor((value - a) * 120 / (b - a)) AS BIGINT) AS bin, max(user_id) AS y FROM events, q WHERE value < b GROUP BY 1), m AS (SELECT *, max(y) OVER (ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e), k AS (SELECT a + (bin + 0.5) * (b - a) / 120 AS x, y FROM m, q WHERE best IS NULL OR y > best), f AS (SELECT * FROM k UNION ALL SELECT a, y FROM q, (SELECT arg_min(y, x) AS y, min(x) AS x FROM k) WHERE x > a) SELECT round(x, 6) AS x, y FROM f")
def pareto_envelope(spark, sf):
    e = table(spark, sf, "events").select(F.col("value").alias("x"), F.col("user_id").alias("y"))
    return rounded(rank.upper_envelope(e, "x", "y"), 6)


_SPLIT = f"WITH {GRID_SQL}, h AS (SELECT id, row_number() OVER (ORDER BY (id * 48271 + 11) % 2147483647, id) - 1 AS i, count(*) OVER () AS n FROM grid), sp AS (SELECT id, CASE WHEN i < CAST(floor(n * 0.70) AS BIGINT) THEN 'train' WHEN i < CAST(floor(n * 0.70) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM h)"


@query(f"{_SPLIT} SELECT id, split FROM sp")
def hash_split(spark, sf):
    return rank.hash_split(grid(spark, sf).select("id"), "id")


@query(f"WITH {GRID_SQL} SELECT id FROM grid ORDER BY (id * 48271 + 11) % 2147483647, id LIMIT 100")
def hash_sample(spark, sf):
    return rank.hash_sample(grid(spark, sf).select("id"), "id", 100)


_P = "p AS (SELECT id, kind, x / 8000 AS built, spend / 1000000 AS stress, bal / 1000 AS vitality, (id % 97) / 97.0 AS green, (id % 31) / 10.0 AS shape FROM cells WHERE spend IS NOT NULL)"


def plots(spark, sf):
    i = F.col("id")
    return cells(spark, sf).where("spend IS NOT NULL").select("id", "kind", (F.col("x") / 8000).alias("built"), (F.col("spend") / 1000000).alias("stress"), (F.col("bal") / 1000).alias("vitality"), ((i % 97) / 97.0).alias("green"), ((i % 31) / 10.0).alias("shape"))


_B = f"""WITH {CELLS_SQL}, {_P}, q AS (SELECT kind, quantile_cont(stress, 0.25) AS s, quantile_cont(vitality, 0.75) AS v FROM p GROUP BY 1),
t AS (SELECT p.*, stress < s AND vitality > v AS top FROM p JOIN q USING (kind)),
b AS (SELECT kind, CASE WHEN count(CASE WHEN top THEN 1 END) >= 5 THEN quantile_cont(CASE WHEN top THEN green END, 0.85) ELSE quantile_cont(green, 0.85) END AS target_green, CASE WHEN count(CASE WHEN top THEN 1 END) >= 5 THEN quantile_cont(CASE WHEN top THEN shape END, 0.85) ELSE quantile_cont(shape, 0.85) END AS target_shape FROM t GROUP BY 1)"""


@query(f"{_B} SELECT kind, round(target_green, 6) AS target_green, round(target_shape, 6) AS target_shape FROM b")
def group_benchmarks(spark, sf):
    return rounded(policy.group_benchmarks(plots(spark, sf), "kind", "stress", "vitality", ["green", "shape"]), 6)


_L = f"""{_B}, g AS (SELECT kind, avg(stress) AS ms, avg(vitality) AS mv FROM p GROUP BY 1), l AS (SELECT p.*, target_green, target_shape, least(greatest(0.8 * (1 - built), 0), 1) AS cap FROM p JOIN g USING (kind) JOIN b USING (kind) WHERE stress > ms OR vitality < mv),
c AS (SELECT *, greatest(0, least(target_green, cap) - green) AS delta FROM l), k AS (SELECT *, least(target_green, cap) = cap AND delta > 0 AS blocked FROM c)"""


def planned(spark, sf):
    p = plots(spark, sf)
    lag = policy.lagging(p, "kind", "stress", "vitality").join(policy.group_benchmarks(p, "kind", "stress", "vitality", ["green", "shape"]), "kind")
    return policy.capped_change(lag, "green", "target_green", "built")


@query(f"{_L} SELECT kind, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(max(delta), 6) AS max_delta, CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM k GROUP BY 1")
def lagging_strategy(spark, sf):
    s = planned(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.max("delta").alias("max_delta"), F.sum(F.col("blocked").cast("long")).alias("blocked"))
    return rounded(s, 6)


@query(f"{_L} SELECT kind, count(*) AS n, CAST(sum(CASE WHEN green + delta >= cap THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM k GROUP BY 1")
def blocked_loose(spark, sf):
    """Rows that are at the cap after the change, those that were above it before included."""
    return planned(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.sum((F.col("green") + F.col("delta") >= F.col("cap")).cast("long")).alias("blocked"))


@query(f"{_B}, g AS (SELECT kind, avg(stress) AS ms, avg(vitality) AS mv FROM p GROUP BY 1) SELECT id FROM p JOIN g USING (kind) WHERE stress > ms AND vitality < mv")
def lagging_both(spark, sf):
    return policy.lagging(plots(spark, sf), "kind", "stress", "vitality", both=True).select("id")


@query(f"{_L}, z AS (SELECT kind, id, round(delta * 3 - 2 * delta * stress, 6) AS score FROM k WHERE cap - green > 0.05 OR target_shape - shape > 0.1) SELECT kind, id, score + 0.0 AS score FROM z QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) <= 2")
def pareto_score_top2(spark, sf):
    df = policy.has_capacity(planned(spark, sf), "green", "shape", "target_shape").withColumns({"d_vitality": F.col("delta") * 3, "d_stress": F.col("delta") * F.col("stress")})
    s = policy.score(df, "d_vitality", "d_stress").withColumn("score", F.round("score", 6) + F.lit(0.0))
    return rank.top_per_group(s, ["kind"], [F.desc("score"), F.col("id")], 2).select("kind", "id", "score")


@query(f"{_L} SELECT kind, count(*) AS n, round(avg(delta), 6) AS change FROM k GROUP BY ROLLUP (kind)")
def impact_rollup(spark, sf):
    return rounded(policy.impact(planned(spark, sf).withColumn("after", F.col("green") + F.col("delta")), "kind", "green", "after"), 6)


_GAINS = f"WITH {GRID_SQL}, e AS (SELECT a.id AS src, b.id AS dst FROM grid a JOIN grid b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1), own AS (SELECT id, bal / 1000 AS own FROM grid)"


@query(f"{_GAINS}, n AS (SELECT o.id, sum(0.1 * g.bal / 1000) AS neighbours FROM own o JOIN e ON src = o.id JOIN grid g ON g.id = dst GROUP BY 1) SELECT id, round(own, 6) + 0.0 AS own, round(coalesce(neighbours, 0), 6) + 0.0 AS neighbours, round(CASE WHEN abs(own) > 0.0001 THEN coalesce(neighbours, 0) / own ELSE 0 END, 6) + 0.0 AS multiplier FROM own LEFT JOIN n USING (id)")
def spillover_multiplier(spark, sf):
    from latticework.operators.spatial import rook_edges

    g = grid(spark, sf)
    chosen = g.select("id")
    own = g.select(F.col("id").alias("source"), "id", (F.col("bal") / 1000).alias("gain"))
    edges = rook_edges(g)
    near = edges.join(chosen.withColumnRenamed("id", "src"), "src").join(g.select(F.col("id").alias("dst"), "bal"), "dst").select(F.col("src").alias("source"), F.col("dst").alias("id"), (0.1 * F.col("bal") / 1000).alias("gain"))
    return rounded(policy.spill_over(chosen, edges, own.unionByName(near)), 6)


def _tiny():
    return gat.Layer(np.array([[0.5], [0.1]]), np.array([[-0.2], [0.3]]), np.array([0.7]), np.array([[1.5]]), np.array([0.05]))


_ATT = f"""WITH {GRID_SQL}, n AS (SELECT id, bal / 10000 AS a, (id % 7) / 7.0 AS b FROM grid), e0 AS (SELECT x.id AS src, y.id AS dst, 1.0 / (1 + (x.id + y.id) % 3) AS w FROM grid x JOIN grid y ON abs(x.cx - y.cx) + abs(x.cy - y.cy) = 1),
e AS (SELECT * FROM e0 UNION ALL SELECT id, id, coalesce((SELECT avg(w) FROM e0 WHERE dst = id), 0) FROM n),
s0 AS (SELECT src, dst, 0.5 * p.a + 0.1 * p.b AS v, 0.5 * p.a + 0.1 * p.b - 0.2 * q.a + 0.3 * q.b + 0.7 * w AS m FROM e JOIN n p ON p.id = src JOIN n q ON q.id = dst), s AS (SELECT src, dst, v, 1.5 * CASE WHEN m > 0 THEN m ELSE 0.2 * m END AS s FROM s0),
al AS (SELECT src, dst, v, exp(s) / sum(exp(s)) OVER (PARTITION BY dst) AS alpha FROM s)"""


def _attended(spark, sf):
    from latticework.operators.spatial import rook_edges

    g = grid(spark, sf)
    nodes = g.select("id", F.array(F.col("bal") / 10000, (F.col("id") % 7) / 7.0).alias("x"))
    edges = rook_edges(g).withColumn("w", 1.0 / (1 + (F.col("src") + F.col("dst")) % 3))
    return nodes, edges


@query(f"{_ATT} SELECT src, dst, 0 AS head, round(alpha, 6) AS alpha FROM al")
def attention_softmax(spark, sf):
    return rounded(gat.attention(*_attended(spark, sf), _tiny()).select("src", "dst", "head", "alpha"), 6)


@query(f"{_ATT} SELECT round(avg(alpha), 6) AS mean, round(stddev_samp(alpha), 6) AS std, round(min(alpha), 6) AS least, round(max(alpha), 6) AS most, round(-sum(alpha * ln(alpha + 1e-9)), 3) AS entropy FROM al")
def attention_head_stats(spark, sf):
    a = gat.attention(*_attended(spark, sf), _tiny())
    s = a.agg(F.avg("alpha").alias("mean"), F.stddev_samp("alpha").alias("std"), F.min("alpha").alias("least"), F.max("alpha").alias("most"), F.sum(-F.col("alpha") * F.ln(F.col("alpha") + 1e-9)).alias("entropy"))
    return s.select(*(F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")), F.round("entropy", 3).alias("entropy"))


@query(f"{_ATT}, o AS (SELECT dst AS id, sum(alpha * v) + 0.05 AS z FROM al GROUP BY 1) SELECT id, round(CASE WHEN z > 0 THEN z ELSE exp(z) - 1 END, 6) + 0.0 AS h FROM o")
def gat_forward(spark, sf):
    return rounded(gat.convolve(*_attended(spark, sf), _tiny()).select("id", F.col("x")[0].alias("h")), 6)


_LIN = f"WITH {CELLS_SQL}, p AS (SELECT id, x / 8000 AS f1, y / 8000 AS f2, bal / 10000 AS f3 FROM cells), t AS (SELECT *, 2 * f1 - f2 + 0.5 * f3 + (id % 10) / 50.0 AS truth FROM p)"


def _linear(spark, sf):
    p = grid(spark, sf).select("id", (F.col("x") / 8000).alias("f1"), (F.col("y") / 8000).alias("f2"), (F.col("bal") / 10000).alias("f3"))
    return p.withColumn("truth", 2 * F.col("f1") - F.col("f2") + 0.5 * F.col("f3") + (F.col("id") % 10) / 50.0)


_PRED = "2 * {f1} - {f2} + 0.5 * {f3}"
_DROP = " UNION ALL ".join(f"SELECT '{g}' AS feature, (SELECT 1 - sum(power(truth - ({_PRED.format(f1='f1', f2='f2', f3='f3')}), 2)) / (var_pop(truth) * count(*)) FROM t) - (1 - sum(power(truth - ({_PRED.format(**{f: ('0' if f == g else f) for f in ('f1', 'f2', 'f3')})}), 2)) / (var_pop(truth) * count(*))) AS fall FROM t" for g in ("f1", "f2", "f3"))


@query(f"{_LIN} SELECT feature, round(fall, 6) AS fall FROM ({_DROP})")
def ablation_drop(spark, sf):
    """How much R2 a linear predictor loses when a feature is 0: every variant in one pass."""
    t = _linear(spark, sf)
    predict = lambda **z: 2 * z.get("f1", F.col("f1")) - z.get("f2", F.col("f2")) + 0.5 * z.get("f3", F.col("f3"))
    names = ["f1", "f2", "f3"]
    sse = lambda p: F.sum((F.col("truth") - p) * (F.col("truth") - p))
    row = t.agg(sse(predict()).alias("base"), (F.var_pop("truth") * F.count("*")).alias("sst"), *(sse(predict(**{n: F.lit(0.0)})).alias(n) for n in names))
    return rounded(row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), ((F.col(n) - F.col("base")) / F.col("sst")).alias("fall")) for n in names))).alias("e")).select("e.*"), 6)


_CURVES = [("f1", 2, "- f2 + 0.5 * f3"), ("f2", -1, "2 * f1 + 0.5 * f3"), ("f3", 0.5, "2 * f1 - f2")]
_CURVE_SQL = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(a + (b - a) * i / 49, 6) + 0.0 AS value, round({w} * (a + (b - a) * i / 49) + m, 6) + 0.0 AS mean, round(s, 6) AS std FROM (SELECT min({f}) AS a, max({f}) AS b, avg({rest}) AS m, stddev_pop({rest}) AS s FROM t), range(50) q(i)" for f, w, rest in _CURVES)


@query(f"{_LIN} {_CURVE_SQL}")
def pdp_curve(spark, sf):
    """Mean and deviation of a linear predictor with one feature held at fifty values: all of them are aggregates of one pass."""
    row = _linear(spark, sf).agg(*(a for f, _, rest in _CURVES for a in (F.min(f).alias(f"a_{f}"), F.max(f).alias(f"b_{f}"), F.avg(F.expr(rest)).alias(f"m_{f}"), F.stddev_pop(F.expr(rest)).alias(f"s_{f}"))))
    curve = lambda f, w: F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.struct(F.lit(f).alias("feature"), at(f, i).alias("value"), (w * at(f, i) + F.col(f"m_{f}")).alias("mean"), F.col(f"s_{f}").alias("std")))
    at = lambda f, i: F.col(f"a_{f}") + (F.col(f"b_{f}") - F.col(f"a_{f}")) * i / 49
    return rounded(row.select(F.explode(F.concat(*(curve(f, w) for f, w, _ in _CURVES))).alias("e")).select("e.*"), 6)


@query(f"{_LIN}, m AS (SELECT avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3 FROM t) SELECT 'place' AS grp, round(avg(abs(2 * (f1 - m1)) + abs(f2 - m2)), 6) AS importance FROM t, m UNION ALL SELECT 'money', round(avg(abs(0.5 * (f3 - m3))), 6) FROM t, m")
def shap_group_sum(spark, sf):
    """Shapley values of a linear predictor are exact: weight times the feature's distance from its mean."""
    from latticework.operators.clean import with_statistics

    wide = with_statistics(_linear(spark, sf), ["f1", "f2", "f3"], {"m": F.avg})
    phi = lambda c, w: F.abs(w * (F.col(c) - F.col(f"{c}__m")))
    row = wide.agg(F.avg(phi("f1", 2.0) + phi("f2", 1.0)).alias("place"), F.avg(phi("f3", 0.5)).alias("money"))
    return rounded(row.select(F.explode(F.array(F.struct(F.lit("place").alias("grp"), F.col("place").alias("importance")), F.struct(F.lit("money").alias("grp"), F.col("money").alias("importance")))).alias("e")).select("e.*"), 6)


@query(f"{_LIN} SELECT round(regr_intercept(truth, f1), 4) AS intercept, round(regr_slope(truth, f1), 4) AS slope FROM t")
def least_squares(spark, sf):
    b = stats.least_squares(_linear(spark, sf), ["f1"], "truth")
    return spark.createDataFrame([(round(float(b[0]), 4), round(float(b[1]), 4))], "intercept double, slope double")
