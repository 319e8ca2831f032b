"""Questions to a network of two attention layers with stated weights, each with the same network in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from latticework.operators import cluster, gat, graph, network, policy, rank, spatial, stats

from latticework.storage import written

from .registry import CELLS_SQL, GRID_SQL, cells, grid, query, rounded, table

FEATURES = ["bal", "phase", "east"]
HEADS, CHANNELS, HIDDEN = 4, 2, 2
_WIDE = HEADS * CHANNELS
#: name: rows, columns, and the rule ((i * a + j * b + c) % m - m // 2) / s of each weight; vectors have one row.
_RULES = {
    "wl1": (3, _WIDE, 7, 5, 1, 11, 10), "wr1": (3, _WIDE, 3, 7, 2, 11, 10), "we1": (1, _WIDE, 0, 5, 3, 7, 5), "wa1": (1, _WIDE, 0, 3, 1, 7, 4), "wb1": (1, _WIDE, 0, 2, 1, 5, 20),
    "wl2": (_WIDE, HIDDEN, 5, 3, 2, 11, 10), "wr2": (_WIDE, HIDDEN, 2, 5, 4, 11, 10), "we2": (1, HIDDEN, 0, 3, 2, 7, 5), "wa2": (1, HIDDEN, 0, 2, 3, 7, 4), "wb2": (1, HIDDEN, 0, 1, 1, 5, 20),
    "wo": (HIDDEN, 2, 3, 2, 1, 7, 4), "wc": (1, 2, 0, 2, 3, 7, 10),
}


def _weights(name: str) -> np.ndarray:
    rows, cols, a, b, c, m, s = _RULES[name]
    i, j = np.mgrid[0:rows, 0:cols]
    return ((i * a + j * b + c) % m - m // 2) / s


def model() -> network.Model:
    w = {n: _weights(n) for n in _RULES}
    layer = lambda k, heads: gat.Layer(w[f"wl{k}"], w[f"wr{k}"], w[f"we{k}"][0], w[f"wa{k}"].reshape(heads, -1), w[f"wb{k}"][0])
    return network.Model(layer(1, HEADS), layer(2, 1), w["wo"], w["wc"][0])


_WEIGHTS_SQL = ",\n".join(f"{n} AS (SELECT i, j, ((i * {a} + j * {b} + {c}) % {m} - {m // 2}) / {s}.0 AS w FROM range({rows}) t(i), range({cols}) u(j))" for n, (rows, cols, a, b, c, m, s) in _RULES.items())


def _layer_sql(k: int, x: str, e: str, channels: int, t: str = "") -> str:
    """CTEs of a layer: h{k}{t}(v, id, k, x) of x(v, id, k, x) over e(v, src, dst, w), and its attention al{k}{t}(v, src, dst, h, alpha)."""
    return f"""l{k}{t} AS (SELECT v, id, j, sum(x * w) AS z FROM {x} JOIN wl{k} ON i = k GROUP BY ALL), r{k}{t} AS (SELECT v, id, j, sum(x * w) AS z FROM {x} JOIN wr{k} ON i = k GROUP BY ALL),
m{k}{t} AS (SELECT e.v, e.src, e.dst, l.j, l.z AS value, l.z + r.z + e.w * we{k}.w AS m FROM {e} e JOIN l{k}{t} l ON l.v = e.v AND l.id = e.src JOIN r{k}{t} r ON r.v = e.v AND r.id = e.dst AND r.j = l.j JOIN we{k} ON we{k}.j = l.j),
s{k}{t} AS (SELECT v, src, dst, m.j // {channels} AS h, sum(w * CASE WHEN m > 0 THEN m ELSE 0.2 * m END) AS s FROM m{k}{t} m JOIN wa{k} USING (j) GROUP BY ALL),
al{k}{t} AS (SELECT v, src, dst, h, exp(s) / sum(exp(s)) OVER (PARTITION BY v, dst, h) AS alpha FROM s{k}{t}),
z{k}{t} AS (SELECT m.v, m.dst AS id, m.j AS k, sum(alpha * value) AS z FROM m{k}{t} m JOIN al{k}{t} a ON a.v = m.v AND a.src = m.src AND a.dst = m.dst AND a.h = m.j // {channels} GROUP BY ALL),
h{k}{t} AS (SELECT v, id, k, CASE WHEN z + w > 0 THEN z + w ELSE exp(z + w) - 1 END AS x FROM z{k}{t} JOIN wb{k} ON wb{k}.j = k)"""


def _net_sql(x: str, e: str, t: str = "") -> str:
    """CTEs of the network: y{t}(v, id, a, b) of x over e, which has loops."""
    return f"""{_layer_sql(1, x, e, CHANNELS, t)},
{_layer_sql(2, f"h1{t}", e, HIDDEN, t)},
y{t} AS (SELECT v, id, sum(CASE WHEN o.j = 0 THEN x * o.w END) + (SELECT w FROM wc WHERE j = 0) AS a, sum(CASE WHEN o.j = 1 THEN x * o.w END) + (SELECT w FROM wc WHERE j = 1) AS b FROM h2{t} JOIN wo o ON o.i = k GROUP BY ALL)"""


_BASE = f"""{GRID_SQL}, n AS (SELECT id, [bal / 10000, (id % 7) / 7.0, x / 8000] AS f, [bal / 5000 + cx / 40.0, (id % 10) / 10.0] AS truth FROM grid),
e0 AS (SELECT p.id AS src, q.id AS dst, 1.0 / (1 + (p.id + q.id) % 3) AS w FROM grid p JOIN grid q ON abs(p.cx - q.cx) + abs(p.cy - q.cy) = 1),
ea AS (SELECT src, dst, w FROM e0 UNION ALL SELECT id, id, coalesce(w, 0) FROM n LEFT JOIN (SELECT dst AS id, avg(w) AS w FROM e0 GROUP BY 1) USING (id)),
hs AS (SELECT id, row_number() OVER (ORDER BY (id * 48271 + 11) % 2147483647, id) - 1 AS i, count(*) OVER () AS c FROM grid),
sp AS (SELECT id, CASE WHEN i < CAST(floor(c * 0.70) AS BIGINT) THEN 'train' WHEN i < CAST(floor(c * 0.70) AS BIGINT) + CAST(floor(c * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM hs),
{_WEIGHTS_SQL}"""
_ONE = f"{_BASE}, x0 AS (SELECT 0 AS v, id, k, f[k + 1] AS x FROM n, range(3) t(k)), e AS (SELECT 0 AS v, * FROM ea), {_net_sql('x0', 'e')}"


def nodes(spark, sf):
    """The grid's cells with three features and two target variables, and a place: forty rows of the grid."""
    i = F.col("id")
    x = F.array(F.col("bal") / 10000, (i % 7) / 7.0, F.col("x") / 8000)
    truth = F.array(F.col("bal") / 5000 + F.col("cx") / 40.0, (i % 10) / 10.0)
    return grid(spark, sf).select("id", x.alias("x"), truth.alias("truth"), "kind", F.floor(F.col("cy") / 40).alias("place"))


def edges(spark, sf):
    return spatial.rook_edges(grid(spark, sf)).withColumn("w", 1.0 / (1 + (F.col("src") + F.col("dst")) % 3))


def held_out(spark, sf):
    """Truth of the test cells."""
    split = rank.hash_split(grid(spark, sf).select("id"), "id")
    return nodes(spark, sf).join(split.where("split = 'test'").select("id"), "id").select("id", "truth")


@query(f"WITH {_ONE} SELECT id, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM y")
def network_forward(spark, sf):
    y = network.predict(nodes(spark, sf), edges(spark, sf), model(), block=F.col("place"))
    return rounded(y.select("id", F.col("y")[0].alias("a"), F.col("y")[1].alias("b")), 6)


@query(f"WITH {_ONE} SELECT id, round(truth[1] - a, 6) + 0.0 AS residual_a, round(truth[2] - b, 6) + 0.0 AS residual_b FROM y JOIN n USING (id)")
def network_residuals(spark, sf):
    y = network.predict(nodes(spark, sf), edges(spark, sf), model(), block=F.col("place")).join(nodes(spark, sf).select("id", "truth"), "id")
    return rounded(y.select("id", (F.col("truth")[0] - F.col("y")[0]).alias("residual_a"), (F.col("truth")[1] - F.col("y")[1]).alias("residual_b")), 6)


_LONG = "q AS (SELECT id, 'a' AS target, truth[1] AS t, a AS p FROM y JOIN n USING (id) UNION ALL SELECT id, 'b', truth[2], b FROM y JOIN n USING (id))"


@query(f"WITH {_ONE}, {_LONG} SELECT split, target, round(sqrt(avg(power(t - p, 2))), 6) AS rmse, round(avg(abs(t - p)), 6) AS mae, round(1 - sum(power(t - p, 2)) / (var_pop(t) * count(*)), 6) AS r2 FROM q JOIN sp USING (id) GROUP BY 1, 2")
def network_metrics(spark, sf):
    """Metrics by split and target variable."""
    y = network.predict(nodes(spark, sf), edges(spark, sf), model(), block=F.col("place")).join(nodes(spark, sf).select("id", "truth"), "id")
    long = y.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("target"), F.col("truth")[k].alias("t"), F.col("y")[k].alias("p")) for k, n in enumerate("ab")))).alias("q")).select("id", "q.*")
    return rounded(stats.regression_metrics(long.join(rank.hash_split(grid(spark, sf).select("id"), "id"), "id"), "t", "p", ["split", "target"]), 6)


_R2 = "1 - sum(power(truth[1] - a, 2)) / (var_pop(truth[1]) * count(*)) AS r2_a, 1 - sum(power(truth[2] - b, 2)) / (var_pop(truth[2]) * count(*)) AS r2_b"
_TEST = "(SELECT id, truth FROM n JOIN sp USING (id) WHERE split = 'test')"


@query(f"""WITH {_BASE}, x0 AS (SELECT v, id, k, f[k + 1] AS x FROM n, range(3) t(k), range(2) u(v)), e AS (SELECT 0 AS v, * FROM ea UNION ALL SELECT 1, id, id, 0.0 FROM n), {_net_sql('x0', 'e')},
g AS (SELECT v, {_R2} FROM y JOIN {_TEST} USING (id) GROUP BY 1)
SELECT CASE v WHEN 0 THEN 'network' ELSE 'self_loops' END AS label, round(r2_a, 6) AS r2_a, round(r2_b, 6) AS r2_b, round((SELECT r2_a FROM g WHERE v = 0) - r2_a, 6) + 0.0 AS delta_a, round((SELECT r2_b FROM g WHERE v = 0) - r2_b, 6) + 0.0 AS delta_b FROM g""")
def self_loop_ablation(spark, sf):
    """The same weights with and without a graph: R2 on held-out cells, and how much less than the network's it is."""
    n, e, truth = nodes(spark, sf), edges(spark, sf), held_out(spark, sf)
    score = lambda edges_, label: network.r2_of(network.predict(n, edges_, model(), block=F.col("place")), truth, 2, []).select(F.lit(label).alias("label"), F.col("r2")[0].alias("r2_a"), F.col("r2")[1].alias("r2_b"))
    both = score(e, "network").unionByName(score(e.where("false"), "self_loops"))
    base = F.broadcast(both.where("label = 'network'").select(F.col("r2_a").alias("base_a"), F.col("r2_b").alias("base_b")))
    return rounded(both.crossJoin(base).select("label", "r2_a", "r2_b", (F.col("base_a") - F.col("r2_a")).alias("delta_a"), (F.col("base_b") - F.col("r2_b")).alias("delta_b")), 6)


_GROUPS = {"money": [0], "place": [1, 2], "bal": [0], "phase": [1], "east": [2]}
_GROUP_SQL = ", ".join(f"({v}, '{g}', {len(c)}, {c})" for v, (g, c) in enumerate(_GROUPS.items(), 1))


@query(f"""WITH {_BASE}, gr(v, feature, features, c) AS (VALUES {_GROUP_SQL}), vs AS (SELECT 0 AS v, CAST([] AS INTEGER[]) AS c UNION ALL SELECT v, c FROM gr),
x0 AS (SELECT v, id, k, CASE WHEN list_contains(c, k) THEN 0.0 ELSE f[k + 1] END AS x FROM n, range(3) t(k), vs), e AS (SELECT v, ea.* FROM ea, vs), {_net_sql('x0', 'e')},
g AS (SELECT v, {_R2} FROM y JOIN {_TEST} USING (id) GROUP BY 1)
SELECT feature, features, round((SELECT r2_a FROM g WHERE v = 0) - r2_a, 6) + 0.0 AS fall_a, round((SELECT r2_b FROM g WHERE v = 0) - r2_b, 6) + 0.0 AS fall_b FROM g JOIN gr USING (v)""")
def grouped_ablation(spark, sf):
    """Groups of features and single ones at 0."""
    out = network.ablation(nodes(spark, sf), edges(spark, sf), held_out(spark, sf), model(), _GROUPS, 3, block=F.col("place"))
    return rounded(out.select("feature", F.col("features").cast("int").alias("features"), F.col("fall_0").alias("fall_a"), F.col("fall_1").alias("fall_b")), 6)


_PERM = ", ".join(f"p{r} AS (SELECT a.id, b.f FROM (SELECT id, row_number() OVER (ORDER BY id) AS i FROM n) a JOIN (SELECT f, row_number() OVER (ORDER BY (id * 48271 + {11 + 7919 * r}) % 2147483647, id) AS i FROM n) b USING (i))" for r in range(3))


@query(f"""WITH {_BASE}, {_PERM}, ps AS (SELECT 0 AS r, * FROM p0 UNION ALL SELECT 1, * FROM p1 UNION ALL SELECT 2, * FROM p2),
x0 AS (SELECT 0 AS v, id, k, f[k + 1] AS x FROM n, range(3) t(k) UNION ALL SELECT 1 + 3 * i + r, n.id, k, CASE WHEN k = i THEN ps.f[k + 1] ELSE n.f[k + 1] END FROM n JOIN ps USING (id), range(3) t(k), range(3) u(i)),
e AS (SELECT v, ea.* FROM ea, range(10) u(v)), {_net_sql('x0', 'e')}, g AS (SELECT v, {_R2} FROM y JOIN {_TEST} USING (id) GROUP BY 1)
SELECT ['bal', 'phase', 'east'][(v - 1) // 3 + 1] AS feature, round(avg((SELECT r2_a FROM g WHERE v = 0) - r2_a), 6) + 0.0 AS fall_a, round(avg((SELECT r2_b FROM g WHERE v = 0) - r2_b), 6) + 0.0 AS fall_b FROM g WHERE v > 0 GROUP BY 1""")
def permutation_importance(spark, sf):
    out = network.permutation_importance(nodes(spark, sf), edges(spark, sf), held_out(spark, sf), model(), FEATURES, block=F.col("place"))
    return rounded(out.select("feature", F.col("fall_0").alias("fall_a"), F.col("fall_1").alias("fall_b")), 6)


@query(f"""WITH {_BASE}, lim AS (SELECT k AS i, min(f[k + 1]) AS lo, max(f[k + 1]) AS hi FROM n, range(3) t(k) GROUP BY 1), vs AS (SELECT 50 * i + p AS v, i, p, lo + (hi - lo) * p / 49 AS value FROM lim, range(50) u(p)),
x0 AS (SELECT v, id, k, CASE WHEN k = i THEN value ELSE f[k + 1] END AS x FROM n, range(3) t(k), vs), e AS (SELECT v, ea.* FROM ea, vs), {_net_sql('x0', 'e')}
SELECT ['bal', 'phase', 'east'][i + 1] AS feature, CAST(p AS INT) AS point, round(value, 6) + 0.0 AS value, round(avg(a), 6) + 0.0 AS mean_a, round(stddev_pop(a), 6) + 0.0 AS std_a, round(avg(b), 6) + 0.0 AS mean_b, round(stddev_pop(b), 6) + 0.0 AS std_b
FROM y JOIN vs USING (v) GROUP BY i, p, value""")
def partial_dependence(spark, sf):
    """Fifty points of each feature, through the network."""
    out = network.partial_dependence(nodes(spark, sf), edges(spark, sf), model(), FEATURES, F.col("place"))
    return rounded(out.select("feature", F.col("point").cast("int").alias("point"), "value", F.col("mean_0").alias("mean_a"), F.col("std_0").alias("std_a"), F.col("mean_1").alias("mean_b"), F.col("std_1").alias("std_b")), 6)


_PHI = lambda i, t: " + ".join(f"{network.factorial(m.bit_count()) * network.factorial(2 - m.bit_count()) / 6} * (max(CASE WHEN v = {m | 1 << i} THEN {t} END) - max(CASE WHEN v = {m} THEN {t} END))" for m in range(8) if not m >> i & 1)
_SHAP = f"""{_BASE}, me AS (SELECT k AS i, avg(f[k + 1]) AS m FROM n, range(3) t(k) GROUP BY 1), x0 AS (SELECT v, id, k, CASE WHEN (v >> k) & 1 = 1 THEN f[k + 1] ELSE m END AS x FROM n, range(3) t(k), range(8) u(v), me WHERE i = k),
e AS (SELECT v, id AS src, id AS dst, 0.0 AS w FROM n, range(8) u(v)), {_net_sql('x0', 'e')},
ph AS ({" UNION ALL ".join(f"SELECT id, '{n}' AS feature, {_PHI(i, 'a')} AS a, {_PHI(i, 'b')} AS b FROM y GROUP BY id" for i, n in enumerate(FEATURES))})"""


@query(f"WITH {_SHAP} SELECT id, feature, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM ph")
def shapley_values(spark, sf):
    out = network.shapley(nodes(spark, sf), model(), FEATURES)
    return rounded(out.select("id", "feature", F.col("phi")[0].alias("a"), F.col("phi")[1].alias("b")), 6)


@query(f"WITH {_SHAP}, s AS (SELECT id, CASE feature WHEN 'bal' THEN 'money' ELSE 'place' END AS grp, sum(abs(a)) AS a, sum(abs(b)) AS b FROM ph GROUP BY 1, 2) SELECT grp, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM s GROUP BY 1")
def shapley_group_means(spark, sf):
    """The mean over cells of each group's summed sizes of Shapley values."""
    phi = network.shapley_rows(nodes(spark, sf), model(), len(FEATURES))
    size = lambda i, k: F.abs(F.col("phi")[i][k])
    per = {"money": [0], "place": [1, 2]}
    groups = F.array(*(F.struct(F.lit(g).alias("grp"), *(stats.total([size(i, k) for i in cols]).alias(n) for k, n in enumerate("ab"))) for g, cols in per.items()))
    return rounded(phi.select(F.explode(groups).alias("e")).select("e.*").groupBy("grp").agg(F.avg("a").alias("a"), F.avg("b").alias("b")), 6)


_KINDS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"WITH {_ONE}, m AS (SELECT src, dst, avg(alpha) AS alpha FROM al1 GROUP BY 1, 2) SELECT p.kind AS src_kind, " + ", ".join(f"round(avg(CASE WHEN q.kind = '{k}' THEN alpha END), 6) AS {k.lower()}" for k in _KINDS) + " FROM m JOIN grid p ON p.id = src JOIN grid q ON q.id = dst GROUP BY 1")
def attention_by_kind(spark, sf):
    """Mean attention (over heads) by the kinds of both ends."""
    a = network.mean_attention(nodes(spark, sf), edges(spark, sf), model(), F.col("place"), ("kind",))
    return rounded(a.groupBy("src_kind").pivot("dst_kind", _KINDS).agg(F.avg("alpha")).withColumnsRenamed({k: k.lower() for k in _KINDS}), 6)


_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
_WIDE_E = f"""{_BASE}, g0 AS (SELECT p.id AS src, q.id AS dst, exp(-(power(p.x - q.x, 2) + power(p.y - q.y, 2)) / 80000.0) AS w FROM grid p JOIN grid q ON p.id <> q.id AND abs(p.cx - q.cx) <= 3 AND abs(p.cy - q.cy) <= 3 WHERE power(p.x - q.x, 2) + power(p.y - q.y, 2) <= 360000),
g1 AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM g0), e AS (SELECT 0 AS v, src, dst, w FROM g1 UNION ALL SELECT 0, dst, dst, avg(w) FROM g1 GROUP BY dst),
x0 AS (SELECT 0 AS v, id, k, f[k + 1] AS x FROM n, range(3) t(k)), {_layer_sql(1, 'x0', 'e', CHANNELS)},
m AS (SELECT round(avg(alpha), 9) AS alpha, round(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)), 6) AS d FROM al1 JOIN grid p ON p.id = src JOIN grid q ON q.id = dst GROUP BY src, dst, p.x, p.y, q.x, q.y)"""


@query(f"WITH {_WIDE_E}, r AS (SELECT alpha, d, {_AVG_RANK.format('d')} AS a, {_AVG_RANK.format('alpha')} AS b FROM m) SELECT round(corr(a, b), 6) AS spearman, round(regr_slope(alpha, d), 9) AS slope, round(regr_intercept(alpha, d), 6) AS intercept, count(*) AS n, CASE WHEN abs(corr(a, b)) * sqrt((count(*) - 2) / (1 - power(corr(a, b), 2))) > 3.3 THEN '***' ELSE '-' END AS stars FROM r")
def attention_distance(spark, sf):
    """Rank correlation (with its significance) and line of attention against distance, over all edges within 600 m and loops."""
    from latticework.functions.expr import stars

    g = grid(spark, sf)
    n = nodes(spark, sf).join(g.select("id", F.col("x").alias("px"), F.col("y").alias("py")), "id")
    a = network.mean_attention(n, graph.gaussian_edges(g), model(), F.col("place"), ("px", "py"))
    apart = F.sqrt(F.pow(F.col("src_px") - F.col("dst_px"), F.lit(2.0)) + F.pow(F.col("src_py") - F.col("dst_py"), F.lit(2.0)))
    m = written(a.select(F.round("alpha", 9).alias("alpha"), F.round(apart, 6).alias("d")), "attention")
    r = stats.with_p(stats.spearman(m, "d", "alpha"))
    line = stats.ols_line(m, "alpha", "d")
    s = stars(F.col("p"))
    return r.crossJoin(F.broadcast(line)).select(F.round("r", 6).alias("spearman"), F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), "n", F.when(s == "***", s).otherwise("-").alias("stars"))


_PLOT = "p AS (SELECT id, kind, x / 8000 AS built, (id % 97) / 97.0 AS green, (id % 31) / 10.0 AS shape, bal / 1000 AS stress, (id % 13) / 13.0 AS vitality FROM grid)"
_SIM = f"""{_BASE}, {_PLOT}, g AS (SELECT kind, avg(stress) AS ms, avg(vitality) AS mv FROM p GROUP BY 1), lag AS (SELECT p.id, p.kind FROM p JOIN g USING (kind) WHERE stress > ms OR vitality < mv),
mo AS (SELECT id, kind, built, CASE WHEN l.id IS NULL THEN green ELSE least(green + 0.15, 0.8 * (1 - built)) END AS green, CASE WHEN l.id IS NULL THEN shape ELSE shape + 0.4 END AS shape, l.id IS NOT NULL AS moved FROM p LEFT JOIN lag l USING (id, kind)),
st AS (SELECT avg(green) AS m0, stddev_samp(green) AS s0, avg(built) AS m1, stddev_samp(built) AS s1, avg(shape) AS m2, stddev_samp(shape) AS s2, avg(stress) AS ma, stddev_samp(stress) AS sa, avg(vitality) AS mb, stddev_samp(vitality) AS sb FROM p),
fs AS (SELECT 0 AS v, id, [(green - m0) / s0, (built - m1) / s1, (shape - m2) / s2] AS f FROM p, st UNION ALL SELECT 1, id, [(green - m0) / s0, (built - m1) / s1, (shape - m2) / s2] FROM mo, st),
x0 AS (SELECT v, id, k, f[k + 1] AS x FROM fs, range(3) t(k)), e AS (SELECT v, ea.* FROM ea, range(2) u(v)), {_net_sql('x0', 'e')}, u AS (SELECT v, id, a * sa + ma AS a, b * sb + mb AS b FROM y, st)"""


@query(f"""WITH {_SIM}, w AS (SELECT kind, count(*) AS n, CAST(sum(CASE WHEN moved THEN 1 ELSE 0 END) AS BIGINT) AS moved, avg(o.a) AS a0, avg(q.a) AS a1, avg(o.b) AS b0, avg(q.b) AS b1 FROM mo JOIN u o ON o.id = mo.id AND o.v = 0 JOIN u q ON q.id = mo.id AND q.v = 1 GROUP BY 1)
SELECT kind, n, moved, round(a0, 6) + 0.0 AS stress_before, round(a1, 6) + 0.0 AS stress_after, round(100 * (a1 - a0) / abs(a0), 4) + 0.0 AS stress_pct, round(b0, 6) + 0.0 AS vitality_before, round(b1, 6) + 0.0 AS vitality_after, round(100 * (b1 - b0) / abs(b0), 4) + 0.0 AS vitality_pct FROM w""")
def what_if_simulation(spark, sf):
    """Lagging cells get more green, as far as built-up land leaves room, and more edges; features are standardised by what they were before, predictions brought back to units."""
    from latticework.functions.expr import percent_change

    i = F.col("id")
    p = grid(spark, sf).select("id", "kind", (F.col("x") / 8000).alias("built"), ((i % 97) / 97.0).alias("green"), ((i % 31) / 10.0).alias("shape"), (F.col("bal") / 1000).alias("stress"), ((i % 13) / 13.0).alias("vitality"))
    lag = policy.lagging(p, "kind", "stress", "vitality").select("id", F.lit(True).alias("moved"))
    both = p.join(lag, "id", "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    names = ["green", "built", "shape"]
    st = p.agg(*(f(c).alias(f"{n}_{c}") for c in (*names, "stress", "vitality") for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = lambda c, v: (v - F.col(f"m_{c}")) / F.col(f"s_{c}")
    before = F.array(*(z(c, F.col(c)) for c in names))
    green = F.when(F.col("moved"), F.least(F.col("green") + 0.15, 0.8 * (1 - F.col("built")))).otherwise(F.col("green"))
    after = F.array(z("green", green), z("built", F.col("built")), z("shape", F.when(F.col("moved"), F.col("shape") + 0.4).otherwise(F.col("shape"))))
    variants = both.crossJoin(F.broadcast(st)).select("id", F.posexplode(F.array(before, after)).alias("variant", "x"))
    y = network.predict_variants(variants, edges(spark, sf), model()).crossJoin(F.broadcast(st)).select("variant", "id", (F.col("y")[0] * F.col("s_stress") + F.col("m_stress")).alias("a"), (F.col("y")[1] * F.col("s_vitality") + F.col("m_vitality")).alias("b"))
    of = lambda v, c: F.avg(F.when(F.col("variant") == v, F.col(c)))
    w = y.join(both.select("id", "kind", "moved"), "id").groupBy("kind").agg(F.countDistinct("id").alias("n"), F.sum(F.when((F.col("variant") == 0) & F.col("moved"), 1).otherwise(0)).alias("moved"), of(0, "a").alias("stress_before"), of(1, "a").alias("stress_after"), of(0, "b").alias("vitality_before"), of(1, "b").alias("vitality_after"))
    pct = lambda c: F.round(percent_change(F.col(f"{c}_after"), F.col(f"{c}_before")), 4).alias(f"{c}_pct")
    return rounded(w.select("kind", "n", "moved", "stress_before", "stress_after", pct("stress"), "vitality_before", "vitality_after", pct("vitality")), 6)


#: Both ends of the grid's roles, by distance from a corner: the graph's degrees are all alike.
_TARGETS = "tg AS (SELECT id, CASE WHEN id % 97 = 0 THEN 'hub' ELSE 'peripheral' END AS role FROM grid WHERE id % 97 IN (0, 50))"
_SHIFTED = """near AS (SELECT t.id AS t, g.id FROM {tg} t JOIN grid c ON c.id = t.id JOIN grid g ON abs(g.cx - c.cx) + abs(g.cy - c.cy) <= 4),
x1 AS (SELECT t AS v, id, k, f[k + 1] + CASE WHEN id = t THEN {shift} ELSE 0 END AS x FROM near JOIN n USING (id), range(3) u(k)), e1 AS (SELECT p.t AS v, ea.* FROM ea JOIN near p ON p.id = src JOIN near q ON q.id = dst AND q.t = p.t)"""


def _targets(spark, sf):
    i = F.col("id") % 97
    return grid(spark, sf).where(i.isin(0, 50)).select("id", F.when(i == 0, "hub").otherwise("peripheral").alias("role"))


_GAIN = "gn AS (SELECT y1.v AS t, -sum(CASE WHEN y1.id = y1.v THEN y1.a - y.a ELSE 0 END) AS own_a, -sum(CASE WHEN y1.id <> y1.v THEN y1.a - y.a ELSE 0 END) AS near_a, sum(CASE WHEN y1.id = y1.v THEN y1.b - y.b ELSE 0 END) AS own_b, sum(CASE WHEN y1.id <> y1.v THEN y1.b - y.b ELSE 0 END) AS near_b FROM y1 JOIN y ON y.id = y1.id JOIN ea ON ea.src = y1.v AND ea.dst = y1.id GROUP BY 1)"
_RATIO = lambda t: f"round(CASE WHEN abs(sum(own_{t})) > 0.0001 THEN sum(near_{t}) / sum(own_{t}) ELSE 0 END, 4) + 0.0 AS multiplier_{t}"


@query(f"WITH {_ONE}, {_TARGETS}, {_SHIFTED.format(tg='tg', shift='CASE k WHEN 0 THEN 1.0 ELSE 0 END')}, {_net_sql('x1', 'e1', '1')}, {_GAIN} SELECT role, count(*) AS n, round(sum(own_a), 6) + 0.0 AS own_a, round(sum(near_a), 6) + 0.0 AS near_a, round(sum(own_b), 6) + 0.0 AS own_b, round(sum(near_b), 6) + 0.0 AS near_b, {_RATIO('a')}, {_RATIO('b')} FROM gn JOIN tg ON tg.id = t GROUP BY 1")
def spillover_network(spark, sf):
    """One feature of one cell rises by 1: what its own predictions gain, and those of its neighbours, by role, through the network."""
    targets = _targets(spark, sf)
    g = network.shift_gains(targets, nodes(spark, sf), edges(spark, sf), model(), {0: 1.0}, 3, (-1.0, 1.0)).join(targets.withColumnRenamed("id", "target"), "target")
    s = g.groupBy("role").agg(F.count("*").alias("n"), *(F.sum(f"{w}_{k}").alias(f"{w}_{t}") for k, t in enumerate("ab") for w in ("own", "near")))
    ratio = lambda t: F.round(F.when(F.abs(f"own_{t}") > 0.0001, F.col(f"near_{t}") / F.col(f"own_{t}")).otherwise(0.0), 4).alias(f"multiplier_{t}")
    return rounded(s.select("role", "n", "own_a", "near_a", "own_b", "near_b", ratio("a"), ratio("b")), 6)


_POOL = "tg AS (SELECT id FROM grid ORDER BY (id * 48271 + 11) % 2147483647, id LIMIT 800)"


@query(f"WITH {_ONE}, {_POOL}, {_SHIFTED.format(tg='tg', shift='CASE WHEN k < 2 THEN 3.0 ELSE 0 END')}, {_net_sql('x1', 'e1', '1')}, {_GAIN} SELECT t AS target, round(own_a + near_a, 6) + 0.0 AS metric FROM gn ORDER BY round(own_a + near_a, 9) DESC, t LIMIT 3")
def champion_scan(spark, sf):
    """Of a pool of at most 800 cells the three whose probe (+3 on two features) gains most, their neighbours' gains included."""
    pool = rank.hash_sample(grid(spark, sf).select("id"), "id", 800)
    gains = network.shift_gains(pool, nodes(spark, sf), edges(spark, sf), model(), {0: 3.0, 1: 3.0}, 3, (-1.0, 1.0))
    return rounded(network.champions(gains, 0).select("target", "metric"), 6)


@query()
def network_optimizer(spark, sf):
    """Shifts of two features for the three champions: a hundred candidates, fifty generations, the mean of three runs."""
    return _optimised(spark, sf)


def _optimised(spark, sf, **options):
    pool = rank.hash_sample(grid(spark, sf).select("id"), "id", 800)
    n, e = nodes(spark, sf), edges(spark, sf)
    best = network.champions(network.shift_gains(pool, n, e, model(), {0: 3.0, 1: 3.0}, 3, (-1.0, 1.0)), 0).select(F.col("target").alias("id"))
    out = network.optimise(best, n, e, model(), [0, 1], _BOUNDS, main=0, weights=(10.0, 1.0), signs=(-1.0, 1.0), **options)
    return rounded(out.select("target", F.col("genes")[0].alias("shift_bal"), F.col("genes")[1].alias("shift_phase"), "value"), 4)


_SEARCH = {"population": 20, "generations": 4, "elite": 5, "mutation": 0.3}
_BOUNDS = [(1.0, 4.0), (0.5, 3.5)]


def _drawn(name: str, source: str, generation: int, ks: list[int]) -> str:
    """policy.draw of source(id, run, c, ...) as u{k} for each k."""
    p = policy._PRIME
    square = lambda h, c: f"({h} * {h} + {c}) % {p}"
    first = ", ".join(f"(id % {p} * 48271 + run * 69621 + {generation * 16807 + k * 131 + 11} + c * 8191) % {p} AS a{k}" for k in ks)
    second, third = ", ".join(f"{square(f'a{k}', 7)} AS b{k}" for k in ks), ", ".join(f"(b{k} * 48271 + 3) % {p} AS d{k}" for k in ks)
    return f"{name} AS (SELECT *, {', '.join(f'({square(f"d{k}", 13)}) / {p}.0::DOUBLE AS u{k}' for k in ks)} FROM (SELECT *, {third} FROM (SELECT *, {second} FROM (SELECT *, {first} FROM {source}))))"


def _generations(start: str, options: dict, value: Callable[[int], list[str]]) -> list[str]:
    """evolve() for start(id, run): CTEs pop{step}(id, run, c, g0, g1), what value(step) adds, which ends with val{step}(id, run, c, g0, g1, value), and o{step}, these in order."""
    n, elite = options["population"], options["elite"]
    ctes = [_drawn("q0", f"(SELECT id, run, c FROM {start}, range({n}) t(c))", 0, [0, 1])]
    ctes += ["pop0 AS MATERIALIZED (SELECT id, run, c, " + ", ".join(f"round({lo} + ({hi} - {lo}) * u{k}, 9) AS g{k}" for k, (lo, hi) in enumerate(_BOUNDS)) + " FROM q0)"]
    for step in range(options["generations"]):
        ctes += value(step)
        ctes += [f"o{step} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY round(value, 9) DESC, c) - 1 AS place FROM val{step})"]
        if step < options["generations"] - 1:
            ctes += [_drawn(f"q{step + 1}", f"(SELECT id, run, c FROM pop{step} WHERE c >= {elite})", step + 1, [100, 101, 102, 103, 104])]
            move = lambda k: f"least({_BOUNDS[k][1]}, greatest({_BOUNDS[k][0]}, o.g{k} + CASE WHEN u101 < {options['mutation']} AND floor(u102 * 2) = {k} THEN 0.5 * sqrt(-2 * ln(greatest(u103, 1e-9))) * cos(2 * pi() * u104) ELSE 0 END))"
            ctes += [f"pop{step + 1} AS MATERIALIZED (SELECT id, run, place AS c, g0, g1 FROM o{step} WHERE place < {elite} UNION ALL SELECT q.id, q.run, q.c, round({move(0)}, 9), round({move(1)}, 9) FROM q{step + 1} q JOIN o{step} o ON o.id = q.id AND o.run = q.run AND o.place = floor(u100 * {max(1, n // 2)}))"]
    return ctes


def _search_sql() -> str:
    """All cells at once, by the network of a cell alone."""
    m = model()
    elu = lambda e: f"(CASE WHEN {e} > 0 THEN {e} ELSE exp({e}) - 1 END)"
    lines = lambda xs: ", ".join(xs)

    def valued(name: str, source: str) -> str:
        """source(id, c, g0, g1, f, ...) with y0, y1 of the network of a cell alone, its features moved by the genes."""
        x = ["(f[1] + g0)", "(f[2] + g1)", "f[3]"]
        h = lines(f"{elu('(' + ' + '.join(f'{x[i]} * {float(m.first.left[i, k])!r}' for i in range(3)) + f' + {float(m.first.bias[k])!r})')} AS h{k}" for k in range(_WIDE))
        g = lines(f"{elu('(' + ' + '.join(f'h{i} * {float(m.second.left[i, k])!r}' for i in range(_WIDE)) + f' + {float(m.second.bias[k])!r})')} AS z{k}" for k in range(HIDDEN))
        y = lines(f"z0 * {float(m.weight[0, t])!r} + z1 * {float(m.weight[1, t])!r} + {float(m.bias[t])!r} AS y{t}" for t in range(2))
        return f"{name} AS (SELECT id, run, c, g0, g1, {y} FROM (SELECT *, {g} FROM (SELECT *, {h} FROM {source})))"

    ctes = [f"{GRID_SQL}, n AS (SELECT id, 42 AS run, [bal / 10000, (id % 7) / 7.0, x / 8000] AS f FROM grid)", "k0 AS (SELECT id, run, 0 AS c, 0.0 AS g0, 0.0 AS g1, f FROM n)", valued("base", "k0")]
    ctes += _generations("n", _SEARCH, lambda k: [valued(f"y{k}", f"(SELECT pop{k}.*, f FROM pop{k} JOIN n USING (id))"), f"val{k} AS (SELECT y.id, y.run, y.c, y.g0, y.g1, (y.y1 - base.y1) - 2 * (y.y0 - base.y0) AS value FROM y{k} y JOIN base USING (id))"])
    return f"WITH {', '.join(ctes)} SELECT id, round(g0, 4) AS shift_bal, round(g1, 4) AS shift_phase, round(value, 6) + 0.0 AS gain FROM o{_SEARCH['generations'] - 1} WHERE place = 0"


@query(_search_sql())
def genetic_search(spark, sf):
    """For each cell the shifts of two features that gain most by the network of a cell alone (the second target's rise less twice the first's): twenty candidates, four generations."""
    from latticework.operators.explain import alone

    predict = alone(model())

    def fitness(x, genes):
        moved = np.tile(x, (len(genes) + 1, 1))
        moved[1:, :2] += genes
        y = predict(moved)
        return (y[1:, 1] - y[0, 1]) - 2 * (y[1:, 0] - y[0, 0])

    found = policy.genetic_search(nodes(spark, sf).select("id", F.col("x").alias("context")), fitness, _BOUNDS, **_SEARCH)
    return found.select("id", F.round(F.col("genes")[0], 4).alias("shift_bal"), F.round(F.col("genes")[1], 4).alias("shift_phase"), (F.round("best", 6) + F.lit(0.0)).alias("gain"))


_FEW = {"population": 12, "generations": 3, "elite": 3, "mutation": 0.4}


def _optimizer_sql() -> str:
    """The champions' searches: every candidate of every run is a variant of its target's surroundings."""
    v = "p.id * 10000 + (p.run - 42) * 1000 + p.c"

    def value(k: int) -> list[str]:
        return [
            f"xs{k} AS (SELECT {v} AS v, nb.id, k, f[k + 1] + CASE WHEN nb.id = p.id THEN CASE k WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE 0 END ELSE 0 END AS x FROM pop{k} p JOIN nb ON nb.t = p.id JOIN n ON n.id = nb.id, range(3) u(k))",
            f"es{k} AS (SELECT {v} AS v, ea.* FROM pop{k} p JOIN nb a ON a.t = p.id JOIN nb b ON b.t = p.id JOIN ea ON ea.src = a.id AND ea.dst = b.id)",
            _net_sql(f"xs{k}", f"es{k}", f"_s{k}"),
            f"val{k} AS (SELECT p.id, p.run, p.c, g0, g1, sum(-10 * (z.a - y.a)) + sum(CASE WHEN z.id = p.id THEN z.b - y.b ELSE 0 END) AS value FROM pop{k} p JOIN y_s{k} z ON z.v = {v} JOIN y ON y.id = z.id JOIN ea ON ea.src = p.id AND ea.dst = z.id GROUP BY ALL)",
        ]

    champion = f"{_POOL}, {_SHIFTED.format(tg='tg', shift='CASE WHEN k < 2 THEN 3.0 ELSE 0 END')}, {_net_sql('x1', 'e1', '1')}, {_GAIN}, top AS MATERIALIZED (SELECT t AS id FROM gn ORDER BY round(own_a + near_a, 9) DESC, t LIMIT 3)"
    around = "nb AS MATERIALIZED (SELECT t.id AS t, g.id FROM top t JOIN grid c ON c.id = t.id JOIN grid g ON abs(g.cx - c.cx) + abs(g.cy - c.cy) <= 4), runs AS (SELECT id, run FROM top, range(42, 45) r(run))"
    last = _FEW["generations"] - 1
    return f"WITH {_ONE}, {champion}, {around}, {', '.join(_generations('runs', _FEW, value))} SELECT id AS target, round(avg(g0), 4) AS shift_bal, round(avg(g1), 4) AS shift_phase, round(avg(value), 4) + 0.0 AS value FROM o{last} WHERE place = 0 GROUP BY id"


@query(_optimizer_sql())
def network_optimizer_few(spark, sf):
    """As network_optimizer, with twelve candidates and three generations, so that SQL can follow."""
    return _optimised(spark, sf, **_FEW)


_CENTRAL = "ce AS (SELECT kind, avg(x) AS mx, avg(y) AS my FROM grid GROUP BY 1), nb AS (SELECT kind, arg_min(id, (round(power(x - mx, 2) + power(y - my, 2), 6), id)) AS id FROM grid JOIN ce USING (kind) GROUP BY 1)"


@query(f"WITH {GRID_SQL}, {_CENTRAL} SELECT kind, id FROM nb")
def centroid_nearest(spark, sf):
    """The cell nearest to each kind's centre."""
    return cluster.nearest_to_centre(grid(spark, sf), ["x", "y"], "kind").select("kind", "id")


@query(f"""WITH {_ONE}, {_CENTRAL}, near AS (SELECT t.id AS t, g.id FROM nb t JOIN grid c ON c.id = t.id JOIN grid g ON abs(g.cx - c.cx) + abs(g.cy - c.cy) <= 4), et AS (SELECT p.t, ea.* FROM ea JOIN near p ON p.id = src JOIN near q ON q.id = dst AND q.t = p.t),
gone AS (SELECT et.t, et.src AS s, et.dst AS d FROM et JOIN ea h ON h.dst = et.t AND h.src = et.dst WHERE et.src <> et.dst), vs AS (SELECT *, row_number() OVER (ORDER BY t, s, d) AS v FROM gone),
x1 AS (SELECT v, id, k, f[k + 1] AS x FROM vs JOIN near USING (t) JOIN n USING (id), range(3) u(k)), e1 AS (SELECT v, src, dst, w FROM vs JOIN et USING (t) WHERE NOT (src = s AND dst = d)), {_net_sql('x1', 'e1', '1')},
ch AS (SELECT t, s, d, abs(y1.a - y.a) + abs(y1.b - y.b) AS c FROM y1 JOIN vs USING (v) JOIN y ON y.id = y1.id WHERE y1.id = t)
SELECT t AS target, s AS src, d AS dst, round(c, 6) + 0.0 AS change, CAST(row_number() OVER (PARTITION BY t ORDER BY round(c, 9) DESC, s, d) AS INT) AS pos FROM ch QUALIFY pos <= 10""")
def edge_occlusion(spark, sf):
    """The ten edges that matter most for the cell nearest to each kind's centre."""
    targets = cluster.nearest_to_centre(grid(spark, sf), ["x", "y"], "kind").select("id")
    return rounded(network.edge_occlusion(targets, nodes(spark, sf), edges(spark, sf), model()), 6)


_CELL_NUM = f"WITH {CELLS_SQL}, c AS (SELECT spend / 1000000 AS f1, n_orders / 10.0 AS f2, bal / 1000 AS t1, qty / 10 AS t2 FROM cells WHERE spend IS NOT NULL AND qty IS NOT NULL), s AS (SELECT avg(f1) AS m1, avg(f2) AS m2, var_pop(f1) AS v1, var_pop(f2) AS v2, covar_pop(f1, f2) AS c12, avg(t1) AS y1, avg(t2) AS y2, covar_pop(f1, t1) AS a1, covar_pop(f2, t1) AS a2, covar_pop(f1, t2) AS b1, covar_pop(f2, t2) AS b2 FROM c), w AS (SELECT *, (a1 * v2 - a2 * c12) / (v1 * v2 - c12 * c12) AS p1, (a2 * v1 - a1 * c12) / (v1 * v2 - c12 * c12) AS p2, (b1 * v2 - b2 * c12) / (v1 * v2 - c12 * c12) AS q1, (b2 * v1 - b1 * c12) / (v1 * v2 - c12 * c12) AS q2 FROM s)"


@query(f"{_CELL_NUM} SELECT 't1' AS target, round(y1 - p1 * m1 - p2 * m2, 4) + 0.0 AS intercept, round(p1, 4) + 0.0 AS f1, round(p2, 4) + 0.0 AS f2 FROM w UNION ALL SELECT 't2', round(y2 - q1 * m1 - q2 * m2, 4) + 0.0, round(q1, 4) + 0.0, round(q2, 4) + 0.0 FROM w")
def least_squares_targets(spark, sf):
    """Two features, two target variables, by the normal equations."""
    c = cells(spark, sf).where("spend IS NOT NULL AND qty IS NOT NULL").select((F.col("spend") / 1000000).alias("f1"), (F.col("n_orders") / 10.0).alias("f2"), (F.col("bal") / 1000).alias("t1"), (F.col("qty") / 10).alias("t2"))
    out = [(t, *(round(float(v), 4) + 0.0 for v in stats.least_squares(c, ["f1", "f2"], t))) for t in ("t1", "t2")]
    return spark.createDataFrame(out, "target string, intercept double, f1 double, f2 double")


@query("WITH c AS (SELECT o_custkey AS q, o_orderkey FROM orders), g AS (SELECT s_suppkey AS q, s_acctbal AS lat, s_nationkey AS lon FROM supplier) SELECT o_orderkey, lat, CAST(lon AS INT) AS lon FROM c JOIN g USING (q)")
def lookup_drop_misses(spark, sf):
    """A query's place from a cache of places; queries that the cache doesn't have are dropped."""
    cache = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("q"), F.col("s_acctbal").alias("lat"), F.col("s_nationkey").alias("lon"))
    found = table(spark, sf, "orders").select(F.col("o_custkey").alias("q"), "o_orderkey").join(cache, "q", "left")
    return found.dropna(subset=["lat", "lon"]).select("o_orderkey", "lat", "lon")
