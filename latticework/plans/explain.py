"""Training on fifteen features, and explanations of networks: Shapley values of fifteen features, learned masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latticework.operators import cluster, explain, gat, network, rank, stats, training
from latticework.plans import network as net

from .registry import CELLS_SQL, cells, grid, query, rounded

FIFTEEN = ["bal", "phase", "east", "north", "orders", "spend", "qty", "disc", "tax", "price", "nation", "by5", "by11", "by13", "edge"]
_COLUMNS = [
    "bal / 10000", "(id % 7) / 7.0", "x / 8000", "y / 8000", "coalesce(n_orders, 0) / 30.0", "coalesce(spend, 0) / 3000000", "coalesce(qty, 0) / 50", "coalesce(disc, 0) * 10", "coalesce(tax, 0) * 10",
    "coalesce(price, 0) / 100000", "nation / 25.0", "(id % 5) / 5.0", "(id % 11) / 11.0", "(id % 13) / 13.0", "abs(x - 4000) / 4000",
]
CENTRES, CENTRE_STEPS, COALITIONS = 50, 6, 128


def fifteen(spark, sf):
    """Cells with fifteen features to six places."""
    return cells(spark, sf).select("id", "kind", F.array(*(F.round(F.expr(c).cast("double"), 6) for c in _COLUMNS)).alias("x"))


def _rule(rows: int, cols: int, a: int, b: int, c: int, m: int, s: int) -> np.ndarray:
    i, j = np.mgrid[0:rows, 0:cols]
    return ((i * a + j * b + c) % m - m // 2) / s


def wide_model() -> network.Model:
    """A network of fifteen features with stated weights."""
    first = gat.Layer(_rule(15, 8, 7, 5, 1, 11, 10), _rule(15, 8, 3, 7, 2, 11, 10), _rule(1, 8, 0, 5, 3, 7, 5)[0], _rule(1, 8, 0, 3, 1, 7, 4).reshape(4, 2), _rule(1, 8, 0, 2, 1, 5, 20)[0])
    second = gat.Layer(_rule(8, 2, 5, 3, 2, 11, 10), _rule(8, 2, 2, 5, 4, 11, 10), _rule(1, 2, 0, 3, 2, 7, 5)[0], _rule(1, 2, 0, 2, 3, 7, 4), _rule(1, 2, 0, 1, 1, 5, 20)[0])
    return network.Model(first, second, _rule(2, 2, 3, 2, 1, 7, 4), _rule(1, 2, 0, 2, 3, 7, 10)[0])


def background(spark, sf):
    """Centres of fifty clusters and how many cells each has."""
    flat = fifteen(spark, sf).select("id", *(F.col("x")[k].alias(n) for k, n in enumerate(FIFTEEN)))
    start = cluster.hashed_starts(flat, FIFTEEN, CENTRES, 1)
    ((centres, n, _),) = cluster.lloyd(flat, FIFTEEN, start, CENTRE_STEPS)
    return centres, n


def _sql() -> str:
    m = wide_model()
    z, w = explain.coalitions(15, COALITIONS)
    solve = explain.solver(z, w)
    z = np.r_[z, np.ones((1, 15))]  # the full coalition is the last
    present = ", ".join(f"({k}, {[int(v) for v in row]})" for k, row in enumerate(z))
    solved = ", ".join(f"({i}, {k}, {v!r})" for i, row in enumerate(solve.tolist()) for k, v in enumerate(row))
    vector = "[" + ", ".join(f"round(CAST({c} AS DOUBLE), 6)" for c in _COLUMNS) + "]"
    mean = "[" + ", ".join(f"round(avg(v[{k}]) FILTER (place = 1), 9)" for k in range(1, 16)) + "]"
    part = lambda v, on, h: " + ".join(f"{v}[{k + 1}] * {on.format(k + 1)} * {float(m.first.left[k, h])!r}" for k in range(15))
    elu = lambda e: f"(CASE WHEN {e} > 0 THEN {e} ELSE exp({e}) - 1 END)"
    lines = lambda xs: ", ".join(xs)
    return f"""WITH RECURSIVE {CELLS_SQL}, pts AS (SELECT id, {vector} AS v FROM cells),
h AS (SELECT v, row_number() OVER (ORDER BY (id * 48271 + 11) % 2147483647, id) - 1 AS j FROM pts),
c(step, j, v) AS (
    SELECT 0, j, v FROM h WHERE j < {CENTRES}
    UNION ALL
    SELECT step + 1, j, CASE WHEN count(*) FILTER (place = 1) > 0 THEN {mean} ELSE any_value(cv) END
    FROM (SELECT c.step, c.j, c.v AS cv, pts.v, row_number() OVER (PARTITION BY pts.id ORDER BY round(power(list_distance(pts.v, c.v), 2), 9), c.j) AS place FROM c, pts WHERE step < {CENTRE_STEPS}) GROUP BY step, j),
b AS (SELECT j, any_value(c.v) AS v, count(*) AS n FROM c JOIN (SELECT arg_min(c.j, (round(power(list_distance(pts.v, c.v), 2), 9), c.j)) AS j FROM c, pts WHERE step = {CENTRE_STEPS} GROUP BY pts.id) USING (j) WHERE step = {CENTRE_STEPS} GROUP BY j),
s(k, z) AS (VALUES {present}), q(f, k, p) AS (VALUES {solved}),
px AS MATERIALIZED (SELECT id, k, {lines(f"{part('v', 'z[{0}]', h)} AS x{h}" for h in range(8))} FROM pts, s),
bx AS MATERIALIZED (SELECT j, k, n, {lines(f"{part('v', '(1 - z[{0}])', h)} + {float(m.first.bias[h])!r} AS b{h}" for h in range(8))} FROM b, s),
l1 AS (SELECT id, px.k, n, {lines(f"{elu(f'(x{h} + b{h})')} AS h{h}" for h in range(8))} FROM px JOIN bx USING (k)),
l2 AS (SELECT id, k, n, {lines(f"{' + '.join(f'h{h} * {float(m.second.left[h, g])!r}' for h in range(8))} + {float(m.second.bias[g])!r} AS g{g}" for g in range(2))} FROM l1),
l3 AS (SELECT id, k, n, {lines(f"{elu(f'g{g}')} AS g{g}" for g in range(2))} FROM l2),
v AS MATERIALIZED (SELECT id, k, {lines(f"sum(n * (g0 * {float(m.weight[0, t])!r} + g1 * {float(m.weight[1, t])!r} + {float(m.bias[t])!r})) / sum(n) AS y{t}" for t in range(2))} FROM l3 GROUP BY 1, 2),
e1 AS (SELECT n, {lines(f"{elu('(' + ' + '.join(f'v[{k + 1}] * {float(m.first.left[k, h])!r}' for k in range(15)) + f' + {float(m.first.bias[h])!r})')} AS h{h}" for h in range(8))} FROM b),
e2 AS (SELECT n, {lines(f"{' + '.join(f'h{h} * {float(m.second.left[h, g])!r}' for h in range(8))} + {float(m.second.bias[g])!r} AS g{g}" for g in range(2))} FROM e1),
e3 AS (SELECT n, {lines(f"{elu(f'g{g}')} AS g{g}" for g in range(2))} FROM e2),
none AS (SELECT {lines(f"sum(n * (g0 * {float(m.weight[0, t])!r} + g1 * {float(m.weight[1, t])!r} + {float(m.bias[t])!r})) / sum(n) AS z{t}" for t in range(2))} FROM e3)
SELECT id, {FIFTEEN!r}[f + 1] AS feature, round(sum(p * (y0 - z0)), 6) + 0.0 AS a, round(sum(p * (y1 - z1)), 6) + 0.0 AS b FROM v JOIN q USING (k), none GROUP BY id, f"""


@query(_sql())
def kernel_shapley_values(spark, sf):
    """Shapley values of all cells for fifteen features, by 128 coalitions against the centres of fifty clusters."""
    centres, n = background(spark, sf)
    out = explain.kernel_shapley(fifteen(spark, sf).select("id", "x"), explain.alone(wide_model()), centres, n, FIFTEEN, COALITIONS)
    return rounded(out.select("id", "feature", F.col("phi")[0].alias("a"), F.col("phi")[1].alias("b")), 6)


@query()
def learned_masks(spark, sf):
    """The ten edges that matter most for the cell nearest to each kind's centre, by masks learned in two hundred steps; features' masks in a row of their own."""
    targets = cluster.nearest_to_centre(grid(spark, sf), ["x", "y"], "kind").select("id")
    found = explain.explain(targets, net.nodes(spark, sf), net.edges(spark, sf), net.model(), net.FEATURES)
    edges = found.select("target", F.posexplode("edges").alias("pos", "e")).select("target", F.lit("edge").alias("part"), (F.col("pos") + 1).alias("pos"), "e.src", "e.dst", F.lit(None).cast("string").alias("feature"), "e.mask")
    features = found.select("target", F.posexplode("features").alias("pos", "e")).select("target", F.lit("feature").alias("part"), (F.col("pos") + 1).alias("pos"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), "e.feature", "e.mask")
    return rounded(edges.unionByName(features), 6)


HEADS, HIDDEN, EPOCHS = 4, 8, 40


def training_rows(spark, sf):
    """Cells with fifteen standardised features, two target variables, a split, and a block of twenty by twenty cells."""
    df = rank.hash_split(fifteen(spark, sf).join(net.nodes(spark, sf).select("id", "truth"), "id").join(grid(spark, sf).select("id", "cx", "cy"), "id"), "id")
    m = df.agg(*(f(F.col("x")[k]).alias(f"{n}{k}") for k in range(15) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    z = F.array(*((F.col("x")[k] - m[f"m{k}"]) / (m[f"s{k}"] or 1.0) for k in range(15)))
    return df.select("id", z.alias("x"), "truth", "split", F.concat_ws("/", F.floor(F.col("cx") / 20), F.floor(F.col("cy") / 20)).alias("place"))


def _trained(spark, sf):
    n, e = training_rows(spark, sf), net.edges(spark, sf)
    model, losses = training.network_of(n, e, F.col("place"), hidden=HIDDEN, heads=HEADS, epochs=EPOCHS, rate=1e-2)
    return n, e, model, losses


@query()
def gat_training(spark, sf):
    """A network of fifteen features trained on the grid's blocks: its fit by split, and the best validation error."""
    n, e, model, losses = _trained(spark, sf)
    fit = network.r2_of(network.predict(n, e, model, block=F.col("place")).join(n.select("id", "split"), "id"), n, 2, ["split"])
    return rounded(fit.select("split", F.col("r2")[0].alias("r2_a"), F.col("r2")[1].alias("r2_b"), F.lit(min(losses)).alias("val_error")), 4)


@query()
def baseline_comparison(spark, sf):
    """R2 on held-out cells of a trained network, the same without a graph, least squares and a multi-layer perceptron, and how much less than the network's each is.

    The network has four heads of 64 and up to 800 epochs (60 without progress end them), the perceptron 64 and 32 units and 500 epochs.
    """
    n, e = training_rows(spark, sf), net.edges(spark, sf)
    model, _ = training.network_of(n, e, F.col("place"), hidden=64, heads=4, epochs=800, rate=1e-3)
    test = n.where("split = 'test'")
    flat = n.where("split = 'train'").select(*(F.col("x")[k].alias(f"x{k}") for k in range(15)), F.col("truth")[0].alias("t0"), F.col("truth")[1].alias("t1"))
    lines = [stats.least_squares(flat, [f"x{k}" for k in range(15)], t) for t in ("t0", "t1")]
    line = F.array(*(gat.total([F.lit(float(b[0])), *(F.col("x")[k] * F.lit(float(v)) for k, v in enumerate(b[1:]))]) for b in lines))
    mlp = training.perceptron_of(n, hidden=(64, 32), epochs=500)
    found = {"network": network.predict(n, e, model, block=F.col("place")), "self_loops": network.predict(n, e.where("false"), model, block=F.col("place")), "ols": test.select("id", line.alias("y")), "mlp": training.perceptron_predict(test, mlp)}
    score = None
    for label, pred in found.items():
        row = network.r2_of(pred, test, 2, []).select(F.lit(label).alias("label"), F.col("r2")[0].alias("r2_a"), F.col("r2")[1].alias("r2_b"))
        score = row if score is None else score.unionByName(row)
    base = F.broadcast(score.where("label = 'network'").select(F.col("r2_a").alias("a"), F.col("r2_b").alias("b")))
    return rounded(score.crossJoin(base).select("label", "r2_a", "r2_b", (F.col("a") - F.col("r2_a")).alias("delta_a"), (F.col("b") - F.col("r2_b")).alias("delta_b")), 6)
