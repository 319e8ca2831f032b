"""Graphs, spatial autocorrelation, rasters and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import cluster, graph, raster, spatial, stats

from .registry import GRID_SQL, grid, query, rounded, table

_GAUSS = f"""WITH {GRID_SQL}, e0 AS (SELECT a.id AS src, b.id AS dst, exp(-(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / (2 * 200.0 * 200.0)) AS w FROM grid a JOIN grid b ON a.id <> b.id AND abs(a.cx - b.cx) <= 3 AND abs(a.cy - b.cy) <= 3 WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 360000),
e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e0)"""


@query(f"{_GAUSS} SELECT src, dst, round(w, 6) AS w FROM e")
def gaussian_edges_rowstd(spark, sf):
    return rounded(graph.gaussian_edges(grid(spark, sf)), 6)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


_COS = "s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), top AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS pos FROM s QUALIFY pos <= 8)"


@query(f"WITH {_COS} SELECT src, dst, round(sim, 6) AS sim, CAST(pos AS INT) AS pos FROM top")
def cosine_topk(spark, sf):
    return rounded(graph.cosine_nearest(vectors(spark, sf)), 6)


@query(f"WITH {_COS} SELECT a.src, a.dst, round(a.sim, 6) AS w FROM top a JOIN top b ON a.src = b.dst AND a.dst = b.src")
def mutual_knn(spark, sf):
    return rounded(graph.mutual(graph.cosine_nearest(vectors(spark, sf))).select("src", "dst", F.col("sim").alias("w")), 6)


def merged(spark, sf):
    near = spatial.nearest(grid(spark, sf), 4, 400.0).select("src", "dst", F.exp(-F.col("d") / 400).alias("w"))
    return graph.merge_edges(graph.gaussian_edges(grid(spark, sf)), near)


_MERGED = f"""{_GAUSS}, n0 AS (SELECT a.id AS src, b.id AS dst, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM grid a JOIN grid b ON a.id <> b.id AND abs(a.cx - b.cx) <= 6 AND abs(a.cy - b.cy) <= 6),
n AS (SELECT src, dst, exp(-d / 400) AS w FROM n0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 4),
u AS (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e UNION ALL SELECT * FROM n UNION ALL SELECT dst, src, w FROM n), m AS (SELECT src, dst, max(w) AS w FROM u WHERE src <> dst GROUP BY 1, 2)"""


@query(f"{_MERGED} SELECT src, dst, round(w, 6) AS w FROM m")
def merge_edges_max(spark, sf):
    return rounded(merged(spark, sf), 6)


@query(f"{_MERGED} SELECT CAST(0 AS BIGINT) AS n_loops, CAST(sum(CASE WHEN w <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_not_positive, CAST((SELECT count(*) FROM m a LEFT JOIN m b ON a.src = b.dst AND a.dst = b.src WHERE b.src IS NULL) AS BIGINT) AS n_one_way FROM m")
def edge_symmetry_check(spark, sf):
    return graph.check_symmetric(merged(spark, sf))


@query(f"{_GAUSS}, d AS (SELECT src, count(*) AS k FROM e GROUP BY 1) SELECT count(*) AS n, round(avg(k), 4) AS mean_degree, max(k) AS most FROM d")
def degree_stats(spark, sf):
    d = graph.degrees(grid(spark, sf).select("id"), graph.gaussian_edges(grid(spark, sf)))
    return rounded(d.agg(F.count("*").alias("n"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("most")))


@query(f"{_GAUSS}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1), q AS (SELECT quantile_cont(degree, 0.9) AS h, quantile_cont(degree, 0.5) AS l FROM d) SELECT id, degree, CASE WHEN degree >= h THEN 'hub' WHEN degree <= l THEN 'peripheral' ELSE 'normal' END AS role FROM d, q")
def hub_roles(spark, sf):
    return graph.roles(graph.degrees(grid(spark, sf).select("id"), graph.gaussian_edges(grid(spark, sf))))


@query(f"{_GAUSS}, t AS (SELECT a.src AS id, count(*) AS t FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst JOIN e c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1), d AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1) SELECT d.id, round(2.0 * coalesce(t, 0) / (k * (k - 1)), 6) AS coefficient FROM d LEFT JOIN t USING (id)")
def clustering_coefficient(spark, sf):
    return rounded(graph.clustering(grid(spark, sf), graph.gaussian_edges(grid(spark, sf))), 6)


_NEAR = f"WITH RECURSIVE {GRID_SQL}, e AS (SELECT a.id AS v, b.id AS t FROM grid a JOIN grid b ON a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 360000)"


@query(f"""{_NEAR}, w(lvl, s, v, paths, fresh) AS (
    SELECT 0, id, id, 1.0::DOUBLE, true FROM grid WHERE id IN (SELECT v FROM e)
    UNION ALL
    SELECT * FROM (
        WITH f AS (SELECT lvl + 1 AS lvl, w.s, e.t AS v, sum(paths) AS paths FROM w JOIN e ON e.v = w.v WHERE fresh GROUP BY ALL), n AS (SELECT f.* FROM f ANTI JOIN w ON w.s = f.s AND w.v = f.v)
        SELECT lvl, s, v, paths, true FROM n UNION ALL SELECT lvl, s, v, paths, false FROM w WHERE fresh AND EXISTS (SELECT 1 FROM n))),
d AS MATERIALIZED (SELECT lvl, s, v, paths FROM w WHERE fresh),
b(lvl, s, v, paths, share) AS (
    SELECT lvl, s, v, paths, 0.0::DOUBLE FROM d WHERE lvl = (SELECT max(lvl) FROM d)
    UNION ALL
    SELECT * FROM (
        WITH p AS (SELECT b.s, e.t AS v, sum((1 + share) / paths) AS part FROM b JOIN e ON e.v = b.v GROUP BY ALL)
        SELECT d.lvl, d.s, d.v, d.paths, d.paths * coalesce(part, 0) FROM d LEFT JOIN p USING (s, v) WHERE d.lvl = (SELECT max(lvl) - 1 FROM b)))
SELECT grid.id, round(coalesce(total, 0), 4) + 0.0 AS betweenness FROM grid LEFT JOIN (SELECT v AS id, sum(share) / 2 AS total FROM b WHERE s <> v GROUP BY 1) USING (id)""")
def betweenness(spark, sf):
    """Shortest paths by steps of 600 m at most, through each cell; a thousand rows of the grid are a block."""
    cells = grid(spark, sf)
    return rounded(graph.betweenness(cells.select("id", "cy"), graph.gaussian_edges(cells), F.floor(F.col("cy") / 1000)), 4)


@query(f"{_GAUSS} SELECT e.src AS id, a.bal, round(sum(w * b.bal), 4) + 0.0 AS lag FROM e JOIN grid a ON a.id = e.src JOIN grid b ON b.id = e.dst GROUP BY 1, 2")
def spatial_lag(spark, sf):
    return rounded(stats.spatial_lag(grid(spark, sf), graph.gaussian_edges(grid(spark, sf)), "bal"))


@query(f"{_GAUSS}, z AS (SELECT id, bal - (SELECT avg(bal) FROM grid) AS z FROM grid) SELECT round((SELECT count(*) FROM z) / (SELECT sum(w) FROM e) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS i, (SELECT count(*) FROM z) AS n FROM e JOIN z a ON a.id = src JOIN z b ON b.id = dst")
def morans_i(spark, sf):
    return rounded(stats.morans_i(grid(spark, sf), graph.gaussian_edges(grid(spark, sf)), "bal"), 6)


@query(f"""{_GAUSS}, z AS (SELECT id, bal - (SELECT avg(bal) FROM grid) AS z, row_number() OVER (ORDER BY id) AS k FROM grid),
pl AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN run = 0 THEN lpad(CAST(k AS VARCHAR), 32, '0') ELSE md5(id || ':' || run || ':42') END, id) AS k FROM z, range(1000) t(run)),
f AS (SELECT run, pl.id, z.z FROM pl JOIN z USING (k)), s AS (SELECT a.run, (SELECT count(*) FROM z) / (SELECT sum(w) FROM e) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM z) AS i FROM e JOIN f a ON a.id = src JOIN f b ON b.id = dst AND b.run = a.run GROUP BY 1),
o AS (SELECT i FROM s WHERE run = 0), c AS (SELECT count(*) AS k FROM s, o WHERE run > 0 AND s.i >= o.i) SELECT round(i, 6) + 0.0 AS i, round((least(k, 999 - k) + 1) / 1000.0, 6) AS p FROM o, c""")
def morans_permutation(spark, sf):
    """999 permutations; a hundred rows of the grid are a block."""
    return rounded(stats.morans_p(grid(spark, sf), graph.gaussian_edges(grid(spark, sf)), "bal", block=F.floor(F.col("cy") / 100)), 6)


_KINDS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"{_GAUSS} SELECT a.kind AS src_kind, " + ", ".join(f"round(avg(CASE WHEN b.kind = '{k}' THEN w END), 6) AS {k.lower()}" for k in _KINDS) + " FROM e JOIN grid a ON a.id = src JOIN grid b ON b.id = dst GROUP BY 1")
def attention_by_type_pivot(spark, sf):
    """Mean edge weight by the kinds of both ends."""
    e = graph.gaussian_edges(grid(spark, sf), keep=("kind",))
    return rounded(e.groupBy("src_kind").pivot("dst_kind", _KINDS).agg(F.avg("w")).withColumnsRenamed({k: k.lower() for k in _KINDS}), 6)


@query(f"{_GAUSS} SELECT src, dst, round(w, 6) AS w FROM e WHERE w > 0.08 ORDER BY w DESC, src, dst LIMIT 10")
def strong_edges_top10(spark, sf):
    return rounded(graph.gaussian_edges(grid(spark, sf)).where("w > 0.08").orderBy(F.round("w", 12).desc(), "src", "dst").limit(10), 6)


def pixels(spark, sf):
    """Parts as a raster of 45 columns; values 0 to 4 are classes, 0 is no data."""
    i = F.col("p_partkey")
    return table(spark, sf, "part").select(F.floor(i / 45).alias("row"), (i % 45).alias("col"), (F.col("p_size") % 5).cast("long").alias("value"))


def frames(spark, sf):
    """Overlapping windows of 21 x 21 pixels."""
    i = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(i.alias("id"), ((i % 97) * 4).alias("r0"), ((i % 3) * 11).alias("c0"))


_WIN = "WITH px AS (SELECT p_partkey // 45 AS row, p_partkey % 45 AS col, CAST(p_size % 5 AS BIGINT) AS value FROM part), f AS (SELECT s_suppkey AS id, s_suppkey % 97 * 4 AS r0, s_suppkey % 3 * 11 AS c0 FROM supplier), w AS (SELECT id, row, col, value FROM f JOIN px ON row >= r0 AND row < r0 + 21 AND col >= c0 AND col < c0 + 21)"


@query(f"{_WIN} SELECT id, round(avg(value), 6) AS mean FROM f LEFT JOIN w USING (id) GROUP BY 1")
def zonal_mean(spark, sf):
    return rounded(raster.zonal_mean(frames(spark, sf), pixels(spark, sf), 21), 6)


def _win(spark, sf):
    return raster.windows(frames(spark, sf), pixels(spark, sf), 21).select("id", "row", "col", "value")


@query(f"{_WIN}, c AS (SELECT id, value, count(*) AS k FROM w WHERE value <> 0 GROUP BY 1, 2), n AS (SELECT id, sum(k) AS n FROM c GROUP BY 1) SELECT id, round(-sum(k / n * ln(k / n)), 6) AS shdi FROM c JOIN n USING (id) GROUP BY 1")
def shdi(spark, sf):
    return rounded(raster.shannon_diversity(_win(spark, sf)), 6)


@query(f"""{_WIN}, v AS (SELECT * FROM w WHERE value <> 0), s AS (SELECT v.id, v.value, row + i AS row, col + j AS col FROM v, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(i, j)),
g AS (SELECT s.id, sum(CASE WHEN v.value IS NULL THEN 2 WHEN v.value <> s.value THEN 1 ELSE 0 END) / 2 AS edge, count(*) // 4 AS area FROM s LEFT JOIN v ON v.id = s.id AND v.row = s.row AND v.col = s.col GROUP BY 1)
SELECT id, round(edge / CASE WHEN area = floor(sqrt(area)) * floor(sqrt(area)) THEN 4 * floor(sqrt(area)) WHEN area <= floor(sqrt(area)) * (floor(sqrt(area)) + 1) THEN 4 * floor(sqrt(area)) + 2 ELSE 4 * floor(sqrt(area)) + 4 END, 6) AS lsi FROM g""")
def lsi(spark, sf):
    return rounded(raster.landscape_shape(_win(spark, sf)), 6)


@query(f"""WITH RECURSIVE {_WIN.removeprefix('WITH ')}, v AS (SELECT * FROM w WHERE value <> 0),
nb AS (SELECT o.id, o.row, o.col, n.row AS r2, n.col AS c2 FROM v o JOIN v n ON n.id = o.id AND n.value = o.value AND abs(n.row - o.row) <= 1 AND abs(n.col - o.col) <= 1),
reach(id, row, col, r, c) AS (SELECT id, row, col, row, col FROM v UNION SELECT reach.id, reach.row, reach.col, r2, c2 FROM reach JOIN nb ON nb.id = reach.id AND nb.row = r AND nb.col = c),
lab AS (SELECT id, r AS row, c AS col, min(row * 100 + col) AS label FROM reach GROUP BY 1, 2, 3), px2 AS (SELECT v.*, label FROM v JOIN lab USING (id, row, col)),
pa AS (SELECT id, label, any_value(value) AS value, count(*) AS area FROM px2 GROUP BY 1, 2),
di AS (SELECT a.id, a.label, sqrt(min(power(a.row - b.row, 2) + power(a.col - b.col, 2))) - 1 AS d FROM px2 a JOIN px2 b ON a.id = b.id AND a.value = b.value AND a.label <> b.label GROUP BY 1, 2),
m AS (SELECT id, sum(area) AS n, 100.0 * max(area) / sum(area) AS lpi, sum(CASE WHEN d IS NOT NULL THEN greatest(d, 0) * area END) / sum(CASE WHEN d IS NOT NULL THEN area END) AS menn FROM pa LEFT JOIN di USING (id, label) GROUP BY 1)
SELECT id, round(CASE WHEN n >= 4 THEN lpi END, 6) AS lpi, round(CASE WHEN n >= 4 THEN coalesce(menn, 0) WHEN n > 0 THEN 0 END, 6) AS menn FROM (SELECT DISTINCT id FROM w) LEFT JOIN m USING (id)""")
def patch_metrics(spark, sf):
    """Largest patch and nearest-neighbour distance, by numpy in groups of one window."""
    return rounded(raster.patch_statistics(_win(spark, sf), 21), 6)


@query("WITH px AS (SELECT p_partkey // 45 AS row, p_partkey % 45 AS col FROM part), b AS (SELECT s_suppkey AS seq, (s_suppkey % 7) * 5 + 0.25 AS x0, (s_suppkey % 11) * 3 + 0.25 AS y0, s_suppkey % 4 + 1 AS value FROM supplier), h AS (SELECT row, col, max_by(value, seq) AS value FROM px JOIN b ON col + 0.5 >= x0 AND col + 0.5 < x0 + 9 AND row + 0.5 >= y0 AND row + 0.5 < y0 + 6 GROUP BY 1, 2) SELECT row, col, coalesce(value, 0) AS value FROM px LEFT JOIN h USING (row, col)")
def rasterise(spark, sf):
    i = F.col("s_suppkey")
    x0, y0 = (i % 7) * 5 + 0.25, (i % 11) * 3 + 0.25
    boxes = table(spark, sf, "supplier").select(i.alias("seq"), x0.alias("x0"), y0.alias("y0"), (x0 + 9).alias("x1"), (y0 + 6).alias("y1"), (i % 4 + 1).alias("value"))
    return raster.rasterise(boxes, pixels(spark, sf))


DIMS = [f"e{k}" for k in range(64)]


def labelled(spark, sf):
    """Embeddings as rows of 64 features with a label."""
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *(v[k].cast("double").alias(c) for k, c in enumerate(DIMS)), F.col("label"))


_LAB = "WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), n AS (SELECT label, count(*) AS n FROM p GROUP BY 1), u AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM p)"
_SSW = "w AS (SELECT sum(v) AS ssw, count(DISTINCT label) AS k FROM (SELECT label, k, var_pop(x) * count(*) AS v FROM u GROUP BY 1, 2))"


@query(f"{_LAB}, d AS (SELECT p.id, p.label, q.label AS other, sum(list_distance(p.v, q.v)) AS s FROM p, p q GROUP BY ALL), m AS (SELECT d.id, max(CASE WHEN d.label = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN d.label <> other THEN s / n END) AS b, max(CASE WHEN d.label = other THEN n END) AS n FROM d JOIN n ON n.label = other GROUP BY 1) SELECT id, round(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) + 0.0 AS silhouette FROM m")
def silhouette_fixed_labels(spark, sf):
    return rounded(cluster.silhouette(labelled(spark, sf), DIMS, "label"), 6)


@query(f"{_LAB}, {_SSW}, t AS (SELECT sum(v) AS sst FROM (SELECT k, var_pop(x) * count(*) AS v FROM u GROUP BY 1)), c AS (SELECT count(*) AS n FROM p) SELECT round(((sst - ssw) / (k - 1)) / (ssw / (n - k)), 6) AS ch FROM w, t, c")
def calinski_harabasz(spark, sf):
    return rounded(cluster.calinski_harabasz(labelled(spark, sf), DIMS, "label"), 6)


@query(f"{_LAB}, c AS (SELECT label, k, avg(x) AS c FROM u GROUP BY 1, 2), cv AS (SELECT label, list(c ORDER BY k) AS c FROM c GROUP BY 1), s AS (SELECT label, c, avg(list_distance(v, c)) AS s FROM p JOIN cv USING (label) GROUP BY ALL), r AS (SELECT x.label, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM s x JOIN s y ON x.label <> y.label GROUP BY 1) SELECT round(avg(r), 6) AS db FROM r")
def davies_bouldin(spark, sf):
    return rounded(cluster.davies_bouldin(labelled(spark, sf), DIMS, "label"), 6)


@query(f"{_LAB}, {_SSW} SELECT round(ssw, 6) AS inertia FROM w")
def inertia(spark, sf):
    return rounded(cluster.inertia(labelled(spark, sf), DIMS, "label"), 6)


def archetypes(spark, sf):
    return grid(spark, sf).select("id", (F.col("bal") / 1000).alias("stress"), (F.col("x") / 1000).alias("vitality"))


#: Validity of labels lb(k, id, a, b, label): al(k, silhouette, ch, db, inertia).
_VALID = """pts AS (SELECT id, bal / 1000 AS a, x / 1000 AS b FROM grid), {labels},
n AS (SELECT k, label, count(*) AS n, avg(a) AS ca, avg(b) AS cb, (var_pop(a) + var_pop(b)) * count(*) AS ss FROM lb GROUP BY 1, 2), w AS (SELECT k, sum(ss) AS ssw, count(*) AS c, sum(n) AS m FROM n GROUP BY 1), t AS (SELECT (var_pop(a) + var_pop(b)) * count(*) AS sst FROM pts),
ch AS (SELECT k, ((sst - ssw) / (c - 1)) / (ssw / (m - c)) AS ch, ssw AS inertia FROM w, t),
sp AS (SELECT lb.k, lb.label, any_value(ca) AS ca, any_value(cb) AS cb, avg(sqrt(power(a - ca, 2) + power(b - cb, 2))) AS s FROM lb JOIN n ON n.k = lb.k AND n.label = lb.label GROUP BY 1, 2),
db AS (SELECT k, avg(r) AS db FROM (SELECT x.k, x.label, max((x.s + y.s) / sqrt(power(x.ca - y.ca, 2) + power(x.cb - y.cb, 2))) AS r FROM sp x JOIN sp y ON x.k = y.k AND x.label <> y.label GROUP BY 1, 2) GROUP BY 1),
ds AS (SELECT p.k, p.id, p.label, q.label AS other, sum(sqrt(power(p.a - q.a, 2) + power(p.b - q.b, 2))) AS s FROM lb p JOIN lb q ON p.k = q.k GROUP BY ALL),
si AS (SELECT ds.k, ds.id, max(CASE WHEN ds.label = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN ds.label <> other THEN s / n END) AS b, max(CASE WHEN ds.label = other THEN n END) AS n FROM ds JOIN n ON n.k = ds.k AND n.label = other GROUP BY 1, 2),
sc AS (SELECT k, avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM si GROUP BY 1),
al AS (SELECT CAST(k AS INT) AS k, round(silhouette, {places}) AS silhouette, round(ch, {places}) AS ch, round(db, {places}) AS db, round(inertia, {places}) AS inertia FROM sc JOIN ch USING (k) JOIN db USING (k))"""
_BANDS = _VALID.format(labels="lb AS (SELECT k, id, a, b, CAST(floor(b * k / 8.0) AS INT) AS label FROM pts, range(2, 7) t(k))", places=6)
_VOTE = "v AS (SELECT arg_max(k, (silhouette, -k)) AS k FROM al UNION ALL SELECT arg_max(k, (ch, -k)) FROM al UNION ALL SELECT arg_min(k, (db, k)) FROM al) SELECT k, count(*) AS votes FROM v GROUP BY 1 ORDER BY votes DESC, k LIMIT 1"
STARTS, STEPS = 20, 12
#: Lloyd's steps of all numbers of clusters and starts: centres after each, then the labels of each best start.
_LLOYD = f"""hashed AS (SELECT k, s, id, a, b, row_number() OVER (PARTITION BY k, s ORDER BY (id * 48271 + 11 + 7919 * s) % 2147483647, id) - 1 AS j FROM pts, range(2, 7) t(k), range({STARTS}) u(s)),
c(step, k, s, j, a, b) AS (
    SELECT 0, k, s, j, round(a, 9), round(b, 9) FROM hashed WHERE j < k
    UNION ALL
    SELECT step + 1, k, s, j, coalesce(round(avg(pa) FILTER (place = 1), 9), any_value(ca)), coalesce(round(avg(pb) FILTER (place = 1), 9), any_value(cb))
    FROM (SELECT c.step, c.k, c.s, c.j, c.a AS ca, c.b AS cb, pts.a AS pa, pts.b AS pb, row_number() OVER (PARTITION BY c.k, c.s, pts.id ORDER BY round((pts.a - c.a) * (pts.a - c.a) + (pts.b - c.b) * (pts.b - c.b), 9), c.j) AS place FROM c, pts WHERE step < {STEPS})
    GROUP BY step, k, s, j),
near AS (SELECT c.k, c.s, pts.id, pts.a, pts.b, arg_min(c.j, (round((pts.a - c.a) * (pts.a - c.a) + (pts.b - c.b) * (pts.b - c.b), 9), c.j)) AS label, min(round((pts.a - c.a) * (pts.a - c.a) + (pts.b - c.b) * (pts.b - c.b), 9)) AS d FROM c, pts WHERE step = {STEPS} GROUP BY ALL),
best AS (SELECT k, arg_min(s, (round(d, 6), s)) AS s FROM (SELECT k, s, sum(d) AS d FROM near GROUP BY 1, 2) GROUP BY 1),
lb AS (SELECT near.k, id, a, b, label FROM near JOIN best USING (k, s))"""
_KMEANS = _VALID.format(labels=_LLOYD, places=4)


@query(f"WITH RECURSIVE {GRID_SQL}, {_KMEANS} SELECT k, silhouette, ch, db, inertia FROM al")
def kmeans_scores(spark, sf):
    """Validity of k-means clusters for two to six of them, twenty starts of twelve steps each."""
    return rounded(cluster.scores(archetypes(spark, sf), ["stress", "vitality"], range(2, 7), starts=STARTS, steps=STEPS), 4)


def _band_scores(spark, sf):
    """Validity of two to six equal bands of the grid."""
    df = archetypes(spark, sf)
    bands = lambda k: df.withColumn("cluster", F.floor(F.col("vitality") * k / 8.0).cast("int"))
    return rounded(cluster.scores(df, ["stress", "vitality"], range(2, 7), assign=bands).drop("inertia"), 6)


@query(f"WITH {GRID_SQL}, {_BANDS} SELECT k, silhouette, ch, db FROM al")
def cluster_validity(spark, sf):
    return _band_scores(spark, sf)


@query(f"WITH RECURSIVE {GRID_SQL}, {_KMEANS}, {_VOTE}")
def majority_vote_k(spark, sf):
    """The number of k-means clusters that most of the three criteria choose."""
    return cluster.majority_k(kmeans_scores(spark, sf))


@query(f"""WITH RECURSIVE {GRID_SQL}, pts AS (SELECT id, bal / 1000 AS a, x / 1000 AS b FROM grid), {_LLOYD}, m AS (SELECT label, avg(a) AS s, avg(b) AS v, count(*) AS n FROM lb WHERE k = 3 GROUP BY 1), top AS (SELECT arg_max(label, (v, -label)) AS t FROM m),
low AS (SELECT arg_min(label, (s, label)) AS l FROM m, top WHERE label <> t) SELECT CASE label WHEN t THEN 'vital' WHEN l THEN 'calm' ELSE 'balanced' END AS archetype, n FROM m, top, low""")
def kmeans_archetypes(spark, sf):
    """Three clusters, the best of twenty starts, by name."""
    found = cluster.kmeans(archetypes(spark, sf), ["stress", "vitality"], 3, STARTS, STEPS)
    return cluster.name_archetypes(found, "stress", "vitality").groupBy("archetype").agg(F.count("*").alias("n"))
