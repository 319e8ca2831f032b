from __future__ import annotations

import numpy as np
import pytest

from latticework.operators import graph, spatial
from latticework.plans import QUERIES


@pytest.fixture(scope="module")
def places(spark):
    """Scattered rows on both sides of 0, some at one place, some exactly a radius apart, and one without a place."""
    rng = np.random.default_rng(8)
    xy = np.r_[rng.integers(-3000, 3000, (150, 2)), np.full((30, 2), 100.0), [[9000, 0], [9600, 0], [9600, 600], [20000, 0]]].astype(float)
    kind = [None if k % 7 == 0 else "abc"[k % 3] for k in range(len(xy))]
    rows = [(k, float(x), float(y), kind[k]) for k, (x, y) in enumerate(xy)]
    return spark.createDataFrame([*rows, (900, None, 5.0, "a")], "id long, x double, y double, kind string"), xy, kind


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_meet_in_blocks_of_squares_without_a_sort_of_pairs(places, monkeypatch):
    monkeypatch.setattr(spatial, "QUERIES", 16)  # the thirty rows at one place are two blocks
    nodes, xy, kind = places
    edges = graph.gaussian_edges(nodes, keep=("kind",), distance=True)
    assert "Window" not in _plan(edges)
    got = {(r.src, r.dst): (r.w, r.d, r.src_kind, r.dst_kind) for r in edges.collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    w = np.where((d <= 600) & ~np.eye(len(xy), dtype=bool), np.exp(-d * d / 80000), 0)
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(w)), strict=True)}
    assert set(got) == want and (180, 181) in want and 183 not in {i for i, _ in want}
    assert all(got[i, j][2:] == (kind[i], kind[j]) for i, j in want)
    assert np.allclose([got[k][:2] for k in sorted(want)], [(w[i, j] / w[i].sum(), d[i, j]) for i, j in sorted(want)])


def test_kinds_are_counted_block_by_block(spark, sf, places, monkeypatch):
    monkeypatch.setattr("latticework.operators.meet.BLOCK_ROWS", 16)
    nodes, xy, kind = places
    got = {r.id: (r.n, r.kinds) for r in spatial.kinds_around(nodes.where("id % 2 = 0"), nodes, 600.0, "kind").collect()}
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) <= 600
    assert got == {i: (int(near[i].sum()), len({kind[j] for j in np.flatnonzero(near[i])} - {None})) for i in range(0, len(xy), 2)}
    assert "FlatMapCoGroupsInArrow" in _plan(QUERIES["radius_join_count"](spark, sf))
