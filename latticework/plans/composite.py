"""Composite indices: the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import clean, stats, weights
from latticework.storage import written

from .registry import CELLS_SQL, cells, query, rounded

INDICATORS = ["spend", "qty", "price"]


def scaled(spark, sf, cols=INDICATORS):
    """Cells with indicators imputed by the median and brought to [0, 1]; written, since weights and scores read them several times."""
    raw = written(cells(spark, sf).select("id", "bal", *cols), "cells")
    return written(clean.minmax(clean.impute_median(raw, cols), cols), "scaled")


_SCALED = CELLS_SQL + ", f AS (SELECT id, bal, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM cells)) AS {c}" for c in INDICATORS) + " FROM cells), s AS (SELECT id, bal, " + ", ".join(f"({c} - (SELECT min({c}) FROM f)) / ((SELECT max({c}) FROM f) - (SELECT min({c}) FROM f)) AS {c}" for c in INDICATORS) + " FROM f)"
_H = "SELECT '{c}' AS indicator, 1 + sum(CASE WHEN {c} > 0 THEN {c} / t * ln({c} / t) ELSE 0 END) / ln((SELECT count(*) FROM s)) AS d FROM s, (SELECT sum({c}) + 1e-12 AS t FROM s)"
_ENTROPY = _SCALED + ", h AS (" + " UNION ALL ".join(_H.format(c=c) for c in INDICATORS) + "), e AS (SELECT indicator, d / (SELECT sum(d) FROM h) AS entropy_w FROM h)"
_C = "SELECT '{c}' AS indicator, {std}({c}) * ({rs}) AS d FROM s"


def _critic(std: str) -> str:
    rows = [_C.format(c=c, std=std, rs=" + ".join(f"1 - corr({c}, {o})" for o in INDICATORS if o != c)) for c in INDICATORS]
    return "c0 AS (" + " UNION ALL ".join(rows) + "), c AS (SELECT indicator, d / (SELECT sum(d) FROM c0) AS critic_w FROM c0)"


_BOTH = _ENTROPY + ", " + _critic("stddev_pop") + ", g AS (SELECT indicator, entropy_w, critic_w, sqrt(entropy_w * critic_w) AS g FROM e JOIN c USING (indicator)), g2 AS (SELECT *, greatest(g / (SELECT sum(g) FROM g), 0.05) AS w FROM g), w AS (SELECT indicator, entropy_w, critic_w, w / (SELECT sum(w) FROM g2) AS combined_w FROM g2)"
_WS = ", ".join(f"(SELECT combined_w FROM w WHERE indicator = '{c}') AS w_{c}" for c in INDICATORS)
_RAW = _BOTH + f", ws AS (SELECT {_WS}), v AS (SELECT id, " + ", ".join(f"{c} * w_{c} AS {c}" for c in INDICATORS) + " FROM s, ws)"
_SUM = _RAW + ", r AS (SELECT id, " + " + ".join(INDICATORS) + " AS r FROM v), sums AS (SELECT id, (r - (SELECT min(r) FROM r)) / ((SELECT max(r) FROM r) - (SELECT min(r) FROM r)) AS stress FROM r)"
_I = ", ".join(f"max({c}) AS hi_{c}, min({c}) AS lo_{c}" for c in INDICATORS)
_D = lambda k: "sqrt(" + " + ".join(f"power({c} - {k}_{c}, 2)" for c in INDICATORS) + ")"
_TOPSIS = _RAW + f", i AS (SELECT {_I} FROM v), t AS (SELECT id, {_D('lo')} / ({_D('hi')} + {_D('lo')}) AS vitality FROM v, i)"


@query(f"WITH {_ENTROPY} SELECT indicator, round(entropy_w, 6) AS weight FROM e")
def entropy_weights(spark, sf):
    return rounded(weights.entropy_weights(scaled(spark, sf), INDICATORS), 6)


@query(f"WITH {_SCALED}, {_critic('stddev_pop')} SELECT indicator, round(critic_w, 6) AS weight FROM c")
def critic_weights(spark, sf):
    return rounded(weights.critic_weights(scaled(spark, sf), INDICATORS), 6)


@query(f"WITH {_SCALED}, {_critic('stddev_samp')} SELECT indicator, round(critic_w, 6) AS weight FROM c")
def critic_legacy(spark, sf):
    return rounded(weights.critic_weights(scaled(spark, sf), INDICATORS, sample=True), 6)


def combined(df):
    return weights.combined_weights(weights.entropy_weights(df, INDICATORS), weights.critic_weights(df, INDICATORS))


@query(f"WITH {_BOTH} SELECT indicator, round(entropy_w, 6) AS entropy_w, round(critic_w, 6) AS critic_w, round(combined_w, 6) AS combined_w FROM w")
def combined_weights_floor(spark, sf):
    return rounded(combined(scaled(spark, sf)), 6)


@query(f"WITH {_SUM} SELECT id, round(stress, 6) AS stress FROM sums")
def weighted_composite(spark, sf):
    s = scaled(spark, sf)
    return rounded(weights.weighted_sum(s, INDICATORS, combined(s), out="stress").select("id", "stress"), 6)


@query(f"WITH {_TOPSIS} SELECT id, round(vitality, 6) AS vitality FROM t")
def topsis_score(spark, sf):
    s = scaled(spark, sf)
    return rounded(weights.topsis(s, INDICATORS, combined(s), out="vitality").select("id", "vitality"), 6)


@query(f"WITH {_TOPSIS}, " + _SUM.removeprefix(_RAW).removeprefix(", ") + ", tt AS (SELECT id, (vitality - (SELECT min(vitality) FROM t)) / ((SELECT max(vitality) FROM t) - (SELECT min(vitality) FROM t)) AS vitality FROM t) SELECT id, round(stress, 6) AS stress, round(vitality, 6) AS vitality FROM sums JOIN tt USING (id)")
def composite_index(spark, sf):
    """Stress by weighted sum and vitality by closeness to the ideal, of the same weights."""
    s = scaled(spark, sf)
    w = written(combined(s), "weights")
    ideal = clean.minmax(weights.topsis(weights.weighted_sum(s, INDICATORS, w, out="stress"), INDICATORS, w, out="vitality"), ["vitality"])
    return rounded(ideal.select("id", "stress", "vitality"), 6)


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_WITH = lambda w: " + ".join(f"{c} * (SELECT {w} FROM w WHERE indicator = '{c}')" for c in INDICATORS)
_VARIANTS = {"equal": " + ".join(INDICATORS), "critic": _WITH("critic_w"), "entropy": _WITH("entropy_w")}
_SENSITIVITY = " UNION ALL ".join(f"SELECT '{n}' AS variant, round(corr(a, b), 4) AS r, count(*) AS n, abs(corr(a, b)) >= 0.9 AS robust FROM (SELECT {_RANK.format(c='round(stress, 9)')} AS a, {_RANK.format(c=f'round({n}, 9)')} AS b FROM sums JOIN q USING (id))" for n in _VARIANTS)


@query(f"WITH {_SUM}, q AS (SELECT id, " + ", ".join(f"{v} AS {n}" for n, v in _VARIANTS.items()) + f" FROM s) {_SENSITIVITY}")
def weight_sensitivity(spark, sf):
    """Rank correlation of the index with its variants: equal weights, and either method's weights alone."""
    s = scaled(spark, sf)
    w = written(combined(s), "weights")
    both = weights.weighted_sum(s, INDICATORS, w, out="stress").withColumn("equal", stats.total([F.col(c) for c in INDICATORS]))
    for name in ("critic", "entropy"):
        both = weights.weighted_sum(both, INDICATORS, w, column=f"{name}_w", out=name)
    both = both.select(*(F.round(c, 9).alias(c) for c in ("stress", *_VARIANTS)))
    pairs = stats.spearman_pairs(written(both, "variants"), ["stress", *_VARIANTS])  # each column is ranked once
    found = pairs.where("a = 'stress'").select(F.col("b").alias("variant"), "r", "n", (F.abs("r") >= 0.9).alias("robust"))
    return rounded(found)
