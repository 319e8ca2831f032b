"""Whole-column cleaning: a statistic of each column is one aggregate row that joins back by broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import expr as E

from .rank import exact_quantiles


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    if missing := sorted(set(cols) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def select_available(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def drop_zero_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(~E.any_zero(*map(F.col, cols)))


def with_statistics(df: DataFrame, cols: list[str], stats: dict[str, Callable[[Column], Column]], by: list[str] = ()) -> DataFrame:
    """df with column__stat for each column and statistic, of all rows or of each group. The statistics are a row (or one for each group) that is broadcast or joined."""
    aggs = [f(F.col(c)).alias(f"{c}__{s}") for c in cols for s, f in stats.items()]
    return df.join(df.groupBy(*by).agg(*aggs), list(by)) if by else df.crossJoin(F.broadcast(df.agg(*aggs)))


def _replaced(df: DataFrame, cols: list[str], stats: dict, make: Callable[[Column, dict[str, Column]], Column]) -> DataFrame:
    wide = with_statistics(df, cols, stats)
    new = {c: make(F.col(c), {s: F.col(f"{c}__{s}") for s in stats}) for c in cols}
    return wide.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def _by_quantiles(df: DataFrame, cols: list[str], shares: list[float], make: Callable[[Column, Column], Column]) -> DataFrame:
    quantiles = exact_quantiles(df, cols, shares).toDF(*(f"{c}__q" for c in cols))
    return df.crossJoin(F.broadcast(quantiles)).select(*[make(F.col(c), F.col(f"{c}__q")).alias(c) if c in cols else F.col(c) for c in df.columns])


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    return _replaced(df, cols, {"m": F.avg}, lambda c, s: F.coalesce(c, s["m"]))


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """By the exact, interpolated median."""
    return _by_quantiles(df, cols, [0.5], lambda c, q: F.coalesce(c, q[0]))


def winsorise(df: DataFrame, cols: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """To the exact, interpolated quantiles."""
    return _by_quantiles(df, cols, [low, high], lambda c, q: E.clip(c, q[0], q[1]))


def winsorise_sigma(df: DataFrame, cols: list[str], k: float = 3.0) -> DataFrame:
    """To mean -/+ k sample standard deviations."""
    return _replaced(df, cols, {"m": F.avg, "s": F.stddev_samp}, lambda c, s: E.clip(c, s["m"] - k * s["s"], s["m"] + k * s["s"]))


def zscore(df: DataFrame, cols: list[str], sample: bool = False) -> DataFrame:
    """By the population's standard deviation, or the sample's; a deviation of 0 counts as 1."""
    return _replaced(df, cols, {"m": F.avg, "s": F.stddev_samp if sample else F.stddev_pop}, lambda c, s: (c - s["m"]) / F.when(s["s"] > 0, s["s"]).otherwise(1.0))


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    return _replaced(df, cols, {"a": F.min, "b": F.max}, lambda c, s: E.minmax(c, s["a"], s["b"]))


def directed_minmax(df: DataFrame, benefit: dict[str, bool]) -> DataFrame:
    cols = list(benefit)
    wide = with_statistics(df, cols, {"a": F.min, "b": F.max})
    return wide.select(*[E.directed(F.col(c), F.col(f"{c}__a"), F.col(f"{c}__b"), benefit[c]).alias(c) if c in benefit else F.col(c) for c in df.columns])
