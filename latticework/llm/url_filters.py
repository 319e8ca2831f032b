"""URL filters: rules are (host, path, action), and a URL is looked up by its host-suffix and path-prefix expressions.

Each URL's host suffixes (only of as many labels as some rule's host has) are combined with its path prefixes (only of lengths that some
rule's path has); each expression's SHA-256 meets the rules' in an equi-join on its first 32 bits, and the full digests then decide.
Of the rules that fit, the longest expression wins; of equally long ones (the same expression twice), block goes before allow.

A null URL, or one without "://", has an empty host and path, which no rule fits; URLs of any length are read whole. Each row is judged for itself, repeated or not: rows are never joined by id.
Rules with a null host or path are left out. Further columns are passed by unless they clash with host, path, rule or verdict, which are
replaced. Empty tables and empty rule lists give empty results or the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Rules of up to this many characters together (with 200 for each rule's digests) go to the executors whole; more are joined by a shuffle.
BROADCAST_CHARS = 10_000_000


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, to the next ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(e: Column) -> Column:
    return F.sha2(e, 256)


def expressions(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """host suffix + path prefix, for each of the given numbers of labels and path lengths that the URL has."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.size(labels)), lambda d: F.concat_ws(".", F.slice(labels, F.size(labels) - d + 1, d)))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host + path of the winning rule, else null) and verdict (its action, else `default`).

    rules: host (lower case), path (a prefix, with its leading slash), action (block or allow).
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select("host", "path", "action")
    stats = rules.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("host", r"\.", -1))).alias("d"), F.collect_set(F.length("path")).alias("l"), F.sum(F.length("host") + F.length("path") + 200).alias("chars")).first()
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not stats.n:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    expr = F.concat("host", "path")
    index = rules.groupBy(expr.alias("__expr")).agg(F.max("action").alias("__action"))  # "block" sorts after "allow"
    index = index.select(F.substring(_digest(F.col("__expr")), 1, 8).alias("__key"), _digest(F.col("__expr")).alias("__digest"), "__expr", "__action")
    if stats.chars <= BROADCAST_CHARS:
        index = F.broadcast(index)
    seen = base.select("host", "path").where("host <> ''").distinct()
    probes = seen.select("host", "path", F.explode(F.transform(expressions(F.col("host"), F.col("path"), sorted(stats.d), sorted(stats.l)), lambda e: _digest(e))).alias("__full"))
    probes = probes.withColumn("__key", F.substring("__full", 1, 8))
    hits = probes.join(index, "__key").where(F.col("__full") == F.col("__digest"))
    key, h, p, w = (free_name(base.columns, x) for x in ("key", "won_host", "won_path", "won"))
    won = hits.groupBy(F.col("host").alias(h), F.col("path").alias(p)).agg(F.max_by(F.struct("__expr", "__action"), F.length("__expr")).alias(w))
    # URLs without a host meet nothing, so they may go anywhere: not all of them to one task.
    keyed = base.withColumn(key, F.when(F.col("host") == "", F.concat(F.lit("/"), F.spark_partition_id().cast("string"))).otherwise(F.col("host")))
    return (
        keyed.join(won, (F.col(key) == F.col(h)) & (F.col("path") == F.col(p)), "left")
        .withColumns({"rule": F.col(w)["__expr"], "verdict": F.coalesce(F.col(w)["__action"], F.lit(default))})
        .select(*base.columns, "rule", "verdict")
    )
