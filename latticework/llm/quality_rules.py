"""Quality rules with robust multivariate outliers, in DataFrame operations alone.

Base statistics of whole texts are array expressions in one pass without a shuffle. Documents that pass the base rules become vectors of transformed statistics; for
each language and source, a minimum-covariance-determinant estimate tells how far a row lies, and rows beyond the cutoff are rejected. Concentration steps (the `part` of the rows nearest by
Mahalanobis distance give the next mean and covariance) run from two starts, all rows and the rows near the medians, until no determinant falls any more; the start with the
smaller determinant counts. Groups of fewer than MIN_GROUP rows use their language's estimate, and languages of fewer that of all.

A step takes counts by distance bin and sums of products by group, both aggregated before the shuffle, so a source with most of the rows is a few
partial sums for each task; distances come from Cholesky factors as column expressions. Bins make the nearest part exact up to one bin's width. What has a row for each group is
broadcast up to 20,000 of them, so that rows aren't dealt out by group; beyond, groups are many and small.

Null and empty texts have no words and fail the base rules; texts of any length are read whole, by the same rule. Null languages and sources are groups. Rows are judged each for itself, repeated or not, and
never joined by id; of equally good starts the first counts. Columns of the input other than the id, language, source and text are left out. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

MIN_GROUP = 100
#: Squared distances beyond which a row is an outlier. Normal vectors of four parts go beyond with a chance of 4e-8; statistics of regular text have longer tails than
#: normal ones, so a usual quantile (18.5 at 0.999) would reject some. Of the labelled documents of sf0.1 with odd ids, 18.5 rejects 1 good one more than 40, and no bad one more.
CUTOFF = 40.0
PART = 0.75
#: Concentration steps, at most; they end when no group's determinant falls by more than a thousandth.
STEPS = 12
#: Bits of a window's place in sorted keys; the other bits are of its hash.
PLACE_BITS = 20
#: Standard deviations of the vector's parts count as this much at least, so that a part that hardly varies doesn't reject on its own.
FLOOR = (0.10, 0.05, 0.10, 0.10)
_P = len(FLOOR)
_SPACE = r"[ \t\n\x0B\f\r]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    df = docs.withColumns({"__words": _words(text), "__lines": lines, "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
    })
    # A part of a window's hash and its place make one number, so sorting brings windows that may be equal together. Neighbours count as equal if their words are.
    # Where neighbours' bits agree but not their words, or places need more bits, whole windows are sorted instead: the result is the same rule's.
    n, words, hashes = F.col("n_words").cast("int"), F.col("__words"), F.col("__hash")
    window = lambda i: F.xxhash64(hashes[i], hashes[i + 1], hashes[i + 2])
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__keys", F.when(F.col("n_words") < 1 << PLACE_BITS, F.sort_array(F.transform(places, lambda i: F.shiftleft(window(i), PLACE_BITS).bitwiseOR(i.cast("long"))))))
    keys = F.col("__keys")
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    alike = lambda x, j, d: F.coalesce(F.shiftright(x, PLACE_BITS) == F.shiftright(F.get(keys, j + d), PLACE_BITS), F.lit(False))
    twins = F.filter(keys, lambda x, j: alike(x, j, -1) | alike(x, j, 1))
    equal = lambda i, k: (words[i] == words[k]) & (words[i + 1] == words[k + 1]) & (words[i + 2] == words[k + 2])
    df = df.withColumn("__twins", twins)
    pair = F.col("__twins")
    after = lambda j: F.get(pair, j + 1)
    false_twins = F.exists(F.transform(pair, lambda x, j: F.coalesce((F.shiftright(x, PLACE_BITS) == F.shiftright(after(j), PLACE_BITS)) & ~equal(place(x), place(after(j))), F.lit(False))), lambda x: x)
    df = df.withColumn("__pairs", F.when(F.col("__keys").isNull() | false_twins, F.array_sort(F.transform(places, lambda i: F.struct(window(i).alias("h"), words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i"))))))
    pairs = F.col("__pairs")
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    same_pairs = F.filter(pairs, lambda x, j: same(x, F.get(pairs, j - 1)) | same(x, F.get(pairs, j + 1)))
    df = df.withColumn("__at", F.sort_array(F.coalesce(F.transform(same_pairs, lambda x: x["i"]), F.transform("__twins", place))))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", covered)
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("__words", "__lines", "__hash", "__keys", "__twins", "__pairs", "__at")


def _vector() -> list[Column]:
    """Mean word length, symbols, repeated words, repeated lines; each damped and steadied by what texts of 50 words can vary."""
    n = F.col("n_words")
    return [F.log(F.col("word_chars") / n), F.log1p(20.0 * F.col("n_symbols") / F.col("word_chars")), F.sqrt(F.col("n_repeat_words") / (n + 100)), F.sqrt(F.col("n_dup_lines") / (n / 20 + 10))]


def _chi2_even(x: float, dof: int) -> float:
    """The chi-squared distribution function for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _consistency(part: float, p: int) -> float:
    """What the covariance of the nearest part is multiplied by to be that of all, for a normal distribution."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_even(mid, p) < part else (lo, mid)
    return part / _chi2_even(lo, p + 2)


def _moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean and Cholesky factor of each group's covariance times scale, the floors added to the diagonal."""
    x = [F.col(f"x{i}") for i in range(_P)]
    aggs = [F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i in range(_P) for j in range(i + 1))]
    df = rows.groupBy(*keys).agg(*aggs)
    df = df.select(*keys, *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(_P)), *((F.greatest(F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n"), F.lit(0.0 if i == j else -1e300)) * scale + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(_P) for j in range(i + 1)))
    for i in range(_P):  # one column after the other; each is used by later ones, so each gets a projection
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((F.ln(f"l{i}{i}") for i in range(_P)), F.lit(0.0))
    return df.select(*keys, *(f"m{i}" for i in range(_P)), *(f"l{i}{j}" for i in range(_P) for j in range(i + 1)), det.alias("det"))


def _distance(df: DataFrame) -> DataFrame:
    """df with dist, the squared Mahalanobis distance to its group's estimate."""
    for i in range(_P):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("dist", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(_P)), F.lit(0.0)))


def _near_medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose parts lie within 2.5 robust deviations (from the quartiles) of their group's medians."""
    quartiles = rows.groupBy(*keys).agg(*(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(_P)))
    quartiles = spread(materialize(quartiles, "quality-quartiles"))
    p = lambda i: F.col(f"p{i}")
    fits = [F.abs(F.col(f"x{i}") - p(i)[1]) <= 2.5 * F.greatest((p(i)[2] - p(i)[0]) / 1.349, F.lit(FLOOR[i])) for i in range(_P)]
    every = fits[0]
    for fit in fits[1:]:
        every = every & fit
    return rows.join(quartiles, keys).where(every).select(*rows.columns)


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's robust mean, Cholesky factor and half its logarithm's determinant (det). rows: keys (never null), x0 to x3."""
    every = [*keys, "start"]
    starts = _moments(rows, keys, 1.0).withColumn("start", F.lit(0)).unionByName(_moments(_near_medians(rows, keys), keys, 1.0).withColumn("start", F.lit(1)))
    est = materialize(starts, "quality-estimates")
    for _ in range(STEPS):
        known = spread(est)
        far = _distance(rows.join(known, keys)).withColumn("bin", F.least(F.floor(F.log1p("dist") * 200), F.lit(20_000)).cast("int"))
        counts = far.groupBy(*every, "bin").agg(F.count("*").alias("n")).groupBy(*every).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("all"))
        edge = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("bin")), lambda a, b: F.when(a["n"] >= PART * F.col("all"), a).otherwise(F.struct((a["n"] + b["n"]).alias("n"), b["bin"].alias("bin"))), lambda a: a["bin"])
        edges = spread(materialize(counts.select(*every, edge.alias("edge")), "quality-edges"))
        near = far.select(*every, "bin", *(f"x{i}" for i in range(_P))).join(edges, every).where("bin <= edge")
        new = materialize(_moments(near, every, _consistency(PART, _P)), "quality-estimates")
        fell = new.select(*every, F.col("det").alias("now")).join(est.select(*every, "det"), every).where("now < det - 0.0005")
        est, done = new, fell.isEmpty()
        if done:
            break
    first = est.groupBy(*keys).agg(F.min(F.struct("det", "start")).alias("best")).select(*keys, F.col("best.start").alias("start"))
    return materialize(est.join(first, every, "left_semi").drop("start"), "quality-estimates")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (null where base_failed), kept."""
    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  a null is a group of its own
    lean = docs.select(F.col(id_col).alias("__id"), own(lang_col).alias("__lang"), own(source_col).alias("__source"), F.col(text_col).alias("__text"))
    stats = materialize(base_statistics(lean, "__text").drop("__text"), "quality-statistics")
    rows = stats.where("NOT base_failed").select("__lang", "__source", *(v.alias(f"x{i}") for i, v in enumerate(_vector())))
    sizes = rows.groupBy("__lang", "__source").agg(F.count("*").alias("n")).withColumn("n_lang", F.sum("n").over(_lang_window()))
    level = sizes.select("__lang", "__source", F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\t", "__lang", "__source")).when(F.col("n_lang") >= MIN_GROUP, F.col("__lang")).otherwise("").alias("key"))
    level = materialize(level, "quality-levels")
    # A row counts for its own group, its language and all of them, each where that level's estimate is used.
    langs = materialize(level.where(F.col("key") == F.col("__lang")).select(F.col("__lang")).distinct().withColumn("by_lang", F.lit(True)), "quality-levels")
    everything = not level.where("key = ''").isEmpty()
    level, langs = spread(level), spread(langs)
    placed = rows.join(level, ["__lang", "__source"]).join(langs, "__lang", "left")
    keys = F.array_compact(F.array(F.when(F.col("key").contains("\t"), F.col("key")), F.when(F.col("by_lang"), F.col("__lang")), F.when(F.lit(everything), F.lit(""))))
    est = estimates(materialize(placed.select(F.explode(keys).alias("key"), *(f"x{i}" for i in range(_P))), "quality-vectors"), ["key"])
    with_x = stats.withColumns({f"x{i}": F.when(~F.col("base_failed"), v) for i, v in enumerate(_vector())})
    joined = _distance(with_x.join(level, ["__lang", "__source"], "left").join(spread(est), "key", "left"))
    return joined.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), F.col("dist")).alias("distance"), (~F.col("base_failed") & (F.coalesce("dist", F.lit(0.0)) <= CUTOFF)).alias("kept"))


def _lang_window():
    from pyspark.sql import Window

    return Window.partitionBy("__lang")
