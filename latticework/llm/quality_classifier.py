"""Weak-label quality classifier.

Heuristic labellers vote good or bad on a document or stay silent, for two questions: is the text regular prose (quality), and is it free of abuse (toxicity); where a table of
labels has the document, it is one more labeller. Expectation-maximisation over how often each combination of votes occurs in the whole corpus (there are few combinations, and they are counted
on the cluster) estimates all labellers' accuracies and gives each combination's posterior. Posteriors of a bounded sample of rows, with and without labels, then train two hashed
linear scorers (logistic, L1): quality on binned statistics and pairs of byte classes, toxicity on words and their beginnings. Both score every document's whole text.

Bounds: at most `sample` rows with labels train the scorers, half of them rows that the labels call bad or toxic, as many as there are, and at most `unlabelled` rows without labels, each
taken in the order of a hash of the id; labelled rows are weighted back to their shares, and the others weigh half as much as these together. A row without labels trains
a scorer only if a labeller of its question voted; where there are no labels at all, silent rows do so too, by their posteriors. Nothing else is bounded.

Null and empty texts get no vote and are rejected: there is nothing to keep. Texts of any length are read whole, one at a time. Repeated rows score alike; repeated labels of an id vote by their
minimum quality and maximum toxicity, and of rows with one id the smallest text trains; null ids have no label. Ties of the sample's order go by id. Further columns are passed by,
whatever their names; those named as the output are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import U64, free_name, materialize, mix, texts_of

#: Words that abuse the reader, for the first labeller of toxicity.
INSULTS = frozenset(b"idiot moron stupid loser scum trash clown disgusting worthless pathetic imbecile idiots morons losers dumb bastard".split())
STATS = ("symbols", "upper", "repeats", "windows", "pipes", "bangs")
#: For each statistic: from which value on its labeller says bad, and up to which a text counts as regular.
RULES = {"symbols": (0.15, 0.02), "upper": (0.55, 0.15), "repeats": (0.4, 0.15), "windows": (0.6, 0.25), "pipes": (0.12, 0.01), "bangs": (0.25, 0.02)}
_SYMBOLS = b"*$%&#"
_BINS = np.array([0.005, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_STRIP = b".,;:!?\"'()[]{}<>*$%&#|-_=+/"
CACHE_WORDS = 300_000
_UPPER, _LETTER = (bytes(c for c in range(256) if not (65 <= c <= 90 or letters and 97 <= c <= 122)) for letters in (False, True))
#: Classes of bytes for the shapes: small, capital, digit, white space, the symbols, other punctuation, the rest (parts of other letters).
_CLASS = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t\n\r\x0b\x0c" else 4 if c in b"*$%&#" else 5 if c in b"!|" else 6 if c < 128 else 7 for c in range(256)], np.int64)


def _feature(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + b"\0" + value) >> 36  # 2**28 places


_BIN_FEATURES = [[_feature(b"bin", f"{s}:{k}".encode()) for k in range(len(_BINS) + 1)] for s in STATS]
#: A bin is all edges up to it, so that values beyond those of the few labelled rows count as much as the highest seen.
_UP_TO = [[_feature(b"upto", f"{s}:{k}".encode()) for k in range(len(_BINS))] for s in STATS]
_BINNED = [[np.array([own, *_UP_TO[s][:k]], np.int64) for k, own in enumerate(bins)] for s, bins in enumerate(_BIN_FEATURES)]
_SHAPE_FEATURES = np.array([_feature(b"shape", str(k).encode()) for k in range(64)], np.int64)


def _describe(text: bytes | None):
    """Words, statistics and the number of insults of a text; None without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return None
    letters = len(text.translate(None, _LETTER))
    capitals = len(text.translate(None, _UPPER))
    symbols = sum(len(w) >= 2 and w[-1] in _SYMBOLS and w[-2] in _SYMBOLS for w in words) if any(text.find(bytes([c])) >= 0 for c in _SYMBOLS) else 0
    bangs = sum(w.endswith(b"!!") for w in words) if b"!!" in text else 0
    h = np.fromiter(map(hash, words), np.int64, n).view(U64)
    own = np.sort(mix(mix(h[:-2]) + h[1:-1] * U64(3) + h[2:] * U64(0x9E3779B97F4A7C15))) if n >= 30 else h[:0]
    same = own[1:] == own[:-1]
    twice = int((np.append(same, False) | np.append(False, same)).sum()) if len(own) else 0
    low = text.lower()
    insults = sum(w.strip(_STRIP) in INSULTS for w in low.split()) if any(low.find(x) >= 0 for x in INSULTS) else 0
    stats = (symbols / n, capitals / letters if letters >= 20 else 0.0, float((h[1:] == h[:-1]).sum()) / (n - 1) if n >= 8 else 0.0, twice / len(own) if len(own) else 0.0, words.count(b"|") / n, bangs / n)
    return words, stats, insults


def _quality_features(text: bytes, stats: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Binned statistics, and the shares of pairs of byte classes."""
    kind = _CLASS[np.frombuffer(text, np.uint8)]
    share = np.bincount(kind[:-1] * 8 + kind[1:], minlength=64) / max(1, len(kind) - 1)
    binned = np.concatenate([_BINNED[k][int(np.searchsorted(_BINS, v, side="right"))] for k, v in enumerate(stats)])
    return np.concatenate([binned, _SHAPE_FEATURES]), np.concatenate([np.ones(len(binned)), share])


def _tox_of(word: bytes) -> list[int]:
    """Features of a word: itself without punctuation, and its beginnings."""
    w = word.lower().strip(_STRIP)
    return [_feature(b"word", w), *(_feature(b"begin", w[:k]) for k in (4, 5, 6, 7, 8) if len(w) > k)] if w else []


def _tox_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    feature, count = np.unique(np.array([f for w in words for f in _tox_of(w)], np.int64), return_counts=True)
    return feature, 10.0 * count / np.sqrt(len(words))


class WordWeight(dict):
    """A word to its features' summed weight; emptied when it is full."""

    def __init__(self, scorer):
        super().__init__()
        self.weights = dict(zip(scorer.places.tolist(), scorer.weights.tolist(), strict=True))

    def __missing__(self, word: bytes) -> float:
        get = self.weights.get
        self[word] = w = sum(get(f, 0.0) for f in _tox_of(word))
        return w

    def total(self, words: list[bytes]) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        return float(np.fromiter(map(self.__getitem__, words), np.float64, len(words)).sum())


#: Labellers of quality: one for each statistic, and one for texts in which all are low. Labellers of toxicity: any insult, many insults.
_QUALITY, _CLEAN = len(STATS) + 1, 2


def _ballot(row) -> list[int]:
    """Votes of the labellers: 1 good, 0 bad, -1 none."""
    if row is None:
        return [-1] * (_QUALITY + _CLEAN)
    words, stats, insults = row
    regular = all(x <= RULES[s][1] for s, x in zip(STATS, stats, strict=True))
    return [*(0 if x >= RULES[s][0] else -1 for s, x in zip(STATS, stats, strict=True)), 1 if regular else -1, 0 if insults else -1, 0 if insults / len(words) >= 0.004 else -1]


def votes(docs: DataFrame, text_col: str, kept: list[str]) -> DataFrame:
    """kept columns with v: array of the labellers' votes (1 good, 0 bad, -1 none), by rule, then by insults, and n_words."""
    df = docs.select(*kept, F.col(text_col).alias(free_name(kept, "text")))

    def run(batches):
        for b in batches:
            v, n = [], []
            for row in map(_describe, texts_of(b, b.schema.names[-1])):
                v.append(_ballot(row))
                n.append(0 if row is None else len(row[0]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(v, pa.list_(pa.int32())), pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "v", "n_words"])

    return df.mapInArrow(run, StructType([*df.schema.fields[:-1], *StructType.fromDDL("v array<int>, n_words long").fields]))


def expectation_maximisation(patterns: np.ndarray, count: np.ndarray, prior: float, *, anchor: int | None = None, silence: float | None = None, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each labeller the chance that a vote is good, given that it votes and the truth is bad or good; each pattern's posterior of good; good's share.

    patterns: (k, labellers) of 1, 0, -1. Not to vote is an outcome too: a labeller that looks for one fault and is silent elsewhere says much when it votes. The anchor, a
    labeller of people's judgements, has a prior that weighs ten times its votes: it calls 2 in 1000 good rows bad, and 1 in 20 bad ones good. silence
    bounds what staying silent says, for faults that no labeller but the anchor may know. The first posteriors follow the bad votes, and pseudo-counts keep the classes from changing places.
    """
    labellers = patterns.shape[1]
    if not len(patterns):
        return np.full((labellers, 2), 0.5), np.empty(0), prior
    bad = (patterns == 0).any(1)
    post = np.where(bad, 0.1, np.where((patterns == 1).any(1), 0.97, prior))
    pseudo = np.array([[1.0, 1.0, 0.3], [0.05, 1.0, 1.0]])  # by truth: bad, silent, good
    theta = np.empty((labellers, 2, 3))
    for _ in range(steps):
        share = float(np.clip((post * count).sum() / count.sum(), 0.5, 0.99))
        for k in range(labellers):
            for truth, w in ((0, (1 - post) * count), (1, post * count)):
                n = np.bincount(np.where(patterns[:, k] < 0, 1, 2 * patterns[:, k]), w, 3) + pseudo[truth]
                theta[k, truth] = n / n.sum()
        if anchor is not None:
            voted = patterns[:, anchor] >= 0
            for truth, wrong, often in ((1, 0, 0.002), (0, 2, 0.05)):
                n = np.bincount(2 * patterns[voted, anchor], ((post if truth else 1 - post) * count)[voted], 3) + pseudo[truth] * [1, 0, 1]
                prior_n = 10 * n.sum() * np.array([often, 0, 1 - often] if wrong == 0 else [1 - often, 0, often])
                votes_of = theta[anchor, truth, 0] + theta[anchor, truth, 2]
                for k in (0, 2):
                    theta[anchor, truth, k] = votes_of * (n[k] + prior_n[k]) / (n.sum() + prior_n.sum())
        outcome = np.where(patterns < 0, 1, 2 * patterns)
        ratio = np.log(theta[:, 1] / theta[:, 0])
        if silence is not None:
            ratio[:, 1] = np.clip(ratio[:, 1], -silence, silence)
        logit = np.log(share / (1 - share)) + ratio[np.arange(labellers), outcome].sum(1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return theta[:, :, 2] / (theta[:, :, 0] + theta[:, :, 2]), post, share


class Scorer:
    """A hashed linear scorer; weights of places that aren't kept are 0."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(places)
        self.places, self.weights, self.bias = places[order], weights[order], bias

    def weight(self, feature: np.ndarray) -> np.ndarray:
        if not len(self.places):
            return np.zeros(len(feature))
        at = np.minimum(np.searchsorted(self.places, feature), len(self.places) - 1)
        return np.where(self.places[at] == feature, self.weights[at], 0.0)

    def score(self, feature: np.ndarray, value: np.ndarray) -> float:
        return self.bias + float((self.weight(feature) * value).sum())


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray, *, least_rows: int = 4, l1: float = 2e-4, rate: float = 0.3, steps: int = 120) -> Scorer:
    """Logistic regression on soft targets by Adagrad with an L1 proximal step, over places that at least least_rows rows have."""
    if not rows:
        return Scorer(np.empty(0, np.int64), np.empty(0), 0.0)
    places, count = np.unique(np.concatenate([f for f, _ in rows]), return_counts=True)
    places = places[count >= least_rows]  # few of all: what follows is small
    if not len(places):
        places = np.zeros(1, np.int64)
    found = [np.minimum(np.searchsorted(places, f), len(places) - 1).astype(np.int32) for f, _ in rows]
    keep = [places[k] == f for k, (f, _) in zip(found, rows, strict=True)]
    at = np.concatenate([k[ok] for k, ok in zip(found, keep, strict=True)])
    value = np.concatenate([v[ok] for (_, v), ok in zip(rows, keep, strict=True)]).astype(float)
    row = np.repeat(np.arange(len(rows)), [int(ok.sum()) for ok in keep])
    del found, keep
    w, bias = np.zeros(len(places)), 0.0
    past, past_bias = np.full(len(places), 1e-8), 1e-8
    weight = weight / weight.sum()
    for _ in range(steps):
        z = bias + np.bincount(row, w[at] * value, len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.bincount(at, g[row] * value, len(places))
        past += grad * grad
        step = rate / np.sqrt(past)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        past_bias += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(past_bias)
    return Scorer(places[w != 0], w[w != 0], bias)


def fit(docs: DataFrame, labels: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, unlabelled: int = 2000) -> dict:
    """The model: accuracies and the two scorers."""
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ballots = materialize(votes(lean, "text", ["id"]).where("n_words > 0"), "quality-votes")
    if labels is not None:
        known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("lq"), F.max("toxic").cast("int").alias("lt"))
        marked = ballots.join(known, "id", "left")
    else:
        known = None
        marked = ballots.withColumns({"lq": F.lit(None).cast("int"), "lt": F.lit(None).cast("int")})
    m = _QUALITY
    combos = marked.groupBy("v", F.coalesce("lq", F.lit(-1)).alias("lq"), F.coalesce(1 - F.col("lt"), F.lit(-1)).alias("lt")).count().collect()
    model = {"scorers": {}}
    for name, part in (("quality", lambda r: [*r.v[:m], r.lq]), ("clean", lambda r: [*r.v[m:], r.lt])):
        total: dict[tuple, int] = {}
        for r in combos:
            key = tuple(int(x) for x in part(r))
            total[key] = total.get(key, 0) + r["count"]
        patterns = np.array(list(total), np.int64).reshape(len(total), 1 + (m if name == "quality" else _CLEAN))
        acc, post, share = expectation_maximisation(patterns, np.array(list(total.values()), float), 0.85, anchor=patterns.shape[1] - 1, silence=0.7 if name == "clean" else None)
        model[name] = {"accuracy": acc, "posterior": dict(zip(total, post.tolist(), strict=True)), "share": share}
    free = marked.where("id IS NOT NULL AND lq IS NULL AND lt IS NULL").select("id", "lq", "lt").distinct()
    picked, counts = free.orderBy(F.xxhash64("id"), "id").limit(unlabelled), {}
    if known is not None:
        rare = F.coalesce((F.col("lq") == 0) | (F.col("lt") == 1), F.lit(False))
        counts = {bool(r.rare): r["count"] for r in known.groupBy(rare.alias("rare")).count().collect()}
        for is_rare in (True, False):
            picked = picked.union(known.where(rare if is_rare else ~rare).orderBy(F.xxhash64("id"), "id").limit(sample // 2).select("id", "lq", "lt"))
    take = lean.join(F.broadcast(picked), "id").groupBy("id", "lq", "lt").agg(F.min("text").alias("text"))
    with_labels = known is not None

    def gather(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            labelled = [x is not None or y is not None for x, y in zip(b.column(b.schema.get_field_index("lq")).to_pylist(), b.column(b.schema.get_field_index("lt")).to_pylist(), strict=True)]
            for text in texts_of(b, "text"):
                row = _describe(text)
                feats = [(np.empty(0, np.int64), np.empty(0))] * 2
                if row is not None:
                    feats = [_quality_features(text, row[1]), feats[1]]
                    if not with_labels or labelled[len(out[0])] or max(_ballot(row)[m:]) >= 0:  # others don't train that scorer
                        feats[1] = _tox_features(row[0])
                for k, x in enumerate((_ballot(row), feats[0][0].tobytes(), feats[0][1].tobytes(), feats[1][0].astype(np.int32).tobytes(), feats[1][1].astype(np.float32).tobytes())):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("lq")), b.column(b.schema.get_field_index("lt")), pa.array(out[0], pa.list_(pa.int32())), *(pa.array(x, pa.binary()) for x in out[1:])], names=["lq", "lt", "v", "qf", "qv", "tf", "tv"])

    got = take.mapInArrow(gather, "lq int, lt int, v array<int>, qf binary, qv binary, tf binary, tv binary").collect()
    if not got:
        return model
    has = np.array([r.lq is not None or r.lt is not None for r in got])
    is_rare = np.array([r.lq == 0 or r.lt == 1 for r in got])
    weight = np.zeros(len(got))
    for k in (True, False):
        if (has & (is_rare == k)).any():
            weight[has & (is_rare == k)] = counts.get(k, 0) / (has & (is_rare == k)).sum()
    none = lambda x: -1 if x is None else int(x)
    for name, at, feature, value, kinds, options in (
        ("quality", slice(0, m), "qf", "qv", (np.int64, np.float64), {"l1": 1e-5, "steps": 600}),
        ("clean", slice(m, None), "tf", "tv", (np.int32, np.float32), {}),
    ):
        label = [none(r.lq) if name == "quality" else none(None if r.lt is None else 1 - r.lt) for r in got]
        post = np.array([model[name]["posterior"].get((*r.v[at], x), 0.5) for r, x in zip(got, label, strict=True)])
        spoke = np.array([max(r.v[at]) >= 0 for r in got]) if has.any() else np.ones(len(got), bool)
        own = np.where(has, weight, 0.0)
        if (~has & spoke).any():
            own[~has & spoke] = (0.5 * own.sum() if has.any() else 1.0) / (~has & spoke).sum()
        use = np.flatnonzero(own > 0)
        rows = [(np.frombuffer(got[k][feature], kinds[0]), np.frombuffer(got[k][value], kinds[1])) for k in use]  # views, no copies
        model["scorers"][name] = train(rows, post[use], own[use], **options)
    return model


def score(docs: DataFrame, model: dict, *, text_col: str = "text", keep: list[str] | None = None, least_quality: float = 0.5, least_clean: float = 0.5) -> DataFrame:
    """docs' columns (or those in keep) with p_quality and p_clean (chances that the text is regular, and free of abuse) and accepted."""
    m = _QUALITY
    names = ("p_quality", "p_clean", "accepted")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    df = docs.select(*kept, F.col(text_col).alias(free_name(kept, "text")))
    sent = df.sparkSession.sparkContext.broadcast({"scorers": model["scorers"], "posterior": {k: model[k]["posterior"] for k in ("quality", "clean")}})

    def run(batches):
        scorers, posterior = sent.value["scorers"], sent.value["posterior"]
        weight = WordWeight(scorers["clean"]) if scorers else None
        chance = lambda z: 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))
        for b in batches:
            q, c = [], []
            for text in texts_of(b, b.schema.names[-1]):
                row = _describe(text)
                if row is None:
                    q.append(0.0)
                    c.append(1.0)
                elif not scorers:
                    own = _ballot(row)
                    q.append(posterior["quality"].get((*own[:m], -1), 0.5))
                    c.append(posterior["clean"].get((*own[m:], -1), 0.5))
                else:
                    q.append(chance(scorers["quality"].score(*_quality_features(text, row[1]))))
                    c.append(chance(scorers["clean"].bias + 10.0 * weight.total(row[0]) / np.sqrt(len(row[0]))))
            ok = [x >= least_quality and y >= least_clean for x, y in zip(q, c, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(q, pa.float64()), pa.array(c, pa.float64()), pa.array(ok, pa.bool_())], names=[*b.schema.names[:-1], *names])

    return df.mapInArrow(run, StructType([*df.schema.fields[:-1], *StructType.fromDDL("p_quality double, p_clean double, accepted boolean").fields]))


def classify(docs: DataFrame, labels: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, keep: list[str] | None = None) -> DataFrame:
    return score(docs, fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample), text_col=text_col, keep=keep)
