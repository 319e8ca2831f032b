from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from latticework.llm import jaccard_join as J
from latticework.llm.common import WordHash, table
from latticework.llm.components import components
from latticework.llm.queries import op1_jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(docs, n):
    out = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    return out


def brute(docs, n, percent):
    sets = sets_of(docs, n)
    holders: dict = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    both = Counter()
    for ks in holders.values():
        both.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in both.items():
        if 100 * c >= percent * (len(sets[a][1]) + len(sets[b][1]) - c) and sets[a][0] is not None and sets[b][0] is not None:
            parent[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least[find(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], 4, 85)
    assert rows(op1_jaccard_join(spark, sf)) == want
    assert sum(a != c for a, _, c in want) > 20


@pytest.mark.parametrize("percent,n", [(85, 4), (60, 1), (80, 5)])
def test_chains_and_crowded_buckets(spark, percent, n, monkeypatch):
    """Copies of copies drift apart, and all share a passage, so that pivots don't reach everything."""
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(percent)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    docs, i = [], 0
    for _ in range(12):
        text = passage + [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(1, 14)):
            docs.append((i := i + 1, " ".join(text)))
            text = list(text)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(docs)
    docs = [(k, t) for (k, _), (_, t) in zip(sorted(docs), docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, n, percent)
    assert rows(J.near_duplicates(df, n=n, percent=percent)) == want
    assert 1 < len({c for _, _, c in want}) < len(docs)
    kept = {r.doc_id for r in J.deduplicate(df, n=n, percent=percent).collect()}
    assert kept == {c for _, _, c in want}


def test_sketches_bound_and_meet():
    """Every pair that is similar shares a bucket."""
    rng = np.random.default_rng(1)
    bands = J.Bands(85, 3000)
    for _ in range(300):
        size = int(rng.integers(1, 800))
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        differ = int((1 - 85 / 100) / 1.85 * 2 * size)
        k = int(rng.integers(0, differ + 1))
        b = np.concatenate([a[: size - k // 2], rng.integers(0, 2**63, k - k // 2).astype(np.uint64)])
        if not len(b) or not J.similar(len(a), len(b), size - k // 2, 85) or set(a) == set(b):
            continue
        key, doc = bands.entries([np.sort(a), np.sort(b)])
        assert set(key[doc == 0]) & set(key[doc == 1])


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(40_000))
    docs = [(1, None), (2, ""), (3, " \t"), (None, "a b c d e"), (None, "a b c d e"), (9, "a b c d e"), (8, "A B c d e"), (7, "a b"), (6, "a B"), (5, "b a"), (20, long), (21, long + " end"), (30, "s " * 300), (31, "s " * 70)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, id int, size int")
    assert rows(J.near_duplicates(df, n=4, percent=85)) == brute(docs, 4, 85)
    assert J.near_duplicates(df.limit(0)).collect() == []
    assert J.deduplicate(df, n=4, percent=85).columns == df.columns


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (200, 199)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 100 for k in range(100, 161)} | {3: 3, 5: 3, 9: 3, 199: 199, 200: 199}


def test_word_hash_cache_is_bounded():
    cache = WordHash(most=10)
    for k in range(100):
        cache.of([b"%d" % k])
    assert len(cache) <= 12
