from __future__ import annotations

import hashlib
import random
import re

from latticework.llm import substring_dedup as S
from latticework.llm.common import table
from latticework.llm.queries import op3_substring_dedup


def brute(docs, window=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    smallest: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                smallest[key] = min(i, smallest.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and smallest[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert rows(op3_substring_dedup(spark, sf)) == want
    assert sum(r[2] > 0 for r in want) > 20


def test_short_windows_on_random_texts(spark):
    rng = random.Random(2)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 20))) for _ in range(6)]
    docs = [(i, " ".join(rng.choice(passages) if rng.random() < 0.5 else rng.choice("abcdefghij") for _ in range(rng.randrange(0, 14)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (4, 7):
        got = S.find_repeats(df, window=window)
        assert rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute(docs, window)
    clean = {r.doc_id: r.text for r in S.remove_repeats(df, window=7).collect()}
    assert {(i, hashlib.sha256(" ".join(t.split()).encode()).hexdigest()) for i, t in clean.items()} == {(r[0], r[3]) for r in brute(docs, 7)}


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i % 997}" for i in range(30_000))
    docs = [(1, None), (2, ""), (None, p), (5, "x " + p), (5, "x " + p), (5, p + " z"), (9, p), (9, p), (3, "one\ttwo three"), (20, long), (21, long + " end"), (30, "s " * 300), (31, "s " * 70)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, id int")
    assert rows(S.find_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute(docs)
    assert S.find_repeats(df.limit(0)).collect() == []
