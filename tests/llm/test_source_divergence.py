from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from latticework.llm import source_divergence as D
from latticework.llm.common import table
from latticework.llm.queries import op13_source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(docs, least=10, top=10):
    """docs: (id, text, lang, source)"""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        count[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = sum((count[lang, s] for s in sources), Counter())

        def share(c):
            n = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}  # noqa: B023

        q, p = share(total), {s: share(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text, r.lang, r.source) for r in table(spark, sf, "documents").collect()])
    assert rows(op13_source_divergence(spark, sf)) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_random_texts_over_small_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = ["aa", "Bb", "ÄÖ", "äö", "x1y", "İst", "zz"]
    docs = [(i, " ".join(rng.choice(words[: rng.randrange(1, 8)]) for _ in range(rng.randrange(0, 9))), rng.choice(["de", "en", None]), rng.choice(["s1", "s2", "é", None])) for i in range(300)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    for least in (1, 10, 60):
        assert rows(D.audit(df, least_docs=least)) == brute(docs, least)
    monkeypatch.setattr(D, "ENTRIES", 3)
    monkeypatch.setattr(D, "BLOCK_TERMS", 2)
    assert list(D._blocks(__import__("pyarrow").table({"lang": [], "term": [], "source": [], "docs": [], "n": []}), 1)) == []


def test_edges(spark):
    long = "word other " * 50_000
    docs = [(None, None, None, None), (1, "", "en", "a"), (2, long, "en", "b"), (2, long, "en", "b"), (3, "Word", "en", "a"), (3, "word_WORD9word", "en", "c"), (4, "x\x00y\x85z", "fr", "a"), (5, "...", "de", "a"), (6, None, "de", "b")]
    df = spark.createDataFrame([(*d, "w", 7) for d in docs], SCHEMA + ", term string, n int")
    assert rows(D.audit(df, least_docs=2)) == brute(docs, 2)
    assert rows(D.audit(df, least_docs=1)) == brute(docs, 1)
    assert rows(D.audit(df, least_docs=99)) == brute(docs, 99)  # no term is kept: pairs of value 0
    assert D.audit(df.limit(0)).collect() == []


def test_many_sources_in_stripes(spark):
    """More sources than a stripe holds."""
    docs = [(i, f"common t{i % 7} {'own ' * (i % 3)}", "en", f"s{i % 300:03d}") for i in range(900)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = rows(D.audit(df, least_docs=10))
    assert got == brute(docs, 10)
    assert sum(r[2] == "pair" for r in got) == 300 * 299


def test_shares_of_large_counts():
    n, size = np.array([3 * 10**12, 5, 0]), np.array([7 * 10**14, 10**15, 9])
    assert D.shares(n, size).tolist() == [1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(n, size, strict=True)]


def test_a_term_in_all_documents_is_few_partial_runs(spark):
    """Runs are counted before they move: a term of half of all words is a row for each task and source."""
    docs = spark.range(20_000, numPartitions=4).selectExpr("id AS document", "'en' AS lang", "concat('s', id % 2) AS source", "concat('the the w', id % 3) AS text")
    partial = D.partial_runs(docs)
    assert partial.where("term = 'the'").count() == 8
    assert partial.where("term = 'the'").agg({"n": "sum"}).first()[0] == 40_000
