from __future__ import annotations

import re
from collections import Counter

import numpy as np

from latticework.llm import quality_rules as Q
from latticework.llm.common import table
from latticework.llm.queries import op4_quality_rules


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    repeat = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in (0, 1, 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), n < 50 or 100 * len(repeat) > 50 * n


def test_query_equals_brute_force(spark, sf):
    want = {r.doc_id: brute(r.text) for r in table(spark, sf, "documents").collect()}
    got = op4_quality_rules(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == want
    assert all(not r.kept for r in got if r.base_failed)


def test_no_python_in_the_plan(spark, sf):
    plan = op4_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(120_000))
    huge = "a b c d " * 270_000  # over 2**20 words: the pairs' branch
    texts = [None, "", " \n\t", "a b c", "x\r\nx\ny\n\ny\n y", "a a a a a", "a b c a b c d", "é ü #*$ <>", long, huge]
    df = spark.createDataFrame([(k, t, None, None, 0, 0) for k, t in enumerate(texts)] + [(2, "a b c", "en", "s", 0, 0)] * 2, "doc_id long, text string, lang string, source string, dist int, key int")
    got = Q.judge(df).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: tuple(r)[1:7] for r in got if r.doc_id != 2} == {k: brute(t) for k, t in enumerate(texts) if k != 2}
    assert Q.judge(df.limit(0)).collect() == []


def test_outliers_by_group(spark):
    """Rows far from their group's bulk are rejected, though a fifth of the group is like them; the bulk stays."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        lang = "abc"[k % 3]
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 6)) + (6 if lang == "c" else 0))) for _ in range(int(rng.integers(80, 200)))]
        odd = k % 5 == 0 and lang != "b"
        rows.append((k, " ".join(w + "%%%" for w in words) if odd else " ".join(words), lang, "s1" if k % 2 else "s2", odd))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, odd boolean")
    got = {r.doc_id: r.kept for r in Q.judge(df).collect()}
    assert all(got[k] != odd for k, _, _, _, odd in rows)


def test_consistency_factor():
    assert abs(Q._chi2_even(5.385, 4) - 0.75) < 1e-3 and Q._consistency(0.75, 4) > 1.3


def test_equal_bits_of_unequal_windows(spark, sf, monkeypatch):
    """With 3 bits of each hash left, most windows collide; words decide."""
    monkeypatch.setattr(Q, "PLACE_BITS", 61)
    docs = table(spark, sf, "documents").where("length(text) < 3000")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.base_statistics(docs).drop("text").collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()} and len(got) > 50


def concentrated(x, start):
    """Plain concentration steps on one group, without bins."""
    est = x[start].mean(0), np.cov(x[start].T, bias=True)
    for _ in range(50):
        m, c = est
        c = c + np.diag(np.square(Q.FLOOR))
        far = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        near = np.argsort(far)[: int(np.ceil(Q.PART * len(x)))]
        est = x[near].mean(0), np.cov(x[near].T, bias=True) * Q._consistency(Q.PART, 4)
    return est[0], est[1] + np.diag(np.square(Q.FLOOR))


def test_estimates_equal_plain_concentration_steps(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for g in "ab":
        a = rng.normal(size=(4, 4))
        x = rng.normal(size=(4000, 4)) @ a * 0.6 + rng.normal(size=4)
        x[:800] = rng.normal(size=(800, 4)) * 0.2 + rng.normal(size=4) * 6  # a crowd of outliers, which masks itself from the classical start
        groups[g] = x
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    est = {r.key: r for r in Q.estimates(spark.createDataFrame(rows, "key string, x0 double, x1 double, x2 double, x3 double"), ["key"]).collect()}
    for g, x in groups.items():
        m = np.array([est[g][f"m{i}"] for i in range(4)])
        low = np.array([[est[g][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        med = np.median(x, 0)
        iqr = (np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349
        found = [concentrated(x, s) for s in (np.ones(len(x), bool), (np.abs(x - med) <= 2.5 * iqr).all(1))]
        mean, cov = min(found, key=lambda e: np.linalg.det(e[1]))
        assert np.allclose(m, mean, atol=0.03) and np.allclose(low @ low.T, cov, atol=0.05, rtol=0.05)
        far = lambda mu, c: np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu)
        ours, plain = far(m, low @ low.T), far(mean, cov)
        sure = np.abs(plain - Q.CUTOFF) > 2
        assert ((ours > Q.CUTOFF) == (plain > Q.CUTOFF))[sure].all() and (plain[:800] > Q.CUTOFF).mean() > 0.9 and (plain[800:] > Q.CUTOFF).mean() < 0.01
