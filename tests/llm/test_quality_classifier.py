from __future__ import annotations

import numpy as np

from latticework.llm import quality_classifier as C
from latticework.llm.common import table


def test_held_out_accuracy(spark):
    """Fit with the labels of even ids, judged by those of odd ids."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = C.classify(docs, labels.where("doc_id % 2 = 0"), keep=["doc_id"])
    held = labels.where("doc_id % 2 = 1").join(found, "doc_id").collect()
    regular = [r for r in held if r.quality == 1]
    assert np.mean([(r.p_quality >= 0.5) == bool(r.quality) for r in held]) > 0.98
    clean = [r for r in regular if not r.toxic]
    assert np.mean([r.accepted for r in clean]) > 0.99
    assert np.mean([not r.accepted for r in regular if r.toxic]) > 0.85


def test_expectation_maximisation_finds_the_poor_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth).astype(int) for a in (0.95, 0.9, 0.9, 0.6)], 1)
    votes[rng.random(votes.shape) < 0.1] = -1
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    acc, post, share = C.expectation_maximisation(patterns, count.astype(float), 0.8)
    assert abs(share - 0.8) < 0.05
    assert acc[0, 1] - acc[0, 0] > acc[1, 1] - acc[1, 0] > acc[3, 1] - acc[3, 0]


def test_edges(spark):
    good = "Plain words make a calm and regular text, and they go on for a while without any trouble. " * 3
    bad = "idiot!!! " * 40
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good), (4, "STOP!! " * 30), (5, "word " * 60_000), (6, bad), (7, "a | b | c | d | e |")]
    df = spark.createDataFrame([(a, b, 0.0, "x") for a, b in rows], "doc_id long, text string, p_clean double, v string")
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 1, 0), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), None):
        got = {(r.doc_id, (r.text or "")[:5]): r.accepted for r in C.classify(df, known).collect()}
        assert got[2, ""] is False and got[3, ""] is False
        assert C.classify(df, known).count() == len(rows)
    assert C.classify(df.limit(0), labels).collect() == []
