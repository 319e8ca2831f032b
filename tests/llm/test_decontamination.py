from __future__ import annotations

import hashlib
import re

import numpy as np

from latticework.llm import decontamination as D
from latticework.llm.common import table
from latticework.llm.queries import op8_benchmark_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=10):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    wins: dict[tuple, set] = {}
    for k, t in items:
        w = words(t)
        for q in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[q : q + window]), set()).add("null" if k is None else str(k))
    out = []
    for k, t in docs:
        w = words(t)
        hit, names = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((k, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = brute(docs, items)
    assert rows(op8_benchmark_decontamination(spark, sf)) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_edges(spark):
    long = " ".join(f"w{i % 7}" for i in range(3000))
    docs = [(1, "The quick, BROWN fox"), (1, "The quick, BROWN fox"), (2, None), (3, ""), (None, "a b c d e f g h i j k l"), (4, long), (5, "é-é é"), (6, "quick brown")]
    items = [(1, "quick brown"), (2, "b c d e f g h i j k l m"), (None, "é é"), (3, None), (4, ""), (5, "w0 w1 w2 w3 w4 w5 w6 w0 w1 w2 w3 w4"), (5, "fox")]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for words in (2_000_000, 3):  # one block, and many
        assert rows(D.digest(D.find_matches(d, b, keep=["doc_id"], block_words=words), "doc_id")) == brute(docs, items)
    none = D.digest(D.find_matches(d, b.limit(0), keep=["doc_id"]), "doc_id")
    assert rows(none) == brute(docs, [])
    assert D.find_matches(d.limit(0), b).collect() == []
    assert {r.doc_id for r in D.decontaminate(d, b).collect()} == {2, 3}
    longest = {(m["item"], m["start"], m["length"]) for r in D.find_matches(d, b).where("doc_id is null").collect() for m in r.matches}
    assert longest == {("2", 1, 11)}


def test_suffix_array_sorts_suffixes():
    codes = np.random.default_rng(0).integers(2, 4, 300)
    sa = D.suffix_array(np.append(codes, 0))
    text = [tuple(codes[i : i + 27]) for i in sa]
    assert sorted(sa) == list(range(300)) and text == sorted(text)


def test_suffix_array_of_a_text_with_more_than_21_bits_of_words():
    n = 2**21 + 100
    codes = np.concatenate([np.arange(2, n + 2), np.arange(2, 22)])
    got = D.suffix_array(codes)
    # The 20 words at the end come before the same words at the beginning, since the text ends there.
    assert got.tolist() == [p for k in range(20) for p in (n + k, k)] + list(range(20, n))


def test_any_window(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 3, n))
    items = [(k, text(int(rng.integers(0, 90)))) for k in range(12)]
    docs = [(k, f"{text(30)} {items[k % 12][1]} {text(20)}" if k % 2 else text(150)) for k in range(24)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (5, 10, 40):
        want = brute(docs, items, window)
        assert any(r[5] for r in want)
        for words in (2_000_000, 100):
            assert rows(D.digest(D.find_matches(d, b, window=window, keep=["doc_id"], block_words=words), "doc_id")) == want


def test_text_of_three_million_words():
    words = [b"%d" % (i % 2_500_000) for i in range(3_000_000)]
    items = [("a", words[1_000_000:1_000_500]), ("b", words[10:40]), ("c", [b"x"] * 20)]
    for window in (40, 30):  # an item of fewer words is one window; the first half million words stand there twice
        (n, found), = D._search_rows([b" ".join(words)], D.Block(items, window))
        assert n == 3_000_000 and found == [("a", 1_000_000, 500), ("b", 10, 30), ("b", 2_500_010, 30)]


def test_all_of_the_benchmark_in_one_long_text():
    rng = np.random.default_rng(5)
    vocabulary = [b"%d" % i for i in range(5000)]
    item = [vocabulary[i] for i in rng.integers(0, 5000, 60_000)]
    (n, found), = D._search_rows([b" ".join(item * 20)], D.Block([("a", item)], 10))
    assert found[0] == ("a", 0, 60_000) and [f[1] for f in found] == [60_000 * k for k in range(20)] and all(f[2] == 60_000 for f in found)
