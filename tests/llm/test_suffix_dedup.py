from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from latticework.llm import suffix_dedup as S
from latticework.llm.common import table
from latticework.llm.queries import op11_suffix_dedup

SCHEMA = "doc_id long, text string"


def gone_of(texts, window):
    """Bytes of each text that a repeated window covers."""
    count = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone, until = [], 0
        for p in range(len(t)):
            if count.get(t[p : p + window], 0) > 1 and p + window <= len(t):
                until = p + window
            gone.append(p < until)
        out.append(gone)
    return out


def brute(docs, window=400):
    texts = [(t or "").encode() for _, t in docs]
    out = []
    for (i, _), t, gone in zip(docs, texts, gone_of(texts, window), strict=True):
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r[0], r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in df.collect()), key=repr)


def texts_of(rng, n, letters, passages, size):
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 4 * size))) for _ in range(passages)]
    parts = lambda: (rng.choice(made) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randrange(0, size))) for _ in range(rng.randrange(0, 7)))
    return [(i, "".join(parts())) for i in range(n)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert sorted(map(tuple, op11_suffix_dedup(spark, sf).collect()), key=repr) == want
    assert sum(0 < r[2] < r[1] for r in want) > 5


@pytest.mark.parametrize(("window", "gram", "letters"), [(12, 5, "ab"), (20, 6, "abcé"), (30, 30, "ab ")])
def test_random_texts(spark, window, gram, letters):
    rng = random.Random(window)
    docs = texts_of(rng, 60, letters, 5, window)
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows(S.find_repeats(df, window=window, gram=gram)) == brute(docs, window)


def test_passages_in_many_surroundings(spark, monkeypatch):
    """Groups that are too large for one suffix array, and stretches cut at the borders of parts of texts."""
    rng = random.Random(8)
    docs = texts_of(rng, 80, "abcdefgh", 3, 40)
    df = spark.createDataFrame(docs, SCHEMA)
    for most in (3, 8):
        monkeypatch.setattr(S, "MOST", most)
        assert rows(S.find_repeats(df, window=40, gram=8)) == brute(docs, 40)


def test_large_groups_have_all_occurrences(spark, monkeypatch):
    rng = random.Random(6)
    docs = texts_of(rng, 60, "abcdefgh", 3, 50)
    texts = [t.encode() for _, t in docs]
    monkeypatch.setattr(S, "MOST", 4)
    got = defaultdict(set)
    for r in S.repeat_groups(spark.createDataFrame(docs, SCHEMA), window=40, gram=8).collect():
        got[r.repeat, r.length].add((r.doc_id, r.start))
    covered = [[False] * len(t) for t in texts]
    for (_, n), at in got.items():
        (s,) = {texts[i][k : k + n] for i, k in at}
        places = {(i, k) for i, t in enumerate(texts) for k in range(len(t) - n + 1) if t[k : k + n] == s}
        assert at == places and len(at) > 1
        for i, k in at:
            covered[i][k : k + n] = [True] * n
    assert covered == gone_of(texts, 40)


def test_parts_of_long_texts():
    rng = random.Random(3)
    t = "".join(rng.choice("abcdefgh") for _ in range(5000)).encode()
    before, S.CHUNK = S.CHUNK, 700
    try:
        seen = []
        for rows_, at, joined, ends in S._segments([t, b"", t[100:]], 50):
            lo, m, _ = S._stretches_of(joined, ends, 50, 10)
            for a, n in zip(lo.tolist(), m.tolist(), strict=True):
                k = next(i for i, e in enumerate(ends[1:]) if a < e)
                seen += [(int(rows_[k]), int(at[k]) + a - ends[k] + x) for x in range(n)]
        assert sorted(seen) == [(0, p) for p in range(4951)] + [(2, p) for p in range(4851)]
    finally:
        S.CHUNK = before


def test_edges(spark):
    p, q = "".join(f"w{i}é" for i in range(100)), "".join(f"v{i}ß" for i in range(120))
    long = "".join(f"z{i % 997}" for i in range(40_000))
    docs = [(1, None), (2, ""), (None, p), (None, "x" + p), (5, q), (5, q), (9, "\x00" * 900), (10, "a" * 399), (11, "a" * 400), (12, "b" * 401), (20, long), (21, "one " + long + " end"), (30, p[:399] + q[200:]), (31, "\x00" * 450)]
    df = spark.createDataFrame([(*d, "t", 1) for d in docs], SCHEMA + ", sx string, id int")
    assert rows(S.find_repeats(df)) == brute(docs)
    assert S.find_repeats(df.limit(0)).collect() == []
    assert S.repeat_groups(df.limit(0)).collect() == []
    kept = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs[10:])], SCHEMA + ", removed int")
    assert S.strip_repeats(kept).columns == kept.columns
    assert {r.doc_id: len(r.text) for r in S.strip_repeats(kept).collect()}[20] == 0


def maximal(texts, window):
    """string -> places, of strings of a window or more that occur twice or more, and cannot be made longer on either side at all of their places."""
    grow = {}
    level = defaultdict(list)
    for i, t in enumerate(texts):
        for k in range(len(t) - window + 1):
            level[t[k : k + window]].append((i, k))
    while level := {s: at for s, at in level.items() if len(at) > 1}:
        longer = defaultdict(list)
        for s, at in level.items():
            right = {texts[i][k + len(s) : k + len(s) + 1] or (i, k) for i, k in at}
            left = {texts[i][k - 1 : k] or (i, k) for i, k in at}
            if len(right) > 1 and len(left) > 1:
                grow[s] = sorted(at)
            for i, k in at:
                if k + len(s) < len(texts[i]):
                    longer[texts[i][k : k + len(s) + 1]].append((i, k))
        level = longer
    return grow


def test_groups_have_all_occurrences(spark):
    """Each group is one string and all of its places, and each maximal repeat that one stretch can hold is there."""
    rng = random.Random(4)
    docs = texts_of(rng, 40, "abc", 4, 14)
    texts = [t.encode() for _, t in docs]
    got = defaultdict(set)
    for r in S.repeat_groups(spark.createDataFrame(docs, SCHEMA), window=9, gram=4).collect():
        got[r.repeat, r.length].add((r.doc_id, r.start))
    strings = {}
    for (name, n), at in got.items():
        (s,) = {texts[i][k : k + n] for i, k in at}
        assert len(s) == n and len(at) > 1
        strings[s] = at
        places = {(i, k) for i, t in enumerate(texts) for k in range(len(t) - n + 1) if t[k : k + n] == s}
        assert at == places
    want = maximal(texts, 9)
    assert sum(len(s) == 9 for s in want) > 3
    for s, at in want.items():
        if len(s) == 9:
            assert strings[s] == set(at)


def test_intervals():
    """Suffixes 0 to 4 share 9, 12, 12, 9; the inner ones have one byte on their left."""
    assert S.intervals([9, 12, 12, 9], [True, True, True, True]) == [(12, 1, [1, 2, 3], 1), (9, -1, [0, 4], 0)]
    assert S.intervals([9, 12, 12, 9], [True, False, False, True]) == [(9, -1, [0, 1, 2, 3, 4], 0)]
    assert S.intervals([9, 12], [False, False]) == []
    assert S.intervals([5, 7, 6], [True] * 3) == [(7, 1, [1, 2], 1), (6, 2, [3], 1), (5, -1, [0], 0)]


def test_only_windows_that_begin_a_repeat_are_sorted(monkeypatch):
    """Nodes are those of all windows' suffixes, and the windows inside of a repeat, which have one left byte everywhere, make no work."""
    rng = random.Random(12)
    made = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    shared, long = made(60), made(900)
    pieces = [made(7) + shared + made(9), made(3) + shared + made(2), shared + made(5), made(40), b"a" * 70, made(1) + long + made(1), made(2) + long, long + made(3)]
    rows_ = [(1, k, k, 0, 10 * k, p, k in (2, 3)) for k, p in enumerate(pieces)]
    runs = []
    counted = lambda shared, differ, f=S.intervals: runs.append(len(shared) + 1) or f(shared, differ)
    monkeypatch.setattr(S, "intervals", counted)
    got = list(S._array(rows_, 40))
    assert sum(runs) < 60, "suffixes that were scanned"
    monkeypatch.setattr(S, "_varied", lambda text, begin, size, copies, window: iter([(j, o) for j, n in enumerate(size.tolist()) for o in range(n - window + 1)]))
    runs.clear()
    key = lambda r: repr((r["node"], r["above"], r["size"], r["own"]))
    assert sorted(map(key, got)) == sorted(map(key, S._array(rows_, 40))) and len(got) > 3 and sum(runs) > 2000
