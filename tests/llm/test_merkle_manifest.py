from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from latticework.llm import merkle_manifest as M
from latticework.llm.common import table
from latticework.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda s: sha256(s.encode()).hexdigest()


def leaf(d):
    i, text, lang, source, n = d
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def grown(nodes):
    """All levels of a tree, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def climbed(levels, at, x, proof):
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        before, after = "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
        x, proof, at = H(before + x + after), proof + before + after, at // 3
    return x, proof


def brute(docs, altered):
    groups = defaultdict(list)
    for d in docs:
        groups[d[3]].append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rows in groups.values():
        rows.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
    trees = {s: grown([leaf(d) for d in groups[s]]) for s in order}
    over = grown([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, d in enumerate(groups[s]):
            x, proof = climbed(trees[s], at, leaf(altered(d)), "")
            x, proof = climbed(over, k, x, proof)
            out.append((d[0], leaf(d), trees[s][-1][0], over[-1][0], H(proof), x, x == over[-1][0]))
    return sorted(out, key=repr)


def without_lines(d):
    return (d[0], d[1].replace("\n", "") if d[1] is not None else None, *d[2:]) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 else d


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def copy():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, M.leaf_of(text=F.translate("text", "\n", "")))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, sf, "documents").collect()]
    want = brute(docs, without_lines)
    assert rows(op12_merkle_manifest(spark, sf)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) and any(r[-1] and zlib.crc32(str(r[0]).encode()) % 2 == 0 for r in want)


@pytest.mark.parametrize("levels", [1, 2])
def test_layers_of_small_blocks(spark, monkeypatch, levels):
    """Blocks of 3 and 9 leaves: several layers, over one source with most rows and many with a few."""
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 3**levels)
    monkeypatch.setattr(M, "NODES", 20)
    rng = random.Random(levels)
    docs = [(i, f"a\nb{i}", "en", "hot" if i % 3 else rng.choice(["a", "b", "ß", "Z", None, f"s{i}"]), i) for i in range(170)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    settings = {"LEVELS": levels, "BLOCK": 3**levels, "NODES": 20}
    for f in ("_roots", "_paths", "_proofs"):
        monkeypatch.setattr(M, f, _with(getattr(M, f), settings))
    assert rows(M.manifest(frame, altered_leaf=copy())) == brute(docs, without_lines)


def _with(f, settings):
    """f, with the module's settings in the worker as here."""

    def run(batches):
        from latticework.llm import merkle_manifest

        for k, v in settings.items():
            setattr(merkle_manifest, k, v)
        return f(batches)

    return run


def test_edges(spark):
    long = "line\n" * 60_000
    docs = [(None, "x\ny", None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "q\nq", "en", "a", 3), (3, "q\nq", "en", "a", 3), (3, "other", "en", "a", 5), (None, "n", "en", "a", 1), (7, long, "fr", "b", len(long)), (8, "one", None, "", 3), (-5, "\n", "en", "b", 1)]
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], SCHEMA + ", key string, pos int")
    assert rows(M.manifest(frame, altered_leaf=copy())) == brute(docs, without_lines)
    assert all(r.verified for r in M.manifest(frame).collect())
    assert M.manifest(frame.limit(0)).collect() == []
    one = spark.createDataFrame(docs[:1], SCHEMA)
    assert rows(M.manifest(one)) == brute(docs[:1], lambda d: d)
    assert M.manifest(one).first().root == leaf(docs[0])


def test_any_change_breaks_the_proof(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 4}", 6) for i in range(50)], SCHEMA)
    for changed in ({"text": F.concat("text", F.lit(" "))}, {"doc_id": F.col("doc_id") + 1}, {"lang": F.lit(None)}, {"source": F.lit("s9")}):
        assert not any(r.verified for r in M.manifest(docs, altered_leaf=M.leaf_of(**changed)).collect())
