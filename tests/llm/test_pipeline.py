from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from latticework.llm import pii
from latticework.llm.common import materialize, table

from .test_decontamination import brute as contaminated
from .test_jaccard_join import brute as near


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    cols = docs.columns
    kept = [docs]
    for name, stage in P.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf), "test-" + name))
    text = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    assert all(k.columns == cols for k in kept[:-1])

    gone = set(text[0]) - set(text[1])
    fine = [i for i, r in labels.items() if r.quality and not r.toxic]
    assert sum(i in gone for i in fine) <= 0.03 * len(fine)
    bad = [i for i, r in labels.items() if not r.quality]
    assert sum(i in gone for i in bad) >= 0.9 * len(bad), [i for i in bad if i not in gone]

    assert set(text[2]) == {c for _, _, c in near(list(text[1].items()), 5, 80)}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert set(text[3]) == {r[0] for r in contaminated(list(text[2].items()), items) if not r[5]} < set(text[2])
    assert set(text[4]) == set(text[3]) and any(text[4][i] != text[3][i] for i in text[3])
    assert not any(pii.base_spans(t) for t in text[4].values())
    assert all(text[4][i] == t for i, t in text[3].items() if not any(c.isdigit() or c in "@=:" for c in t))

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known.no_truncation()
    last = {r.doc_id: r for r in kept[-1].collect()}
    assert set(last) == set(text[4])
    assert all(r.ids == known.encode(text[4][i], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for i, r in last.items())


def test_run_is_the_stages(spark, sf):
    assert P.run(spark, sf).count() > 0 and P.ORACLE_SQL is None


def test_quality_stage_rejects_every_long_bad_or_toxic_document(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    size = {r.doc_id: len(r.text.split()) for r in docs.where("text is not null").collect()}
    kept = {r.doc_id for r in P.quality(spark, docs, sf).select("doc_id").collect()}
    labels = table(spark, sf, "labels").collect()
    wrong = [r.doc_id for r in labels if (not r.quality or r.toxic) and size.get(r.doc_id, 0) > 50]
    fine = [r.doc_id for r in labels if r.quality and not r.toxic]
    assert len(wrong) > 50 and not kept.intersection(wrong), sorted(kept.intersection(wrong))
    assert sum(i not in kept for i in fine) <= 0.03 * len(fine)


def test_edges(spark, tmp_path):
    """Nulls in any column, no words, repeated rows, ties, a long text, further columns, and tables without rows."""
    good = "The committee met on Monday and agreed that the road along the river should be repaired before the winter rains begin. "
    long = " ".join(f"{good}Part {i} of the report describes village number {i * 7}." for i in range(3000))
    texts = [(1, good * 2), (1, good * 2), (2, good * 2), (3, None), (4, ""), (5, " \t"), (None, good + "It was late."), (6, long), (7, long + " end"), (8, "idiot!!! " * 40)]
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None, "kept", "x") for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text string, own string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([*((i, 1, 0) for i in (1, 2, 6, 7)), (8, 0, 1)], "doc_id long, quality int, toxic int").limit(5 if d == "a" else 0).write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([(1, "not in any of these documents at all, since nobody wrote it")], "item_id long, text string").limit(1 if d == "a" else 0).write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    kept = docs
    for _, stage in P.STAGES[:-1]:
        kept = materialize(stage(spark, kept, f"{tmp_path}/a"), "test-edges")
        assert kept.columns == docs.columns and all(r["__text"] == "kept" for r in kept.collect())
    assert sorted(P.run(spark, f"{tmp_path}/a").select("doc_id").collect(), key=repr) == sorted(kept.select("doc_id").collect(), key=repr)
    assert {r.doc_id for r in kept.collect()} - {8} == {None, 1, 6} and kept.where("doc_id = 1").count() == 2
    assert P.run(spark, f"{tmp_path}/b").collect() == []
