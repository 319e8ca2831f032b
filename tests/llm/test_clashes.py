"""Further columns, whatever their names, don't disturb the operators and come through where they are passed by."""

from __future__ import annotations

import public_tokenizers

from latticework.llm import bpe, decontamination, jaccard_join, license_scan, merkle_manifest, pii, quality_classifier, source_divergence, substring_dedup, suffix_dedup

NAMES = ["__text", "__n", "__m", "__id", "__b", "__row", "__dir", "__x", "removed", "removed_", "base", "added", "own", "file", "row", "id", "size", "comp", "text_", "v", "part", "h"]


def frame(spark, texts):
    rows = [(k, t, *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in NAMES)]))


def passed(df, but=()):
    """Each row's further columns are its own."""
    got = df.collect()
    assert got
    for r in got:
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES if n not in but)
    return got


def test_columns_of_any_name(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = frame(spark, [long, long + " x", "ask anna@example.org or call +1 555 010 0199", None, "", "Released under the MIT License"])
    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 112)), "a", "b")], "item_id long, text string, __n string, __m string")
    path = public_tokenizers.path("word_bpe_49k.json")

    assert {r.doc_id for r in passed(jaccard_join.deduplicate(docs))} == {0, 2, 3, 4, 5}
    assert {r.doc_id for r in passed(decontamination.decontaminate(docs, benchmark))} == {2, 3, 4, 5}
    assert sum(bool(r.matches) for r in passed(decontamination.find_matches(docs, benchmark))) == 2
    assert [r.text for r in passed(substring_dedup.remove_repeats(docs)) if r.doc_id == 1] == ["x"]
    assert [r.text for r in passed(pii.redact(docs)) if r.doc_id == 2] == ["ask <email> or call <phone>"]
    passed(pii.find(docs), but=("base", "added"))
    assert all(r.ids is not None for r in passed(bpe.encode(docs, path)))
    assert all(r.decoded is not None for r in passed(bpe.decode(bpe.encode(docs, path), path)))
    passed(quality_classifier.classify(docs, None))
    assert [r.license for r in passed(license_scan.scan(docs.withColumn("path", docs.text))) if r.doc_id == 5] == ["MIT"]
    assert [r.text for r in passed(suffix_dedup.strip_repeats(docs, window=100)) if r.doc_id == 1] == [" x"]
    source = docs.withColumns({"lang": docs.text, "source": docs.text, "n_chars": docs.doc_id})
    assert merkle_manifest.manifest(source).where("verified").count() == 6 and source_divergence.audit(source).count() == 0
    for df in (jaccard_join.deduplicate(docs), suffix_dedup.strip_repeats(docs), substring_dedup.remove_repeats(docs), pii.redact(docs), decontamination.decontaminate(docs, benchmark)):
        assert df.columns == docs.columns
