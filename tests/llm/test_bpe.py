from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from latticework.llm import bpe
from latticework.llm.common import table
from latticework.llm.queries import op7_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_query_equals_the_library(spark, sf, known):
    want = {}
    for r in table(spark, sf, "documents").collect():
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in op7_bpe(spark, sf).collect()} == want


def odd_texts():
    rng = random.Random(5)
    pool = ["a", "Z", "é", "é", "ß", "Σ", "ς", "İ", "ſ", "中", "٣", "½", "²", "_", "'s", "'LL", " ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "​", "　", "\U0001f600", "‍", "\x00", "-", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "the", "ing", "!!", "﻿", "ﬁ", "Ⅷ", "ǅ", "क्ष", "한", "하", " "]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]


def test_odd_texts_equal_the_library(known):
    coder = bpe.Encoder(bpe.vocabulary(PATH))
    texts = [*odd_texts(), "", "x" * 3000, "ab" * 2000, "!" * 500, "\ufdfa" * 50]
    ids, n = coder.encode(texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == known.encode(t, add_special_tokens=False).ids, t


def test_edges(spark):
    long = "word " * 30_000 + "y" * 20_000
    df = spark.createDataFrame([(1, None, [1]), (2, "", [2]), (None, "the the", None), (4, "the the", None), (5, long, None)], "doc_id long, text string, ids array<int>")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert {r.doc_id: (len(r.ids), r.decoded[:20]) for r in got if r.doc_id in (1, 2, 4)} == {1: (0, ""), 2: (0, ""), 4: (2, "the</w> the</w>")}
    assert got[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"} and len(got) == 5
    assert bpe.encode(df.limit(0), PATH).collect() == []
