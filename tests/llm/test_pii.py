from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from latticework.llm import pii
from latticework.llm.common import table
from latticework.llm.queries import op10_pii


def plain_spans(text: str):
    """The four patterns as they are written, with re."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_patterns_equal_re():
    rng = random.Random(3)
    pool = ["a", "Z", "9", "1", "25", "255", "256", ".", "@", "-", "+", " ", "(", ")", "%", "4111111111111111", "\n", "é", "x.y", "1.2.3.4"]
    for _ in range(6000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_query_equals_brute_force(spark, sf):
    want = {}
    for r in table(spark, sf, "documents").collect():
        s = plain_spans(r.text or "")
        want[r.doc_id] = (*(sum(k == kind for k, *_ in s) for kind in pii.KINDS[:4]), hashlib.sha256(",".join(":".join(map(str, x)) for x in s).encode()).hexdigest())
    got = op10_pii(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == want
    assert sum(sum(v[:4]) for v in want.values()) > 0
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in got:
        all_spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {tuple(s) for s in all_spans} >= {tuple(map(str, s)) for s in plain_spans(texts[r.doc_id])}
        assert all(0 <= int(b) < int(e) <= len(texts[r.doc_id]) for _, b, e in all_spans)


def test_field_on_held_out_rows():
    field = pii.default_field()
    held = pii.labelled_table(400, seed=99)
    words = pii.Words([" ".join(w).encode() for w, _ in held])
    gold = np.array([pii.LABELS.index(x) for _, row in held for x in row])
    which, fresh = pii._runs(words)
    got = field.decode(pii.features(words, which), fresh)
    assert (got == gold[which]).mean() > 0.95


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    feats = rng.integers(0, pii.N_FEATURES, (6, 4))
    fresh = np.array([True, False, False, False, True, False])
    got = field.decode(feats, fresh)

    def score(labels, at):
        e = field.emit[feats[at]].sum(1)
        return field.start[labels[0]] + sum(e[i, x] for i, x in enumerate(labels)) + sum(field.move[a, b] for a, b in zip(labels, labels[1:]))

    for at in (range(0, 4), range(4, 6)):
        at = list(at)
        best = max(product(range(k), repeat=len(at)), key=lambda x: score(x, at))
        assert tuple(got[at]) == best


def test_edges(spark):
    long = "7" * 60_000 + " " + "a" * 60_000 + "@b.c " + "1 " * 30_000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "é x@y.zz", 0), (3, "é x@y.zz", 0), (3, "é x@y.zz", 0), (4, long, 0)], "doc_id long, text string, base int")
    got = {(r.doc_id, r.spans) for r in pii.digest(pii.find(df, keep=["doc_id"]), "doc_id").collect()}
    assert {(1, ""), (2, ""), (None, "email:2:8"), (3, "email:2:8")} <= got
    assert any(k == 4 and "email:60001:120005" in s for k, s in got)
    assert pii.find(df.limit(0)).collect() == []
    assert {r.text for r in pii.redact(df).where("doc_id = 3").collect()} == {"é <email>"}
    assert pii.redact(df).columns == df.columns and pii.redact(df).where("text is null").count() == 1


def test_words_without_digits_are_labelled():
    field = pii.default_field()
    found = lambda t: [(k, t[b:e]) for k, b, e in pii.find_spans([t.encode()], field)[0][1]]
    assert found("we met there and password: correcthorse was lost again") == [("secret", "correcthorse")]
    assert found("write to jane at mailbox dot com about the matter") == [("email", "jane at mailbox dot com")]
    assert found("we looked at the house and the note: nothing else was there") == [] == found("the password was changed at the office")


def test_whole_texts_are_decoded_exactly():
    field = pii.default_field()
    held = pii.labelled_table(300, seed=5)
    words = pii.Words([" ".join(w).encode() for w, _ in held])
    which, fresh = pii._runs(words)
    feats = pii.features(words, which)
    assert np.allclose(pii.scores(words, field.emit), field.emit[feats].sum(1))
    assert (field.label(words) == field.decode(feats, fresh)).all()


def test_recall_and_precision_on_documents(spark):
    """Every planted token is covered, and what is added elsewhere are numbers or addresses, never plain prose."""
    import re

    covered = planted = 0
    for r in pii.find(table(spark, "/root/testdata/sf0.01", "documents"), keep=["text"]).collect():
        text = r.text or ""
        spans = [(x.start, x.end) for x in (*r.base, *r.added)]
        tokens = [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)]
        planted += len(tokens)
        covered += sum(any(s <= a and e >= b for s, e in spans) for a, b in tokens)
        assert all(re.search(r"\d|@", text[x.start : x.end]) for x in r.added)
    assert covered == planted >= 10
