from __future__ import annotations

import math
import re

from latticework.llm import license_scan as L
from latticework.llm.common import table
from latticework.llm.queries import op5_license_scan


def brute(files):
    """(path, text) to (license, origin, directory), plainly."""
    terms = L._terms()
    docs = [set(L.tokens(t or "")) for _, t in files]
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in d for d in docs))) + 1 for t in terms}
    vectors = L._vectors(idf)
    own = []
    for _, text in files:
        best, n = None, 0
        for line in (text or "").split("\n"):
            w = L.tokens(line)
            v: dict = {}
            for x in w:
                if x in idf:
                    v[x] = v.get(x, 0) + idf[x]
            if not v or 2 * sum(x in idf or x in L._FILLER for x in w) < len(w):
                continue
            norm = math.sqrt(sum(x * x for x in v.values()))
            s, k = max((round(sum(x * v.get(t, 0) for t, x in u.items()) / norm, 9), -j) for j, (_, u) in enumerate(vectors))
            if s >= 0.8:
                best = max(best or (0, 0, ""), (s, k, vectors[-k][0]))
                n += len(line.split())
        own.append((best[2], n / len(re.findall(r"[^ \t\n\x0B\f\r]+", text))) if best else None)
    dirs: dict = {}
    for (p, _), o in sorted(zip(files, own), key=lambda x: x[0][0] or ""):
        if o and o[1] >= 0.5 and p is not None:
            dirs.setdefault(p.rpartition("/")[0], set()).add(o[0])
    out = []
    for (p, _), o in zip(files, own):
        if o:
            out.append((p, o[0], "own", None))
            continue
        at = p.rpartition("/")[0] if p is not None else None
        while at is not None and at not in dirs:
            at = at.rpartition("/")[0] if at else None
        out.append((p, next(iter(dirs[at])), "inherited", at) if at is not None else (p, None, "none", None))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "documents").collect()
    files = [(f"{r.source}/{r.lang}/{r.doc_id // 100}/{r.doc_id}.txt", r.text) for r in rows]
    got = sorted(((r.path, r.license, r.origin, r.license_dir) for r in op5_license_scan(spark, sf).collect()), key=repr)
    assert got == brute(files)
    assert sum(x[1] is not None for x in got) > 10


def test_nearest_ancestor_and_edges(spark):
    files = [
        ("LICENSE", "Released under the MIT License."), ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/x.py", "import x"), ("a/y.py", "print(1)"), ("z/q/r.py", "some words here"),
        ("a/b/gpl.c", "int main()\n" * 20 + "This work is licensed under the GNU General Public License, version 3."), ("a/b/none.c", None), (None, "words"), ("", ""), ("top.py", "Mit und. Ungte mit."), ("z/q/cc.txt", "Licensed under CC BY-NC 4.0."),
        ("z/long.txt", "word " * 60_000), ("z/q/r.py", "some words here"),
    ]
    df = spark.createDataFrame([(p, t, "x", 1) for p, t in files], "path string, text string, license string, origin int")
    got = L.scan(df)
    assert sorted(((r.path, r.license, r.origin, r.license_dir) for r in got.collect()), key=repr) == brute(files)
    by = {r.path: r for r in got.collect()}
    assert by["a/b/c/x.py"].license == "Apache-2.0" and by["a/b/c/x.py"].license_dir == "a" and by["a/b/gpl.c"].origin == "own" and by["a/b/none.c"].license == "Apache-2.0"
    assert by["z/q/r.py"].license == "CC-BY-NC-4.0" and by["z/long.txt"].license == "MIT" and by["top.py"].license == "MIT" and by[None].license is None
    assert L.scan(df.limit(0)).collect() == []
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_full_texts_headers_and_tags(spark):
    texts = dict(L.full_texts())
    mit = texts["MIT"].replace("<year> <copyright holders>", "2020 Jane Roe")
    gnu = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    code = "int main() { int value = compute(3); return value; }\n" * 30
    want = {
        "m/LICENSE": ("MIT", "own", None), "m/x.py": ("MIT", "inherited", "m"), "n/NOTICE": ("GPL-3.0", "own", None), "n/x.c": ("GPL-3.0", "inherited", "n"),
        "g/h.c": ("GPL-3.0", "own", None), "g/two.c": ("GPL-2.0", "own", None), "g/y.c": (None, "none", None),
        "s/tag.c": ("MIT", "own", None), "s/gpl.c": ("GPL-2.0", "own", None), "s/other.c": (None, "none", None),
        "w/wrapped.c": ("CC-BY-4.0", "own", None), "w/long.txt": ("Apache-2.0", "own", None), "w/far.txt": (None, "none", None),
    }
    files = {
        "m/LICENSE": mit, "m/x.py": "x = 1", "n/NOTICE": "\n".join(gnu), "n/x.c": code, "g/h.c": "/*\n" + "".join(f" * {x}\n" for x in gnu) + " */\n" + code, "g/two.c": "".join(f"# {x}\n" for x in gnu).replace("version 3", "version 2") + code, "g/y.c": code,
        "s/tag.c": "// SPDX-License-Identifier: MIT\n" + code, "s/gpl.c": "// SPDX-License-Identifier: GPL-2.0-or-later\n" + code, "s/other.c": code,
        "w/wrapped.c": "# Licensed under\n# CC BY 4.0\n" + code, "w/long.txt": "zork plugh " * 200 + "Licensed under the Apache License, Version 2.0 " + "zork plugh " * 200, "w/far.txt": "a driving license " + "zork plugh " * 40,
    }
    for name, text in texts.items():
        files[f"full/{name}/COPYING"], files[f"full/{name}/a/b.c"] = text, code
        want[f"full/{name}/COPYING"], want[f"full/{name}/a/b.c"] = (name, "own", None), (name, "inherited", f"full/{name}")
    got = {r.path: (r.license, r.origin, r.license_dir) for r in L.scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == want
