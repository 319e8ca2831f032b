"""Licence scan in DataFrame operations alone: TF-IDF cosine of lines, headers and whole files to licence templates, then inheritance along directories.

Lines that hold a term of some template (others have cosine 0) become sparse TF-IDF vectors over the templates' terms; the idf counts all documents. A line whose
cosine to a template reaches `least` and of whose words at least half are template terms or filler carries that licence; a file takes its best line. Files that hold a word of CORE are also compared as a whole, in runs of neighbouring lines
and in windows of up to WINDOW lines (pieces of PIECE words, in lines of more than LONG) with full licence texts, headers and notices; there the idf counts templates, so a file's
result doesn't depend on other files. An SPDX tag carries the licence that it names. A file takes the licence of a full text that it is as a whole, then its SPDX tag's, then the best
cosine's. A file that is a licence's full text as a whole, or whose licence lines are at least half of its words, is a licence file and covers its directory. A file without a licence inherits from the nearest ancestor directory that has a
licence file. Directories, not files, meet their ancestors in the path join, so a directory of any size is one row there.

Null and empty texts have no licence of their own; texts of any length are read whole; a null path is in no directory and inherits nothing. Rows are judged each for itself, repeated or not. Ties go to the
template listed first. Further columns are passed by; those with the output's names are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

#: licences' names and their customary notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may obtain a copy of the License at apache.org"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "free software: redistribute it and modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
]
#: Headers as their licences ask for them; files wrap them over several lines.
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see"
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
HEADERS = [
    *((f"{pre}GPL-{v}", f"This program {_GNU.format(kind, v.removesuffix('.0'))}{rest}") for pre, kind, v in (("", "", "3.0"), ("", "", "2.0"), ("L", "Lesser ", "3.0"), ("L", "Lesser ", "2.1")) for rest in ("", " " + _GNU_REST.format(kind))),
    ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Every template holds one of these words.
CORE = ["license", "licensed", "permission", "redistribution", "redistribute"]
WINDOW, LONG, PIECE = 5, 24, 4
_SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]*[A-Za-z0-9+])"
_FILLER = set("a an and any are at be by for from in is it its may of on or the this to under use with work you".split())
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What parts such tokens in lower-cased text. A dot or dash parts unless it stands between letters or digits.
_SPACE = r"[ \t\n\x0B\f\r]+"
_BETWEEN = r"(?:[^a-z0-9.-]|[.-](?![a-z0-9])|[.-](?<![a-z0-9][.-]))+"


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _terms() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in tokens(text)} - _FILLER | {"by", "by-nc", "by-sa"})


@lru_cache(maxsize=1)
def full_texts() -> list[tuple[str, str]]:
    """Licences' names and full texts. Those of CC-BY and CC-BY-NC are made from CC-BY-SA's, from which they differ by a few paragraphs."""
    out = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
    by = "\n\n".join(p for p in dict(out)["CC-BY-SA-4.0"].replace("Attribution-ShareAlike", "Attribution").split("\n\n") if not re.search("ShareAlike|BY-SA|Adapter's", p))
    limits = "NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation. reproduce and Share the Licensed Material, in whole or in part, for NonCommercial purposes only; produce and reproduce Adapted Material for NonCommercial purposes only; used other than for NonCommercial purposes."
    return [*out, ("CC-BY-4.0", by), ("CC-BY-NC-4.0", by.replace("Attribution 4.0", "Attribution-NonCommercial 4.0").replace("Creative Commons Attribution", "Creative Commons Attribution-NonCommercial") + limits)]


@lru_cache(maxsize=1)
def passages() -> tuple[list[str], int, list[tuple[str, float, list[float]]]]:
    """Names of full texts, headers and notices; how many of them are full texts; each term's idf over them, and its weight in each unit vector."""
    all_of = [*full_texts(), *HEADERS, *TEMPLATES]
    have = [tokens(t) for _, t in all_of]
    idf = {t: math.log((1 + len(have)) / (1 + sum(t in h for h in map(set, have)))) + 1 for t in sorted({t for h in have for t in h})}
    rows = {t: [0.0] * len(have) for t in idf}
    for k, h in enumerate(have):
        for t in h:
            rows[t][k] += idf[t]
        norm = math.sqrt(sum(rows[t][k] ** 2 for t in set(h)))
        for t in set(h):
            rows[t][k] /= norm
    return [n for n, _ in all_of], len(full_texts()), [(t, idf[t], w) for t, w in rows.items()]


def _words(text: Column) -> Column:
    return F.split(F.lower(text), _BETWEEN)


def _let(value: Column, body) -> Column:
    """body(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _vectors(idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """Each template's unit vector."""
    out = []
    for name, text in TEMPLATES:
        v: dict[str, float] = {}
        for t in tokens(text):
            if t in idf:
                v[t] = v.get(t, 0.0) + idf[t]
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {t: x / norm for t, x in v.items()}))
    return out


def own_licences(docs: DataFrame, *, text_col: str = "text", least: float = 0.8) -> DataFrame:
    """docs (its columns must not be called own or begin with two underscores) without text_col, with own: struct of license, score, share (of the file's words that are in licence lines, or 1 of a full text); null if there is none.

    Texts are read once: what is written between the passes is which template terms each document has, the few lines that are mostly such terms, and the texts that hold a word of CORE.
    """
    terms = _terms()
    text = F.coalesce(F.col(text_col), F.lit(""))
    filler, known = F.array(*map(F.lit, sorted(_FILLER))), F.array(*map(F.lit, terms))
    size = lambda x: F.size(F.filter(F.split(x, _SPACE), lambda w: w != ""))
    lines = F.transform(F.split(text, "\n"), lambda x: _let(_words(x), lambda w: F.struct(x.alias("line"), w.alias("words"), F.array_intersect(w, known).alias("hit"))))
    kept = F.filter(lines, lambda s: F.size(s["hit"]) > 0)
    filled = lambda s: F.size(F.filter(s["words"], lambda w: F.array_contains(known, w) | F.array_contains(filler, w))) * 2 >= F.size(F.array_remove(s["words"], ""))
    likely = lambda part: F.transform(F.filter(part, filled), lambda s: F.struct(F.filter(s["words"], lambda w: F.array_contains(known, w)).alias("inside"), size(s["line"]).alias("n")))
    both = _let(kept, lambda part: F.struct(F.array_distinct(F.flatten(F.transform(part, lambda s: s["hit"]))).alias("terms"), likely(part).alias("part")))
    base = docs.withColumn("__b", both)
    base = base.withColumn("__full", F.when(F.arrays_overlap("__b.terms", F.array(*map(F.lit, CORE))), text)).withColumn("__spdx", F.when(text.contains("SPDX-License-Identifier:"), F.nullif(F.regexp_extract(text, _SPDX, 1), F.lit(""))))
    base = base.withColumn("__n", F.when((F.size("__b.part") > 0) | F.col("__spdx").isNotNull(), size(text))).withColumn("__row", F.monotonically_increasing_id())
    base = materialize(base.drop(text_col), "licence-lines")
    counts = {r.t: r.n for r in base.select(F.explode("__b.terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    n = base.count()
    idf = {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in terms}
    vectors = _vectors(idf)
    weight = F.create_map(*(x for t, v in sorted(idf.items()) for x in (F.lit(t), F.lit(v))))

    def cosine(inside: Column) -> Column:
        """The best template by cosine, of a line's template terms."""
        tf = lambda t: F.size(F.filter(inside, lambda w: w == t))
        # The squared norm is a sum over distinct terms of (tf * idf) squared, which is a sum over words of tf * idf squared.
        norm = F.sqrt(F.aggregate(inside, F.lit(0.0), lambda a, w: a + F.size(F.filter(inside, lambda x: x == w)) * F.pow(F.element_at(weight, w), F.lit(2.0))))
        return F.array_max(F.array(*(F.struct(F.bround(sum((F.lit(x * idf[t]) * tf(t) for t, x in v.items()), F.lit(0.0)) / norm, 9).alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("license")) for k, (name, v) in enumerate(vectors))))

    judged = F.filter(F.transform("__b.part", lambda s: F.struct(cosine(s["inside"]).alias("best"), s["n"].alias("n"))), lambda s: s["best"]["score"] >= least)

    def whole(found: Column) -> Column:
        best = F.array_max(F.transform(found, lambda s: s["best"]))
        share = F.aggregate(found, F.lit(0), lambda a, s: a + s["n"]) / F.col("__n")
        return F.when(F.size(found) > 0, F.struct(best["license"].alias("license"), best["score"].alias("score"), share.alias("share")))

    of_lines = F.when(F.size("__b.part") > 0, _let(judged, whole))
    tag = F.regexp_replace("__spdx", r"(?<=GPL-[0-9]\.[0-9])(?:-only|-or-later|\+)$", "")
    of_tag = F.when(tag.isNotNull(), F.struct(tag.alias("license"), F.lit(1.0).alias("score"), (F.lit(2) / F.col("__n")).alias("share")))
    of_lines = F.when(of_lines["score"] >= F.coalesce(F.col("__part.score"), F.lit(0.0)), of_lines).otherwise(F.coalesce("__part", of_lines))
    found = base.drop("__full").join(_of_passages(base.where("__full IS NOT NULL").select("__row", "__full"), least), "__row", "left").withColumn("own", F.coalesce(F.col("__text"), of_tag, of_lines))
    return found.select(*[c for c in base.columns if c not in ("__b", "__n", "__full", "__spdx", "__row")], "own")


def _of_passages(texts: DataFrame, least: float) -> DataFrame:
    """__row with __text and __part, structs as own's: the full text that the whole of __full is, and the best template of its runs and windows. Rows without either are left out."""
    names, n_full, vocabulary = passages()
    core, filler = F.array(*map(F.lit, CORE)), F.array(*map(F.lit, sorted(_FILLER)))
    known = [t for t, _, _ in vocabulary]
    line = lambda x: F.array_remove(_words(x), "")
    pieces = lambda w: F.when(F.size(w) <= LONG, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.size(w), F.lit(PIECE)), lambda k: F.slice(w, k, F.lit(PIECE))))
    parts = F.flatten(F.transform(F.split("__full", "\n"), lambda x: _let(line(x), pieces)))
    fits = lambda w: (F.size(w) > 0) & (F.size(F.filter(w, lambda t: t.isin(known) | F.array_contains(filler, t))) * 2 >= F.size(w))
    # A part that doesn't fit ends a run: the last run is open, and closed ones follow one another.
    start = F.array(F.array().cast("array<string>"))
    add = lambda runs, w: F.when(fits(w), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.concat(F.element_at(runs, -1), w)))).otherwise(F.when(F.size(F.element_at(runs, -1)) > 0, F.concat(runs, start)).otherwise(runs))
    windows = lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(WINDOW)), lambda m: F.flatten(F.slice(p, i, m)))))
    units = lambda p: F.concat(F.array(F.flatten(p)), F.filter(F.concat(F.aggregate(p, start, add), windows(p)), lambda w: F.arrays_overlap(w, core) & fits(w)))
    words = texts.select("__row", F.posexplode(_let(parts, units)).alias("unit", "words")).select("__row", "unit", F.size("words").alias("size"), F.explode("words").alias("term"))
    terms = F.broadcast(texts.sparkSession.createDataFrame(vocabulary, "term string, idf double, w array<double>"))
    counted = words.groupBy("__row", "unit", "size", "term").agg(F.count("*").alias("n")).join(terms, "term")
    x = F.col("n") * F.col("idf")
    dots = counted.groupBy("__row", "unit", "size").agg(F.sum("n").alias("inside"), F.sqrt(F.sum(x * x)).alias("norm"), *(F.sum(x * F.col("w")[k]).alias(f"d{k}") for k in range(len(names))))
    best = lambda ks: F.array_max(F.array(*(F.struct(F.bround(F.col(f"d{k}") / F.col("norm"), 9).alias("score"), F.lit(-k).alias("k"), F.col("size"), F.lit(names[k]).alias("license")) for k in ks)))
    full = F.col("inside") * 2 >= F.col("size")
    judged = dots.select("__row", F.when(F.col("unit") == 0, F.col("size")).alias("total"), F.when(full & (F.col("unit") == 0), best(range(n_full))).alias("text"), F.when(full, best(range(len(names)))).alias("part"))
    own = lambda b, share: F.when(b["score"] >= least, F.struct(b["license"].alias("license"), b["score"].alias("score"), share.alias("share")))
    rows = judged.groupBy("__row").agg(*(F.max(c).alias(c) for c in ("total", "text", "part")))
    return rows.select("__row", own(F.col("text"), F.lit(1.0)).alias("__text"), own(F.col("part"), F.col("part.size") / F.col("total")).alias("__part")).where("__text IS NOT NULL OR __part IS NOT NULL")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """files without text_col, with license (null if none), score (of its own line), origin (own, inherited or none) and license_dir (from where it is inherited)."""
    names = ["license", "score", "origin", "license_dir"]
    passed = [c for c in files.columns if c not in (*names, text_col)]
    lean = files.select(F.struct(*passed).alias("file"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))  # columns of files can't clash with those made here
    lean = materialize(own_licences(lean, least=least).withColumn("__dir", _directory(F.col("path"))), "licence-own")  # read three times
    covering = lean.where("own.share >= 0.5 AND __dir IS NOT NULL").groupBy(F.col("__dir").alias("at")).agg(F.max_by("own.license", F.struct("own.score", "path")).alias("dir_license"))
    covering = spread(materialize(covering, "licence-directories"), 100_000)  # else all directories would meet at the root
    dirs = lean.where("own IS NULL AND __dir IS NOT NULL").select("__dir").distinct()
    parts = F.split("__dir", "/")
    above = dirs.select("__dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("at")).distinct()
    nearest = above.join(covering, "at").groupBy(F.col("__dir").alias("__of")).agg(F.max_by(F.struct("at", "dir_license"), F.length("at")).alias("__from"))
    out = lean.join(nearest, (F.col("__dir") == F.col("__of")) & F.col("own").isNull(), "left")
    return out.select(
        "file.*", F.coalesce("own.license", "__from.dir_license").alias("license"), F.col("own.score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("__from").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("__from.at").alias("license_dir"),
    )
