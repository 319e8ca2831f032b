"""How far the vocabularies of sources lie apart: for each language and source, the other sources by triangular divergence, and the terms it uses more than its language.

Sort-based streaming:
1. Each task counts its documents by language and source, and writes partial runs (lang, term, source, document, documents, occurrences) as often as its dictionary fills up; `document` is the
   first one of the run. A frequent term is one row for each source and filling, never one for each document.
2. Partial runs are dealt out by (lang, term) and sorted within partitions by (lang, term, source, document). A run-length scan over the stream sums them: document frequencies and counts of
   a term's sources are known when its run ends. Terms in too few documents are dropped there; the others leave as blocks of runs, which are written.
3. Blocks give the sizes of groups; with these, each block gives partial sums for pairs of sources and values for terms, which are then added and ranked.

Shares are integers of a billionth and all sums are exact: occurrences times a billion are divided in decimals, or digit by digit in numpy.

Null text, lang and source count as ''. Every row is a document of its own, so repeated rows count as often as they are there, and ids (null ones, too) only order runs. Texts of any length
are counted whole. A group without terms, or of a language without kept terms, has value 0 with every other source and no term rows. Ties go by the item's bytes. An empty table gives an
empty result, and further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread, texts_of

UNIT = 1_000_000_000
#: Dictionary entries of a task that are written at once, terms of a block, sources of a stripe of pairs, cells of a matrix of shares.
ENTRIES, BLOCK_TERMS, STRIPE, CELLS = 400_000, 4096, 256, 1 << 20

_PARTIAL = "lang string, term string, source string, document long, docs long, n long"
_BLOCKS = "lang string, runs array<struct<term:string,total:long,own:array<struct<source:string,n:long>>>>"
#: A term is a run of ASCII letters and bytes from 0x80 on; all else parts terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def partial_runs(docs: DataFrame) -> DataFrame:
    """docs: lang, source, document, text."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter, list]] = {}
        for b in batches:
            for lang, source, i, text in zip(*(c.to_pylist() for c in b.columns[:3]), texts_of(b, "text"), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                n, docs_, first = held.setdefault((lang, source), (Counter(), Counter(), [i]))
                n.update(words)
                docs_.update(set(words))
            if sum(len(n) for n, _, _ in held.values()) > ENTRIES:
                yield from _emitted(held)
        yield from _emitted(held)

    return docs.select("lang", "source", "document", "text").mapInArrow(run, _PARTIAL)


def _emitted(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs, first) in held.items():
        terms, k = pa.array(list(n), pa.binary()).cast(pa.string()), len(n)
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), k)  # noqa: E731, B023
        columns = [same(lang, pa.string()), terms, same(source, pa.string()), same(first[0], pa.int64()), pa.array([docs[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "document", "docs", "n"])
    held.clear()


def _heads(t: pa.Table, names: list[str]) -> np.ndarray:
    """Where runs of equal values in the columns begin, and the number of rows at the end."""
    if not t.num_rows:
        return np.zeros(1, np.int64)
    fresh = np.zeros(t.num_rows, bool)
    fresh[0] = True
    for c in names:
        col = t.column(c)
        fresh[1:] |= pc.not_equal(col.slice(1), col.slice(0, t.num_rows - 1)).to_numpy()
    return np.append(np.flatnonzero(fresh), t.num_rows)


def _ints(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def scan_runs(partial: DataFrame, least: int) -> DataFrame:
    """Blocks of runs of the terms that are in at least `least` documents of their language. partial: sorted by lang, term, source, document, with a term in one partition."""

    def summed(t: pa.Table) -> pa.Table:
        edge = _heads(t, ["lang", "term", "source"])[:-1]
        if not len(edge):
            return t
        own = t.take(pa.array(edge))
        return pa.table([own.column("lang"), own.column("term"), own.column("source"), *(pa.array(np.add.reduceat(_ints(t, c), edge)) for c in ("docs", "n"))], names=["lang", "term", "source", "docs", "n"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]).drop_columns(["document"])
            t = summed(pa.concat_tables([rest, t.cast(rest.schema)]) if rest is not None else t)
            edge = _heads(t, ["lang", "term"])
            if len(edge) > 1:
                yield from _blocks(t.slice(0, edge[-2]), least)
                rest = t.slice(edge[-2])  # its term may go on in the next batch; one row for each source
        if rest is not None:
            yield from _blocks(rest, least)

    return partial.mapInArrow(run, _BLOCKS)


def _blocks(t: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    edge = _heads(t, ["lang", "term"])
    if len(edge) < 2:
        return
    keep = np.add.reduceat(_ints(t, "docs"), edge[:-1]) >= least
    t = t.filter(pa.array(np.repeat(keep, np.diff(edge)))).combine_chunks()
    edge = _heads(t, ["lang", "term"])
    if len(edge) < 2:
        return
    flat = lambda name: t.column(name).combine_chunks()
    own = pa.StructArray.from_arrays([flat("source"), flat("n")], names=["source", "n"])
    own = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), own)
    head = t.take(pa.array(edge[:-1]))
    runs = pa.StructArray.from_arrays([head.column("term").combine_chunks(), pa.array(np.add.reduceat(_ints(t, "n"), edge[:-1])), own], names=["term", "total", "own"])
    langs = _heads(head, ["lang"])
    cut = np.unique(np.concatenate([langs, *(np.arange(a, b, BLOCK_TERMS) for a, b in zip(langs[:-1], langs[1:], strict=True))]))
    yield pa.RecordBatch.from_arrays([head.column("lang").take(pa.array(cut[:-1])).combine_chunks(), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs)], names=["lang", "runs"])


def shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / size), exactly, for n + 2 <= size < 2**53: three digits at a time."""
    rest, out = n + 2, np.ones(np.broadcast_shapes(n.shape, size.shape), np.int64)
    whole, rest = np.divmod(rest, size)
    digits = whole
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, size)
        digits = digits * 1000 + more
    return out + digits


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums for each pair of a stripe's sources with the sources after them. Columns: lang, stripe, runs, sources, sizes, terms (how many are kept)."""
    held: dict[tuple[str, int], tuple[pa.Array, np.ndarray]] = {}
    for b in batches:
        for k in range(b.num_rows):
            lang, stripe, kept = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(5)[k].as_py()
            runs, sources, size = b.column(2)[k].values, b.column(3)[k].values, b.column(4)[k].values.to_numpy().astype(np.int64)
            lo, hi, s = stripe * STRIPE, min(len(sources), stripe * STRIPE + STRIPE), len(sources)
            if (lang, stripe) not in held:
                if sum(a.size for _, a in held.values()) > CELLS:
                    yield from _pair_rows(held)
                held[lang, stripe] = sources, np.zeros((hi - lo, s), np.int64)
            total = held[lang, stripe][1]
            if not len(runs):
                continue
            own = runs.field(2)
            edge = own.offsets.to_numpy().astype(np.int64)
            flat, edge = own.values.slice(edge[0], edge[-1] - edge[0]), edge - edge[0]  # the values are those of the whole batch
            column, n = pc.index_in(flat.field(0), value_set=sources).to_numpy(), flat.field(1).to_numpy()
            step = max(1, CELLS // max(1, s))
            for a in range(0, len(runs), step):
                e = edge[a : a + step + 1]
                count = np.zeros((len(e) - 1, s), np.int64)
                count[np.repeat(np.arange(len(e) - 1), np.diff(e)), column[e[0] : e[-1]]] = n[e[0] : e[-1]]
                p = np.ascontiguousarray(shares(count, size + 2 * kept).T)
                for i in range(lo, hi):
                    d = p[i + 1 :] - p[i]
                    total[i - lo, i + 1 :] += ((d * d).astype(np.uint64) // (p[i + 1 :] + p[i]).astype(np.uint64)).sum(axis=1).astype(np.int64)
    yield from _pair_rows(held)


def _pair_rows(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, stripe), (sources, total) in held.items():
        i, j = np.nonzero(np.arange(total.shape[1]) > np.arange(total.shape[0])[:, None] + stripe * STRIPE)
        for at in range(0, len(i), 10_000):
            a, b = i[at : at + 10_000], j[at : at + 10_000]
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(a)), sources.take(pa.array(a + stripe * STRIPE)), sources.take(pa.array(b)), pa.array(total[a, b])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])
    held.clear()


def _share(n: str, size: str) -> str:
    return f"1 + (cast({n} + 2 AS decimal(20,0)) * {UNIT}) div ({size} + 2 * kept)"


def audit(docs: DataFrame, *, least_docs: int = 10, top: int = 10, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: a row for each other source of the language, and for each of the `top` terms that the source uses more than its language.

    The sources of one language are held as one array, and their pairs are the result's rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lean = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(id_col).cast("long").alias("document"), text(text_col).alias("text"))
    runs = partial_runs(lean).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    blocks = materialize(scan_runs(runs, least_docs), "divergence-runs")

    terms = blocks.select("lang", F.explode("runs").alias("r")).select("lang", "r.term", "r.total", F.explode("r.own").alias("o")).select("lang", "term", "total", "o.source", "o.n")
    sizes = terms.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    kinds = blocks.groupBy("lang").agg(F.sum(F.size("runs").cast("long")).alias("kept"), F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["total"])).alias("lang_size"))
    groups = lean.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0, ["size", "kept", "lang_size"])
    groups = materialize(groups, "divergence-groups")

    gap = "((p - q) * (p - q)) div (p + q)"
    used = terms.join(spread(groups), ["lang", "source"]).select("lang", "source", "term", F.expr(_share("n", "size")).alias("p"), F.expr(_share("total", "lang_size")).alias("q"))
    used = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap).alias("value"))

    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "size"))).alias("s"), F.max("kept").alias("kept"))
    langs = materialize(langs.select("lang", F.col("s.source").alias("sources"), F.col("s.size").alias("sizes"), "kept"), "divergence-langs")
    none = langs.select("lang", F.array().cast(blocks.schema["runs"].dataType).alias("runs"))  # pairs are there without terms, too
    work = blocks.unionByName(none).join(spread(langs, 1000), "lang").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.floor((F.size("sources") - 1) / STRIPE).cast("int"))))
    pairs = work.select("lang", "stripe", "runs", "sources", "sizes", "kept").mapInArrow(_pair_sums, "lang string, a string, b string, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(used).where(F.col("rank") <= top))
