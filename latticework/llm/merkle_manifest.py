"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources' roots, and a proof for each row that is checked against an altered copy of it.

H is the lowercase hex SHA-256 of its inputs, concatenated. A leaf is H of the row's fields, each `-` if null, else its bytes' number, `:` and its value. While a tree has more than one node,
every three consecutive ones (fewer in the last run, even one) become their H.

1. Spark works out leaves, so texts don't move, and numbers them within their source: a sort by ranges that is written and counted, not a window, so a source may hold any share of all rows.
2. Rows are packed into aligned blocks of 3**7 leaves: their inner nodes depend on nothing outside. Executors unpack the blocks of an Arrow batch in DuckDB and run a level query after
   another, ordered string_agg and sha256, for all blocks of the batch together; a block leaves as one root.
3. Roots of blocks are the leaves of the next layer, packed in the same way, until each source has one node; then the sources' roots likewise. Layers shrink by 2187 each.
4. From the top down, each layer's blocks are joined with the proof of the block itself, and give the proofs of their nodes. Only in the last layer, where nodes are rows of the dataset, proofs
   are hashed and folded, inside DuckDB; they never move.

Null ids come first; rows of a source with the same id go by their leaves, so repeated rows have different proofs but the same leaf. Null sources are a source, before all others. Null and empty texts have
different leaves. Texts of any length are taken whole. Rows without an id are not altered. Further columns, whatever their names, are no part of a leaf. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.rank import dense_index

from .common import Scratch, spread

FAN, LEVELS = 3, 7
BLOCK = FAN**LEVELS
#: Nodes that one DuckDB query unpacks (a block may be the last to come in).
NODES = 30_000

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<l:string,r:string>>"


def encoded(c: Column) -> Column:
    """The value with its bytes' number in front, or `-`."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[str] = FIELDS, **changed: Column) -> Column:
    """The leaf of a row, or of a copy of it with some columns changed."""
    return F.sha2(F.concat(*(encoded(changed.get(f, F.col(f))) for f in fields)), 256)


def _packed(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """key, n (of the key's nodes), block, nodes: the fields of the block's nodes in order. nodes: key, n, pos and the fields."""
    held = F.array_sort(F.collect_list(F.struct("pos", *fields)))
    return nodes.groupBy("key", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(held.alias("nodes"))


def _levels(n: int) -> int:
    """Levels inside a block of a tree of n nodes."""
    k = 0
    while k < LEVELS and FAN**k < n:
        k += 1
    return k


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A connection with the table b (t, levels, and the batch's columns) for some blocks after the others, and how many levels are needed."""
    import duckdb

    with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""}) as con:
        for b in batches:
            size, ns, at = b.column("nodes").value_lengths().to_pylist(), b.column("n").to_pylist(), 0
            while at < b.num_rows:
                to, held = at + 1, size[at]
                while to < b.num_rows and held + size[to] <= NODES:
                    held += size[to]
                    to += 1
                levels = [_levels(n) for n in ns[at:to]]
                part = pa.Table.from_batches([b.slice(at, to - at)])
                con.register("b", part.append_column("t", pa.array(range(at, to), pa.int32())).append_column("levels", pa.array(levels, pa.int32())))
                con.execute("CREATE OR REPLACE TEMP TABLE own AS SELECT t, levels, unnest(nodes, recursive := true) FROM b")
                _run_levels(con, max(levels))
                yield con, max(levels)
                con.unregister("b")
                at = to


def _run_levels(con, most: int) -> None:
    """Tables run1, run2, ...: a row for each run of nodes of the level below, with their hashes in order and its own."""
    con.execute("CREATE OR REPLACE TEMP TABLE run0 AS SELECT t, levels, pos, [h] AS hs, h FROM own")
    for k in range(1, most + 1):
        con.execute(
            f"""CREATE OR REPLACE TEMP TABLE run{k} AS
            SELECT t, levels, pos // {FAN} AS pos, list(h ORDER BY pos) AS hs, sha256(string_agg(h, '' ORDER BY pos)) AS h
            FROM run{k - 1} below WHERE levels >= {k} GROUP BY t, levels, below.pos // {FAN}"""
        )


def _roots(batches):
    for con, most in _chunks(batches):
        tops = " UNION ALL ".join(f"SELECT t, h FROM run{k} WHERE levels = {k}" for k in range(most + 1))
        yield from con.sql(f"SELECT b.key, (b.n + {BLOCK - 1}) // {BLOCK} AS n, b.block AS pos, tops.h FROM b JOIN ({tops}) tops USING (t)").to_arrow_table().to_batches()


def _own_siblings(k: int) -> tuple[str, str]:
    """The siblings before and after a node of the level below k, in the table up."""
    at = f"(pos // {FAN ** (k - 1)}) % {FAN}"
    return f"array_to_string(up.hs[:{at}], '')", f"array_to_string(up.hs[{at} + 2:], '')"


def _paths(batches):
    """The proof of each node: siblings before and after it, level by level, then those of its block."""
    for con, most in _chunks(batches):
        con.execute("CREATE OR REPLACE TEMP TABLE c AS SELECT t, own.pos, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS path FROM own")
        for k in range(1, most + 1):
            before, after = _own_siblings(k)
            con.execute(
                f"""CREATE OR REPLACE TEMP TABLE c AS
                SELECT c.t, c.pos, CASE WHEN up.t IS NULL THEN path ELSE list_append(path, {{'l': {before.replace("(pos", "(c.pos")}, 'r': {after.replace("(pos", "(c.pos")}}}) END AS path
                FROM c LEFT JOIN run{k} up ON up.t = c.t AND up.pos = c.pos // {FAN**k}"""
            )
        yield from con.sql("SELECT b.key, c.pos, list_concat(c.path, b.outer_path) AS path FROM c JOIN b USING (t)").to_arrow_table().to_batches()


def _proofs(batches):
    """Each row's leaf, the hash of its proof, and the root that its altered leaf, or else its own, folds to."""
    for con, most in _chunks(batches):
        con.execute("CREATE OR REPLACE TEMP TABLE c AS SELECT t, own.pos, id, own.h AS leaf, coalesce(altered, own.h) AS x, '' AS proof FROM own")
        for k in range(1, most + 1):
            before, after = (s.replace("(pos", "(c.pos") for s in _own_siblings(k))
            con.execute(
                f"""CREATE OR REPLACE TEMP TABLE c AS
                SELECT t, pos, id, leaf, CASE WHEN l IS NULL THEN x ELSE sha256(l || x || r) END AS x, CASE WHEN l IS NULL THEN proof ELSE proof || l || r END AS proof
                FROM (SELECT c.*, {before} AS l, {after} AS r FROM c LEFT JOIN run{k} up ON up.t = c.t AND up.pos = c.pos // {FAN**k})"""
            )
        for k in range(1, con.execute("SELECT max(len(outer_path)) FROM b").fetchall()[0][0] + 1):
            con.execute(
                f"""CREATE OR REPLACE TEMP TABLE c AS
                SELECT t, pos, id, leaf, CASE WHEN s IS NULL THEN x ELSE sha256(s.l || x || s.r) END AS x, CASE WHEN s IS NULL THEN proof ELSE proof || s.l || s.r END AS proof
                FROM (SELECT c.*, b.outer_path[{k}] AS s FROM c JOIN b USING (t))"""
            )
        yield from con.sql("SELECT c.id, leaf, b.subroot, sha256(proof) AS proof_sha256, x AS folded_root FROM c JOIN b USING (t)").to_arrow_table().to_batches()


_ROOTS = "key string, n long, pos long, h string"


class _Tree:
    """The layers of the trees of all keys: packed blocks, from the leaves up, and each key's root (key, h)."""

    def __init__(self, packed: DataFrame, scratch: Scratch, name: str):
        self.layers = [scratch.write(packed, f"{name}-blocks")]
        while True:
            up = scratch.write(self.layers[-1].select("key", "n", "block", "nodes").mapInArrow(_roots, _ROOTS), f"{name}-roots")
            if (up.agg(F.max("n")).first()[0] or 0) <= 1:
                break
            self.layers.append(scratch.write(_packed(up, ["h"]), f"{name}-blocks"))
        self.roots = up.select("key", "h")

    def outer(self, scratch: Scratch, name: str, above: DataFrame) -> DataFrame:
        """The lowest layer's blocks with outer_path, what follows the proofs inside of them. above: key, path, the proof of the key's root."""
        paths = above.withColumn("pos", F.lit(0).cast("long"))
        for k in range(len(self.layers) - 1, -1, -1):
            blocks = self.layers[k].join(paths.select("key", F.col("pos").alias("block"), F.col("path").alias("outer_path")), ["key", "block"])
            if k:
                paths = scratch.write(blocks.select("key", "n", "block", "nodes", "outer_path").mapInArrow(_paths, f"key string, pos long, path {_PATH}"), f"{name}-paths")
        return blocks


def manifest(docs: DataFrame, *, altered_leaf: Column | None = None, fields: list[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of docs.

    altered_leaf: what each proof is to be checked with (null: the row's own leaf), such as leaf_of(text=...).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    altered = (F.lit(None) if altered_leaf is None else altered_leaf).cast("string")
    leaves = docs.select(F.col(source_col).alias("source"), encoded(F.col(source_col)).alias("key"), F.col(id_col).alias("id"), leaf_of(fields).alias("h"), altered.alias("altered"))
    placed = dense_index(leaves, ["source", "id", "h"], "idx")
    kinds = scratch.write(placed.groupBy("key").agg(F.min("idx").alias("start"), F.count("*").alias("n"), F.first("source").alias("source")), "sources")
    nodes = placed.drop("source").join(spread(kinds.drop("source")), "key").withColumn("pos", F.col("idx") - F.col("start"))
    tree = _Tree(_packed(nodes, ["h", "altered", "id"]), scratch, "rows")

    subroots = scratch.write(tree.roots.withColumnRenamed("h", "subroot"), "subroots")
    numbered = dense_index(kinds.join(subroots, "key").select("key", "source", F.col("subroot").alias("h")), ["source"], "pos").withColumn("tree", F.lit("all"))
    numbered = scratch.write(numbered.select("tree", "key", "pos", "h"), "numbered")
    total = numbered.count()
    over = _Tree(_packed(numbered.select(F.col("tree").alias("key"), F.lit(total).cast("long").alias("n"), "pos", "h"), ["h"]), scratch, "top")
    root = over.roots.first()
    start = spark.range(1).select(F.lit("all").alias("key"), F.array().cast(_PATH).alias("path"))
    top = over.outer(scratch, "top", start).select("key", "n", "block", "nodes", "outer_path").mapInArrow(_paths, f"key string, pos long, path {_PATH}")
    above = scratch.write(numbered.join(top.select("pos", "path"), "pos").select("key", "path"), "above")

    blocks = tree.outer(scratch, "rows", above).join(spread(subroots), "key")
    kind = docs.schema[id_col].dataType.simpleString()
    found = blocks.select("key", "n", "block", "nodes", "outer_path", "subroot").mapInArrow(_proofs, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    whole = F.lit(root["h"] if root else None).cast("string")
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))

