"""A paged source of JSON records as a Python data source: pages of `limit` records from `offset` on until one is empty.

Option fetch names a function (module:function) of (offset, limit) that gives a list of dicts, so credentials and transport stay outside; the number of records is asked
for with total (module:function) if it is known, and then each page is a partition. Option source, if there is one, is handed to both as a further argument.

A table can be stored as such pages (write_pages), which stored_page and stored_total then serve.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import opened, store


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.fetch, self.total = options["fetch"], options.get("total")
        self.more = [options["source"]] if "source" in options else []
        self.limit, self.names = int(options.get("limit", 10_000)), schema.fieldNames()

    def partitions(self):
        if not self.total:
            return [InputPartition(None)]
        n = _named(self.total)(*self.more)
        return [InputPartition(i) for i in range(0, n, self.limit)] or [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        fetch, offset = _named(self.fetch), partition.value or 0
        while page := fetch(offset, self.limit, *self.more):
            for record in page:
                yield tuple(record.get(n) for n in self.names)
            offset += len(page)
            if partition.value is not None:
                break


class PagedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema):
        return PagedReader(dict(self.options), schema)


#: Records of a stored page.
STORED = 500


def write_pages(df: DataFrame, order: list[str], path: str) -> None:
    """df's rows as JSON lines in pages of STORED records in order, a folder each, and their number."""
    from latticework.operators.rank import dense_index

    placed = dense_index(df, order, "__at").withColumn("__page", F.floor(F.col("__at") / STORED).cast("long"))
    lines = placed.select("__page", "__at", F.to_json(F.struct(*df.columns)).alias("value"))
    lines.repartition("__page").sortWithinPartitions("__page", "__at").select("__page", "value").write.partitionBy("__page").text(f"{path}/pages")
    df.agg(F.count("*").cast("string")).coalesce(1).write.text(f"{path}/total")


def _lines(path: str) -> list[str]:
    from pyarrow import fs

    system, at = store(path)
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith("part-"))
    root = path[: path.index(at)]
    out: list[str] = []
    for name in found:
        with opened(root + name) as f:
            out += f.read().decode().splitlines()
    return out


def stored_total(path: str) -> int:
    return int(_lines(f"{path}/total")[0])


def stored_page(offset: int, limit: int, path: str) -> list[dict]:
    first, last = offset // STORED, (offset + limit - 1) // STORED
    rows = [json.loads(r) for k in range(first, last + 1) for r in _lines(f"{path}/pages/__page={k}")]
    return rows[offset - first * STORED : offset - first * STORED + limit]
