"""WARC archives as a PySpark Python data source, read and write.

    spark.dataSource.register(WarcDataSource)
    df.write.format("warc").mode("append").save(folder)     columns of SCHEMA; see record_rows() for how to make them
    spark.read.format("warc").load(folder_or_file)          .where("record_type = 'response'") reaches the reader

Files are WARC/1.1 with plain headers (foreign .warc.gz files can be read too), closed at about max_file_bytes and listed in a manifest when the job commits, so what a failed or repeated
task left behind isn't read. Each file is an input partition. The reader parses a record's headers first; filters on headers (record
type, record id, target URI, digest, refers_to; =, IN, IS [NOT] NULL, LIKE 'x%') are decided on them, and the payload of a record that is filtered
out, or of any record where option payload is "skip", is passed over by Content-Length and never decoded. Option payload "verify" checks payloads
against their digests and drops them.

The folder may be in any store that pyarrow's file systems open. Null texts are empty payloads; null ids and URIs are written as empty headers and
read as nulls. Repeated pages are records each, equal payloads revisits of the largest id's; payloads of any length are whole in one record. Further columns are left out. Header values have line ends replaced by spaces. An empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import materialize, spread

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
_MANIFEST = "_warc_manifest-"
#: Column, WARC header. The payload's length has a header of its own, since a revisit's block doesn't hold the payload.
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_GZIP = b"Content-Encoding: gzip\r\n"
#: Payloads from this size on are stored with HTTP's own gzip coding, so that records' headers stay plain and payloads can be passed over.
GZIP_BYTES = 512
#: Payloads of more than one page, of about 100 bytes each here, that are broadcast.
BROADCAST_WINNERS = 100_000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(row: dict) -> bytes:
    """One record; a revisit has no payload of its own."""
    revisit, payload = row["record_type"] == "revisit", row["payload"] or b""
    packed = not revisit and len(payload) >= GZIP_BYTES
    block = _HTTP + (_GZIP if packed else b"") + b"\r\n" + (b"" if revisit else gzip.compress(payload, 1, mtime=0) if packed else payload)
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id'] or ''}>"), ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", row["payload_bytes"])]
    if revisit:
        fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", _PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(str('' if v is None else v).splitlines())}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder.rstrip("/"), most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = _fs(self.folder)
        fs.create_dir(folder, recursive=True)
        files, out = [], None
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc")
                    out = fs.open_output_stream(f"{folder}/{files[-1]}", buffer_size=1 << 20)
                out.write(record({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}))
                if out.tell() >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, folder = _fs(self.folder)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{_MANIFEST}{uuid.uuid4().hex}") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages) -> None:
        fs, folder = _fs(self.folder)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{folder}/{f}")


def _bare(value: str | None) -> str | None:
    """Without the brackets of a WARC id."""
    value = value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value
    return value or None


def headers_of(stream) -> dict[str, str] | None:
    """The next record's headers, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    found: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        if line[:1] in b" \t" and name:  # a folded line
            found[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def row_of(headers: dict[str, str]) -> dict:
    row = {k: headers.get(h.lower()) for k, h in _HEADERS.items()}
    for k in ("record_id", "refers_to"):
        row[k] = _bare(row[k])
    row["target_uri"] = row["target_uri"] or None
    row["payload_digest"] = (row["payload_digest"] or "").rpartition(":")[2] or None
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
    return row


def payload_of(block: bytes, headers: dict[str, str]) -> bytes:
    """An HTTP message's body, its gzip coding undone; any other block whole."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    return gzip.decompress(body) if b"\r\ncontent-encoding: gzip" in head.lower() else body


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str, rows: int):
        self.path, self.payload, self.rows, self.tests = path, payload, rows, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADERS and column != "payload_bytes" and isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull | StringStartsWith):
                self.tests.append((type(f).__name__, column, getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            v = row[column]
            ok = {"EqualTo": lambda: v is not None and v == value, "EqualNullSafe": lambda: v == value, "In": lambda: v is not None and v in value, "IsNull": lambda: v is None, "IsNotNull": lambda: v is not None, "StringStartsWith": lambda: v is not None and v.startswith(value)}[kind]()
            if not ok:
                return False
        return True

    def partitions(self):
        from pyarrow import fs as pafs

        fs, at = _fs(self.path)
        if fs.get_file_info(at).type == pafs.FileType.File:
            return [InputPartition(self.path)]
        infos = fs.get_file_info(pafs.FileSelector(at))
        listed = [f for i in infos if i.base_name.startswith(_MANIFEST) for f in json.loads(fs.open_input_stream(i.path).read())]
        names = listed if any(i.base_name.startswith(_MANIFEST) for i in infos) else [i.base_name for i in infos if i.base_name.endswith((".warc", ".warc.gz"))]
        return [InputPartition(f"{self.path.rstrip('/')}/{n}") for n in sorted(names)] or [InputPartition(None)]

    def read(self, partition):
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        if partition.value is None:
            yield pa.RecordBatch.from_pylist([], schema)
            return
        fs, at = _fs(partition.value)
        held, size = [], 0
        with fs.open_input_stream(at, buffer_size=1 << 20) as raw:
            stream = _Lines(raw)
            while (headers := headers_of(stream)) is not None:
                row, length = row_of(headers), int(headers.get("content-length", 0))
                wanted = self._wanted(row)
                if not wanted or self.payload == "skip" or row["record_type"] == "revisit":
                    stream.skip(length)
                    row["payload"] = None
                else:
                    body = payload_of(stream.take(length), headers)
                    if self.payload == "verify" and (sha1_base32(body), len(body)) != (row["payload_digest"], row["payload_bytes"]):
                        raise ValueError(f"payload of {row['record_id']} doesn't have the digest or length of its header")
                    row["payload"] = None if self.payload == "verify" else body
                    size += len(row["payload"] or b"")
                if wanted:
                    held.append(row)
                if len(held) >= self.rows or size > 32 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class _Lines:
    """A binary stream by lines, by counts and by skips."""

    def __init__(self, raw, step: int = 1 << 20):
        self.raw, self.step, self.buf, self.at = raw, step, b"", 0

    def _fill(self) -> bool:
        more = self.raw.read(self.step)
        self.buf, self.at = self.buf[self.at :] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        while (end := self.buf.find(b"\n", self.at)) < 0:
            if not self._fill():
                end = len(self.buf) - 1
                break
        line, self.at = self.buf[self.at : end + 1], end + 1
        return line

    def take(self, n: int) -> bytes:
        have = self.buf[self.at : self.at + n]
        self.at += len(have)
        parts = [have]
        n -= len(have)
        while n > 0 and (more := self.raw.read(n)):
            parts.append(more)
            n -= len(more)
        if n > 0:
            raise ValueError("the archive ends within a record")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        step = min(n, len(self.buf) - self.at)
        self.at += step
        n -= step
        while n > 0 and (more := self.raw.read(min(n, self.step))):
            n -= len(more)
        if n > 0:
            raise ValueError("the archive ends within a record")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "read"), int(self.options.get("batch_rows", 2000)))

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"], int(self.options.get("max_file_bytes", 256 << 20)))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def record_rows(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> DataFrame:
    """Rows of SCHEMA for pages. Of equal payloads of at least min_revisit_bytes, the largest id's is the response (all of them, if that id is
    there more than once; null ids come first), others revisit it.

    The winners are found on ids and digests alone. Up to BROADCAST_WINNERS of them are broadcast, and payloads don't move at all; more join by a shuffle,
    as a side that a large group of equal pages can't fill.
    """
    page = F.col(id_col).cast("string")
    raw = pages.select(
        F.col(id_col).alias("__id"), F.concat(F.lit("urn:page:"), page).alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"__sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    best = raw.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("__sha").agg(F.max("__id").alias("__best"), F.count("*").alias("__n")).where("__n > 1").select(F.col("__sha").alias("__key"), "__best")
    best = materialize(best, "warc-winners")
    few = spread(best, BROADCAST_WINNERS)
    joined = raw.join(few if few is not best else best.hint("shuffle_hash"), F.col("__sha") == F.col("__key"), "left")
    revisit = F.col("__best").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__best"))
    return joined.select(
        "record_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("warc_date"), _base32(F.col("__sha")).alias("payload_digest"), "payload_bytes",
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("__best").cast("string"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(sha1_hex):
    """40 hex digits as 32 base32 ones: each 5 hex digits make 4."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        n = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(alphabet, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def archive(pages: DataFrame, path: str, **options) -> None:
    register(pages.sparkSession)
    record_rows(pages, **options).write.format("warc").mode("append").save(path)


def read(spark, path: str, payload: str = "read") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)
