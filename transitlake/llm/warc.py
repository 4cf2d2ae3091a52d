"""WARC archives as a Spark data source.

``spark.dataSource.register(WarcSource)`` gives the format ``warc``.

*Writing* takes rows of (record_id, warc_type, target_uri, payload, refers_to,
payload_digest, payload_length) and makes one file or more per task. Records
are gzip members of their own; a member's extra field ``sl`` (skip lengths)
holds its compressed and uncompressed size, so a reader can step over it. A
task writes to names of its own and reports them; the driver's commit writes
a list of files of its own, and only files of any list are read, so failed and
repeated tasks leave nothing behind that counts. An abort removes them. An
append to a folder without lists lists the archives that lie there too; only
an overwrite removes the lists and archives of earlier writes.

*Reading* plans partitions from the list (or the folder, for archives made
elsewhere): files are packed into partitions of about ``partition_bytes``.
Equality, membership, prefix and null tests on header columns are taken over
from Spark: a record's headers are inflated and parsed first, and the rest of
an unwanted record is skipped without inflating it (without the ``sl`` field it
is inflated and thrown away). With the option ``payload=false`` no payload is
decoded and the column is not there.

A response holds an HTTP response head and the payload. A revisit holds the
head alone, refers to the record with the equal payload, and keeps the full
payload's length and digest in its headers.

Defined cases: a null payload is empty; a null target is left out; line
breaks in a target are percent-encoded; an empty table writes a list of no
files and reads back empty; plain ``.warc`` files are read too; a gzip member of
another writer may hold many records; a file that ends inside a record or a
member raises ``ValueError`` with its path and place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage)

LIST = "_files"
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
LEVEL = 6
#: Smallest payload that is stored once and revisited.
REVISIT_BYTES = 1000

HEADERS = ("warc_type string, record_id string, warc_date string, target_uri string, payload_digest string, "
           "content_length long, payload_length long, refers_to string")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_BREAK = b"\r\n\r\n"
_WINDOW = 1 << 20
_BATCH = 4 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") \
        else (pafs.LocalFileSystem(), path)


def member(block: bytes, level: int = LEVEL) -> bytes:
    """One gzip member with its skip lengths."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(block) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(block))
            + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF))


def record(kind: str, record_id: str, target: str | None, payload: bytes, refers_to: str | None = None,
           digest: str | None = None, length: int | None = None) -> bytes:
    """A WARC/1.1 record; ``digest`` and ``length`` are the full payload's."""
    digest = digest or hashlib.sha1(payload).hexdigest()
    length = len(payload) if length is None else length
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n").encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if target is not None:
        clean = "".join(f"%{ord(c):02X}" if ord(c) < 32 or c == "\x7f" else c for c in target)
        lines.append(f"WARC-Target-URI: {clean}")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _BREAK + block + _BREAK


def parse(head: bytes) -> dict:
    """Header columns of a record's header block."""
    got: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        got[name.strip().lower()] = value.strip()
    digest = got.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        try:
            digest = base64.b32decode(digest[5:]).hex()
        except ValueError:
            digest = digest[5:].lower()
    length = got.get("x-payload-length")
    ref = got.get("warc-refers-to")
    return {"warc_type": got.get("warc-type"), "record_id": (got.get("warc-record-id") or "").strip("<>") or None,
            "warc_date": got.get("warc-date"), "target_uri": got.get("warc-target-uri"),
            "payload_digest": digest or None, "content_length": int(got.get("content-length", 0)),
            "payload_length": int(length) if length else None, "refers_to": ref.strip("<>") if ref else None,
            "content_type": got.get("content-type", "")}


class _File:
    """Random reads through one window."""

    def __init__(self, path: str):
        fs, at = _open(path)
        self.f, self.path = fs.open_input_file(at), path
        self.size, self.at, self.held = self.f.size(), 0, b""

    def read(self, pos: int, n: int) -> bytes:
        n = max(0, min(n, self.size - pos))
        if pos < self.at or pos + n > self.at + len(self.held):
            self.f.seek(pos)
            self.at, self.held = pos, self.f.read(max(n, _WINDOW))
        return self.held[pos - self.at:pos - self.at + n]


def _cut_short(f: _File, pos: int) -> ValueError:
    return ValueError(f"{f.path}: the record at byte {pos} is cut short")


class _Member:
    """The bytes of a gzip member, inflated as they are asked for."""

    def __init__(self, f: _File, start: int):
        self.f, self.at, self.held = f, start, b""
        self.z, self.step = zlib.decompressobj(-15), 1024

    def more(self) -> bool:
        if self.z.eof or self.at >= self.f.size:
            return False
        chunk = self.f.read(self.at, self.step)
        self.at += len(chunk)
        self.held += self.z.decompress(chunk)
        self.step = 1 << 16
        return True

    def head(self) -> bytes | None:
        """The next record's header block; None at the member's end or where it is cut."""
        while _BREAK not in self.held.lstrip(b"\r\n"):
            if not self.more():
                return None
        head, _, self.held = self.held.lstrip(b"\r\n").partition(_BREAK)
        return head

    def take(self, n: int, keep: bool) -> bytes | None:
        """The next ``n`` bytes (empty if they are not kept); None if the member holds fewer."""
        parts = []
        while n:
            if not self.held and not self.more():
                return None
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def end(self) -> int | None:
        """Place behind the member; None if the file ends before it."""
        while self.more():
            self.held = b""
        return self.at - len(self.z.unused_data) + 8 if self.z.eof else None


def _gzip_records(f: _File, wanted) -> Iterator[tuple[dict, bytes]]:
    """Records of gzip members; a member may hold one or, in other writers' files, many."""
    pos = 0
    while pos < f.size:
        head = f.read(pos, 10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"{f.path}: no gzip member at byte {pos}")
        start, skip = pos + 10, None
        if head[3] & 4:
            (n,) = struct.unpack("<H", f.read(start, 2))
            extra = f.read(start + 2, n)
            start += 2 + n
            while len(extra) >= 4:
                (size,) = struct.unpack("<H", extra[2:4])
                if extra[:2] == b"sl" and size >= 8:
                    skip = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size:]
        for flag in (8, 16):
            if head[3] & flag:
                while f.read(start, 1) != b"\0":
                    start += 1
                start += 1
        start += 2 if head[3] & 2 else 0
        member = _Member(f, start)
        while (text := member.head()) is not None:
            fields = parse(text)
            keep = wanted(fields)
            if not keep and skip:
                break
            block = member.take(fields["content_length"], keep)
            if block is None:
                raise _cut_short(f, pos)
            if keep:
                yield fields, block
        if text is not None:
            pos += skip
            continue
        left, end = member.held.strip(b"\r\n"), member.end()
        if left or end is None:
            raise _cut_short(f, pos)
        pos = end


def _plain_records(f: _File, wanted) -> Iterator[tuple[dict, bytes]]:
    pos = 0
    while pos < f.size:
        n = 4096
        while _BREAK not in (head := f.read(pos, n)).lstrip(b"\r\n") and n < f.size - pos:
            n *= 4
        text = head.lstrip(b"\r\n")
        if not text:
            break
        if _BREAK not in text:
            raise _cut_short(f, pos)
        fields = parse(text[:text.index(_BREAK)])
        block = pos + len(head) - len(text) + text.index(_BREAK) + 4
        if block + fields["content_length"] > f.size:
            raise _cut_short(f, pos)
        if wanted(fields):
            yield fields, f.read(block, fields["content_length"])
        pos = block + fields["content_length"]


def _payload(fields: dict, block: bytes) -> bytes | None:
    if fields["warc_type"] == "revisit":
        return None
    if fields["content_type"].startswith("application/http"):
        return block.partition(_BREAK)[2]
    return block


_HEADER_COLUMNS = [c.split()[0] for c in HEADERS.split(", ")]


def _test(f: Filter):
    """A test of header columns for a filter, or None where Spark has to apply it."""
    column = getattr(f, "attribute", None)
    if not column or len(column) != 1 or column[0] not in _HEADER_COLUMNS:
        return None
    name = column[0]
    if isinstance(f, EqualTo):
        return lambda h: h[name] == f.value
    if isinstance(f, In):
        return lambda h: h[name] in f.value
    if isinstance(f, StringStartsWith):
        return lambda h: h[name] is not None and h[name].startswith(f.value)
    if isinstance(f, IsNotNull):
        return lambda h: h[name] is not None
    if isinstance(f, IsNull):
        return lambda h: h[name] is None
    return None


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[InputPartition]:
        fs, at = _open(self.path)
        lists, files = _listed(fs, at)
        found = [(x["name"], x["bytes"]) for x in (files if lists else _archives(fs, at))]
        out: list[list[str]] = []
        room = 0
        for name, size in sorted(found):
            if not out or room < size:
                out.append([])
                room = self.bytes
            out[-1].append(f"{self.path.rstrip('/')}/{name}")
            room -= size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [_test(f) for f in self.filters]
        columns = [*_HEADER_COLUMNS, *(["payload"] if self.payload else [])]
        schema = pa.schema([(c, pa.int64() if c.endswith("_length") else pa.binary() if c == "payload"
                             else pa.string()) for c in columns])

        def wanted(h: dict) -> bool:
            return all(t(h) for t in tests)

        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            f = _File(path)
            records = _gzip_records if path.endswith(".gz") else _plain_records
            for fields, block in records(f, wanted):
                if self.payload:
                    fields["payload"] = _payload(fields, block)
                    held += len(fields["payload"] or b"")
                held += 512
                rows.append(fields)
                if held >= _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _listed(fs: pafs.FileSystem, at: str) -> tuple[list[str], list[dict]]:
    """The folder's lists and the files of all of them."""
    there = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    lists = [i.base_name for i in there if i.base_name.startswith(LIST) and i.base_name.endswith(".json")]
    files: dict[str, dict] = {}
    for name in lists:
        with fs.open_input_stream(f"{at}/{name}") as f:
            files |= {x["name"]: x for x in json.loads(f.read())["files"]}
    return lists, list(files.values())


def _archives(fs: pafs.FileSystem, at: str) -> list[dict]:
    return [{"name": i.base_name, "bytes": i.size} for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
            if i.base_name.endswith((".warc", ".warc.gz"))]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.level = int(options.get("level", LEVEL))
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.overwrite = overwrite
        fs, at = _open(self.path)
        lists, _ = _listed(fs, at)
        # Archives made elsewhere: read as they are while no list is there.
        self.unlisted = [] if lists else _archives(fs, at)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        files: list[dict] = []
        out = None
        for batch in iterator:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if out is None or files[-1]["bytes"] >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "bytes": 0, "records": 0})
                    out = fs.open_output_stream(f"{at}/{files[-1]['name']}", compression=None)
                row = {n: c[i].as_py() for n, c in cols.items()}
                z = member(record(row["warc_type"], row["record_id"], row["target_uri"], row["payload"] or b"",
                                  row["refers_to"], row["payload_digest"], row["payload_length"]), self.level)
                out.write(z)
                files[-1]["bytes"] += len(z)
                files[-1]["records"] += 1
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        files = [x for m in messages if m is not None for x in m.files]
        lists, old = _listed(fs, at)
        if not self.overwrite:
            files += self.unlisted
        with fs.open_output_stream(f"{at}/{LIST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({"files": files}).encode())
        if self.overwrite:
            for name in [*lists, *(x["name"] for x in [*old, *self.unlisted])]:
                fs.delete_file(f"{at}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _open(self.path)
        for m in messages:
            for x in m.files if m is not None else []:
                fs.delete_file(f"{at}/{x['name']}")


class WarcSource(DataSource):
    """Format ``warc``; options: path, payload, partition_bytes, level, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        whole = str(self.options.get("payload", "true")).lower() == "true"
        return HEADERS + (", payload binary" if whole else "")

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


URN = "urn:transitlake:page:"


def page_records(pages: DataFrame, keepers_path: str, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """Rows to write: payloads of ``REVISIT_BYTES`` or more are stored once, with the largest id.

    Only digests that several rows share are looked up: they are written to
    ``keepers_path`` first, so Spark knows their size and broadcasts them or
    not; the payloads are shuffled only if they are too many.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"),
                        payload.alias("payload"))
    rows = (rows.withColumn("payload_digest", F.sha1("payload"))
            .withColumn("payload_length", F.octet_length("payload").cast("long")))
    (rows.filter(F.col("payload_length") >= REVISIT_BYTES)
     .groupBy("payload_digest", "payload_length").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
     .filter("n > 1 AND keeper IS NOT NULL").drop("n").write.parquet(keepers_path))
    keepers = pages.sparkSession.read.parquet(keepers_path)
    rows = rows.join(keepers, ["payload_digest", "payload_length"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    name = F.coalesce(F.concat(F.lit(URN), F.col("page_id").cast("string")),
                      F.concat(F.lit("urn:transitlake:digest:"), F.col("payload_digest")))
    return rows.select(
        name.alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), "target_uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, F.concat(F.lit(URN), F.col("keeper").cast("string"))).alias("refers_to"),
        "payload_digest", "payload_length")


def _page_id(col: str):
    return F.when(F.col(col).startswith(URN), F.substring(F.col(col), len(URN) + 1, 20).cast("long"))


def page_digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages.

    Both payload columns are taken from the payload itself where the record
    has one.
    """
    return records.select(
        _page_id("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), _page_id("refers_to").alias("refers_to"))
