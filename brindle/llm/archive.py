"""Operator 9: web archives packaged as ZIP files, read by byte ranges without unpacking.

A package holds stored (uncompressed) members ``archive/*.warc.gz`` of gzipped records and indexes ``indexes/*.cdx*``
that give each record's offset and length. The reader looks at a package's end for the central directory, in its plain
or its ZIP64 form, finds the members' data by their local headers, reads the indexes, and makes byte ranges of
neighbouring records. The ranges, rows of a few numbers, are spread over the cluster; each is one read of the file.

A package's directory is read by one task, packages by as many as there are; records by as many as their bytes ask for.
Bytes of a member that no index line names, or a whole member, are one range, read on from its start a chunk at a time.

Defined results
  records that no index names  read all the same, record by record
  members of the same name     told apart by their path; an index line that names neither path nor a single member is an error
  index entry of no member     an error, like any damage; with ``errors="skip"`` the package gives no rows
  damaged record               an error; with ``errors="skip"`` no row, and in a range without an index none of what follows it there
  deflated archive member      an error: it can't be read by ranges
  index that is deflated       inflated, and a gzipped one too
  no package, no record        no row; a file of no bytes is no package
  record without a type, uri   null in that column
  writer: null url, id, html   no such header; a null html is a truncated record, and comes back as null
  writer: empty html, repeats  a record each
  writer: extra columns        not read
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.scratch import materialize

RANGE_BYTES, TASK_BYTES, CHUNK = 4 << 20, 16 << 20, 1 << 20
#: Tasks for each core, at most, that read directories.
DIRECTORY_TASKS = 16
RANGE_TYPE = "path string, start bigint, length bigint, offsets array<bigint>, lengths array<bigint>"
RECORD_TYPE = "path string, offset bigint, type string, uri string, record_id string, date string, status int, truncated boolean, payload binary"
_DATE = "2024-01-01T00:00:00Z"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Member:
    """An entry of the central directory; ``header`` is where its local header stands."""

    name: str
    method: int
    header: int
    packed: int
    size: int


def _at(file, start: int, length: int) -> bytes:
    file.seek(start)
    found = file.read(length)
    if len(found) < length:
        raise ValueError(f"the package ends at {start + len(found)}, before {start + length}")
    return found


def directory(file, size: int) -> list[Member]:
    """Members by the central directory at the end of a package of ``size`` bytes."""
    back = min(size, 65557)
    tail = _at(file, size - back, back)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) - end < 22:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    close = size - back + end
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if close < 20 or (mark := _at(file, close - 20, 20))[:4] != b"PK\x06\x07":
            raise ValueError("no locator of the ZIP64 directory")
        close = struct.unpack("<Q", mark[8:16])[0]
        big = _at(file, close, 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no end of the ZIP64 directory")
        count, length, start = struct.unpack("<QQQ", big[32:56])
    before = close - length - start  # bytes that stand before the package in its file
    data, at, out = _at(file, start + before, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
        packed, full, n, extra, note = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, place = data[at + 46 + n : at + 46 + n + extra], 0
        while place + 4 <= len(more):
            kind, many = struct.unpack("<HH", more[place : place + 4])
            if kind == 1:
                wide = [x[0] for x in struct.iter_unpack("<Q", more[place + 4 : place + 4 + many // 8 * 8])]
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            place += 4 + many
        out.append(Member(name, method, header + before, packed, full))
        at += 46 + n + extra + note
    return out


def data_start(file, member: Member) -> int:
    """Where a member's bytes begin, by its local header."""
    head = _at(file, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def _index_lines(file, member: Member) -> Iterator[tuple[str, int, int]]:
    """(member's file name, offset, length) of each record in an index."""
    raw = _at(file, data_start(file, member), member.packed)
    raw = zlib.decompress(raw, -15) if member.method == 8 else raw
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    for line in raw.decode().splitlines():
        if (brace := line.find("{")) >= 0 and not line.startswith("!"):
            entry = json.loads(line[brace:])
            yield entry["filename"], int(entry["offset"]), int(entry["length"])


def ranges(file, size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(start, length, record starts, record lengths) in the package's file; neighbours share a range. An empty list of records: read all."""
    members = directory(file, size)
    archives = {m.name: m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
    for m in archives.values():
        if m.method:
            raise ValueError(f"{m.name} is compressed within the package and can't be read by ranges")
    found: dict[str, set[tuple[int, int]]] = {}
    for m in members:
        if m.name.startswith("indexes/") and ".cdx" in m.name:
            for name, offset, length in _index_lines(file, m):
                found.setdefault(_named(name, archives), set()).add((offset, length))
    for name, m in archives.items():
        base, run, end = data_start(file, m), [], 0
        for offset, length in [*sorted(found.get(name, ())), (m.packed, 0)]:
            if offset + length > m.packed:
                raise ValueError(f"the index goes beyond the end of {name}")
            if run and (offset > end or not length or offset + length - run[0][0] > most):
                yield _range(base, run)
                run = []
            if offset > end:  # what the index leaves out
                yield base + end, offset - end, [], []
            if length:
                run.append((offset, length))
            end = max(end, offset + length)


def _named(name: str, archives: dict[str, Member]) -> str:
    """The member that an index line means: by its path, with or without the folder, or by its name where one member alone has it."""
    for path in (name, f"archive/{name}"):
        if path in archives:
            return path
    same = [path for path in archives if path.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]]
    if len(same) != 1:
        raise ValueError(f"the index names {name}, of which the package has {len(same)}")
    return same[0]


def _range(base: int, run: list[tuple[int, int]]):
    start = run[0][0]
    return base + start, max(o + n for o, n in run) - start, [base + o for o, _ in run], [n for _, n in run]


def _all_records(file, start: int, length: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(start, record) of all records of a range, gzipped ones or plain ones one after the other; a chunk and a record are held at a time."""
    held, at, left = b"", start, length
    file.seek(start)

    def more() -> bytes:
        nonlocal left
        found = file.read(min(left, chunk))
        if not found:
            raise ValueError("a record is cut off")
        left -= len(found)
        return found

    while held or left:
        held = held or more()
        if held[:1] in b"\r\n":  # lines between records
            blank = len(held) - len(held.lstrip(b"\r\n"))
            held, at = held[blank:], at + blank
            continue
        if len(held) < 2 and left:
            held += more()
        if held[:2] == b"\x1f\x8b":
            unpack, parts, taken = zlib.decompressobj(31), [], 0
            while True:
                parts.append(unpack.decompress(held))
                taken += len(held)
                if unpack.eof:
                    break
                held = more()
            held = unpack.unused_data
            yield at, b"".join(parts)
            at += taken - len(held)
        else:
            parts = bytearray(held)
            while (head := parts.find(b"\r\n\r\n")) < 0:
                parts += more()
            stop = head + 4 + int(_headers(bytes(parts[:head])).get("content-length", 0))
            while len(parts) < stop:
                parts += more()
            held = bytes(parts[stop:])
            yield at, bytes(parts[:stop])
            at += stop


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(record: bytes) -> tuple:
    """(type, uri, record_id, date, status, truncated, payload); a response's payload is what follows its HTTP headers."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a record")
    h = _headers(head)
    body, status = rest[: int(h.get("content-length", 0))], None
    if h.get("warc-type") == "response" and body.startswith(b"HTTP/"):
        first, _, payload = body.partition(b"\r\n\r\n")
        parts = first.split(b"\r\n", 1)[0].split()
        status, body = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None, payload
    return h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-record-id"), h.get("warc-date"), status, "warc-truncated" in h, body


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RANGES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_RECORDS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("truncated", pa.bool_()), ("payload", pa.binary())])


def read_ranges(packages: DataFrame, *, errors: str = "raise") -> DataFrame:
    """The byte ranges of packages. packages: one row a package, with its ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    store, inner = open_store(path)
                    with store.open_input_file(inner) as file:
                        yield _table([(path, *r) for r in ranges(file, file.size())], _RANGES)
                except (ValueError, KeyError, struct.error, zlib.error, OSError):
                    if errors != "skip":
                        raise

    paths = materialize(packages.select("path").where("path IS NOT NULL").distinct(), "paths")
    # by their number: paths are so short that by bytes one task would read all directories
    tasks = max(1, min(paths.count(), DIRECTORY_TASKS * packages.sparkSession.sparkContext.defaultParallelism))
    return paths.repartition(tasks).mapInArrow(run, RANGE_TYPE)


def _unpacked(record: bytes) -> bytes:
    return gzip.decompress(record) if record[:2] == b"\x1f\x8b" else record


_DAMAGE = (ValueError, EOFError, zlib.error, OSError)


def read_records(spans: DataFrame, *, errors: str = "raise") -> DataFrame:
    """The records of byte ranges, each range of listed records one read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                for row in records(r):
                    rows.append(row)
                    size += len(row[-1])
                    if size > RANGE_BYTES:
                        yield _table(rows, _RECORDS)
                        rows, size = [], 0
                yield _table(rows, _RECORDS)

    def records(r: dict) -> Iterator[tuple]:
        try:
            store, inner = open_store(r["path"])
            with store.open_input_file(inner) as file:
                if not r["offsets"]:
                    for start, record in _all_records(file, r["start"], r["length"]):
                        yield r["path"], start, *parse(record)
                    return
                raw = _at(file, r["start"], r["length"])
        except _DAMAGE:
            if errors != "skip":
                raise
            return
        for start, length in zip(r["offsets"], r["lengths"]):
            try:
                yield r["path"], start, *parse(_unpacked(raw[start - r["start"] : start - r["start"] + length]))
            except _DAMAGE:
                if errors != "skip":
                    raise

    return spans.mapInArrow(run, RECORD_TYPE)


def read_packages(packages: DataFrame, *, errors: str = "raise") -> DataFrame:
    """All records of packages. packages: one row a package, with its ``path``."""
    spans = materialize(read_ranges(packages, errors=errors), "ranges")
    total = spans.agg(F.sum("length")).first()[0] or 0
    tasks = max(packages.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return read_records(spans.repartition(tasks), errors=errors)


def find_packages(spark: SparkSession, folder: str, pattern: str = "*.wacz") -> DataFrame:
    """The paths of the packages in a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")


def record(url: str | None, html: str | None, record_id: str | None) -> bytes:
    """A gzipped response record."""
    clean = {k: None if v is None else v.replace("\r", "%0D").replace("\n", "%0A") for k, v in (("WARC-Target-URI", url), ("WARC-Record-ID", record_id))}
    payload = (html or "").encode()
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Date: {_DATE}", *(f"{k}: {v}" for k, v in clean.items() if v is not None)]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", *(["WARC-Truncated: unspecified"] if html is None else [])]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def write_package(sink, rows: Iterator[tuple]) -> int:
    """Write (url, html, record_id) rows as one package into a binary file; the number of records."""
    at, lines = 0, []
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True) as member:
            for url, html, record_id in rows:
                packed = record(url, html, record_id)
                member.write(packed)
                entry = {"url": url, "mime": "text/html", "status": 200, "offset": at, "length": len(packed), "filename": "data.warc.gz"}
                lines.append(f"{url or '-'} 20240101000000 ".replace("{", "%7B").replace("\r", "%0D").replace("\n", "%0A") + json.dumps(entry))
                at += len(packed)
        package.writestr("indexes/index.cdxj", "".join(x + "\n" for x in sorted(lines)), zipfile.ZIP_DEFLATED)
        package.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": []}))
    return len(lines)


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write each partition as a package; ``(path, records)`` of those written, as a written table.

    A task that runs twice leaves a second file, which the returned table doesn't list.
    """
    rows = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string"), F.concat(F.lit("<urn:page:"), F.col(id_col).cast("string"), F.lit(">")))
    kind = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(folder)
        store.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}.wacz"
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        first = next(each, None)
        if first is None:
            return
        with store.open_output_stream(f"{inner}/{name}") as sink:
            n = write_package(_Sink(sink), _chain(first, each))
        yield _table([(f"{folder.rstrip('/')}/{name}", n)], kind)

    return materialize(rows.mapInArrow(run, "path string, records bigint"), "packages")


def _chain(first, rest):
    yield first
    yield from rest


class _Sink(io.RawIOBase):
    """A stream that can't be wound back, as object stores have them."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)


def pages(records: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` of the records that ``write_packages`` made."""
    html = F.when(~F.col("truncated"), F.decode("payload", "utf-8"))
    return records.where("type = 'response'").select(F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint").alias("page_id"), F.col("uri").alias("url"), html.alias("html"))
