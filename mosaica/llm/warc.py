"""WARC files as a PySpark data source, ``warc``: reads ``.warc`` and ``.warc.gz``, writes ``.warc.gz``.

Reading plans partitions of whole files of about ``partitionBytes`` together. Filters on the record type, the target,
the date, the identifier, the content type, the length and their nullness are pushed down: a record's headers are
parsed first, and a payload is read, inflated and decoded only if they pass, and only if a payload column is asked
for. A gzip member that carries its length (the ``sl`` extra field, which the writer sets) and holds one record is skipped by a
seek, an uncompressed record by its Content-Length; another member is inflated without being kept. A member may hold any
number of whole records. Pushed filters follow SQL's rules for nulls.

Columns, any of which ``.schema(...)`` may pick: ``record_type, record_id, target_uri, warc_date, content_type``
(string), ``content_length`` (long), ``headers`` (map of all headers in lower case), ``http_status`` (int),
``http_headers`` (map), ``block`` (binary, the record as it stands), ``body`` (binary, without HTTP headers, chunks and
content encoding), ``malformed`` (string, null for a good record).

Malformed records: those that don't begin with ``WARC/``, without a Content-Length of digits, with over 1 MB of headers,
cut off at the end of a file or gzip member, and broken gzip members. With the option ``mode`` = ``failfast`` (the default) the
first one raises an error with its place; with ``permissive`` reading goes on at the next line that begins with ``WARC/``, or
the next member, and a malformed record is a row with the reason in ``malformed`` and nulls elsewhere (but for the headers, where
those were good) if that column is read, so that they can be counted, and no row if it isn't. No malformed record: lines that
end in LF alone, and blank lines before, between and after records.

Writing takes ``record_type``, ``target_uri``, ``record_id``, ``warc_date``, ``content_type``, ``block`` and ``headers`` as far
as there are such columns; a task writes one file, under its name once the job commits.

Defined cases: a header without value in the row isn't written and is read as null; a null block is an empty one; line
ends in header values become blanks; values of a repeated header are joined by a comma; an empty table gives an empty folder,
and an empty folder no rows; other columns are not written; a ``page_id`` of another type goes as its text and comes back as
null where that is no integer.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, content_type string, content_length long, headers map<string,string>, http_status int, http_headers map<string,string>, block binary, body binary, malformed string"
_FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type"}
_NAMES = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type"}
_PAYLOAD = {"http_status", "http_headers", "block", "body"}
PARTITION_BYTES = 128 << 20
_STEP = 1 << 16


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def parse_headers(data: bytes) -> dict[str, str]:
    """Header lines -> lower-case name: value; folded lines are joined, and so are the values of a repeated name, by a comma."""
    out: dict[str, str] = {}
    last = None
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return out


def passes(f, row: dict) -> bool | None:
    """Whether a row of header columns passes a pushed filter, None where SQL says null; only True keeps a row."""
    if isinstance(f, Not):
        inner = passes(f.child, row)
        return None if inner is None else not inner
    v = row[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (v is None) == isinstance(f, IsNull)
    if v is None:
        return None
    if isinstance(f, In):
        return True if v in [x for x in f.value if x is not None] else None if None in f.value else False
    x = f.value
    if x is None:
        return None
    return {EqualTo: lambda: v == x, GreaterThan: lambda: v > x, GreaterThanOrEqual: lambda: v >= x, LessThan: lambda: v < x, LessThanOrEqual: lambda: v <= x, StringStartsWith: lambda: v.startswith(x), StringEndsWith: lambda: v.endswith(x), StringContains: lambda: x in v}[type(f)]()


_KINDS = (EqualTo, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Malformed(Exception):
    """What is wrong with a record, and the byte of the file at which it, or its gzip member, begins."""

    def __init__(self, why: str, at: int):
        super().__init__(f"{why} at byte {at}")
        self.at = at


#: A header block that is longer is no header block.
MOST_HEADER = 1 << 20
_NEXT = b"\nWARC/"


def _head(data: bytes, at: int, ended: bool = False) -> tuple[dict[str, str], int, int] | None:
    """Headers, where the block starts and how long it is; None as long as more bytes are needed. Lines may end in LF alone."""
    if not data.startswith(b"WARC/"[: len(data)]) or (ended and len(data) < 5):
        raise Malformed("no WARC record", at)
    ends = [(data.find(sep), len(sep)) for sep in (b"\r\n\r\n", b"\n\n")]
    if not (ends := [x for x in ends if x[0] >= 0]):
        if ended or len(data) > MOST_HEADER:
            raise Malformed("a record is cut off", at)
        return None
    end, width = min(ends)
    headers = parse_headers(data[data.index(b"\n") + 1 : end] if b"\n" in data[:end] else b"")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(length) > 18:
        raise Malformed(f"Content-Length is {length[:40]!r}", at)
    return headers, end + width, int(length)


class Records:
    """The records of one file: headers first, then the block if it is wanted. Counts what it inflates.

    With ``permissive`` a malformed record comes as :class:`Malformed`, in place of its headers or its block, and reading goes on
    at the next line that begins with ``WARC/`` (or, where a gzip member is broken, at the next member); else it is raised.
    """

    def __init__(self, f, gz: bool, size: int, permissive: bool = False):
        self.f, self.gz, self.size, self.permissive, self.inflated = f, gz, size, permissive, 0

    def __iter__(self):
        at = 0
        while at < self.size:
            self.f.seek(at)
            try:
                at = yield from (self._member(at) if self.gz else self._record(at))
            except (Malformed, zlib.error) as e:
                e = e if isinstance(e, Malformed) else Malformed(f"a gzip member is broken ({e})", at)
                if not self.permissive:
                    raise ValueError(str(e)) from e
                yield e
                at = self._resume(max(at, e.at) + 1, b"\x1f\x8b\x08" if self.gz else _NEXT)

    def _resume(self, at: int, mark: bytes) -> int:
        """Where the mark next occurs from ``at`` on, or the end of the file."""
        self.f.seek(at)
        held = b""
        while True:
            piece = self.f.read(_STEP)
            if not piece:
                return self.size
            held += piece
            if (k := held.find(mark)) >= 0:
                return at + k + (1 if mark is _NEXT else 0)
            keep = len(mark) - 1
            at, held = at + len(held) - keep, held[-keep:]

    def _record(self, at: int):
        data, more = b"", True
        while True:
            blank = len(data) - len(data.lstrip(b"\r\n"))
            at, data = at + blank, data[blank:]  # blank lines before a record are none of it
            if data and (got := _head(data, at, not more)):
                break
            if not more:
                return self.size
            more = self.f.read(4096)
            data += more
        headers, start, length = got
        if at + start + length > self.size:
            raise Malformed("a record is cut off", at)
        want = yield headers
        if want:
            block = data[start : start + length]
            self.f.seek(at + start + len(block))
            yield block + (self.f.read(length - len(block)) if length > len(block) else b"")
        return at + start + length

    def _member(self, at: int):
        head = self.f.read(24)
        known, whole = struct.unpack("<II", head[16:24]) if head[:2] == b"\x1f\x8b" and len(head) == 24 and head[3] & 4 and head[12:14] == b"sl" else (0, 0)
        d, raw = zlib.decompressobj(31), head

        def more(most: int) -> bytes:
            """At most ``most`` bytes more; none at the member's end."""
            nonlocal raw
            piece = b""
            while not piece and not d.eof:
                raw = raw or self.f.read(_STEP)
                if not raw:
                    raise Malformed("a gzip member is cut off", at)
                piece = d.decompress(raw, most)
                raw = d.unconsumed_tail
            self.inflated += len(piece)
            return piece

        data, first, ended, lost = b"", True, False, False
        while True:
            try:
                got = None
                while not got:
                    if lost:  # behind a malformed record
                        k = data.find(_NEXT)
                        data, lost = (data[k + 1 :], False) if k >= 0 else (data[1 - len(_NEXT) :], True)
                    else:
                        data = data.lstrip(b"\r\n")
                        got = _head(data, at, ended) if data else None
                    if got or (ended and (lost or not data)):
                        break
                    if ended:
                        continue
                    piece = more(4096)
                    data, ended = data + piece, not piece
                if not got:
                    if first:
                        raise Malformed("no WARC record in the member", at)
                    return self.f.tell() - len(d.unused_data)
                headers, start, length = got
                want = yield headers
                if not want and known and first and (start + length + 4) & 0xFFFFFFFF == whole:
                    return at + known  # the record is all of the member
                pieces, have = [data[start : start + length]], min(len(data) - start, length)
                data, first = data[start + length :], False
                while have < length:
                    piece = more(length - have if want else min(length - have, _STEP))
                    if not piece:
                        ended = True
                        raise Malformed("a record is cut off", at)
                    have += len(piece)
                    if want:
                        pieces.append(piece)
                if want:
                    yield b"".join(pieces)
            except Malformed as e:
                if not self.permissive or (not ended and d.eof is False and "gzip" in str(e)):
                    raise
                yield e
                data, first, lost = data[1:], False, True


def http(block: bytes) -> tuple[int | None, dict[str, str] | None, bytes]:
    """Status, headers and decoded body of an HTTP message; a block that is none is all body."""
    if not block.startswith(b"HTTP/") or (end := block.find(b"\r\n\r\n")) < 0:
        return None, None, block
    first, _, rest = block[:end].partition(b"\r\n")
    headers, body = parse_headers(rest), block[end + 4 :]
    if headers.get("transfer-encoding", "").lower() == "chunked":
        out, i = [], 0
        try:
            while i < len(body):
                j = body.index(b"\r\n", i)
                n = int(body[i:j].split(b";")[0], 16)
                if not n:
                    break
                out.append(body[j + 2 : j + 2 + n])
                i = j + 4 + n
            body = b"".join(out)
        except ValueError:
            pass
    if headers.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, 47)
        except zlib.error:
            pass
    status = first.split()[1:2]
    return int(status[0]) if status and status[0].isdigit() else None, headers, body


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        mode = options.get("mode", "failfast").lower()
        if mode not in ("failfast", "permissive"):
            raise ValueError(f"mode is {mode!r}; it can be failfast or permissive")
        self.permissive = mode == "permissive"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, _KINDS) and len(inner.attribute) == 1 and inner.attribute[0] in (*_FIELDS, "content_length"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        where, root = _fs(self.path)
        info = where.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        bins, room = [], 0
        for path, size in files:
            if not bins or size > room:
                bins.append(Files([]))
                room = self.most
            bins[-1].paths.append(path)
            room -= size
        return bins or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        names = arrow.names
        payload = bool(_PAYLOAD & set(names))
        rows, held = [], 0
        where = _fs(self.path)[0]
        for path in partition.paths:
            with where.open_input_file(path) as f:
                records = iter(Records(f, path.endswith(".gz"), f.size(), self.permissive))
                answer = None
                while True:
                    try:
                        headers = records.send(answer)
                    except StopIteration:
                        break
                    answer, bad = None, headers if isinstance(headers, Malformed) else None
                    row = dict.fromkeys((*_FIELDS, "content_length", *names))
                    if not bad:
                        row |= {c: headers.get(h) for c, h in _FIELDS.items()} | {"content_length": int(headers["content-length"])}
                    if not all(passes(x, row) for x in self.filters):
                        continue
                    if not bad:
                        row["headers"] = headers
                        if payload:
                            row["block"] = records.send(True)
                            bad = row["block"] if isinstance(row["block"], Malformed) else None
                    if bad:  # a row of nothing but the reason, or of the headers without a block
                        if "malformed" not in names:
                            continue
                        row |= {"malformed": f"{path}: {bad}", "block": None}
                    elif payload:
                        if {"http_status", "http_headers", "body"} & set(names):
                            row["http_status"], row["http_headers"], row["body"] = http(row["block"])
                        held += len(row["block"])
                    rows.append({c: row[c] for c in names})
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist([_maps(r) for r in rows], arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([_maps(r) for r in rows], arrow)


def _maps(row: dict) -> dict:
    return {c: list(v.items()) if isinstance(v, dict) else v for c, v in row.items()}


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member that says how long it is."""
    lines = "".join(f"{k}: {' '.join(v.splitlines()) if len(v.splitlines()) > 1 or v[-1:] in '\r\n' else v}\r\n" for k, v in headers)
    data = b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    z = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(z) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + z + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]
        where, root = _fs(self.path)
        if overwrite:
            from pyarrow import fs

            if where.get_file_info(root).type == fs.FileType.Directory:
                where.delete_dir_contents(root)
        where.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        c = TaskContext.get()
        where, root = _fs(self.path)
        final = f"{root}/part-{c.partitionId():05d}-{self.job}.warc.gz"
        temporary = f"{final}.{c.taskAttemptId()}.part"
        with where.open_output_stream(temporary) as f:
            f.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: mosaica\r\n"))
            for b in iterator:
                for row in b.to_pylist():
                    headers = [(n, str(row[x])) for x, n in _NAMES.items() if row.get(x) is not None]
                    headers += [(k, v) for k, v in (row.get("headers") or []) if v is not None]
                    f.write(member(headers, bytes(row.get("block") or b"")))
        return Written(temporary, final)

    def commit(self, messages) -> None:
        where, _ = _fs(self.path)
        for m in messages:
            if m:
                where.move(m.temporary, m.final)

    def abort(self, messages) -> None:
        where, _ = _fs(self.path)
        for m in messages:
            if m:
                where.delete_file(m.temporary)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pages_to_warc(pages: DataFrame, path: str) -> None:
    """Writes a ``request`` and a ``response`` record for each row of ``pages``; ``page_id`` goes with both as ``X-Page-Id``."""
    register(pages.sparkSession)
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    url = F.col("url").cast("string")
    both = F.explode(
        F.array(
            F.struct(F.lit("request").alias("record_type"), F.lit("application/http; msgtype=request").alias("content_type"), F.encode(F.concat(F.lit("GET "), F.coalesce(url, F.lit("")), F.lit(" HTTP/1.1\r\n\r\n")), "UTF-8").alias("block")),
            F.struct(F.lit("response").alias("record_type"), F.lit("application/http; msgtype=response").alias("content_type"), F.encode(F.concat(head, F.coalesce("html", F.lit(""))), "UTF-8").alias("block")),
        )
    )
    records = pages.select(url.alias("target_uri"), F.map_from_arrays(F.array(F.lit("X-Page-Id")), F.array(F.col("page_id").cast("string"))).alias("headers"), both.alias("r"))
    records.select("r.record_type", "target_uri", F.lit("1970-01-01T00:00:00Z").alias("warc_date"), "r.content_type", "headers", "r.block").write.format("warc").mode("append").save(path)


def responses(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, html)`` of the response records: the others' payloads are never inflated."""
    register(spark)
    read = spark.read.format("warc").schema("record_type string, target_uri string, content_type string, headers map<string,string>, body binary").load(path)
    got = read.where("record_type = 'response'").where(F.col("content_type").startswith("application/http"))
    return got.select(F.expr("try_cast(headers['x-page-id'] as long)").alias("page_id"), F.col("target_uri").alias("url"), F.decode("body", "UTF-8").alias("html"))


#: :func:`responses` of ``pages``, for DuckDB.
PAGES_SQL = "SELECT page_id, url, coalesce(html, '') AS html FROM pages"
