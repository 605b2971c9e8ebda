"""WARC archives as a PySpark Python data source (format ``warc``), read and write.

Writing: one file for each task, a gzip member for each record, closed under a
temporary name and renamed by the driver's commit, so a task that ran twice
leaves one file. Each member's gzip header has an ``sl`` extra field with the
compressed and the whole length of the record (the skip lengths of the WARC
annex on compression).

Reading: partitions are ranges of files planned from their sizes (long files of
members with skip lengths are split; a range begins at the first member that
starts in it, others are read whole). Of a record first the header alone is
inflated and parsed; predicates on the record type and on the target URI, pushed
down by Spark (``spark.sql.python.filterPushdown.enabled``) or given as options
``recordTypes`` and ``uriPrefix``, are tried on it; an unwanted record is
skipped by its skip length without its payload being inflated. Nor is it where
option ``payload`` is ``false``.

Files are reached through pyarrow's file systems, so any store with a URI that
pyarrow knows serves, from every executor.

Duplicates: of records with equal payloads of ``LEAST_BYTES`` or more, the one
with the largest page_id is a response, the others are revisits that name it;
a digest that a third of all pages share is summed up in each task before it
is moved, and the small table of revisits is broadcast only below a checked
count of rows, else joined by shuffle.

Defined cases: null html is an empty payload; a null url is an empty target
URI; a null page_id is written as no id and ranks lowest; rows that repeat the
largest page_id are responses all; empty tables give an empty result; payloads
are read whole at any length; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import Written, scratch, table

LEAST_BYTES = 1000
SPLIT_BYTES = 64 << 20
#: Revisits that are broadcast at most.
BROADCAST_ROWS = 200_000
READ_SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
WRITE_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
#: Start of a gzip member with an sl extra field: magic, deflate, FEXTRA; then time, flags, system, extra length 12, "sl", length 8.
_MAGIC = b"\x1f\x8b\x08\x04"
_EXTRA = b"\x0c\x00sl\x08\x00"
_HEAD = 24
_STAMP = "2024-01-01T00:00:00Z"


def _id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(row) -> bytes:
    """One uncompressed WARC record of a row of WRITE_SCHEMA."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else (row["html"] or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    uri = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"] or "")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_id(row['page_id'])}", f"WARC-Date: {_STAMP}", f"WARC-Target-URI: {uri}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of data, with skip lengths."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = _MAGIC + bytes(4) + b"\x00\xff" + _EXTRA
    return head + struct.pack("<II", _HEAD + len(body) + 8, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Done(WriterCommitMessage):
    name: str | None


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Done:
        fs, root = _system(self.path)
        out, name = None, f"part-{uuid.uuid4().hex}.warc.gz"
        for row in rows:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/_{name}", compression=None)
            out.write(member(record(row)))
        if out is None:
            return Done(None)
        out.close()
        return Done(name)

    def commit(self, messages: list[Done]) -> None:
        fs, root = _system(self.path)
        fs.create_dir(root, recursive=True)
        names = {m.name for m in messages if m and m.name}
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.base_name.startswith("_") and f.base_name[1:] in names:
                continue
            if f.base_name.startswith("_part-") or self.overwrite and f.base_name.startswith("part-"):
                fs.delete_file(f.path)
        for n in sorted(names):
            fs.move(f"{root}/_{n}", f"{root}/{n}")

    def abort(self, messages: list[Done]) -> None:
        fs, root = _system(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/_{m.name}")


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        types = options.get("recordtypes", options.get("recordTypes"))
        self.types = set(types.split(",")) if types else None
        self.prefix = options.get("uriprefix", options.get("uriPrefix", ""))
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("record_type",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("record_type",):
                self._only(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("target_uri",) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def _only(self, types: set) -> None:
        self.types = types if self.types is None else self.types & types

    def partitions(self) -> list[Piece]:
        fs, root = _system(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            return [Piece("", 0, 0)]
        files = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.base_name[0] not in "_."]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            cut = self.split
            if f.size > self.split:
                with fs.open_input_file(f.path) as s:
                    cut = self.split if self._skips(s.read(_HEAD)) else f.size
            out += [Piece(f.path, at, min(at + cut, f.size)) for at in range(0, f.size, cut)]
        return out or [Piece("", 0, 0)]

    @staticmethod
    def _skips(head: bytes) -> bool:
        return head[:4] == _MAGIC and head[10:16] == _EXTRA

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.path:
            return
        fs, _ = _system(self.path)
        with fs.open_input_file(piece.path) as s:
            if piece.start == 0 and not self._skips(s.read_at(_HEAD, 0)):
                yield from self._plain(s)
                return
            at = self._first(s, piece)
            while at is not None and at < piece.end:
                length = struct.unpack("<I", s.read_at(4, at + 16))[0]
                yield from self._wanted(_Inflated(s, at + _HEAD, at + length))
                at += length

    def _first(self, s, piece: Piece) -> int | None:
        """The first member that starts in the range: one whose successor, too, is a member or the end."""
        size, at = s.size(), piece.start
        if at == 0:
            return 0
        while at < piece.end:
            block = s.read_at(min(1 << 20, piece.end - at) + _HEAD, at)
            k = block.find(_MAGIC)
            while 0 <= k < piece.end - at:
                if self._skips(block[k : k + _HEAD]) and len(block) >= k + 20:
                    nxt = at + k + struct.unpack("<I", block[k + 16 : k + 20])[0]
                    if nxt == size or self._skips(s.read_at(_HEAD, nxt)):
                        return at + k
                k = block.find(_MAGIC, k + 1)
            at += 1 << 20
        return None

    def _plain(self, s) -> Iterator[tuple]:
        """Records of an uncompressed file, or of gzip members without skip lengths, one after another."""
        source = _Stream(s)
        while source.more():
            yield from self._wanted(source)
            source.skip_gap()

    def _wanted(self, source) -> Iterator[tuple]:
        head = source.until(b"\r\n\r\n")
        if not head.strip():
            return
        fields = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        length, kind, uri = int(fields.get("content-length", 0)), fields.get("warc-type", ""), fields.get("warc-target-uri", "")
        if (self.types is not None and kind not in self.types) or not uri.startswith(self.prefix):
            source.skip(length)
            return
        number = lambda k: int(fields[k]) if k in fields else None
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        digest = base64.b32decode(said).hex() if len(said) == 32 else (said.lower() or None)
        n, payload = number("x-payload-length"), None
        if self.payload and kind != "revisit":
            block = source.take(length)
            if fields.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            payload, n, digest = block, len(block), hashlib.sha1(block).hexdigest()
        else:
            source.skip(length)
        yield fields.get("warc-record-id"), kind, uri, number("x-page-id"), number("x-refers-to-page"), n, digest, payload


class _Inflated:
    """One member's content; no more is inflated than asked for, and skipping costs nothing."""

    def __init__(self, s, start: int, end: int):
        self.s, self.at, self.end, self.z, self.left = s, start, end, zlib.decompressobj(-15), b""

    def _fill(self, n: int) -> None:
        while len(self.left) < n and (self.z.unconsumed_tail or (self.at < self.end and not self.z.eof)):
            data = self.z.unconsumed_tail
            if not data:
                data = self.s.read_at(min(1 << 16, self.end - self.at), self.at)
                self.at += len(data)
            self.left += self.z.decompress(data, max(4096, n - len(self.left)))

    def until(self, mark: bytes) -> bytes:
        n = 2048
        while True:
            self._fill(n)
            head, found, rest = self.left.partition(mark)
            if found or len(self.left) < n:
                self.left = rest
                return head
            n *= 2

    def take(self, n: int) -> bytes:
        parts, have = [self.left[:n]], min(n, len(self.left))
        self.left = self.left[n:]
        while have < n:
            self._fill(min(1 << 20, n - have))
            if not self.left:
                break
            parts.append(self.left[: n - have])
            have += len(parts[-1])
            self.left = self.left[len(parts[-1]) :]
        return b"".join(parts)

    def skip(self, n: int) -> None:
        self.left = b""


class _Stream:
    """Bytes of a whole file, inflated where it is gzip."""

    def __init__(self, s):
        self.s, self.left, self.z = s, b"", None
        first = s.read_at(2, 0)
        s.seek(0)
        if first == b"\x1f\x8b":
            self.z = zlib.decompressobj(31)

    def _fill(self, n: int) -> None:
        while len(self.left) < n:
            data = self.s.read(1 << 20)
            if not data:
                return
            if self.z is None:
                self.left += data
                continue
            while data:
                self.left += self.z.decompress(data)
                data = self.z.unused_data
                if self.z.eof:
                    self.z = zlib.decompressobj(31)

    def more(self) -> bool:
        self._fill(1)
        return bool(self.left)

    def until(self, mark: bytes) -> bytes:
        n = 2048
        while True:
            self._fill(n)
            head, found, rest = self.left.partition(mark)
            if found or len(self.left) < n:
                self.left = rest
                return head
            n *= 2

    def take(self, n: int) -> bytes:
        self._fill(n)
        out, self.left = self.left[:n], self.left[n:]
        return out

    def skip(self, n: int) -> None:
        while n:
            self._fill(min(n, 1 << 20))
            if not self.left:
                return
            step = min(n, len(self.left))
            self.left, n = self.left[step:], n - step

    def skip_gap(self) -> None:
        self._fill(4)
        while self.left[:2] == b"\r\n":
            self.left = self.left[2:]
            self._fill(4)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter pushdown, which its reader implements."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def planned(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) in WRITE_SCHEMA: digests, and which rows revisit which."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    large = rows.filter(F.col("payload_bytes") >= LEAST_BYTES)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = Written(groups, "warc-groups")
    small = F.broadcast(groups.df) if groups.rows <= BROADCAST_ROWS else groups.df
    out = rows.join(small, "payload_digest", "left")
    again = F.col("refers_to").isNotNull() & (F.col("payload_bytes") >= LEAST_BYTES) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return out.select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("refers_to")).alias("refers_to"), "payload_bytes", "payload_digest", "html")


def archive(pages: DataFrame, path: str) -> None:
    """Write a WARC record for each row of pages (page_id, url, html)."""
    register(pages.sparkSession)
    planned(pages).write.format("warc").mode("overwrite").save(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of the archives under path."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    path = scratch(spark, "warc")
    archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return load(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Digests by the SQL engine itself; sha1 of the UTF-8 text.
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN g.top IS NULL OR g.top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.top IS NULL OR g.top = page_id THEN NULL ELSE g.top END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
