"""WARC archives: writing records, and a reader that salvages what is left of damaged files.

A file is a row of gzip members, one record each. The reader checks every record (version line,
lengths, block digest). Where a check fails it looks for the next member, or the next version line in
files that aren't compressed, goes on there and logs the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.common import new_folder, written

#: Records with equal payloads of at least so many bytes are written once and then revisited.
REVISIT_BYTES = 1000
#: Bytes after which a task begins another file.
FILE_BYTES = 16 << 20
#: Bytes read at once.
READ_BYTES = 1 << 20
#: Gzip at its fastest: pages of HTML shrink to a third already.
LEVEL = 1
VERSION = b"WARC/1.1"
_MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return "<urn:page:unknown>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str | None) -> int | None:
    tail = (record or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool) -> bytes:
    """One record. A revisit names the record it refers to and has no payload, only its size and digest."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    uri = "".join(c if "!" <= c <= "~" else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in url) if url else record_id(page_id)[1:-1]
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(original))]
    head.append(("Content-Length", str(len(block))))
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block + b"\r\n\r\n"])


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_size(self) -> int:
        """Of the full payload: a revisit's HTTP header still says it."""
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.lower() == b"content-length":
                return int(value)
        return len(self.payload)

    @property
    def payload_digest(self) -> str:
        """Lower-case hex. Of a response it is computed anew, of a revisit the header's."""
        if self.headers.get("warc-type") == "revisit":
            return base64.b32decode(self.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        return hashlib.sha1(self.payload).hexdigest()


@dataclass
class Salvage:
    """Reads records from a file; `gaps` has (from, to, reason) of the bytes that hold none."""

    file: object
    gaps: list[tuple[int, int, str]] = field(default_factory=list)
    _data: bytearray = field(default_factory=bytearray)
    _base: int = 0
    _ended: bool = False

    def _have(self, upto: int) -> bool:
        """Read on until the file's bytes before `upto` are there."""
        while not self._ended and self._base + len(self._data) < upto:
            more = self.file.read(READ_BYTES)
            if more:
                self._data += more
            else:
                self._ended = True
        return self._base + len(self._data) >= upto

    def _forget(self, before: int) -> None:
        del self._data[:before - self._base]
        self._base = before

    def _find(self, start: int) -> int | None:
        """The next place, from `start`, where a member or an uncompressed record may begin."""
        while True:
            at = [x for x in (self._data.find(m, start - self._base) for m in (_MAGIC, b"WARC/1.")) if x >= 0]
            if at:
                return self._base + min(at)
            if self._ended:
                return None
            # A mark may stand across the end of what has been read.
            start = max(start, self._base + len(self._data) - 6)
            self._forget(start)
            self._have(self._base + len(self._data) + 1)

    def _inflate(self, start: int) -> tuple[bytes, int]:
        unpacker, out, at = zlib.decompressobj(31), [], start
        while not unpacker.eof:
            if not self._have(at + 1):
                raise ValueError("member ends too soon")
            piece = bytes(self._data[at - self._base:at - self._base + (1 << 16)])
            try:
                out.append(unpacker.decompress(piece))
            except zlib.error as error:
                raise ValueError("damaged member") from error
            at += len(piece) - len(unpacker.unused_data)
        return b"".join(out), at

    def _plain(self, start: int) -> tuple[bytes, int]:
        at = start
        while (cut := self._data.find(b"\r\n\r\n", at - self._base)) < 0:
            at = max(start, self._base + len(self._data) - 3)
            if not self._have(self._base + len(self._data) + 1):
                raise ValueError("header ends too soon")
        head = self._base + cut + 4
        length = _headers(bytes(self._data[start - self._base:cut])).get("content-length", "")
        if not length.isdigit():
            raise ValueError("no length")
        end = head + int(length) + 4
        if not self._have(end):
            raise ValueError("record ends too soon")
        return bytes(self._data[start - self._base:end - self._base]), end

    def __iter__(self) -> Iterator[Record]:
        at, bad, reason = 0, None, ""
        while True:
            # While a damaged stretch is searched, its bytes needn't be kept.
            self._forget(at)
            found = self._find(at)
            if found is None or found > at:
                if bad is None:
                    bad, reason = at, "no record"
                if found is None:
                    end = self._base + len(self._data)
                    if end > bad:
                        self.gaps.append((bad, end, reason))
                    return
                at = found
            try:
                zipped = self._data[at - self._base:at - self._base + 3] == _MAGIC
                data, end = self._inflate(at) if zipped else self._plain(at)
                got = _parsed(data, at, end)
            except ValueError as error:
                if bad is None:
                    bad, reason = at, str(error)
                at += 1
                continue
            if bad is not None:
                self.gaps.append((bad, at, reason))
                bad = None
            yield got
            at = end


def _headers(data: bytes) -> dict[str, str]:
    lines = data.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError("no version line")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _parsed(data: bytes, start: int, end: int) -> Record:
    head, mark, rest = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    length = headers.get("content-length", "")
    if not mark or not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("wrong length")
    block = rest[:-4]
    if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise ValueError("wrong digest")
    return Record(start, end, headers, block)


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html and `original`: for payloads of at least REVISIT_BYTES that several rows have, the largest page_id.

    Only digests that occur more than once are joined back; the pre-aggregation sends one row per task and digest.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.when(F.octet_length(html) >= REVISIT_BYTES, F.sha1(html.cast("binary"))).alias("digest"))
    seen = rows.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("original")).filter("n > 1").select("digest", "original", F.lit(True).alias("known"))
    return rows.join(seen, "digest", "left").select("page_id", "url", "html", "original", F.coalesce("known", F.lit(False)).alias("known"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row; gives the manifest (file, records, bytes). `pages` as with_originals() gives them.

    Of rows that share a payload the ones with the original's page_id are responses, the others revisits.
    A task that runs twice leaves files that no manifest names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, html, original, known = row
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = member(record(page_id, url, html.encode(), original, known and page_id != original))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(pages.mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


_ROW = "file string, start long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_end long, gap_reason string"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record and per gap of the files of a manifest; gaps have gap_end and gap_reason."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pa.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{name}", compression=None) as file:
                    salvage, rows = Salvage(file), []
                    for r in salvage:
                        h = r.headers
                        rows.append((name, r.start, page_of(h.get("warc-record-id")), h.get("warc-target-uri"), r.payload_size, r.payload_digest, h.get("warc-type"), page_of(h.get("warc-refers-to")), None, None))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                    rows += [(name, a, None, None, None, None, None, None, b, why) for a, b, why in salvage.gaps]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = manifest.select("file")
    return files.repartition(max(1, files.count())).mapInArrow(read, _ROW)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives written and read back.

    Null html is an empty payload. A null page_id is written as an unknown page; among equal payloads it
    revisits the largest known id, and if none is known all of them do, of an unknown page. Rows that tie
    on the largest id are all responses. An empty table gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    rows = read_archives(write_archives(with_originals(pages), folder), folder)
    return rows.filter("gap_end is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
s as (select d, max(page_id) as original from p where n >= 1000 group by d having count(*) > 1)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest, case when s.d is not null and p.page_id is distinct from s.original then 'revisit' else 'response' end as record_type,
 case when s.d is not null and p.page_id is distinct from s.original then s.original end as refers_to
from p left join s on p.d = s.d and p.n >= 1000
"""
