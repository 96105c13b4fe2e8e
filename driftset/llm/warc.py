"""WARC archives: writing with revisits, and a reader that salvages damage.

Writing: exact-payload groups are found by digest with partial aggregation,
the winner of a group is joined back, and each task writes archives of
bounded size (one gzip member per record) into the shared folder.  A task
reports the files that it finished; only reported files are ever read, so a
retried or speculative task cannot add records twice.

Reading: each file is read piece by piece, records of any length too.  A
member or record that fails a check (gzip CRC, version line, header, length,
block digest) is not the end: the reader searches for the next gzip member or
version line that passes all checks (inside a member, in its decompressed
data), goes on from there, and reports the bytes between as a quarantined gap.

Defined cases: a null html is an empty payload, a null url has no target URI;
a row without page_id is written without a page and never chosen as the
response of a group (a group of such rows alone has responses only); rows
that repeat a page_id with the same payload are all responses if it is the
largest; an empty table gives no archives and no records; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.functions.shared import fresh_path, materialise

ARCHIVE_BYTES = 32 << 20
#: Keys that rows of one payload are dealt to.
SALT = 16
#: Bytes read at a time; a header has no more than HEAD_BYTES.  Blocks may have any length.
PIECE, HEAD_BYTES = 1 << 20, 1 << 24
DATE = "1970-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_HEAD = re.compile(rb"WARC/\d\.\d\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, not compressed."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]+", "%20", url))
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """A record that passed its checks; ``body`` is its payload, if that was asked for."""

    offset: int
    headers: dict[str, str]
    lead: bytes
    size: int
    digest: str
    body: bytes | None

    def payload_bytes(self) -> int:
        if self.headers.get("warc-type") == "revisit":
            m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", self.lead)
            return int(m[1]) if m else 0
        return self.size


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(Exception):
    """A check failed; the text says which."""


class _Raw:
    """The bytes of a seekable file from any place on, piece by piece."""

    def __init__(self, file):
        self.file = file

    def pieces(self, at: int) -> Iterator[bytes]:
        while True:
            self.file.seek(at)
            piece = self.file.read(PIECE)
            if not piece:
                return
            yield piece
            at += len(piece)


class _Member:
    """The data of the gzip member at a place of a file; ``end`` is known once all of it was read."""

    def __init__(self, raw: _Raw, start: int):
        self.raw, self.start, self.end = raw, start, None

    def pieces(self, at: int) -> Iterator[bytes]:
        d, place = zlib.decompressobj(31), self.start
        for piece in self.raw.pieces(self.start):
            place += len(piece)
            while piece and not d.eof:
                sound = d.copy()
                try:
                    outs, piece = [d.decompress(piece, 4 * PIECE)], d.unconsumed_tail
                except zlib.error:
                    outs = self._until_damage(sound, piece)
                for out in outs:
                    if len(out) > at:
                        yield out[at:]
                    at = max(0, at - len(out))
            if d.eof:
                self.end = place - len(d.unused_data)
                return
        raise Damaged("truncated member")

    @staticmethod
    def _until_damage(d, piece: bytes) -> Iterator[bytes]:
        """What comes before the damage in a piece, in small steps."""
        for k in range(0, len(piece), 64):
            try:
                yield d.decompress(piece[k : k + 64])
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from e


class _Reader:
    """Reads a layer forward from a place; holds no more than was asked for and a piece."""

    def __init__(self, layer: _Raw | _Member, at: int):
        self.at, self.buf, self.source = at, b"", layer.pieces(at)

    def need(self, n: int) -> bool:
        parts, have = [self.buf], len(self.buf)
        while have < n and (piece := next(self.source, None)) is not None:
            parts.append(piece)
            have += len(piece)
        if len(parts) > 1:
            self.buf = b"".join(parts)
        return have >= n

    def skip(self, n: int) -> bytes:
        out, self.buf = self.buf[:n], self.buf[n:]
        self.at += len(out)
        return out

    def until(self, token: bytes) -> bytes:
        """Everything up to and with ``token``, which comes within HEAD_BYTES."""
        size = 1 << 12
        while True:
            more = self.need(size)
            end = self.buf.find(token, 0, HEAD_BYTES)
            if end >= 0:
                return self.skip(end + len(token))
            if not more or size >= HEAD_BYTES:
                raise Damaged("header without end")
            size *= 4

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.need(1):
                raise Damaged("block length")
            piece = self.skip(min(n, len(self.buf)))
            n -= len(piece)
            yield piece

    def find(self, pattern: re.Pattern, width: int) -> bool:
        """Goes forward to the next match of a pattern of at most ``width`` bytes."""
        while True:
            self.need(PIECE)
            m = pattern.search(self.buf)
            if m:
                self.skip(m.start())
                return True
            before = len(self.buf)
            self.skip(max(0, before - width + 1))
            if not self.need(len(self.buf) + 1):
                self.skip(len(self.buf))
                return False


def _record(r: _Reader, offset: int, keep: bool) -> Record:
    """The record at the reader's place, in one pass and in bounded memory unless its payload is asked for."""
    head = r.until(b"\r\n\r\n") if r.need(10) and _HEAD.match(r.buf) else b""
    if not head:
        raise Damaged("no version line")
    headers: dict[str, str] = {}
    for line in head[:-4].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    whole, payload = hashlib.sha1(), hashlib.sha1()
    lead, size, kept = (b"" if "http" in headers.get("content-type", "") else None), 0, []
    http = b""
    for piece in r.take(int(headers["content-length"])):
        whole.update(piece)
        if lead is not None:  # the head of the response comes before its payload
            lead += piece
            end = lead.find(b"\r\n\r\n")
            if end < 0 and len(lead) <= HEAD_BYTES:
                continue
            http, piece, lead = (lead[:end], lead[end + 4 :], None) if end >= 0 else (lead, b"", None)
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if b"".join(r.take(4)) != b"\r\n\r\n":
        raise Damaged("block length")
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base64.b32encode(whole.digest()).decode():
        raise Damaged("block digest")
    return Record(offset, headers, http or lead or b"", size, base64.b32encode(payload.digest()).decode(), b"".join(kept) if keep else None)


def _inside(member: _Member, keep: bool) -> Iterator[Record | str]:
    """Sound records of a member, and reasons of what was skipped between them; Damaged if the member itself is."""
    r = _Reader(member, 0)
    while r.need(1):
        at = r.at
        try:
            yield _record(r, member.start, keep)
        except Damaged as e:
            yield str(e)
            r = _Reader(member, at + 1)
            r.find(_HEAD, 10)


def salvage(file, keep: bool = True) -> Iterator[Record | Gap]:
    """Records of a damaged or sound archive (a seekable file), and the gaps between them.

    Records that carry a good block digest are taken from a member even if it
    breaks off later; others only if the whole member is sound.
    """
    raw, pos, gap, reason = _Raw(file), 0, None, ""
    while True:
        r = _Reader(raw, pos)
        if not r.need(1):
            break
        r.need(10)
        wait, inner = [], []
        try:
            if r.buf.startswith(_MAGIC):
                member, any_found = _Member(raw, pos), False
                for x in _inside(member, keep):
                    if isinstance(x, str):
                        inner.append(x)
                    elif x.headers.get("warc-block-digest", "").startswith("sha1:"):
                        if gap is not None:
                            yield Gap(gap, pos, reason)
                            gap = None
                        any_found = True
                        yield x
                    else:
                        wait.append(x)
                if not wait and not any_found:
                    raise Damaged(inner[0] if inner else "empty member")
                end = member.end
            elif _HEAD.match(r.buf):
                wait, end = [_record(r, pos, keep)], r.at
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged as e:
            if gap is None:
                gap, reason = pos, str(e)
            r = _Reader(raw, pos + 1)  # the next place where a member or a record may start
            r.find(_START, 10)
            pos = r.at
            continue
        if gap is not None:
            yield Gap(gap, pos, reason)
            gap = None
        yield from wait
        if inner:
            yield Gap(pos, end, f"inside a member: {inner[0]}")
        pos = end
    if gap is not None:
        yield Gap(gap, pos, reason)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html); the manifest: path, records, bytes.

    Payloads of at least ``min_bytes`` that are equal share one response, that
    of the largest page_id; the others revisit it.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    best = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    # a very common payload is spread over SALT keys, each of which knows its response
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    told = rows.join(best, ["digest", "salt"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        name, out, size, count, done = "", None, 0, 0, []
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(i) for i in range(4))):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                data = z.compress(raw) + z.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((name, count, size))
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{path}/{x[0]}" for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
            names=["path", "records", "bytes"],
        )

    return materialise(told.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


SCHEMA = (
    "archive string, offset bigint, gap_end bigint, gap_reason string, record_id string, record_type string, target_uri string, "
    "page_id bigint, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (``gap_end`` not null) of the archives in ``files.path``."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def number(x: str | None) -> int | None:
        return int(x) if x and x.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as file:
                    for x in salvage(file, with_payload):
                        if isinstance(x, Gap):
                            rows.append((path, x.start, x.end, x.reason, *[None] * 8))
                            continue
                        h = x.headers
                        revisit = h.get("warc-type") == "revisit"
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else x.digest
                        rows.append((
                            path, x.offset, None, None, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), number(h.get("x-page-id")),
                            x.payload_bytes(), digest, number(h.get("x-refers-to-page")), x.body,
                        ))
                        size += len(x.body) if with_payload else 200
                        if size > 4 << 20 or len(rows) >= 4096:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()

    return files.select("path").mapInArrow(run, SCHEMA)


def op8_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    # one archive a row: deal them out evenly before they are read
    files = manifest.repartition(max(1, manifest.count()))
    return read_archives(files, with_payload=False).where("gap_end is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, ((i // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM best AND best IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to FROM m
"""
