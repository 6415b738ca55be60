"""WARC archives: writing, reading back, and reassembly of segmented records.

Writing: each task streams its rows into gzip-per-record archives.  Payloads are
sent as HTTP messages in chunked transfer framing; a block over `segment_bytes`
becomes a first segment and continuation records that carry the origin's
identifier, a segment number and, on the last one, the total length.  Of rows
with equal payloads the one with the smallest id is a response, the others are
revisit records without payload that refer to it.

Reading: archives are streamed record by record.  Whole records are decoded on
the spot; segments are grouped by origin identifier, ordered by segment number,
checked against the total length and decoded from their chunked framing.  Only
records that were split are shuffled, and a group is one record.

Defined results: a null payload is an empty one.  Repeated equal rows give equal
records and are counted, not merged.  A null id is written as "null" and read as
null.  Records that cannot be rebuilt have a null payload and a status of
`missing_segment`, `length_mismatch`, `bad_chunking` or `digest_mismatch`.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written
from .files import AtomicFile, open_input
from .words import settled

READ_SCHEMA = "record_id string, record_type string, origin_id string, segment int, total_bytes long, target_uri string, payload_digest string, refers_to string, copies int, block binary, payload binary, payload_bytes long, status string"
BATCH_BYTES = 4 << 20
#: Payloads that occur again whose digest and first id are broadcast, about 120 bytes each.
MAX_BROADCAST_FIRST = 200_000


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def frame_chunks(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing: hexadecimal length, CRLF, data, CRLF; a chunk of length 0 ends it."""
    out = io.BytesIO()
    for at in range(0, len(payload), chunk_bytes):
        piece = payload[at : at + chunk_bytes]
        out.write(b"%x\r\n" % len(piece))
        out.write(piece)
        out.write(b"\r\n")
    out.write(b"0\r\n\r\n")
    return out.getvalue()


def unframe_chunks(body: bytes) -> bytes | None:
    """The payload, or None if the framing is broken.  Chunk extensions and trailers are skipped."""
    pieces, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";", 1)[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(pieces)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        pieces.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    if b"transfer-encoding: chunked" in head.lower():
        return unframe_chunks(body)
    return body


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _one_line(value: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def record_members(record_id: str, target: str | None, digest: str, payload: bytes, refers_to: str | None, date: str, chunk_bytes: int, segment_bytes: int, level: int) -> Iterator[bytes]:
    """The gzip members of one page: a revisit, a whole response, or a response and its continuations."""
    common = [("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if target is not None:
        common.insert(0, ("WARC-Target-URI", _one_line(target)))
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common]
        yield _member(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", level)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame_chunks(payload, chunk_bytes)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("Content-Type", "application/http; msgtype=response"), *common]
    if len(block) <= segment_bytes:
        yield _member(head, block, level)
        return
    yield _member([*head, ("WARC-Segment-Number", "1")], block[:segment_bytes], level)
    starts = range(segment_bytes, len(block), segment_bytes)
    for number, at in enumerate(starts, 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}/{number}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(number)), *common]
        if number == len(starts) + 1:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _member(more, block[at : at + segment_bytes], level)


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", chunk_bytes: int = 4096, segment_bytes: int = 16384, archive_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """rows(record_id, target_uri, payload_digest, payload, refers_to) -> the manifest (archive, records), already written.

    Only archives of attempts that succeeded are in the manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, file, size, count = [], None, 0, 0
        stem = f"part-{TaskContext.get().partitionId():06d}"
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                record_id, target, digest, payload, refers = row
                if file is None:
                    file, size, count = AtomicFile(folder, stem, ".warc.gz"), 0, 0
                    size += file.stream.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:warcinfo:{file.name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                for member in record_members(record_id, target, digest, payload or b"", refers, date, chunk_bytes, segment_bytes, level):
                    size += file.stream.write(member)
                    count += 1
                if size >= archive_bytes:
                    done.append((file.commit(), count))
                    file = None
        if file is not None:
            done.append((file.commit(), count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return written(rows.select("record_id", "target_uri", "payload_digest", "payload", "refers_to").mapInArrow(settled(write), "archive string, records long"), "warc-manifest")


def iter_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzip-per-record archive; header names in lower case."""
    data = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and last:
                fields[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        yield fields, data.read(int(fields.get("content-length", 0)))


def _verified(block: bytes, digest: str | None) -> tuple[bytes | None, str]:
    payload = http_payload(block)
    if payload is None:
        return None, "bad_chunking"
    if digest and base32_sha1(payload) != digest:
        return None, "digest_mismatch"
    return payload, "ok"


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value is not None else None


def scan_archives(manifest: DataFrame) -> DataFrame:
    """One row per record or segment of the archives (READ_SCHEMA); whole responses are decoded here."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for pdf in batches:
            for uri in pdf["archive"]:
                rows, size = [], 0
                with open_input(uri) as stream:
                    for fields, block in iter_records(stream):
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                        segment = fields.get("warc-segment-number")
                        total = fields.get("warc-segment-total-length")
                        record_id = _bare(fields.get("warc-record-id"))
                        origin = _bare(fields.get("warc-segment-origin-id")) or record_id
                        payload, status = None, "ok"
                        if segment is None and kind == "response":
                            payload, status = _verified(block, digest)
                        rows.append((record_id, kind, origin, int(segment) if segment else None, int(total) if total else None, fields.get("warc-target-uri"), digest, _bare(fields.get("warc-refers-to")), 1, block if segment else None, payload, len(payload) if payload is not None else None, status))
                        size += len(block)
                        if size >= BATCH_BYTES:
                            yield _frame(rows, names)
                            rows, size = [], 0
                yield _frame(rows, names)

    # one archive a task: manifests are small, archives are not; names are distinct, so ranges of them hold one each
    parts = max(1, manifest.count())
    return manifest.repartitionByRange(parts, "archive").mapInPandas(settled(scan), READ_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("segment", "copies"):
        frame[c] = frame[c].astype("Int32")
    for c in ("total_bytes", "payload_bytes"):
        frame[c] = frame[c].astype("Int64")
    return frame


def join_segments(segments: list[dict]) -> tuple[bytes | None, str]:
    """Blocks of one origin, ordered by number, against the length that the last one states."""
    by_number: dict[int, dict] = {}
    for s in segments:
        by_number.setdefault(s["segment"], s)
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        return None, "missing_segment"
    total = by_number[len(by_number)]["total_bytes"]
    if total is None or pd.isna(total):
        return None, "missing_segment"
    block = b"".join(bytes(by_number[i]["block"]) for i in range(1, len(by_number) + 1))
    return (block, "ok") if len(block) == total else (None, "length_mismatch")


def reassemble(records: DataFrame) -> DataFrame:
    """scan_archives' rows -> one row per record, segmented ones rebuilt: READ_SCHEMA without segment columns."""
    columns = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "copies", "payload", "payload_bytes", "status"]
    whole = records.where("segment IS NULL").select(columns)
    # a page that occurs often has its segments as often: one of each is enough, and their number
    once = (
        records.where("segment IS NOT NULL")
        .groupBy("origin_id", "segment")
        .agg(F.count("*").cast("int").alias("copies"), F.max("total_bytes").alias("total_bytes"), F.min("record_type").alias("record_type"), F.min("target_uri").alias("target_uri"), F.min("payload_digest").alias("payload_digest"), F.min("block").alias("block"))
    )
    first = F.col("segment") == 1
    grouped = once.groupBy("origin_id").agg(
        F.max(F.when(first, F.struct("record_type", "target_uri", "payload_digest"))).alias("head"), F.coalesce(F.max(F.when(first, F.col("copies"))), F.lit(0)).alias("copies"), F.collect_list(F.struct("segment", "total_bytes", "block")).alias("segments")
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                head = row["head"] or {}
                block, status = join_segments(row["segments"])
                payload = None
                if block is not None:
                    payload, status = _verified(block, head.get("payload_digest"))
                values = [row["origin_id"], head.get("record_type") or "response", head.get("target_uri"), head.get("payload_digest"), None, max(row["copies"], 1), payload, None if payload is None else len(payload), status]
                types = [pa.string()] * 5 + [pa.int32(), pa.binary(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], columns)

    rebuilt = grouped.mapInArrow(rebuild, "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, copies int, payload binary, payload_bytes long, status string")
    return whole.unionByName(rebuilt)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """The rows to archive: record ids, digests, and for all but the first of equal payloads whom they refer to."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select(F.col("sha1").alias("first_sha1"), "first_id"), "warc-first")
    # payloads are shuffled only where there are too many kinds of repeated ones to broadcast
    linked = rows.join(F.broadcast(first) if first.count() <= MAX_BROADCAST_FIRST else first, F.col("sha1") == F.col("first_sha1"), "left")
    name = lambda c: F.concat(F.lit("urn:lakewarden:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.col("sha1"))
    return linked.select(
        name(F.col("id")).alias("record_id"), "target_uri", F.col("sha1"), "payload",
        F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), name(F.col("first_id"))).alias("refers_to"),
    )


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of a 40-digit hexadecimal SHA-1: each five digits are four symbols."""
    parts = []
    for i in range(8):
        number = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, segment_bytes: int = 16384, **options) -> DataFrame:
    """Write pages as WARC archives in the shared folder, read them back, and give one row per record.

    Columns: record_id, record_type, target_uri, payload_digest, refers_to,
    copies, payload (null for revisits), payload_bytes (of the full payload), status.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    plan = plan_records(pages, id_col, url_col, payload_col, least_bytes).withColumn("payload_digest", base32_of_hex(F.col("sha1")))
    manifest = write_archives(plan, folder, segment_bytes=segment_bytes, **options)
    return reassemble(scan_archives(manifest))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Fill a revisit's payload length from the response it refers to; narrow rows only."""
    facts = records.select("record_id", "record_type", "payload_digest", "refers_to", "copies", "payload_bytes", "status")
    facts = written(facts, "warc-facts")
    origin = facts.where("record_type = 'response'").select(F.col("record_id").alias("o_id"), F.col("payload_bytes").alias("o_bytes")).dropDuplicates(["o_id"])
    revisits = facts.where("record_type = 'revisit'").join(origin, F.col("refers_to") == F.col("o_id"), "left").withColumn("payload_bytes", F.col("o_bytes")).drop("o_id", "o_bytes")
    return facts.where("record_type <> 'revisit'").unionByName(revisits)
