"""WARC records in ZIP packages: written by tasks, read back by ranges without extraction.

A package is a ZIP file with stored members: archive/*.warc.gz, one gzip member per record, and indexes/*.cdxj, one JSON line
per record with its place. The reader finds the end of the central directory (or its ZIP64 form) from the tail of
the file, reads the directory, keeps the stored archive and index members, and reads each record by its own byte range.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a response, the others are
revisits without payload that refer to it. A task writes to a name of its own; only names that arrive in the manifest count, so a task
that runs twice leaves a file that nobody reads.

Defined cases: a null html is an empty payload; a null url has no target header and reads back as null; a null page_id
is larger than any other and reads back as null; of repeated rows with the same page_id one is the response; an empty table
gives no archives and no rows; further columns are ignored; a file that is no ZIP, or a compressed archive member, raises ValueError.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import hot_of_counts, salted_join
from .common import shared_folder, stored

MIN_REVISIT = 100
PACKAGE_BYTES = 16 << 20
# Names and numbers of the WARC and ZIP formats.
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED, FULL16, FULL32 = 0, 0xFFFF, 0xFFFFFFFF


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


# ---- records --------------------------------------------------------------------------------------------

def record(page_id, uid: int, url: str | None, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """The bytes of one record."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if is_revisit else http + payload
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{page_id}:{uid}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()))
    if is_revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return WARC_VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}, rest


def parse_record(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits)."""
    if not data.startswith(WARC_VERSION):
        raise ValueError("no WARC record at this place")
    head, rest = _headers(data)
    block = rest[:int(head["content-length"])]
    http, payload = _headers(block)
    number = lambda s: None if s in ("", "None") else int(s)
    kind, size, digest = head["warc-type"], int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
    refers = None
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload in {head['warc-record-id']}")
    else:
        refers, payload = number(head["warc-refers-to"].strip("<>").split(":")[2]), None
    return {"page_id": number(head["warc-record-id"].strip("<>").split(":")[2]), "url": head.get("warc-target-uri"), "record_type": kind,
            "refers_to": refers, "payload_bytes": size, "payload_digest": digest, "payload": payload}


# ---- writing --------------------------------------------------------------------------------------------

def marked(pages: DataFrame, minimum: int = MIN_REVISIT) -> DataFrame:
    """uid, page_id, url, payload, is_revisit, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = stored(rows, "warc-pages").withColumn("uid", F.monotonically_increasing_id())
    rank = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "uid")
    large = rows.where(F.octet_length("payload") >= minimum)
    first = large.groupBy(F.col("digest").alias("d")).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first, "warc-first")
    # the copies of a hot page are spread over several tasks
    joined = salted_join(rows, first.select(F.col("d").alias("digest"), "first"), "digest", "left", hot_of_counts(first, "d", "n"))
    again = F.col("first").isNotNull() & (F.col("first.uid") != F.col("uid"))
    return joined.select("uid", "page_id", "url", "payload", again.alias("is_revisit"), F.when(again, F.col("first.page_id")).alias("refers_to"))


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes all pages below a folder that all executors share; returns the manifest: path, n_records, n_bytes."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = marked(pages)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        body, index = io.BytesIO(), []

        def close():
            name = f"{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr("archive/data.warc.gz", body.getvalue())
                z.writestr("indexes/index.cdxj", "".join(index))
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([body.tell()], pa.int64())],
                                             names=["path", "n_records", "n_bytes"])
            body.seek(0)
            body.truncate()
            index.clear()
            return row

        for batch in batches:
            for uid, page, url, payload, again, refers in zip(*(c.to_pylist() for c in batch.columns)):
                data = _gzip(record(page, uid, url, payload, refers, again))
                place = {"offset": body.tell(), "length": len(data), "filename": "archive/data.warc.gz"}
                index.append(f"x-page:{page}:{uid} {DATE} {json.dumps(place)}\n")
                body.write(data)
                if body.tell() >= package_bytes:
                    yield close()
        if index:
            yield close()

    # the join that marks revisits has dealt the pages out; each of its tasks writes its own packages
    return stored(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


# ---- reading --------------------------------------------------------------------------------------------

def directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, local header offset, stored size) of each member, from the central directory."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10:at + 20])
    if FULL16 == count or FULL32 in (length, start):
        locator = f.read_at(20, tail_at + at - 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("damaged ZIP64 file: no locator")
        end = f.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        if end[:4] != END64:
            raise ValueError("damaged ZIP64 file: no end record")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    data, at, out = f.read_at(length, start), 0, []
    for _ in range(count):
        if data[at:at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack("<HH", data[at + 8:at + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", data[at + 20:at + 34])
        local, = struct.unpack("<I", data[at + 42:at + 46])
        name = data[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, to = at + 46 + n, at + 46 + n + extra
        while more + 4 <= to:
            kind, size64 = struct.unpack("<HH", data[more:more + 4])
            if kind == 1:  # the full values of those fields that are all ones, in this order
                wide = iter(struct.unpack(f"<{size64 // 8}Q", data[more + 4:more + 4 + size64 // 8 * 8]))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            more += 4 + size64
        out.append((name, method, local, packed))
        at = to + comment
    return out


def member_start(f, local: int) -> int:
    """Where a member's bytes begin: behind its local header."""
    head = f.read_at(30, local)
    if head[:4] != LOCAL:
        raise ValueError("damaged local header")
    n, extra = struct.unpack("<HH", head[26:30])
    return local + 30 + n + extra


def record_ranges(path: str) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of every indexed record."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        members = {name: (method, local, size) for name, method, local, size in directory(f, f.size())}
        for name, (method, local, size) in members.items():
            if not name.startswith("indexes/"):
                continue
            if method != STORED:
                raise ValueError(f"{name} is not stored")
            starts: dict[str, int] = {}
            for line in f.read_at(size, member_start(f, local)).decode().splitlines():
                place = json.loads(line.split(" ", 2)[2])
                archive = place["filename"]
                if archive not in starts:
                    if members[archive][0] != STORED:
                        raise ValueError(f"{archive} is not stored")
                    starts[archive] = member_start(f, members[archive][1])
                yield starts[archive] + place["offset"], place["length"]


def read_archives(manifest: DataFrame, with_payload: bool = True, partitions: int | None = None) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and payload if asked for."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = list(record_ranges(path))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()),
                                                  pa.array([x[1] for x in found], pa.int64())], names=["path", "offset", "length"])

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
              ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, open_path = None, None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != open_path:
                    if f:
                        f.close()
                    system, at = opened(path)
                    f, open_path = system.open_input_file(at), path
                rows.append(parse_record(zlib.decompress(f.read_at(length, offset), 31)))
                held += rows[-1]["payload_bytes"] if with_payload else 0
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
        if f:
            f.close()

    # the records of a package are dealt out by ranges of their place, so a task reads neighbours
    places = manifest.select("path").mapInArrow(ranges, "path string, offset long, length long")
    n = partitions or 4 * manifest.sparkSession.sparkContext.defaultParallelism
    places = places.repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    return places.mapInArrow(read, schema + ", payload binary" * with_payload)
