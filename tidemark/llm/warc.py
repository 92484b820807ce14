"""WARC records in seekable Zstandard bundles.

Each bundle is a ``.warc.zst`` file of independent frames; a frame holds
consecutive whole records up to ``frame_bytes``. A skippable frame at the end
is the seek table (compressed and uncompressed size of each frame, in the
public seekable format), so a reader decodes only the frames it needs. The
index table maps each record id to its file, frame and place inside the frame.

Equal payloads of at least ``min_revisit_bytes`` are stored once, by the record
with the largest id; the others are ``revisit`` records that name it.

Bundles are written to a folder that all executors share, under a name of the
attempt, and only files named in the index count: a lost executor's files are
left out by its repeated task. Any file system known to Arrow will do.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path, shared_folder, written

SEEKABLE_MAGIC = 0x8F92EAB1
SKIPPABLE = 0x184D2A5E
INDEX = "id bigint, file string, frame int, frame_at bigint, frame_bytes bigint, at bigint, bytes bigint"
RECORD = ("id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest, from its hexadecimal form."""
    hexa = F.sha1(payload)
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    # 40 bits are ten hexadecimal and eight base32 digits.
    groups = [F.conv(F.substring(hexa, 1 + 10 * g, 10), 16, 10).cast("bigint") for g in range(4)]
    return F.concat(*(F.substring(alphabet, F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
                      for v in groups for i in range(8)))


def record_bytes(id_: int | None, url: str | None, digest: str, payload: bytes | None, length: int, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has no block and names the record that has the payload."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    clean = "".join(c for c in url or "" if c >= " ")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{'none' if id_ is None else id_}>", f"WARC-Target-URI: {clean}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:record:{refers_to}>")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record at the start of ``data``; digest and length of a response come from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    named = lambda key: fields[key].rpartition(":")[2].rstrip(">")
    id_ = named("WARC-Record-ID")
    if fields["WARC-Type"] == "response":
        payload = rest[:int(fields["Content-Length"])]
        digest, size, refers = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), None
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not have its digest")
    else:
        payload, refers = None, int(named("WARC-Refers-To"))
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    return {"id": None if id_ == "none" else int(id_), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": refers, "payload": payload}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: one entry a frame, then count, descriptor and magic number."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Frame sizes from the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    start = len(tail) - 9 - 8 * count
    return [struct.unpack_from("<II", tail, start + 8 * i) for i in range(count)]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BundleWriter:
    """Adds records to frames and frames to one bundle."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        self.system, root = file_system(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.sink = self.system.open_output_stream(f"{root}/{self.name}", compression=None)
        self.coder, self.limit = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.at, self.parts, self.size, self.waiting = 0, [], 0, []

    def add(self, id_: int, record: bytes) -> list[tuple]:
        """Index rows of the frame that this record completed."""
        self.waiting.append((id_, self.size, len(record)))
        self.parts.append(record)
        self.size += len(record)
        return self.flush() if self.size >= self.limit else []

    def flush(self) -> list[tuple]:
        if not self.parts:
            return []
        data = self.coder.compress(b"".join(self.parts))
        self.sink.write(data)
        rows = [(i, self.name, len(self.frames), self.at, len(data), at, n) for i, at, n in self.waiting]
        self.frames.append((len(data), self.size))
        self.at += len(data)
        self.parts, self.size, self.waiting = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        self.sink.write(seek_table(self.frames))
        self.sink.close()
        return rows


_INDEX_TYPE = pa.schema([("id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()),
                         ("frame_bytes", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64())])
_RECORD_TYPE = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                          ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def plan_records(pages: DataFrame, key: str, url: str, html: str, min_revisit_bytes: int = 0) -> DataFrame:
    """``id, url, payload, payload_bytes, payload_digest, refers_to``; null html is an empty payload.

    Rows that repeat an id are written once each; the one response of a payload
    may then stand several times under the same id. Rows without an id are
    written too; none can refer to them, so where no row of a payload has an id
    all of them are responses, and else they revisit the one with the largest.
    """
    rows = pages.select(
        F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    digest, size = base32_sha1(F.col("payload").cast("binary")), F.octet_length("payload").cast("bigint")
    narrow = rows.select("id", digest.alias("payload_digest"), size.alias("payload_bytes"))
    keeper = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    keeper = keeper.filter((F.col("copies") > 1) & (F.col("payload_bytes") >= min_revisit_bytes)).drop("copies")
    full = rows.select("*", digest.alias("payload_digest"), size.alias("payload_bytes"))
    return full.join(keeper, ["payload_digest", "payload_bytes"], "left").select(
        "id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(~F.col("keeper").eqNullSafe(F.col("id")), F.col("keeper")).alias("refers_to"))


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write the rows of ``plan_records`` as bundles under ``folder``; returns the index, written beside them."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, made = None, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload_digest", "payload", "payload_bytes", "refers_to"))):
                bundle = bundle or BundleWriter(folder, frame_bytes, level)
                made += bundle.add(r[0], record_bytes(r[0], r[1], r[2], r[3].encode("utf-8"), r[4], r[5]))
                if bundle.at >= bundle_bytes:
                    made += bundle.close()
                    bundle = None
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), _INDEX_TYPE)], schema=_INDEX_TYPE)
                made = []
        if bundle is not None and (made := bundle.close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), _INDEX_TYPE)], schema=_INDEX_TYPE)

    return written(records.mapInArrow(pack, INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str, payload: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """The records behind index rows, decoded frame by frame through the bundles.

    Rows of one frame are read together, so any part of the index can be given.
    The index is small, what it names is not: a task gets about ``task_bytes`` of records.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        coder, name, source = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for file, at, size, entries in zip(*(batch.column(c).to_pylist() for c in ("file", "frame_at", "frame_bytes", "entries"))):
                if file != name:
                    name, source = file, system.open_input_file(f"{root}/{file}")
                source.seek(at)
                frame = coder.decompress(source.read(size))
                rows = [parse_record(frame[e["at"]:e["at"] + e["bytes"]]) for e in entries]
                if not payload:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_TYPE)

    tasks = 1 + (index.agg(F.sum("bytes")).first()[0] or 0) // task_bytes
    frames = index.repartition(tasks, "file", "frame").groupBy("file", "frame", "frame_at", "frame_bytes").agg(F.collect_list(F.struct("at", "bytes")).alias("entries"))
    return frames.mapInArrow(unpack, RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    path = scratch_path(spark, "warc")
    return path if ":" in shared_folder(spark).split("/")[0] else f"file://{path}"
