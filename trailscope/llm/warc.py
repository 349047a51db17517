"""WARC records in seekable Zstandard bundles.

Each page becomes a WARC record. Records of a task are packed into frames that decompress on their own; a bundle is a run of
frames closed by a seek table (a skippable frame with the sizes of all frames, read from the end), so any
Zstandard tool can read it from front to back and a reader can jump to one frame. The index maps a record to its bundle, frame and
the offset within the decompressed frame.

Pages with equal payloads are stored once: the page with the largest id holds the payload (``response``), the others are
``revisit`` records that refer to it. Payload groups are counted by digest with partial sums and joined back in
``SALTS`` slices, so one payload that many pages share spreads over tasks. Bundles are written under a temporary name and moved when complete, so a task that runs again replaces
its own files; the index (stored) lists only completed ones. Both go to a shared folder.

Results: null html is an empty payload; a null url is written as ``urn:unknown``; rows repeated with the same id and payload are all
responses or all revisits; a null id can be a response, never referred to unless the whole group has none (then all are responses);
an empty table gives an empty index and no bundle. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.llm.common import slices, step_path, store

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
SALTS = 32
WARC_DATE = "2024-01-01T00:00:00Z"
#: Fixed by the formats: skippable frame magic, seek table magic, revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, offset int, length int"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header of the full payload and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields, HTTP fields and payload of one record; raises ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError("payload does not match its digest")
    number = lambda urn: None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def file_system(path: str):
    """The file system of a path or URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else path)


class BundleReader:
    """Random access to the frames of one bundle through its seek table."""

    def __init__(self, path: str):
        files, name = file_system(path)
        self.file = files.open_input_file(name)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {path}")
        table = self._at(end - 9 - 8 * count, 8 * count)
        self.frames, at = [], 0
        for compressed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, compressed, size))
            at += compressed

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def frame(self, k: int) -> bytes:
        import zstandard

        at, compressed, size = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self._at(at, compressed), max_output_size=size)


class _BundleWriter:
    """Frames of one task: one open bundle at a time, index rows out."""

    def __init__(self, folder: str, part: int, attempt: int, level: int):
        import zstandard

        self.folder, self.part, self.attempt, self.level = folder, part, attempt, level
        self.packer = zstandard.ZstdCompressor(level=level)
        self.number, self.file, self.frames, self.written = -1, None, [], 0
        self.buffer, self.rows = bytearray(), []

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.file is None:
            self.number += 1
            # Named by attempt: a late or repeated attempt never replaces a bundle that the other attempt's index rows point into.
            self.name = f"part-{self.part:06d}-{self.attempt:08d}-{self.number:04d}.warc.zst"
            self.files, self.folder_path = file_system(self.folder)
            self.files.create_dir(self.folder_path, recursive=True)
            self.temporary = f"{self.folder_path}/.{self.name}-{self.attempt}"
            self.file, self.frames, self.written = self.files.open_output_stream(self.temporary, compression=None), [], 0
        self.rows.append((page_id, f"{self.folder}/{self.name}", len(self.frames), len(self.buffer), len(raw)))
        self.buffer += raw
        if len(self.buffer) >= FRAME_BYTES:
            self.flush()
            if self.written >= BUNDLE_BYTES:
                self.close()

    def flush(self) -> None:
        if self.buffer:
            packed = self.packer.compress(bytes(self.buffer))
            self.file.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.written += len(packed)
            self.buffer = bytearray()

    def close(self) -> None:
        if self.file is not None:
            self.flush()
            self.file.write(seek_table(self.frames))
            self.file.close()
            self.files.move(self.temporary, f"{self.folder_path}/{self.name}")
            self.file = None

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "bundle", "frame", "offset", "length"])


def with_referrals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) with ``refers_to``: the page that holds the same payload, null where the page holds its own."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.when(F.octet_length(html) >= min_bytes, F.sha1(html.cast("binary"))).alias("sha"))
    shared = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1 AND holder IS NOT NULL")
    shared = store(shared.select(F.col("sha").alias("s_sha"), "holder"), "warc-shared").withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(shared, F.expr("sha = s_sha AND salt = s_salt"), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write all pages below ``folder`` (shared by all executors) and return the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out = _BundleWriter(folder, task.partitionId(), task.taskAttemptId(), level)
        for batch in slices(batches):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out.add(page_id, record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
            yield out.batch()
        out.close()

    return store(with_referrals(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """Read the indexed records from their bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits)."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def run(batches):
        path, reader, number, frame = None, None, None, b""
        for batch in batches:
            out = []
            for _, bundle, k, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != path:
                    path, reader, number = bundle, BundleReader(bundle), None
                if k != number:
                    number, frame = k, reader.frame(k)
                record = parse_record(frame[offset : offset + length])
                if record["record_type"] == "revisit":
                    record["payload"] = None
                out.append(record)
            names = [f.split()[0] for f in fields.split(", ")]
            kinds = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds.get(n, pa.int64())) for n in names], names)

    ordered = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.select("page_id", "bundle", "frame", "offset", "length").mapInArrow(run, fields)


def archive_folder(pages: DataFrame) -> str:
    return step_path(pages.sparkSession, "warc")
