"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with some whole records, and a seek table in a skippable
frame at its end (the public seekable format: for each frame its compressed and decompressed size). Readers without
that format just see a stream of frames. An index row for each record has its bundle, frame, and place in the
decompressed frame, so one record costs one seek and one frame.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import Scratch, bounded, chunks

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

#: Decompressed bytes after which a frame is closed; a longer record has a frame of its own.
FRAME_BYTES = 1 << 20
#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: int | None, digest: str, place: str = "") -> str:
    """The id of a record: its page and payload, and its place for a page without an id. Rows equal in both are one record, written again."""
    return f"<urn:page:none:{digest}:{place}>" if key is None else f"<urn:page:{key}:{digest}>"


def key_of(record: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?\d+):[^>]*>", record)
    if not found:
        raise ValueError(f"not an id of this writer: {record}")
    return None if found[1] == "none" else int(found[1])


def write_record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, place: str = "") -> bytes:
    """A response with the payload, or a revisit that names the response's record instead. Blanks and control characters of a URL are percent-encoded."""
    revisit = refers_to is not None
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(key, digest, place), "WARC-Date": date}
    if url:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    head["WARC-Payload-Digest"] = f"sha256:{digest}"
    if revisit:
        head |= {"WARC-Refers-To": record_id(refers_to, digest), "WARC-Profile": PROFILE, "X-Payload-Length": str(len(payload))}
    body = b"" if revisit else payload
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + body + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines)
    n = int(head["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("a damaged WARC record")
    return head, rest[:n]


class BundleWriter:
    """Appends records; add() tells (frame, offset in the decompressed frame, length)."""

    def __init__(self, out) -> None:
        self.out, self.frames, self.held, self.size, self.count = out, [], [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.size and self.size + len(record) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), self.size, len(record)
        self.held.append(record)
        self.size += len(record)
        self.count += 1
        return place

    def flush(self) -> None:
        if self.held:
            data = self.zstd.compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads records by frame and place; the last frame stays decompressed."""

    def __init__(self, file) -> None:
        self.file, size, self.zstd, self.kept = file, file.size(), zstandard.ZstdDecompressor(), (-1, b"")
        count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE or flags & 0x7C:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8  # with or without checksums
        start = size - 9 - count * entry
        table = file.read_at(count * entry, start)
        if struct.unpack("<II", file.read_at(8, start - 8)) != (SKIPPABLE, count * entry + 9):
            raise ValueError("a damaged seek table")
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        if self.kept[0] != i:
            at, packed, plain = self.frames[i]
            self.kept = i, self.zstd.decompress(self.file.read_at(packed, at), max_output_size=plain)
        return self.kept[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def write_archives(space: Scratch, pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, path, frame, offset, length): a record for each row, in one bundle for each task.

    Of payloads equal in at least REVISIT_BYTES bytes, rows with the smallest id are responses and the others
    revisits of it. Null payloads are empty; a row with a null id is a response and nobody's. Only digests are
    grouped, with partial sums first; pages move only if repeated digests are too many to broadcast, and Spark then
    splits partitions of a hot digest. Bundles are named for the task attempt; the returned index, itself written
    out, names only those of attempts that succeeded.
    """
    folder = space.folder("warc")
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    plain = plain.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    groups = plain.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= REVISIT_BYTES)).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    typed = plain.join(bounded(space.table(groups)), "digest", "left").withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        at, writer, out = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst", None, None
        for batch in chunks(batches, "payload"):
            if not writer:
                out = store.open_output_stream(at, compression=None)
                writer = BundleWriter(out)
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True)
            places = [writer.add(write_record(key, url, text.encode(), digest, ref, date, f"{at.rsplit('/', 1)[1]}-{writer.count}")) for key, url, text, digest, ref in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([at] * len(places)), *(pa.array(c, pa.int64()) for c in zip(*places, strict=True))], ["page_id", "path", "frame", "offset", "length"])
        if writer:
            writer.close()
            out.close()

    return space.table(typed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "page_id long, path string, frame long, offset long, length long"))


def read_archives(space: Scratch, index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the records that index rows point to.

    A response's size and digest are worked out from its payload, and the digest must be the one in its header.
    """
    folder = space.folder("warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        path, file, reader = None, None, None
        for batch in batches:
            out = []
            for at, *place in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offset", "length")), strict=True):
                if at != path:
                    if file:
                        file.close()
                    path, file = at, store.open_input_file(at)
                    reader = BundleReader(file)
                head, payload = read_record(reader.record(*place))
                digest, refers = head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("WARC-Refers-To")
                if refers is None and sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{head['WARC-Record-ID']} in {at} isn't what its digest says")
                out.append((key_of(head["WARC-Record-ID"]), len(payload) if refers is None else int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers and key_of(refers)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file:
            file.close()

    # a frame's records stay together, so it is read once; frames of one bundle may go to several tasks
    return index.select("path", "frame", "offset", "length").repartition("path", "frame").sortWithinPartitions("path", "frame", "offset").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
