"""Token ids in files of patched frame-of-reference blocks.

File: b"VPF1", blocks, index, then the index's offset (u64) and b"VPF1" again. All integers are little-endian.
Block: count u16, width u8, minimum u32, exceptions u16; count values, each less the minimum and cut to its low
`width` bits, packed from the lowest bit on; the exceptions' places (u16) and whole differences (u32). The width is
that of the difference at the EXACT_SHARE percentile, so larger ones are exceptions.
Index: u32 block count, their offsets (u64); u32 document count, then for each its id (i64, with a u8 that is 0 for
a null id) and its number of ids (u64).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import Scratch, chunks, claim
from vantor.llm.units import UnitMemory, joinable

MAGIC, BLOCK, EXACT_SHARE = b"VPF1", 4096, 0.97
HEAD = struct.Struct("<HBIH")


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, from the lowest bit on."""
    if width % 8 == 0:
        return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 4), np.uint8)
    if width % 8 == 0:
        out[:, : width // 8] = np.frombuffer(data, np.uint8).reshape(count, width // 8) if width else 0
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
        packed = np.packbits(bits, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.view("<u4").ravel()


def write_block(values: np.ndarray) -> bytes:
    low = int(values.min())
    rest = values.astype(np.uint32) - np.uint32(low)
    width = int(np.partition(rest, k := int((len(rest) - 1) * EXACT_SHARE))[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return b"".join((HEAD.pack(len(values), width, low, len(over)), pack(rest, width), over.astype("<u2").tobytes(), rest[over].astype("<u4").tobytes()))


def read_block(data: bytes) -> np.ndarray:
    count, width, low, over = HEAD.unpack_from(data)
    at = HEAD.size + (count * width + 7) // 8
    out = unpack(data[HEAD.size : at], count, width).copy()
    places = np.frombuffer(data, "<u2", over, at)
    out[places] = np.frombuffer(data, "<u4", over, at + 2 * over)
    return out + np.uint32(low)


class BlockWriter:
    """Writes one file; documents are appended whole and may cross blocks."""

    def __init__(self, out) -> None:
        self.out, self.at, self.blocks, self.docs, self.held, self.n, self.total = out, 0, [], [], [], 0, 0
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        n = len(ids) // 4
        self.docs.append((doc_id, n))
        self.total += n
        self.held.append(ids)
        self.n += n
        if self.n >= 16 * BLOCK:
            self.flush()

    def flush(self, end: bool = False) -> None:
        values = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(values) if end else len(values) - len(values) % BLOCK
        for i in range(0, stop, BLOCK):
            self.blocks.append(self.at)
            self.put(write_block(values[i : min(i + BLOCK, stop)]))
        self.held, self.n = [values[stop:].tobytes()], len(values) - stop

    def close(self) -> None:
        self.flush(end=True)
        index = self.at
        self.put(struct.pack("<I", len(self.blocks)) + np.array(self.blocks, "<u8").tobytes())
        self.put(struct.pack("<I", len(self.docs)) + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + bytes(d is not None for d, _ in self.docs) + np.array([n for _, n in self.docs], "<u8").tobytes())
        self.put(struct.pack("<Q", index) + MAGIC)


class BlockReader:
    """Reads one file; any document or range of ids is found through the index."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        tail = file.read_at(12, size - 12)
        if tail[8:] != MAGIC or file.read_at(4, 0) != MAGIC:
            raise ValueError("not a file of patched blocks")
        self.index = struct.unpack("<Q", tail[:8])[0]
        data = file.read_at(size - 12 - self.index, self.index)
        blocks = struct.unpack_from("<I", data)[0]
        self.blocks = [*np.frombuffer(data, "<u8", blocks, 4).tolist(), self.index]
        at = 8 + 8 * blocks
        docs = struct.unpack_from("<I", data, at - 4)[0]
        ids, known, self.sizes = np.frombuffer(data, "<i8", docs, at).tolist(), data[at + 8 * docs : at + 9 * docs], np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.ids = [i if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, i: int) -> np.ndarray:
        if self.kept[0] != i:
            self.kept = i, read_block(self.file.read_at(self.blocks[i + 1] - self.blocks[i], self.blocks[i]))
        return self.kept[1]

    def doc(self, i: int) -> np.ndarray:
        start, stop = int(self.starts[i]), int(self.starts[i] + self.sizes[i])
        parts = [self.block(b)[max(0, start - b * BLOCK) : stop - b * BLOCK] for b in range(start // BLOCK, -(-stop // BLOCK))] if stop > start else []
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class LibraryEncoder:
    """The tokenizers library's ids. Distinct units are encoded many in one call.

    Units join to texts that the library cuts at the same places, and byte-level tokens hold all bytes of their text,
    so the tokens' lengths in bytes give back which unit each belongs to.
    """

    TEXT, CALL, MOST = 256, 20_000, 1_000_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        sizes = {i: len(t) for t, i in self.library.get_vocab(with_added_tokens=False).items()}  # a letter for each byte
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        self.memory = UnitMemory(self.encode_units, self.MOST)

    def encode_units(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        spaced, lines, words, rest = joinable(units)
        for places, gap in ((spaced, 0), (lines, 0), (words, 1)):
            for i in range(0, len(places), self.CALL):
                some = places[i : i + self.CALL]
                for at, ids in zip(some, self._encode_joined([units[j] for j in some], gap), strict=True):
                    out[at] = ids
        for at in rest:
            out[at] = np.array(self.library.encode(units[at], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _encode_joined(self, units: list[str], gap: int) -> list[bytes]:
        """Ids of units that may stand one behind the other, with a line feed before each if gap is 1."""
        texts = ["\n" * gap + ("\n" * gap).join(units[i : i + self.TEXT]) for i in range(0, len(units), self.TEXT)]
        ids = np.array(list(chain.from_iterable([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])), "<u4")
        ends = np.append(0, np.cumsum(self.sizes[ids]))
        sizes = np.array([len(u.encode()) for u in units]) + gap
        stops = np.cumsum(sizes)
        first, last = 4 * np.searchsorted(ends, stops - sizes + gap), 4 * np.searchsorted(ends, stops)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        alone = [any(a in t for a in self.added) for t in texts]
        shared = iter(self.memory.joined([t for t, x in zip(texts, alone, strict=True) if not x]))
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if x else next(shared) for t, x in zip(texts, alone, strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> LibraryEncoder:
    """One for each Python worker."""
    return LibraryEncoder(path)


def encoder(path: str) -> LibraryEncoder:
    claim("pfor", _encoder.cache_clear)
    return _encoder(path)


def write_token_files(space: Scratch, docs: DataFrame, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, path, n_docs, n_ids): one file for each range of doc_id, ranges and rows in ascending order (nulls first).

    The one shuffle deals whole texts by range of doc_id. A file is named for its task attempt, and the returned
    table, itself written out, names only those of attempts that succeeded.
    """
    folder, end = space.folder("ids"), struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        at = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}.vpf"
        with store.open_output_stream(at) as out:
            writer = BlockWriter(out)
            for batch in chunks(batches, "text"):
                ids = encoder(path).encode([t or "" for t in batch.column("text").to_pylist()])
                for doc, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    writer.add(doc, x + end)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [at], "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    parts = int(space.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return space.table(dealt.mapInArrow(run, "part long, path string, n_docs long, n_ids long"))


def read_token_files(space: Scratch, files: DataFrame) -> DataFrame:
    """(doc_id, start, ids): each document's ids as little-endian 32-bit integers, and how many ids stand before it in all files.

    The driver adds up one row for each file, as many as there were tasks.
    """
    listed, before = [], 0
    for x in sorted(files.collect(), key=lambda x: x.part):
        listed.append((x.path, before))
        before += x.n_ids
    folder = space.folder("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    reader, held, size = BlockReader(file), [], 0
                    for i, doc in enumerate(reader.ids):
                        held.append((doc, first + int(reader.starts[i]), x := reader.doc(i).astype("<u4").tobytes()))
                        size += len(x)
                        if size > 8 << 20 or i + 1 == len(reader.ids):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "ids"])
                            held, size = [], 0

    rows = space.spark.createDataFrame(listed, "path string, before long").repartition(max(1, len(listed)))
    return rows.mapInArrow(run, "doc_id long, start long, ids binary")



def token_file_digests(space: Scratch, docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of the query, from ids that were read back from the files. Spark's crc32 is the unsigned one."""
    return read_token_files(space, write_token_files(space, docs, path)).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
