"""Token-ID output: files of bit- or byte-plane-shuffled, zstandard-compressed id blocks with a chunk index.

A file holds consecutive documents:

    magic | planes of block 0 | planes of block 1 | ... | footer | length of the footer (8 bytes) | magic

Each block of ``BLOCK`` ids is transposed into planes (all first bytes, all second bytes, ...; or bit by bit) and each
plane is a zstandard frame; planes of zeros are left out.  The footer is a zstandard frame of JSON lengths and arrays:
the chunk index (place and ids of each block, length of each plane) and the documents (doc_id, number of ids).

Defined cases: a null text is empty and yields the end id alone; rows with equal doc_id follow one another in the order
of their texts; a null doc_id sorts first; no documents, no files.  Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import saved, shared_dir, strings
from doclake.llm.tokens import tokenizer

MAGIC = b"DLBP0001"
BLOCK = 1 << 16
LEVEL = 3


def shuffle(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, least significant first; without the zero planes at the end."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    planes = np.packbits(np.unpackbits(by_byte, axis=0, bitorder="little").reshape(32, -1), axis=1) if bits else by_byte
    used = np.flatnonzero(planes.any(axis=1))
    return [planes[i].tobytes() for i in range(used[-1] + 1 if len(used) else 0)]


def unshuffle(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    out = np.zeros((4, n), np.uint8)
    if bits:
        one = np.zeros((32, n), np.uint8)
        for i, p in enumerate(planes):
            one[i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        out = np.packbits(one.reshape(4, 8, n), axis=1, bitorder="little").reshape(4, n)
    else:
        for i, p in enumerate(planes):
            out[i] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(out.T).view("<u4").reshape(-1)


class Writer:
    """Writes one file; at most one block and the index are held."""

    def __init__(self, sink, bits: bool = False) -> None:
        self.sink, self.bits, self.squeeze = sink, bits, zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.chunks, self.docs, self.sizes = bytearray(), [], [], []
        self.sink.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held += ids
        full = len(self.held) // (4 * BLOCK)
        for i in range(full):
            self._block(self.held[4 * BLOCK * i : 4 * BLOCK * (i + 1)])
        if full:
            del self.held[: 4 * BLOCK * full]

    def _block(self, raw: bytes | bytearray) -> None:
        planes = [self.squeeze.compress(p) for p in shuffle(np.frombuffer(bytes(raw), "<u4"), self.bits)]
        self.chunks.append([self.at, len(raw) // 4, [len(p) for p in planes]])
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._block(self.held)
        footer = self.squeeze.compress(json.dumps({"bits": self.bits, "chunks": self.chunks, "docs": self.docs, "sizes": self.sizes}).encode())
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


def read_index(source, size: int) -> dict:
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a complete bit-plane file")
    n = int.from_bytes(tail[:8], "little")
    source.seek(size - 16 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))


def read_documents(source, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids) of each document in turn, through the chunk index."""
    index, expand = read_index(source, size), zstandard.ZstdDecompressor()

    def blocks() -> Iterator[np.ndarray]:
        for at, n, lengths in index["chunks"]:
            source.seek(at)
            raw, planes = source.read(sum(lengths)), []
            for length in lengths:
                planes.append(expand.decompress(raw[:length]))
                raw = raw[length:]
            yield unshuffle(planes, n, index["bits"])

    start, left, more = 0, np.zeros(0, "<u4"), blocks()
    for doc_id, n in zip(index["docs"], index["sizes"], strict=True):
        have, parts = len(left), [left]
        while have < n:
            parts.append(next(more))
            have += len(parts[-1])
        left = np.concatenate(parts) if len(parts) > 1 else left
        yield doc_id, start, left[:n]
        left, start = left[n:], start + n


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None, bits: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode ``docs`` into files in ascending ``key`` order; one row per file: shard, path, bytes, docs, ids.

    Rows are dealt out by key ranges, so the files in shard order are the corpus in key order.  A retried task writes
    under another name, and only the names of tasks that ended well are returned.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/doclake-{uuid.uuid4().hex}/ids"
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{task.partitionId():08d}-{task.taskAttemptId()}.ids"
        encode, ids = tokenizer(path), 0
        with store.open_output_stream(name) as sink:
            out = Writer(sink, bits)
            while batch is not None:
                keys, texts = batch.column(0).to_pylist(), strings(batch.column(1))
                for i in range(0, len(texts), 512):
                    for k, e in zip(keys[i : i + 512], encode(texts[i : i + 512]), strict=True):
                        out.add(k, e + end)
                        ids += len(e) // 4 + 1
                batch = next(batches, None)
            out.close()
        row = [[task.partitionId()], [name], [store.get_file_info(name).size], [len(out.docs)], [ids]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["shard", "path", "bytes", "docs", "ids"])

    files = ordered.mapInArrow(run, "shard long, path string, bytes long, docs long, ids long")
    return saved(files, "files").withColumn("folder", F.lit(folder))


def read(files: DataFrame) -> DataFrame:
    """The documents of the files that ``write`` names: doc_id, start, n_tokens, ids_crc32."""
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    placed = files.withColumn("before", F.coalesce(before, F.lit(0)).cast("long"))
    spread = placed.repartition(max(1, min(4096, files.count())), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(r["folder"])
                with store.open_input_file(r["path"]) as source:
                    rows = [(k, r["before"] + s, len(ids), zlib.crc32(ids.tobytes())) for k, s, ids in read_documents(source, r["bytes"])]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
