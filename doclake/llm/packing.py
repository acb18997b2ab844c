"""Bounded-space online packing of token ids into windows of fixed length.

Each partition keeps at most ``OPEN`` open windows.  A document first fills whole windows of its own; its rest goes to
the open window that it fits best.  If none fits, the fullest window is emitted: the head of the rest fills its gap,
unless the gap is smaller than ``LEAST_PIECE``, and a new window takes what remains.  The windows that partitions leave
open are merged by the same rule in a reduction tree of ``FAN`` partitions a node; at its root the last ids are cut
into windows without a gap, and the very last into windows whose lengths are powers of two, which need no padding.

Defined cases: a null text is empty and is the end id alone; repeated rows are packed as often as they occur; no rows,
no pieces.  Other columns are not read.  A piece's ids travel only while its window is open.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import saved, strings
from doclake.llm.tokens import tokenizer

WINDOW = 2048
OPEN = 64
LEAST_PIECE = 16
FAN = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]


class Packer:
    """Pieces are (doc_id, start, ids as bytes, tokens of the document)."""

    def __init__(self, first_id: int, window: int = WINDOW, spaces: int = OPEN) -> None:
        self.window, self.spaces, self.next_id = window, spaces, first_id
        self.open: list[list[tuple]] = []
        self.fill: list[int] = []
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, zlib.crc32(ids), tokens, self.next_id, offset, None))
            offset += n
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, ids: bytes, tokens: int) -> None:
        size = 4 * self.window
        while len(ids) >= size:
            self.emit([(doc_id, start, ids[:size], tokens)])
            ids, start = ids[size:], start + self.window
        n = len(ids) // 4
        if not n:
            return
        room = self.window - n
        best = max((i for i, f in enumerate(self.fill) if f <= room), key=self.fill.__getitem__, default=None)
        if best is None and len(self.open) >= self.spaces:
            full = max(range(len(self.fill)), key=self.fill.__getitem__)
            pieces, gap = self.open.pop(full), self.window - self.fill.pop(full)
            if gap >= LEAST_PIECE:
                pieces.append((doc_id, start, ids[: 4 * gap], tokens))
                ids, start, n = ids[4 * gap :], start + gap, n - gap
            self.emit(pieces)
        if best is None:
            self.open.append([])
            self.fill.append(0)
            best = -1
        self.open[best].append((doc_id, start, ids, tokens))
        self.fill[best] += n
        if self.fill[best] == self.window:
            self.emit(self.open.pop(best))
            self.fill.pop(best)

    def finish(self) -> None:
        """Cut what is open into full windows, and the rest into powers of two."""
        order = sorted(range(len(self.open)), key=lambda i: -self.fill[i])
        pieces = [p for i in order for p in self.open[i]]
        left, self.open, self.fill = sum(len(p[2]) for p in pieces) // 4, [], []
        target = lambda: self.window if left >= self.window else 1 << (left.bit_length() - 1)
        now, room = [], target() if left else 0
        for doc_id, start, ids, tokens in pieces:
            while ids:
                n = min(room, len(ids) // 4)
                now.append((doc_id, start, ids[: 4 * n], tokens))
                ids, start, room = ids[4 * n :], start + n, room - n
                if not room:
                    left -= sum(len(p[2]) for p in now) // 4
                    self.emit(now)
                    now, room = [], target() if left else 0

    def rows(self) -> pa.RecordBatch:
        """All that was emitted since the last call."""
        out, self.done = self.done, []
        return _batch(out)

    def leftovers(self) -> pa.RecordBatch:
        """The pieces of open windows; their ids travel with them."""
        return _batch([(d, s, len(ids) // 4, 0, t, -1 - w, 0, ids) for w, pieces in enumerate(self.open) for d, s, ids, t in pieces])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(COLUMNS)
    kinds = [pa.int64()] * (len(COLUMNS) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], COLUMNS)


def _merge(depth: int, last: bool, window: int, spaces: int) -> Callable[[pa.Table], pa.Table]:
    """The packer of one node of the tree: at most FAN * spaces open windows come in."""

    def merge(group: pa.Table) -> pa.Table:
        node = group.column("offset")[0].as_py() // FAN
        packer = Packer((depth << 56) + (node << 28), window, spaces)
        for r in sorted(group.to_pylist(), key=lambda r: (r["offset"], -r["sequence_id"], r["doc_id"] or 0, r["start"], r["length"])):
            packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        if last:
            packer.finish()
        left = packer.leftovers()
        return pa.Table.from_batches([packer.rows(), left.set_column(6, "offset", pa.array([node] * len(left), pa.int64()))])

    return merge


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, spaces: int = OPEN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, encode = Packer(part << 32, window, spaces), tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for i in range(0, len(texts), 512):
                for k, e in zip(keys[i : i + 512], encode(texts[i : i + 512]), strict=True):
                    packer.add(k, 0, e + end, len(e) // 4 + 1)
                yield packer.rows()
        left = packer.leftovers()
        yield left.set_column(6, "offset", pa.array([part] * len(left), pa.int64()))

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    level = saved(rows.mapInArrow(first, PIECE), "pieces")
    done = [level.where("ids is null")]
    parts = 1 + (level.where("ids is not null").agg(F.max("offset")).first()[0] or 0)  # a leftover's offset holds the node that it comes from
    depth = 0
    while True:
        parts, depth = -(-parts // FAN), depth + 1
        last = parts == 1
        left = level.where("ids is not null")
        level = saved(left.groupBy(F.floor(F.col("offset") / FAN)).applyInArrow(_merge(depth, last, window, spaces), PIECE), "pieces")
        done.append(level.where("ids is null"))
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("ids")
