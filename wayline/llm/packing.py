"""Bounded-space online packing of documents into windows of tokens.

Each partition keeps a fixed number of open windows. A document's whole windows are sequences of their own; the rest
goes into the open window that it fits best. Where none has room, the fullest takes just what fills it and is emitted. What is
left open in each partition is merged in rounds of ``FAN`` partitions by the same rule, until one group is left; its last
tokens are cut into powers of two. So no sequence needs padding, and no task holds more than FAN * OPEN windows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteModel, ChunkTable, chunk_starts, text_slices, tokenizer_path
from .common import cut

WINDOW = 2048
END = 1
OPEN = 64  # windows
FAN = 64  # partitions
BATCH = 4096  # pieces

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("left_ids", pa.binary())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, left_ids binary"


class IdChunks(ChunkTable):
    """The ids of chunks; special strings are chunks of their own with one id."""

    def __init__(self, model: ByteModel):
        super().__init__([np.int32])
        self.model = model
        self.special = {k.encode(): i for k, i in model.special.items()}
        self.finds = re.compile(b"|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True)) or b"(?!)")

    def learn(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        plain = [c for c in chunks if c not in self.special]
        ids, n = self.model.encode_chunks(plain)
        if len(plain) < len(chunks):
            own = np.array([self.special.get(c, -1) for c in chunks])
            size = np.ones(len(chunks), np.int64)
            size[own < 0] = n
            all_ids = np.empty(size.sum(), np.int64)
            first = np.cumsum(size) - size
            mine = np.zeros(len(all_ids), bool)
            mine[first[own >= 0]] = True
            all_ids[mine], all_ids[~mine] = own[own >= 0], ids
            ids, n = all_ids, size
        return [(ids, n)]

    def encoded(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie end to end, and where each text's begin and the last's end."""
        borders, raw = [ends[:-1]], data.tobytes()
        if self.special and self.finds.search(raw):
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
                borders += [np.array([a + m.start(), a + m.end()]) for m in self.finds.finditer(raw[a:z]) if m.end() > m.start()]
        begin = chunk_starts(data, np.concatenate(borders))
        numbers = self.numbers(data, begin)
        size = np.r_[0, np.cumsum(self.lengths(1, numbers))]
        return self.gathered(1, numbers), size[np.searchsorted(begin, ends)]


@lru_cache(maxsize=1)
def chunks_of(path: str) -> IdChunks:
    """Kept by a Python worker from task to task."""
    return IdChunks(ByteModel(path))


class Packer:
    """A fixed number of open windows. A piece is (doc_id, start, ids, doc_tokens); ``out`` gets those of closed windows."""

    def __init__(self, window: int, opened: int, first_id: int):
        self.window, self.next, self.out = window, first_id, []
        self.held: list[list[tuple]] = [[] for _ in range(opened)]
        self.order = [(window, k) for k in range(opened)]  # free places and number, fullest first

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), ids.tobytes(), total, self.next, offset, None, None))
            offset += len(ids)
        self.next += 1

    def put(self, at: int, piece: tuple) -> None:
        free, k = self.order.pop(at)
        self.held[k].append(piece)
        free -= len(piece[2])
        if not free:
            self.emit(self.held[k])
            self.held[k], free = [], self.window
        insort(self.order, (free, k))

    def place(self, piece: tuple) -> None:
        while (at := bisect_left(self.order, (len(piece[2]), -1))) == len(self.order):
            doc, start, ids, total = piece
            gap = self.order[0][0]
            self.put(0, (doc, start, ids[:gap], total))
            piece = (doc, start + gap, ids[gap:], total)
        self.put(at, piece)

    def document(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self.emit([(doc, at, ids[at : at + self.window], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:].copy(), len(ids)))

    def left(self, part: int) -> list[tuple]:
        """The rows of windows that are still open."""
        return [(doc, start, len(ids), None, total, k, None, part, ids.tobytes()) for k, pieces in enumerate(self.held) for doc, start, ids, total in pieces]

    def finish(self) -> None:
        """Closes all windows: their pieces go into whole windows and a last rest into sequences of powers of two."""
        pieces, total = [p for held in self.held for p in held], sum(self.window - free for free, _ in self.order)
        sizes = [self.window] * (total // self.window) + [1 << b for b in reversed(range(self.window.bit_length())) if total % self.window >> b & 1]
        pieces.reverse()
        for size in sizes:
            own = []
            while size:
                doc, start, ids, n = pieces.pop()
                if len(ids) > size:
                    pieces.append((doc, start + size, ids[size:], n))
                own.append((doc, start, ids[:size], n))
                size -= len(own[-1][2])
            self.emit(own)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)] if rows else [pa.array([], f.type) for f in SCHEMA], schema=SCHEMA)


def pack(docs: DataFrame, window: int = WINDOW, end: int | None = END, opened: int = OPEN, fan: int = FAN, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row per piece of a document.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. A document is its text's ids, special strings
    inside as their id, and then ``end`` (none if None). A null text counts as empty: it has the end alone; without an end it has no piece.
    Sequences hold ``window`` ids; the last few of the whole table hold smaller powers of two. ``window`` must be a
    power of two. Null and repeated ids keep their rows, each row is a document. Windows with equal room: the one with the lowest number is
    taken. A very long text is cut into windows whole. An empty table gives no rows; other columns of ``docs`` aren't read.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = chunks_of(path), TaskContext.get().partitionId()
        packer = Packer(window, opened, part << 32)
        for rows, data, ends in text_slices(batches, 1):
            ids, edges = chunks.encoded(data, ends)
            if end is not None:
                ids, edges = np.insert(ids, edges[1:], end), edges + np.arange(len(edges))
            ids = ids.astype("<u4")
            for doc, a, z in zip(rows.column(0).to_pylist(), edges.tolist(), edges[1:].tolist()):
                packer.document(doc, ids[a:z])
                if len(packer.out) >= BATCH:
                    yield batch(packer.out)
                    packer.out = []
        yield batch(packer.out + packer.left(part))

    packed = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DDL), "packed")
    done, turn = packed.where("part is null"), 0
    parts = packed.agg(F.max("part").alias("most")).first()["most"]
    while parts is not None:
        turn += 1
        last = parts < fan

        def merge(group: pa.Table, turn: int = turn, last: bool = last) -> pa.Table:
            own = group.column("part")[0].as_py() // fan
            packer = Packer(window, opened, turn << 58 | own << 32)
            rows = list(zip(*[group.column(c).to_pylist() for c in ("part", "sequence_id", "start", "length", "doc_id", "left_ids", "doc_tokens")]))
            for _, _, start, _, doc, ids, total in sorted(rows, key=lambda r: (-r[3], *r[:3], r[4] is None, r[4] or 0)):
                packer.place((doc, start, np.frombuffer(ids, "<u4"), total))
            if last:
                packer.finish()
            return pa.Table.from_batches([batch(packer.out + ([] if last else packer.left(own)))])

        left = packed.where("part is not null").drop("ids").withColumn("own", F.floor(F.col("part") / fan))
        packed = cut(left.groupBy("own").applyInArrow(lambda g: merge(g.drop_columns(["own"])), DDL), "merged")
        done = done.unionByName(packed.where("part is null"))
        parts = None if last else packed.agg(F.max("part").alias("most")).first()["most"]
    return done.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
