"""Ids of two tokenizers aligned over a corpus by id-striped dense count matrices.

Both encode the same bytes; where tokens of both end, a group ends, and all its pairs of occurrences are links. Ids of side A
are dealt to stripes by their remainder. A slice of texts leaves, for each stripe, its id pairs with the documents that
hold them; how many these are is added up in the stripe's dense block of counts, whose row maxima give the best partners. For the scores,
links meet the counts of their stripe in the same partition, a stripe at a time, dealt by slices too, so that no
task holds the links of all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteModel, ChunkTable, chunk_starts, spread, text_slices, tokenizer_path
from .common import cut
from .pieces import SPACE, model_path

WIDTH = 256  # ids of side A in a stripe
SLICE = 1 << 22  # bytes of text
MOST_PAIRS = 4096  # of a group that are listed one by one; of larger ones distinct ids are
SIDES = 8  # partitions of stripes for the scores
TASK_LINKS = 1 << 22  # distinct links of a task of the scores, or so
TASK_SLICES = 4096  # of a task that adds up a stripe
HASH_CHUNKS = 1 << 16  # of a text, hashed together

LINKS = "slice long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, rows int, links long, keys binary, docs_each binary, docs binary, times binary"


class PieceSide:
    """A piece model's file: the bytes of every id, and ids of chunks. Pieces that cross the begin of a chunk are refused."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        own = range(self.processor.get_piece_size())
        pieces = [self.processor.id_to_piece(i) for i in own]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if self.processor.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(own, pieces)]
        self.lengths = np.array([len(b) for b in self.bytes_of])
        inner = {c for i, p in zip(own, pieces) if len(p) > 1 and not self.processor.is_byte(i) and not self.processor.is_control(i) and not self.processor.is_unknown(i) for c in p.lstrip(SPACE)}
        if SPACE in inner or "\n" in inner or any(ord(c) > 127 and c.isspace() for c in inner):
            raise ValueError(f"{path} has pieces that go beyond a chunk")
        self.uncut = bytes(ord(c) for c in inner if c.isspace())
        self.size = len(pieces)

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, end to end, and how many each has. A line feed keeps the model's own space away."""
        ids = [x[2:] for x in self.processor.encode(["\n" + c.decode() for c in chunks], num_threads=1)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())), n


class AlignedChunks(ChunkTable):
    """Of a chunk: the text of its groups, its linked id pairs as cells of the striped matrix, how often each, and counts."""

    TEXT, CELLS, TIMES, COUNTS = 1, 2, 3, 4

    def __init__(self, a_path: str, b_path: str):
        super().__init__([np.uint8, np.int64, np.int64, np.int64])
        self.a, self.b = ByteModel(a_path), PieceSide(b_path)
        self.stripes = -(-self.a.size // WIDTH)
        self.block = WIDTH * self.b.size
        most = max(self.a.size, self.b.size)
        signs = [[f"{s}{i}".encode() for i in range(most)] for s in ";,|"]  # before a group's first A, any other id, its first B
        self.signs = signs[0] + signs[1] + signs[2]
        self.sign_sizes = np.array(list(map(len, self.signs)))
        self.most = most

    def cell(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a % self.stripes) * self.block + (a // self.stripes) * self.b.size + b

    def learn(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        (a, n_a), (b, n_b) = self.a.encode_chunks(chunks), self.b.encode_chunks(chunks)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        good = np.ones(len(chunks), bool)
        for side, ids, n in ((self.a, a, n_a), (self.b, b, n_b)):
            if b"".join(map(side.bytes_of.__getitem__, ids.tolist())) != b"".join(chunks):
                at = np.r_[0, np.cumsum(n)].tolist()
                good &= [b"".join(map(side.bytes_of.__getitem__, ids[p:q].tolist())) == c for p, q, c in zip(at, at[1:], chunks)]
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        chunk = np.flatnonzero(good)
        a_end, b_end, chunk_end = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]), np.cumsum(size[chunk])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        g_a, g_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        p, q = np.bincount(g_a, minlength=len(common)), np.bincount(g_b, minlength=len(common))
        a_first, b_first = np.cumsum(p) - p, np.cumsum(q) - q
        owner_of = np.repeat(chunk, np.diff(np.r_[0, np.searchsorted(common, chunk_end) + 1]))
        large = p * q > MOST_PAIRS
        reps = np.where(large, 0, q)[g_a]
        cells = self.cell(np.repeat(a, reps), b[spread(b_first[g_a], reps)])
        times, owner = np.ones(len(cells), np.int64), np.repeat(owner_of[g_a], reps)
        for g in np.flatnonzero(large):
            (ids_a, of_a), (ids_b, of_b) = np.unique(a[a_first[g] : a_first[g] + p[g]], return_counts=True), np.unique(b[b_first[g] : b_first[g] + q[g]], return_counts=True)
            cells = np.r_[cells, self.cell(ids_a[:, None], ids_b[None]).ravel()]
            times, owner = np.r_[times, np.outer(of_a, of_b).ravel()], np.r_[owner, np.full(len(ids_a) * len(ids_b), owner_of[g])]
        if large.any():
            order = np.argsort(owner, kind="stable")
            cells, times, owner = cells[order], times[order], owner[order]
        sign = np.empty(len(a) + len(b), np.int64)
        sign[np.arange(len(a)) + b_first[g_a]] = a + np.where(np.arange(len(a)) == a_first[g_a], 0, self.most)
        sign[np.arange(len(b)) + (a_first + p)[g_b]] = b + np.where(np.arange(len(b)) == b_first[g_b], 2 * self.most, self.most)
        text = np.frombuffer(b"".join(map(self.signs.__getitem__, sign.tolist())), np.uint8)
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        text_ends = np.r_[0, np.cumsum(self.sign_sizes[sign])][np.cumsum(n_a + n_b)]
        links = np.bincount(owner, times, len(chunks)).astype(np.int64) if len(owner) else np.zeros(len(chunks), np.int64)
        counts = np.column_stack([n_a, n_b, np.bincount(owner_of, minlength=len(chunks)), links, ~good]).astype(np.int64)
        each = np.bincount(owner, minlength=len(chunks))
        return [(text, np.diff(np.r_[0, text_ends])), (cells, each), (times, each), (counts.ravel(), np.full(len(chunks), 5))]

    def groups_sha256(self, numbers: np.ndarray) -> str:
        digest, skip = hashlib.sha256(), 1  # the first sign
        for at in range(0, len(numbers), HASH_CHUNKS):
            digest.update(self.gathered(self.TEXT, numbers[at : at + HASH_CHUNKS])[skip:])
            skip = 0
        return digest.hexdigest()


@lru_cache(maxsize=1)
def chunks_of(a_path: str, b_path: str) -> AlignedChunks:
    """Kept by a Python worker from task to task."""
    return AlignedChunks(a_path, b_path)


def narrow(numbers: np.ndarray) -> bytes:
    """A byte with the width of a number, then the numbers, little-endian and unsigned."""
    most = int(numbers.max()) if len(numbers) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Two kinds of rows: a document's counts (stripe is null), and for a slice of documents and a stripe its id pairs
    with, for each pair, the documents that hold it and how often."""
    schema = pa.schema([("slice", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("stripe", pa.int32()), ("rows", pa.int32()), ("links", pa.int64()), ("keys", pa.binary()), ("docs_each", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())])

    def batch(n: int, **columns: object) -> pa.RecordBatch:
        arrays = [pa.nulls(n, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = chunks_of(a_path, b_path), TaskContext.get().partitionId() << 32
        for rows, data, ends in text_slices(batches, 1, " ", SLICE):
            n = rows.num_rows
            begin = chunk_starts(data, ends[:-1], table.b.uncut)
            numbers = table.numbers(data, begin)
            edges = np.searchsorted(begin, ends)
            counts = table.flat[table.COUNTS][: int(table.ends[table.COUNTS][-1])].reshape(-1, 5)[numbers]
            sums = np.diff(np.vstack([np.zeros((1, 5), np.int64), np.cumsum(counts, axis=0)])[edges], axis=0)
            empty = (sums[:, 4] > 0) | (edges[1:] == edges[:-1])
            sums[empty] = 0
            shas = ["" if e else table.groups_sha256(numbers[a:z]) for e, a, z in zip(empty.tolist(), edges.tolist(), edges[1:].tolist())]
            yield batch(n, slice=np.full(n, number), row=np.arange(n, dtype=np.int32), doc_id=rows.column(0), n_a=sums[:, 0], n_b=sums[:, 1], n_groups=sums[:, 2], n_links=sums[:, 3], groups_sha256=shas)
            doc = np.repeat(np.arange(n), np.diff(edges))
            used = ~empty[doc]
            held, often = np.unique(doc[used] * len(table.sizes) + numbers[used], return_counts=True)
            doc, held = held // len(table.sizes), held % len(table.sizes)
            each = table.lengths(table.CELLS, held)
            place = table.gathered(table.CELLS, held) << 16 | np.repeat(doc, each)
            times = table.gathered(table.TIMES, held) * np.repeat(often, each)
            order = np.argsort(place)
            place, times = place[order], times[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
            place, times = place[first], np.add.reduceat(times, first) if len(first) else times
            cell, doc = place >> 16, place & 0xFFFF
            pair = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
            pair_ends = np.r_[pair[1:], len(cell)]
            stripe = cell[pair] // table.block
            edge = np.flatnonzero(np.r_[True, stripe[1:] != stripe[:-1], True]) if len(pair) else np.zeros(1, np.int64)
            out: dict[str, list] = {k: [] for k in ("stripe", "links", "keys", "docs_each", "docs", "times")}
            for a, z in zip(edge.tolist(), edge[1:].tolist()):
                p, q = pair[a], pair_ends[z - 1]
                for k, v in zip(out, (stripe[a], q - p, narrow(cell[pair[a:z]] % table.block), narrow(pair_ends[a:z] - pair[a:z]), narrow(doc[p:q]), narrow(times[p:q]))):
                    out[k].append(v)
            m = len(out["stripe"])
            yield batch(m, slice=np.full(m, number), rows=np.full(m, n, np.int32), **out)
            number += 1

    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINKS), "linked")


def added(rows: DataFrame, block: int, width: int, last: bool) -> DataFrame:
    """stripe, keys, docs_each: what (stripe, salt, keys, docs_each) rows add up to for each stripe and salt; if ``last``,
    with ``best``: which keys have their row's highest count."""
    schema = pa.schema([("stripe", pa.int32()), ("salt", pa.int64()), ("keys", pa.binary()), ("docs_each", pa.binary()), ("best", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, now = np.zeros(block, np.int64), None

        def done() -> pa.RecordBatch:
            keys = np.flatnonzero(counts)
            n, best = counts[keys], b""
            if last:
                best = (n == counts.reshape(-1, width).max(axis=1)[keys // width]).astype(np.uint8).tobytes()
            counts[keys] = 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, narrow(keys), narrow(n), best), schema)], schema=schema)

        for b in batches:
            for stripe, salt, keys, n in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if now is not None and now != (stripe, salt):
                    yield done()
                now = (stripe, salt)
                np.add.at(counts, wide(keys), wide(n))
        if now is not None:
            yield done()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("stripe", "salt", "keys", "docs_each").repartition(parts, "stripe", "salt").sortWithinPartitions("stripe", "salt")
    return dealt.mapInArrow(run, "stripe int, salt long, keys binary, docs_each binary, best binary")


def scored(links: DataFrame, counts: DataFrame, block: int, salts: int) -> DataFrame:
    """slice, row, n_best, count_sum: what a document's links score, in one row for each partition of stripes."""
    schema = pa.schema([("slice", pa.int64()), ("row", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    side, none = F.pmod("stripe", F.lit(SIDES)).alias("side"), F.lit(None)
    own = links.select(side, F.pmod(F.xxhash64("slice"), F.lit(salts)).alias("salt"), "stripe", "slice", "rows", "keys", "docs_each", "docs", "times", none.cast("binary").alias("best"))
    known = counts.select(side, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("salt"), "stripe", none.cast("long").alias("slice"), none.cast("int").alias("rows"), "keys", "docs_each", none.cast("binary").alias("docs"), none.cast("binary").alias("times"), "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_counts, filled, now = np.zeros(block, np.int64), np.empty(0, np.int64), None
        sums: dict[int, np.ndarray] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for slice_, (best, total) in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), slice_)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], schema=schema)
            sums.clear()

        for b in batches:
            for side_, salt, _, slice_, rows, keys, each, docs, times, best in zip(*[b.column(k).to_pylist() for k in range(10)]):
                if now != (side_, salt):
                    yield from done()
                    now = (side_, salt)
                keys, each = wide(keys), wide(each)
                if slice_ is None:  # the counts of a stripe come before its links; the lowest bit marks best ones
                    block_counts[filled] = 0
                    filled = keys
                    block_counts[keys] = each << 1 | np.frombuffer(best, np.uint8)
                    continue
                if slice_ not in sums:
                    sums[slice_] = np.zeros((2, rows), np.int64)
                got, docs, times = np.repeat(block_counts[keys], each), wide(docs), wide(times)
                np.add.at(sums[slice_][0], docs, (got & 1) * times)
                np.add.at(sums[slice_][1], docs, (got >> 1) * times)
        yield from done()

    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(known).repartition(parts, "side", "salt").sortWithinPartitions("side", "salt", "stripe", F.col("slice").asc_nulls_first())
    return dealt.mapInArrow(run, "slice long, row int, n_best long, count_sum long")


def counted(found: DataFrame, table: AlignedChunks) -> DataFrame:
    """stripe, keys, docs_each, best of the corpus: for every linked id pair how many documents hold it, and whether that is its A id's most."""
    links = found.where("stripe is not null")
    slices = found.select("slice").distinct().count()
    salts = -(-slices // TASK_SLICES)
    rows = links.select("stripe", F.pmod(F.xxhash64("slice"), F.lit(salts)).alias("salt"), "keys", "docs_each")
    if salts > 1:
        rows = cut(added(rows, table.block, table.b.size, False), "added").withColumn("salt", F.lit(0).cast("long"))
    return cut(added(rows, table.block, table.b.size, True).drop("salt"), "pair-counts")


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b, docs, best: the linked id pairs of the corpus, how many rows of ``docs`` hold each, and whether b is (among) a's best."""
    table = chunks_of(a_path or tokenizer_path(), b_path or model_path())
    counts, stripes, width = counted(linked(docs, a_path or tokenizer_path(), b_path or model_path()), table), table.stripes, table.b.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stripe, keys, n, best in zip(*[b.column(k).to_pylist() for k in range(4)]):
                keys = wide(keys)
                columns = [keys // width * stripes + stripe, keys % width, wide(n), np.frombuffer(best, np.uint8) > 0]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a", "b", "docs", "best"])

    return counts.mapInArrow(run, "a long, b long, docs long, best boolean")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    A text that is null or empty, or whose bytes either side doesn't give back, has no tokens: zeros and ''. Special strings
    are plain text. A pair that ties for its A id's highest count is best too. Repeated rows and null ids are
    documents of their own. A very long text is worked on alone; of a group with very many links the distinct ones are held.
    An empty table gives no rows; other columns of ``docs`` aren't read.
    """
    a_path, b_path = a_path or tokenizer_path(), b_path or model_path()
    table = chunks_of(a_path, b_path)
    found = linked(docs, a_path, b_path)
    counts = counted(found, table)
    links = found.where("stripe is not null")
    total = links.agg(F.sum("links").alias("n")).first()["n"] or 0
    sums = scored(links, counts, table.block, 1 + total // (SIDES * TASK_LINKS)).groupBy("slice", "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = found.where("stripe is null").select("slice", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, ["slice", "row"], "left")
    score = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *score, "groups_sha256")
