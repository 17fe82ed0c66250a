"""SimHash near-dedup with a Gray-order hierarchical index.

Texts become fingerprints of 64 bits. Of B bands of bits, two fingerprints within ``LIMIT`` = 4 bits agree on
B - 4 at least, so each is dealt to one group for every choice of B - 4 bands and their values; B grows with
the number of fingerprints so that groups stay small. Every group is searched in its task with the index:
fingerprints in Gray order, bit patterns that a run of them shares factored out into upper nodes, differences
added up on the way down, whole runs dropped once the sum is over the limit.

Only a spanning star of each group's components leaves a task, never its pairs; components then grow over
the groups by contraction. Copies are one fingerprint throughout. A crowded group (a template with very many
small edits) is never one task's: runs of it are searched in four Gray orders, each over other leading bits, and what
these connect is contracted; then only chunks meet that aren't of one component and whose shared bits
don't already differ too often (``meetings``). Nothing is left out; the work is in proportion to a crowd's size as far as
it is connected.

``drop_near`` looks for likeness, not for a number of bits: texts whose sets of five-word shingles have a Jaccard
index of ``LIKENESS`` or more. 64 bits can't tell 0.8 from chance among very many texts, so its fingerprints have
``WORDS`` x 64 bits of the shingle set. Each of some tables deals them by other chosen bits; with n texts a table has
log2(n / NEAR_AIM) bits, and there are as many tables as make ``MISS`` of the pairs at exactly ``LIKENESS`` meet in none
(n ** 0.24 or so). The same index finds the candidates in a group, whose shingle sets are then compared exactly.
A group with very many candidates sends a spanning forest of the nearest ones only, and what these connect is contracted.
Its texts meet again by their rarest shingles (``meeting_shingles``): two texts that are alike enough share one of them,
while those of a template whose edits are their own don't, so the pairs that are just not alike enough are never made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidied
from .components import components
from .exact_dedup import possible
from .shingles import shingle_digests

LIMIT = 4
WIDTH = 4
FAN = 16
GROUP_MOST = 2048  # fingerprints searched together; larger groups are crowds
GROUP_AIM = 512  # random fingerprints in a group, at most, before one more band (or bit) is used
BLOCK = 256
LIKENESS = 0.8
NEAR_WIDTH = 5
WORDS = 4
REACH = 62  # of 256 bits: texts of likeness 0.8 differ in 39 on average, with a deviation of 6; unrelated ones in 128
MISS = 0.004
NEAR_AIM, NEAR_MOST = 2048, 8192  # as GROUP_AIM and GROUP_MOST: larger groups mean fewer tables, so less is shuffled
BLOCK_SHINGLES = 1 << 15
PAIRS_EACH = 4  # candidate pairs a fingerprint that a group sends on; where there are more, it is treated as a crowd
TURNS = (0, 16, 32, 48)
COUNT_BITS, COUNT_BLOCK = 22, 14  # how often shingles are there is counted in 2 ** COUNT_BITS buckets at most, which move in blocks of 2 ** COUNT_BLOCK
ODD = [f"odd{k}" for k in range(8)]  # words of a sketch
HELD = 1 << 18  # pairs that a task keeps before it thins them out
SLACK = 1e-5  # for what is left over of a whole number in floating point


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit k is set if it is in over half of the shingle hashes; as a signed 64-bit number."""
    return majority(shingle_digests((text or "").encode().lower().split(), width))


def majority(digests: np.ndarray) -> int:
    """Of digests in rows of 8 bytes, big-endian."""
    return int.from_bytes(np.packbits(ones(digests) * 2 > len(digests)).tobytes(), "big", signed=True)


def ones(rows: np.ndarray) -> np.ndarray:
    """How many of the rows of bytes have each bit; summed in bytes first, 255 rows at a time."""
    total = np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, len(rows), 255 * 64):
        bits = np.unpackbits(rows[at : at + 255 * 64], axis=1)
        for k in range(0, len(bits), 255):
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return total


def wide_majority(hashes: np.ndarray) -> np.ndarray:
    """WORDS x 64 bits (int64) of a set of 64-bit hashes: each word is a SimHash of the hashes, mixed differently."""
    if not len(hashes):
        return np.zeros(WORDS, np.int64)
    with np.errstate(over="ignore"):
        z = hashes.view(np.uint64)[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.packbits(ones(z.view(np.uint8)) * 2 > len(hashes)).view(np.int64)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, fp for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def masks(n: int, limit: int = LIMIT) -> list[int]:
    """The bits (signed 64-bit) on which a group agrees, for each choice of bands, for ``n`` fingerprints."""
    bands = limit + 1
    while bands < 3 * limit and n >> (64 * (bands - limit) // bands) > GROUP_AIM:
        bands += 1
    edges = [64 * k // bands for k in range(bands + 1)]
    band = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int.from_bytes(sum(chosen).to_bytes(8, "big"), "big", signed=True) for chosen in combinations(band, bands - limit)]


def gray_rank(fp: F.Column, turn: int = 0) -> F.Column:
    """The place of a bit pattern, turned left by ``turn`` bits, in the Gray sequence: neighbours there differ in one bit."""
    if turn:
        fp = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn))
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


class GrayIndex:
    """The hierarchical index over several groups at once.

    ``fps``: uint64 [word, fingerprint], grouped, in Gray order within a group; ``group``: 0-based group of each.
    Level 0 are the fingerprints; a node above covers up to FAN neighbours of its group and holds the bits on which
    all of these agree. Each node tests only the bits that no node above it has tested.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        fixed, pattern = [np.full(fps.shape, np.uint64(2**64 - 1))], [fps]
        self.children: list[np.ndarray] = []  # per level: first child of each node, and the end
        all_and, all_or = fps, fps
        up: list[np.ndarray] = []
        while True:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            within = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            first = np.flatnonzero(within % FAN == 0)
            all_and, all_or = np.bitwise_and.reduceat(all_and, first, 1), np.bitwise_or.reduceat(all_or, first, 1)
            up.append(np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(group)])))
            self.children.append(np.r_[first, len(group)])
            group = group[first]
            fixed.append(~(all_and ^ all_or))
            pattern.append(all_and)
            if len(starts) == len(first):
                break
        self.pattern = pattern
        self.mask = [f & ~fixed[k + 1][:, up[k]] if k < len(up) else f for k, f in enumerate(fixed)]

    def differing(self, level: int, queries: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        bits = [np.bitwise_count((asked[q] ^ own[node]) & mask[node]) for asked, own, mask in zip(queries, self.pattern[level], self.mask[level])]
        return bits[0] if len(bits) == 1 else np.sum(bits, 0, dtype=np.int16)

    def search(self, queries: np.ndarray, roots: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, fingerprint, bits) within ``limit`` bits; query k looks below root ``roots[k]`` only."""
        top = len(self.pattern) - 1
        q, node = np.arange(queries.shape[1]), roots
        diff = self.differing(top, queries, q, node)
        for level in range(top - 1, -1, -1):
            keep = diff <= limit
            q, node, diff = q[keep], node[keep], diff[keep]
            first, n = self.children[level][node], np.diff(self.children[level])[node]
            q, diff = np.repeat(q, n), np.repeat(diff, n)
            node = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            diff = diff + self.differing(level, queries, q, node)
        keep = diff <= limit
        return q[keep], node[keep], diff[keep]

    def pairs(self, fps: np.ndarray, group: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, bits) of all pairs with a > b within a group, a block of queries at a time."""
        for at in range(0, fps.shape[1], BLOCK):
            q, hit, bits = self.search(fps[:, at : at + BLOCK], group[at : at + BLOCK], limit)
            once = q + at > hit
            yield q[once] + at, hit[once], bits[once]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) after joining a[k] with b[k] for all k."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def stars(fps: np.ndarray, group: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) index pairs: a star over every component of more than one within each group."""
    label = np.arange(fps.shape[1])
    for a, b, _ in GrayIndex(fps, group).pairs(fps, group, limit):
        label = merge(label, a, b)
    member = np.flatnonzero(label != np.arange(len(label)))
    return member, label[member]


def forest(n: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest of least differences: every component takes its nearest pair, again and again."""
    order = np.argsort(bits, kind="stable")
    a, b, taken, label = a[order], b[order], np.zeros(len(a), bool), np.arange(n)
    while True:
        left = np.flatnonzero(label[a] != label[b])
        if not len(left):
            return order[taken]
        nearest = np.full(n, len(a))
        np.minimum.at(nearest, label[a[left]], left)
        np.minimum.at(nearest, label[b[left]], left)
        chosen = np.unique(nearest[nearest < len(a)])
        taken[chosen] = True
        label = merge(label, a[chosen], b[chosen])


def thinned(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b of the pairs (a, b, bits) that are found; where a group has over PAIRS_EACH of them a row, a spanning forest of its pairs only. Third, the rows that have a pair that is left out."""
    n, held = np.bincount(group), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    sent, crowded = np.zeros(len(n), np.int64), np.zeros(len(group), bool)

    def fewer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, bits = (np.concatenate(x) for x in zip(*held))
        keep = ~(sent > PAIRS_EACH * n)[group[a]]
        inside = np.flatnonzero(~keep)
        keep[inside[forest(len(group), a[inside], b[inside], bits[inside])]] = True
        crowded[a[~keep]] = crowded[b[~keep]] = True
        return a[keep], b[keep], bits[keep]

    for a, b, bits in found:
        sent += np.bincount(group[a], minlength=len(n))
        held.append((a, b, bits))
        if sum(len(x) for x, _, _ in held) > HELD:
            held = [fewer()]
    a, b, _ = fewer()
    return a, b, np.flatnonzero(crowded)


PAIRS = "a long, b long, g long"


def key_pairs(rows: np.ndarray, a: np.ndarray, b: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
    """a, b: the smaller and the larger key of each pair, and a row (key, NULL, g) for each crowded row."""
    key, pair = rows["key"], np.arange(len(a) + len(crowded)) < len(a)
    x, y = np.r_[np.minimum(key[a], key[b]), key[crowded]], np.r_[np.maximum(key[a], key[b]), key[crowded]]
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y, mask=~pair), pa.array(np.r_[key[a], rows["g"][crowded]], mask=pair)], names=["a", "b", "g"])


Find = Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def searched(rows: DataFrame, find: Find, schema: str, most: int = GROUP_MOST) -> DataFrame:
    """``find(rows, group)`` over the rows of each partition, which are sorted by g (the first column) and have long
    columns only: a block of whole groups at a time, and of a group of more than ``most`` a run of that many."""
    kind = [(c, np.int64) for c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            held = np.empty(0, kind)
            for b in batches:
                new = np.empty(b.num_rows, kind)
                for k, (c, _) in enumerate(kind):
                    new[c] = b.column(k).to_numpy()
                held = np.concatenate([held, new])
                while len(held) > 8 * most:
                    ends = np.flatnonzero(held["g"][1:] != held["g"][:-1]) + 1
                    end = ends[-1] if len(ends) else len(held) // most * most
                    yield held[:end]
                    held = held[end:]
            if len(held):
                yield held

        for block in blocks():
            first = np.flatnonzero(np.r_[True, block["g"][1:] != block["g"][:-1]])
            within = np.arange(len(block)) - np.repeat(first, np.diff(np.r_[first, len(block)]))
            yield from find(block, np.cumsum(within % most == 0) - 1)

    return rows.mapInArrow(tidied(run), schema)


def dealt_by_group(rows: DataFrame, *order: str | F.Column) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g").sortWithinPartitions("g", *order)


def dealt_in_runs(rows: DataFrame, *order: str | F.Column, parts: int | None = None) -> DataFrame:
    """Large groups, split over the partitions by ranges of their order."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)


def meetings(rows: DataFrame, words: list[str], limit: int, most: int = GROUP_MOST, runs: int | None = None) -> DataFrame:
    """The rows (g, rank, root, words, ...) of large groups, dealt to new groups of at most 2 * ``most`` in which any two
    rows of a group meet, unless they have one root or are seen to differ in over ``limit`` bits.

    Rows of a root stand together and are cut into chunks. The bits that a whole chunk shares make it an upper
    node: two chunks whose shared bits differ too often, or that are of one and the same root, don't meet. A chunk ends where
    one of the ``runs`` (partitions) does, so with fewer of these fewer meet.
    """
    names = [c for c in rows.columns if c != "rank"]

    def find(block: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.flatnonzero(np.r_[True, (block["root"][1:] != block["root"][:-1]) | (run[1:] != run[:-1]), True])
        long_ = np.diff(ends) >= most // 8  # a long run of one root is chunks of its own
        edge = np.zeros(len(block) + 1, bool)
        edge[ends[:-1][long_]], edge[ends[1:][long_]] = True, True
        edge[0], edge[-1] = True, False
        edge[1:-1] |= run[1:] != run[:-1]
        begun = TaskContext.get().partitionId() << 40
        find.chunks += 1
        chunk = begun + (find.chunks << 20) + np.cumsum(edge[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(chunk), *[pa.array(block[c]) for c in names]], names=["chunk", *names])

    find.chunks = 0
    chunked = cut(searched(dealt_in_runs(rows, "root", "rank", parts=runs).select(*names), find, "chunk long, " + ", ".join(f"{c} long" for c in names), most), "chunks")
    whole = [F.min("root").alias("low"), F.max("root").alias("high"), *[F.bit_and(w).alias(f"all_{w}") for w in words], *[F.bit_or(w).alias(f"any_{w}") for w in words]]
    node = chunked.groupBy("g", "chunk").agg(*whole)
    node = cut(node.select("g", "chunk", "low", "high", *[f"all_{w}" for w in words], *[F.bitwise_not(F.col(f"all_{w}").bitwiseXOR(F.col(f"any_{w}"))).alias(f"fixed_{w}") for w in words]), "nodes")
    other = node.select("g", *[F.col(c).alias(f"{c}2") for c in node.columns[1:]])
    apart = sum((F.bit_count(F.col(f"all_{w}").bitwiseXOR(F.col(f"all_{w}2")).bitwiseAND(F.col(f"fixed_{w}")).bitwiseAND(F.col(f"fixed_{w}2"))) for w in words), F.lit(0))
    one_root = (F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))
    pairs = node.join(other, "g").where((F.col("chunk") <= F.col("chunk2")) & (apart <= limit) & ~one_root)
    met = pairs.select("g", F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk"), F.xxhash64("g", "chunk", "chunk2").alias("met"))
    return chunked.join(met, ["g", "chunk"]).select(F.col("met").alias("g"), *[c for c in names if c != "g"])


def linked(groups: DataFrame, limit: int = LIMIT, most: int = GROUP_MOST) -> DataFrame:
    """a, b: stars of linked fingerprints within the dealt groups of (g, fp), or within runs of ``most`` of larger ones."""

    def find(rows: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        member, centre = stars(rows["fp"].view(np.uint64)[None], group, limit)
        yield pa.RecordBatch.from_arrays([pa.array(rows["fp"][member]), pa.array(rows["fp"][centre])], names=["a", "b"])

    return searched(groups.select("g", "fp"), find, "a long, b long", most)


def roots_of(fps: DataFrame, n: int, limit: int = LIMIT, most: int = GROUP_MOST) -> DataFrame:
    """node, root of the components of the ``n`` distinct fingerprints (fp) that have a link, all links within ``limit`` bits."""
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks(n, limit))]
    dealt = fps.select(F.explode(F.array(*keys)).alias("g"), "fp").withColumn("rank", gray_rank(F.col("fp")))
    large = cut(dealt.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("g"), "large")
    if large.isEmpty():
        return components(linked(dealt_by_group(dealt, "rank"), limit, most))
    edges = linked(dealt_by_group(dealt.join(large, "g", "left_anti"), "rank"), limit, most)
    crowds = dealt.join(large, "g", "left_semi")
    for turn in TURNS:
        edges = edges.unionByName(linked(dealt_in_runs(crowds.withColumn("rank", gray_rank(F.col("fp"), turn)), "rank"), limit, most))
    edges = cut(edges.distinct(), "stars")
    roots = components(edges)
    known = crowds.join(roots, crowds["fp"] == roots["node"], "left").select("g", "rank", F.coalesce("root", "fp").alias("root"), "fp")
    more = cut(linked(dealt_by_group(meetings(known, ["fp"], limit, most), "fp"), limit, 2 * most), "more-stars")
    return roots if more.isEmpty() else components(edges.unionByName(more))


def near_groups(docs: DataFrame, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """doc_id, text_hash, fp, component_id: one row per row of ``docs``.

    component_id is the smallest doc_id that links reach. A text without words has fingerprint zero and is
    linked like any other; a null text counts as empty. A null doc_id is never a component_id, unless the
    component has no other. Repeated rows each get their row. An empty table gives no rows. A very long text is
    hashed whole, a part at a time. Columns other than doc_id and text aren't read, whatever their names.
    """
    rows = cut(fingerprints(docs, width), "fingerprints")
    heads = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "heads")
    roots = roots_of(heads.select("fp"), heads.count(), limit)
    placed = cut(heads.join(roots, heads["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    lows = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")), "lows")
    named = cut(placed.join(lows, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


FPS = [f"w{k}" for k in range(WORDS)]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, key, size, w0, w1, ... for every row: a hash of the set of shingles, how many there are, and the
    set's wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.empty((b.num_rows, 2 + WORDS), np.int64)
            for k, t in enumerate(b.column(2).to_pylist()):
                different = shingle_set(t, width)
                made[k, 0] = xxhash.xxh64_intdigest(different.tobytes()) - 2**63
                made[k, 1] = len(different)
                made[k, 2:] = wide_majority(different)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, made.T.copy())], names=["doc_id", "text_hash", "key", "size", *FPS])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, text_hash long, key long, size long, " + ", ".join(f"{w} long" for w in FPS))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_digests((text or "").encode().lower().split(), width).view(np.int64))


def tables(n: int, likeness: float = LIKENESS, miss: float = MISS, aim: int = NEAR_AIM) -> list[list[int]]:
    """Per table the masks of its bits (a signed number for each word), for ``n`` fingerprints.

    At likeness J two sets' vectors have the cosine 2 J / (1 + J), and a bit of theirs agrees with chance 1 - angle / pi.
    """
    bits = max(0, math.ceil(math.log2(max(1, n / aim))))
    met = (1 - math.acos(2 * likeness / (1 + likeness)) / math.pi) ** bits
    made = []
    for k in range(1 if met == 1 else math.ceil(math.log(miss) / math.log(1 - met))):
        chosen = np.zeros(64 * WORDS, bool)
        chosen[np.random.default_rng([20, k]).permutation(64 * WORDS)[:bits]] = True
        made.append(np.packbits(chosen).view(np.int64).tolist())
    return made


def candidates(groups: DataFrame, limit: int, likeness: float, most: int) -> DataFrame:
    """a, b: keys of candidate pairs in the dealt groups of (g, key, size, words). Of a group with very many only a spanning
    forest is here, and a row (key, NULL, g) for each key with a pair that isn't.
    Sets can't be ``likeness`` alike if their sizes differ by more than that, so such pairs are none."""

    def find(rows: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, size = np.stack([rows[w].view(np.uint64) for w in FPS]), rows["size"]

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for a, b, bits in GrayIndex(fps, group).pairs(fps, group, limit):
                fits = np.minimum(size[a], size[b]) >= likeness * np.maximum(size[a], size[b]) - 1e-6
                yield a[fits], b[fits], bits[fits]

        yield key_pairs(rows, *thinned(found(), group))

    return searched(groups.select("g", "key", "size", *FPS), find, PAIRS, most)


def packed(hashes: np.ndarray) -> bytes:
    """The sorted upper 40 bits of different 64-bit hashes, 5 bytes each."""
    upper = np.unique(hashes.view(np.uint64) >> np.uint64(24))
    return upper.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(made: bytes) -> np.ndarray:
    rows = np.zeros((len(made) // 5, 8), np.uint8)
    rows[:, 3:] = np.frombuffer(made, np.uint8).reshape(-1, 5)
    return rows.view(">u8").ravel().astype(np.uint64)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """key, shingles (packed) of the ``wanted`` keys (key, text_hash, times)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [packed(shingle_set(t, width)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["key", "shingles"])

    marked = possible(docs.select("text"), F.xxhash64("text"), wanted.select("text_hash"), wanted.count())
    texts = marked.where("`\x00maybe`").select(F.xxhash64("text").alias("text_hash"), "text").join(wanted.select("key", "text_hash", "times"), "text_hash")
    once = texts.where("times = 1").select("key", "text")
    if not wanted.where("times > 1").isEmpty():
        once = once.unionByName(texts.where("times > 1").groupBy("key").agg(F.min("text").alias("text")))
    return cut(once.mapInArrow(tidied(shingled), "key long, shingles binary"), "sets")


def bucket_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """How many shingles of the ``sets`` are in each of 2 ** bits buckets (a shingle's lowest bits). Tasks send sums, not shingles."""
    low = min(bits, COUNT_BLOCK)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                bucket, n = np.unique(unpacked(b"".join(b.column(0).slice(at, 256).to_pylist())) & np.uint64(len(total) - 1), return_counts=True)
                total[bucket] += n.astype(np.int32)
        yield from blocks({k: part for k, part in enumerate(total.reshape(-1, 1 << low)) if part.any()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(part, np.int32)
        yield from blocks(total)

    def blocks(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = "block long, counts binary"
    counts = np.zeros((1 << (bits - low), 1 << low), np.int32)
    for r in sets.select("shingles").mapInArrow(tidied(counted), made).repartition(parts, "block").mapInArrow(summed, made).collect():
        counts[r["block"]] = np.frombuffer(r["counts"], np.int32)
    return counts.ravel()


def first_ones(n: np.ndarray, least: float) -> np.ndarray:
    """How many of the rarest of a set of ``n`` shingles hold one that it shares with any set with which it shares ``least`` * n."""
    return n - np.ceil(least * n - SLACK).astype(np.int64) + 1


def meeting_shingles(known: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """g, place, shallow, size, a sketch and the columns of ``known`` (key, words) for each of the rarest shingles of the sets; g is the shingle.

    All sets are put into one order of shingles, rare ones first. Two that share k shingles then have one in common among
    the first |x| - k + 1 of x and |y| - k + 1 of y. Alike sets share ``likeness`` of the larger one and 2 * likeness / (1 + likeness)
    of the smaller one: a place among the first ones of the latter kind is ``shallow``. How rare a shingle is taken to be
    (it shares a bucket's count) is of no matter to what is found, only to how many meet; one that is alone in its bucket is of this set only.
    A bit of the sketch tells whether an odd number of shingles fall on it, so two sets differ in as many shingles at least as their sketches do in bits.
    """
    shingles = known.agg(F.sum("size")).first()[0] or 1
    counts = bucket_counts(sets, max(10, min(COUNT_BITS, math.ceil(math.log2(shingles)))))
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    carried = [c for c in known.columns if c != "size"]
    names, width = ["g", "place", "shallow", "size", *ODD, *carried], 64 * len(ODD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = part.column("shingles").to_pylist()
                n = np.array([len(m) // 5 for m in made])
                shingle, own = unpacked(b"".join(made)), np.repeat(np.arange(len(n)), n)
                often = counts[shingle & np.uint64(len(counts) - 1)]
                odd = np.bincount(own * width + (shingle >> np.uint64(COUNT_BITS)).astype(np.int64) % width, minlength=len(n) * width) & 1
                odd = np.packbits(odd.astype(np.uint8).reshape(len(n), width), axis=1).view(np.int64)
                order = np.lexsort((shingle, often, own))
                place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                sent = np.flatnonzero((place < first_ones(n, likeness)[own]) & (often[order] > 1))
                own, place = own[sent], place[sent]
                shallow = (place < first_ones(n, 2 * likeness / (1 + likeness))[own]).astype(np.int64)
                columns = [shingle[order[sent]].astype(np.int64), place, shallow, n[own], *odd.T[:, own]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *[part.column(c).take(pa.array(own)) for c in carried]], names=names)

    return known.join(sets, "key").select(*carried, "shingles").mapInArrow(tidied(run), ", ".join(f"{c} long" for c in names))


def late_candidates(groups: DataFrame, limit: int, likeness: float, whole: bool, most: int) -> DataFrame:
    """a, b: keys of the candidate pairs of different roots in the dealt groups of ``meeting_shingles``: all of them with ``whole``, else as ``candidates``.

    One of a pair is shallow, and one isn't of the root that most of a group are of: whichever are fewer are looked for among all.
    """

    def find(rows: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = np.stack([rows[w].view(np.uint64) for w in FPS])
        size, root, place, shallow = (rows[c] for c in ("size", "root", "place", "shallow"))
        order = np.lexsort((root, group))
        first = np.flatnonzero(np.r_[True, (np.diff(root[order]) != 0) | (np.diff(group[order]) != 0)])
        n, of = np.diff(np.r_[first, len(order)]), group[order[first]]
        longest = np.lexsort((n, of))[np.cumsum(np.bincount(of)) - 1]
        other = root != root[order[first[longest]]][group]
        fewer = np.bincount(group, other) < np.bincount(group, shallow)
        asked = np.where(fewer[group], other, shallow == 1)
        asking = np.flatnonzero(asked)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            index = GrayIndex(fps, group)
            for at in range(0, len(asking), BLOCK):
                block = asking[at : at + BLOCK]
                q, b, bits = index.search(fps[:, block], group[block], limit)
                a = block[q]
                both = np.ceil(likeness / (1 + likeness) * (size[a] + size[b]) - SLACK)  # shingles that alike sets of these sizes share
                fits = (root[a] != root[b]) & (~asked[b] | (a > b)) & (place[a] <= size[a] - both) & (place[b] <= size[b] - both)
                fits &= np.minimum(size[a], size[b]) >= likeness * np.maximum(size[a], size[b]) - SLACK
                a, b, bits, both = a[fits], b[fits], bits[fits], both[fits]
                odd = sum((np.bitwise_count((rows[w][a] ^ rows[w][b]).view(np.uint64)).astype(np.int64) for w in ODD), np.zeros(len(a), np.int64))
                fits = odd <= size[a] + size[b] - 2 * both
                yield a[fits], b[fits], bits[fits]

        if whole:
            yield from (key_pairs(rows, a, b, asking[:0]) for a, b, _ in found())
        else:
            yield key_pairs(rows, *thinned(found(), group))

    return searched(groups.select("g", "root", "key", "size", "place", "shallow", *ODD, *FPS), find, PAIRS, most)


def alike(docs: DataFrame, heads: DataFrame, pairs: DataFrame, width: int, likeness: float, sets: DataFrame | None = None) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose shingle sets have a Jaccard index of ``likeness`` or more.

    The sets themselves are compared, as hashes of 40 bits. No set moves once for every pair: keys with a common
    neighbour are put into blocks of BLOCK_SHINGLES shingles or so, and a set goes to each meeting of two
    blocks that has a pair of it. A meeting's memory is that of two blocks, however long the texts or large the crowd.
    ``sets`` are those of ``shingle_sets``, where they are there already.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        found: list[tuple[int, int]] = []
        for _, seated in groupby(rows, itemgetter(0)):
            seated = list(seated)
            own = {key: unpacked(made) for _, key, _, made in seated}
            for _, a, others, _ in seated:
                if not others:
                    continue
                x, theirs = own[a], [own[o] for o in others]
                n, every = np.array([len(y) for y in theirs]), np.concatenate(theirs)
                both = np.add.reduceat(x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every, np.cumsum(n) - n, dtype=np.int64)
                found += [(a, others[k]) for k in np.flatnonzero(both >= likeness * (len(x) + n - both) - 1e-6)]
            if len(found) >= 4096:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*found))], names=["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*found))], names=["a", "b"])

    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("other")), F.struct(F.col("b").alias("key"), F.col("a").alias("other")))).alias("end"))
    label = ends.groupBy("end.key").agg(F.min("end.other").alias("low")).select("key", F.least("key", "low").alias("label"))
    wanted = cut(heads.select("key", "text_hash", "size", "times").join(label, "key"), "wanted")
    blocks = wanted.groupBy("label").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks"))
    block = cut(wanted.join(blocks, "label").select("key", F.xxhash64("label", F.pmod("key", "blocks")).alias("block")), "blocks")
    met = pairs.join(block.select(F.col("key").alias("a"), F.col("block").alias("x")), "a").join(block.select(F.col("key").alias("b"), F.col("block").alias("y")), "b")
    seat = F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("other")), F.struct(F.col("b").alias("key"), F.lit(None).cast("long").alias("other")))
    seats = met.select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("meeting"), F.explode(seat).alias("seat"))
    seats = seats.groupBy("meeting", F.col("seat.key").alias("key")).agg(F.collect_list("seat.other").alias("others"))

    if sets is None:
        sets = shingle_sets(docs, wanted, width)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seats.join(sets, "key").select("meeting", "key", "others", "shingles").repartition(parts, "meeting").sortWithinPartitions("meeting").mapInArrow(tidied(compared), "a long, b long")


def like_groups(docs: DataFrame, width: int = NEAR_WIDTH, limit: int = REACH, likeness: float = LIKENESS, most: int = NEAR_MOST, aim: int = NEAR_AIM) -> DataFrame:
    """doc_id, text_hash, root: one row per row of ``docs``; root is one of the shingle sets that links join.

    Texts are linked if they are candidates (they meet in a table, their fingerprints are within ``limit`` bits) and their
    shingle sets are ``likeness`` or more alike; texts of one shingle set, those without words among them, are one.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(sketches(docs, width), "sketches")
    heads = cut(rows.groupBy("key").agg(F.min("size").alias("size"), F.min("text_hash").alias("text_hash"), F.count("*").alias("times"), *[F.min(w).alias(w) for w in FPS]), "heads")
    masked = [F.xxhash64(F.lit(k), *[F.col(w).bitwiseAND(F.lit(m).cast("long")) for w, m in zip(FPS, table)]) for k, table in enumerate(tables(heads.count(), likeness, aim=aim))]
    dealt = heads.where("size > 0").select(F.explode(F.array(*masked)).alias("g"), "key", "size", *FPS)
    large = cut(dealt.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("g"), "large")
    small, crowds = (dealt, None) if large.isEmpty() else (dealt.join(large, "g", "left_anti"), dealt.join(large, "g", "left_semi"))
    found = candidates(dealt_by_group(small, gray_rank(F.col("w0"))), limit, likeness, most)
    if crowds is not None:
        for word, turn in [(w, t) for w in FPS[:2] for t in TURNS[::2]]:
            found = found.unionByName(candidates(dealt_in_runs(crowds, gray_rank(F.col(word), turn)), limit, likeness, most))
    found = cut(found.distinct(), "candidates")
    pairs = found.where("b is not null").select("a", "b")
    links = cut(alike(docs, heads, pairs, width, likeness), "links")
    roots = components(links)
    dense = found.where("b is null").select("g", F.col("a").alias("key"))
    if crowds is not None:
        dense = dense.unionByName(crowds.select("g", "key"))
    dense = cut(dense.distinct(), "dense")
    if not dense.isEmpty():
        known = with_roots(dense, roots)
        split = known.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("g")
        known = cut(heads.select("key", "size", *FPS).join(known.join(split, "g", "left_semi"), "key", "left_semi"), "crowd")
        sets = shingle_sets(docs, heads.join(known, "key", "left_semi").select("key", "text_hash", "times"), width)
        entries = cut(meeting_shingles(known, sets, likeness), "rarest")
        for whole in (False, True):  # first a forest of nearest ones in crowded lists, which connects most of a crowd; then whatever is left of these
            held = with_roots(entries, roots)
            lists = held.groupBy("g").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("shallow").alias("shallow"))
            lists = cut(lists.where("low < high and shallow = 1").select("g", "n"), "lists")
            few, many = lists.where(F.col("n") <= most), lists.where(F.col("n") > most)
            more = late_candidates(dealt_by_group(held.join(few, "g", "left_semi"), gray_rank(F.col("w0"))), limit, likeness, whole, most)
            crowded = many.agg(F.sum("n")).first()[0]
            if crowded:
                crowds = held.join(many, "g", "left_semi")
                if whole:
                    met = meetings(crowds.withColumn("rank", gray_rank(F.col("w0"))), FPS, limit, most, runs=min(parts, crowded // most))
                    more = more.unionByName(late_candidates(dealt_by_group(met, F.col("w0")), limit, likeness, True, 2 * most))
                else:
                    for word, turn in [(w, t) for w in FPS[:2] for t in TURNS[::2]]:
                        more = more.unionByName(late_candidates(dealt_in_runs(crowds, gray_rank(F.col(word), turn)), limit, likeness, False, most))
            more = cut(more.distinct(), "late-candidates")
            left = more.where("b is null").select("g", F.col("a").alias("key"))
            if crowded:
                left = left.unionByName(held.join(many, "g", "left_semi").select("g", "key"))
            more = cut(more.where("b is not null").select("a", "b").join(pairs, ["a", "b"], "left_anti"), "more-candidates")
            if not more.isEmpty():
                pairs = pairs.unionByName(more)
                links = cut(links.unionByName(alike(docs, heads, more, width, likeness, sets)), "links")
                roots = components(links)
            if left.isEmpty():
                break
            entries = entries.join(left.distinct(), ["g", "key"], "left_semi")
    return rows.join(roots, rows["key"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("root"))


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of each key: itself where it has no link."""
    return rows.join(roots, rows["key"] == roots["node"], "left").select(*[rows[c] for c in rows.columns], F.coalesce("root", "key").alias("root"))


def drop_near(docs: DataFrame, width: int = NEAR_WIDTH, limit: int = REACH, likeness: float = LIKENESS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id (a null one only if there is no
    other), then the smallest text_hash. Components are told apart by their root, so null or repeated ids of
    unrelated texts all stay. A null text counts as empty; texts without words are one component. An empty table stays
    empty. Very long texts are hashed whole. All columns are kept, whatever their names. Whole rows move only where their
    text may be in a component of several rows; the rest pass straight through.
    """
    found = cut(like_groups(docs, width, limit, likeness), "near")
    groups = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"), F.count("*").alias("n")).where("n > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    touched = cut(found.join(groups, "root").groupBy("doc_id", "text_hash", stays.alias("stays")).agg(F.count("*").alias("n")), "touched")
    gone, again = touched.where("not stays"), touched.where("stays and n > 1")
    marked = possible(docs, F.xxhash64("text"), touched.select("text_hash"), touched.count())
    alone, rows = marked.where("not `\x00maybe`").drop("\x00maybe"), marked.where("`\x00maybe`").drop("\x00maybe")
    kept = rows.join(gone, same(rows, gone), "left_anti")
    if not again.isEmpty():
        once = kept.join(again, same(kept, again), "left_semi").withColumn("\x00row", F.struct("doc_id", F.xxhash64("text"))).dropDuplicates(["\x00row"]).drop("\x00row")
        kept = kept.join(again, same(kept, again), "left_anti").unionByName(once)
    return alone.unionByName(kept)


def same(docs: DataFrame, rows: DataFrame) -> F.Column:
    return docs["doc_id"].eqNullSafe(rows["doc_id"]) & (F.xxhash64(docs["text"]) == rows["text_hash"])
