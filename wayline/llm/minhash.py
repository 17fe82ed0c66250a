"""One-permutation MinHash fingerprints.

Each word shingle is hashed once; the top bits choose a bin and a bin keeps its smallest hash. Empty bins
borrow from a full one by optimal densification: bin i walks its own fixed random sequence of bins to the
first full one, the same in every document. A bin's hash is mixed with the bin's number and only a few bits of
that are stored, packed. Two bins of unlike documents agree in b bits with chance 2**-b, which the estimate
corrects for; the mixing makes those chances independent where one hash fills many bins of a short text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut
from .shingles import shingle_digests

WIDTH = 5
BINS = 512  # a power of two
BITS = 4
NO_ID = -(2**63)  # stands for a null doc_id, and sorts first
EMPTY = np.uint64(2**64 - 1)


@lru_cache(maxsize=4)
def walks(bins: int) -> np.ndarray:
    """Row t: the bin that each empty bin tries in its t-th step."""
    rng = np.random.default_rng(20170614)
    return rng.integers(0, bins, (256, bins))


def mixed(kept: np.ndarray) -> np.ndarray:
    """Each bin's hash hashed again with the bin's number: a hash that fills several bins leaves other bits in each."""
    with np.errstate(over="ignore"):
        z = kept + np.arange(len(kept), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def fingerprint(text: str, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> bytes:
    """The packed low bits of the densified bins; no bytes for a text without words."""
    digests = shingle_digests(text.encode().split(), width)
    if not len(digests):
        return b""
    hashes = np.sort(np.ascontiguousarray(digests).view(">u8").ravel().astype(np.uint64))
    bin_of = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])  # sorted, so the smallest of its bin
    kept = np.full(bins, EMPTY)
    kept[bin_of[first]] = hashes[first]
    full = np.zeros(bins, bool)
    full[bin_of[first]] = True
    empty = np.flatnonzero(~full)
    for step in walks(bins):
        if not len(empty):
            break
        to = step[empty]
        hit = full[to]
        kept[empty[hit]] = kept[to[hit]]
        empty = empty[~hit]
    kept[empty] = hashes[0]  # after 256 misses
    low = (mixed(kept) >> np.uint64(64 - bits)).astype(np.uint8)
    return np.packbits((low[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1. Two texts without words are alike, one isn't like another."""
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits)
    same = 1 - x.any(1).mean()
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The text whose last quarter of signs gives way to as many first signs of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """part, doc_id, text, tail: documents dealt by ranges of doc_id, each range followed by a copy of the
    first document of the next (tail true), so that a task finds every document's successor.

    Range limits are sketched quantiles of doc_id. Texts move once; besides, one text per range is copied.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("cuts")).first()["cuts"]
    limits = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, ids.to_numpy(), "left").astype(np.int32))

    placed = rows.withColumn("part", part("doc_id"))
    firsts = cut(placed.groupBy("part").agg(F.min("doc_id").alias("doc_id")), "firsts")  # a row per part
    before = F.coalesce(F.lag("part").over(W.orderBy("part")), F.max("part").over(W.partitionBy()))
    ring = cut(firsts.select("doc_id", before.alias("before")), "ring")
    tails = rows.join(F.broadcast(ring), "doc_id").select(F.col("before").alias("part"), "doc_id", "text", F.lit(True).alias("tail"))
    own = placed.select("part", "doc_id", "text", F.lit(False).alias("tail"))
    return own.unionByName(tails).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text")


def fingerprints(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    One row per row of ``docs``. The next document is the one after in the order of doc_id, null first, then
    text; after the last comes the first. A null text counts as empty; the fingerprint of a text without
    words is the empty string. An empty table gives no rows. Very long texts are hashed whole. Repeated rows follow each
    other; null ids are one range of the order, so a table with very many of them has them in one task. Other
    columns of ``docs`` aren't read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def row(doc_id: int, text: str, own: bytes, following: str, its: bytes) -> tuple:
        new = edited(text, following)
        made = own if new == text else fingerprint(new, width, bins, bits)
        sha = hashlib.sha256(new.encode()).hexdigest()
        return None if doc_id == NO_ID else doc_id, len(text), sha, own.hex(), made.hex(), likeness(own, made, bits), likeness(own, its, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the document whose successor comes next
        for b in batches:
            out = []
            for doc_id, text, tail in zip(*(c.to_pylist() for c in b.columns)):
                if waiting or not tail:
                    own = waiting[2] if waiting and waiting[1] == text else fingerprint(text, width, bins, bits)
                if waiting:
                    out.append(row(*waiting, text, own))
                waiting = None if tail else (doc_id, text, own)
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = neighbours(docs, parts).select("doc_id", "text", "tail")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
