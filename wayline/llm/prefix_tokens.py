"""Exact token counts of every prefix by dynamic programming.

The last token of a prefix's encoding is a piece t such that the encoding of the rest ends in a piece u
and (u, t) next to each other stay two tokens. So count(prefix) = count(prefix without t) + size(t), and
one pass from left to right gives the counts of all prefixes. The counts at every prefix of a text are laid end
to end from those of its units and stored, packed as differences, so that truncation and budget questions are
answered from the store (``longest_within``, ``cuts``), without a text and without encoding again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, PieceModel, UnitTable, model_path, open_model, slices

LIMIT = 4096
MOST_PAIRS = 500_000


class PrefixCounter(UnitTable):
    """The table of the dynamic programme: per unit of the model the token count at each of its prefixes."""

    def __init__(self, model: PieceModel):
        super().__init__(model, 1)
        self.stays: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for piece, token in model.ids.items():
            if model.encode_unit(piece) == [token]:  # merges don't reach every piece
                self.matches.add_word(piece, (len(piece), token))
        self.matches.make_automaton()

    def two(self, left: int, right: int) -> bool:
        """Whether the tokens stay two side by side."""
        if len(self.stays) > MOST_PAIRS:
            self.stays.clear()
        known = self.stays[left << 20 | right] = self.model.encode_unit(self.model.piece[left] + self.model.piece[right]) == [left, right]
        return known

    def learn(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        counts: list[int] = []
        for unit in units:
            counts += self.counts(unit) if len(unit) > 1 else [1 if unit in self.model.ids else len(unit.encode())]
        return [(np.array(counts), np.array(list(map(len, units))))]

    def counts(self, unit: str) -> list[int]:
        """Counts of unit[:1], unit[:2], ..., unit. Of the pieces that end a prefix, longest first, one goes with the rest."""
        n = len(unit)
        count, last, done, stays = [0] * (n + 1), [0] * (n + 1), 0, self.stays
        for end, (length, token) in self.matches.iter(unit):
            end += 1
            if end == done:
                continue
            begin = end - length
            if begin:
                pair = stays.get(last[begin] << 20 | token)
                if not (self.two(last[begin], token) if pair is None else pair):
                    continue
            count[end], last[end], done = count[begin] + 1, token, end
        return count[1:]

    def prefixes(self, numbers: np.ndarray) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text, from the numbers of its units."""
        counts = self.gathered(0, numbers)
        if not len(counts):
            return np.zeros(1, np.int32)
        size = self.lengths(0, numbers)
        whole = counts[np.cumsum(size) - 1]
        counts += np.repeat((np.cumsum(whole) - whole).astype(np.int32), size)
        counts[0] = 0  # the space that the model puts before a text isn't a sign of it
        return counts


@lru_cache(maxsize=1)
def counter_of(path: str) -> PrefixCounter:
    """Kept by a Python worker from task to task."""
    return PrefixCounter(open_model(path))


def packed(counts: np.ndarray) -> bytes:
    """The counts as differences: a byte with the width of a number, then the numbers, little-endian."""
    steps = np.diff(counts)
    least, most = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    width = 1 if -128 <= least and most < 128 else 2 if -(2**15) <= least and most < 2**15 else 4
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpacked(store: bytes) -> np.ndarray:
    """Token counts of text[:0], text[:1], ..., text."""
    return np.r_[0, np.cumsum(np.frombuffer(store, f"<i{store[0]}", offset=1), dtype=np.int64)]


def longest_within(counts: np.ndarray, limit: int) -> int:
    """The length of the longest prefix that has at most ``limit`` tokens, from its counts; they may fall again."""
    return int(np.flatnonzero(counts <= limit)[-1]) if counts[-1] > limit else len(counts) - 1


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars, prefix_counts: one row per row of ``docs``.

    prefix_counts holds the count at every prefix (``unpacked``); n_tokens is the last of them, over_limit says
    whether that is above ``limit``, fit_chars is the length of the longest prefix within it. A null text
    counts as empty: 0 bytes, 0 tokens, one prefix. Special strings inside texts are plain text, as the library has
    it. A very long text is worked on alone and whole; texts without spaces take time in proportion too.
    Repeated rows and null ids keep their rows, an empty table gives none, other columns of ``docs`` aren't read.
    """
    path = path or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64()), ("prefix_counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for rows, texts in slices(batches, 1):
            counts = [counter.prefixes(numbers) for numbers in counter.numbers(texts)]
            n = [int(c[-1]) for c in counts]
            columns = [[len(t.encode()) for t in texts], n, [k > limit for k in n], [longest_within(c, limit) for c in counts], [packed(c) for c in counts]]
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)

    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_counts binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def cuts(counted: DataFrame, limit: int, start: str | None = None) -> DataFrame:
    """doc_id, start, stop: the longest part text[start:stop] that adds at most ``limit`` tokens to text[:start], from
    the stored counts of ``counted`` alone; ``start`` names a column of characters to begin at (0 where it isn't given,
    0 for null or less, the text's end for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begins, stops = [], []
            for store, begin in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                counts = unpacked(store)
                begin = min(max(0, begin or 0), len(counts) - 1)
                begins.append(begin)
                stops.append(begin + longest_within(counts[begin:] - counts[begin], limit))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(begins, pa.int64()), pa.array(stops, pa.int64())], names=["doc_id", "start", "stop"])

    begin = F.col(start).cast("long") if start else F.lit(0).cast("long")
    return counted.select("doc_id", "prefix_counts", begin.alias("start")).mapInArrow(run, "doc_id long, start long, stop long")
