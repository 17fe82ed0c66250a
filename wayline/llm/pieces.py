"""What the two piece-model operators share: the model, the units of a text and tables over units.

The model writes a space as U+2581 and puts one before a text. A merge never goes beyond two signs that stand
side by side in no piece, so a text falls into units that are encoded independently: a sign that is in no longer
piece is a unit, and so is each run of spaces, then other signs, then letters, as no piece has a space behind
another sign or another sign behind a letter. What is known of a unit is kept in flat arrays, and a text is put
together from them by its units' numbers.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
NEVER = 1 << 62
MOST_UNITS = 400_000  # kept in a table
MOST_FLAT = 1 << 24  # numbers kept in one of its arrays
SLICE = 1 << 21  # characters of the texts that are worked on together; a longer text is alone


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def one_of(signs: set[str]) -> str:
    return "[" + "".join(map(re.escape, sorted(signs))) + "]" if signs else "(?!)"


class PieceModel:
    """The vocabulary file, opened once per Python worker, and whether its pieces are as said above."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        skip = [self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i) or self.processor.is_unused(i) for i in range(size)]
        self.piece = [self.processor.id_to_piece(i) for i in range(size)]
        self.ids = {self.piece[i]: i for i in range(size) if not skip[i]}
        self.byte_ids = {int(self.piece[i][1:-1], 16): i for i in range(size) if self.processor.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        # what an id adds to a text: an ASCII byte is that sign whatever stands beside it, other bytes depend on that
        self.shown = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p for i, p in enumerate(self.piece)]
        self.is_high = np.array([self.byte_of.get(i, 0) > 127 for i in range(size)])
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a word start")
        inner = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        if any(c not in self.ids for c in inner | {SPACE}):
            raise ValueError("a sign of longer pieces is no piece")
        letters = {c for c in inner if c.isalpha()}
        if any(a in letters and b not in letters for p in self.ids for a, b in zip(p, p[1:])):
            letters = set()  # then a unit is what stands between word starts
        other = inner - letters
        self.unit = re.compile(f"[^{one_of(inner)[1:-1]}{SPACE}]|{SPACE}*{one_of(other)}*{one_of(letters)}*", re.S)

    def units(self, text: str) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE))[:-1] if text else []

    def encode_unit(self, unit: str) -> list[int]:
        """The model's own ids of a unit; a line feed keeps the model's own space away."""
        return self.processor.encode("\n" + unit.replace(SPACE, " "))[2:]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return [ids[2:] for ids in self.processor.encode(["\n" + u.replace(SPACE, " ") for u in units], num_threads=1)]

    def bytes_of(self, sign: str) -> list[int]:
        """The ids of a sign outside the vocabulary."""
        return [self.byte_ids[b] for b in sign.encode()]


class Lookup:
    """Numbers by numbers of 0 or more, for many at once: a hash table with open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(3 * len(keys)).bit_length())
        self.keys, self.values = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int64)
        for key, at, value in zip(keys.tolist(), self.place(keys).tolist(), values.tolist()):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.values[at] = key, value
        if self.keys[-1] >= 0:
            raise ValueError("the numbers don't spread over the table")

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, NEVER for keys that aren't there."""
        at = self.place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], NEVER)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            at[on] += 1
            there = self.keys[at[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out


class Merges:
    """The encoding of units by the model's own merges: of all neighbours that make a piece together, those of the highest score
    are joined, the leftmost of equals, until none are left. Many units go on together, a join each at a time."""

    def __init__(self, model: PieceModel):
        self.model = model
        whole = [i for p, i in model.ids.items() if len(p) > 1]
        pairs = [(model.ids[p[:k]] * len(model.piece) + model.ids[p[k:]], i) for i in whole for p in [model.piece[i]] for k in range(1, len(p)) if p[:k] in model.ids and p[k:] in model.ids]
        keys, made = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.join = dict(pairs)
        score = np.array([model.processor.get_score(i) for i in range(len(model.piece))])
        self.turn = np.unique(-score, return_inverse=True)[1]  # lower is earlier
        self.found = Lookup(keys, (self.turn[made] << 20) + made)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What neighbours make together: turn << 20 | piece, NEVER if nothing."""
        return self.found.get(left * len(self.model.piece) + right)

    def of_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of pieces' signs, end to end, and how many each has.

        All that have as many parts now are rows of one table; a turn joins a pair in each of them, and takes in those that begin
        with one part less."""
        size = np.array(list(map(len, units)), np.int64)
        signs, place = np.unique(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), return_inverse=True)
        flat = np.array([self.model.ids[chr(c)] for c in signs], np.int64)[place]
        first = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        begins = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0)) + 1), "left")  # those of a size or more come before
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ids, made, unit = np.empty((0, 0), np.int64), np.empty((0, 0), np.int64), np.empty(0, np.int64)
        for n in range(int(size.max(initial=0)), 0, -1):
            new = order[begins[n] : begins[n - 1]]
            if len(new):
                more = flat[first[new][:, None] + np.arange(n)]
                pairs = self.joined(more[:, :-1].ravel(), more[:, 1:].ravel()).reshape(len(new), n - 1)
                ids, made, unit = (np.concatenate([x, y]) if len(unit) else y for x, y in ((ids, more), (made, pairs), (unit, new)))
            if not len(unit):
                continue
            if n == 1:
                done.append((unit, ids))
                break
            rows = np.arange(len(unit))
            at = (made >> 20).argmin(1)  # the leftmost of equals
            best = made[rows, at]
            over = best == NEVER
            if over.any():
                done.append((unit[over], ids[over]))
                ids, made, unit, at, best = ids[~over], made[~over], unit[~over], at[~over], best[~over]
                rows = np.arange(len(unit))
            columns = np.arange(n - 1)
            ids[rows, at] = best & (1 << 20) - 1
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            if n > 2:
                columns = columns[:-1]
                made = np.take_along_axis(made, columns + (columns >= at[:, None]), 1)
                left, right = at > 0, at < n - 2
                made[rows[left], at[left] - 1] = self.joined(ids[rows[left], at[left] - 1], ids[rows[left], at[left]])
                made[rows[right], at[right]] = self.joined(ids[rows[right], at[right]], ids[rows[right], at[right] + 1])
            else:
                made = np.empty((len(unit), 0), np.int64)
        counts = np.zeros(len(units), np.int64)
        for own, parts in done:
            counts[own] = parts.shape[1]
        out, start = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        for own, parts in done:
            out[start[own][:, None] + np.arange(parts.shape[1])] = parts
        return out, counts

    def of_one(self, unit: str) -> list[int]:
        """The same for one unit of any length."""
        ids, n, count_ = [self.model.ids[c] for c in unit], len(unit), len(self.model.piece)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (made := self.join.get(ids[a] * count_ + ids[b])) is not None:
                heapq.heappush(queue, (int(self.turn[made]), a, ids[a] * count_ + ids[b], made))

        for k in range(n - 1):
            offer(k)
        while queue:
            _, a, key, made = heapq.heappop(queue)
            b = after[a] if alive[a] else n
            if b >= n or ids[a] * count_ + ids[b] != key:
                continue
            ids[a], alive[b] = made, False
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [ids[k] for k in range(n) if alive[k]]


@lru_cache(maxsize=2)
def open_model(path: str) -> PieceModel:
    return PieceModel(path)


class UnitTable(dict):
    """Unit to its number. What ``learn`` appends to the flat arrays for each new unit is found by that number.

    Emptied between slices of texts once it is full, so its memory is bounded by a slice's.
    """

    def __init__(self, model: PieceModel, flats: int):
        super().__init__()
        self.model, self.flats = model, flats
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.flat = [array("i") for _ in range(self.flats)]
        self.ends = [array("q", [0]) for _ in range(self.flats)]

    def learn(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per flat array: what it gets for each of the new units, end to end, and how much that is for each."""
        raise NotImplementedError

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the numbers of its units; those that are new are learned together."""
        if len(self) > MOST_UNITS or max(map(len, self.flat)) > MOST_FLAT:
            self.empty()
        split = [self.model.units(t) for t in texts]
        known = [list(map(self.get, units)) for units in split]
        new = list(dict.fromkeys(u for units, found in zip(split, known) if None in found for u, k in zip(units, found) if k is None))
        if new:
            for k, (flat, size) in enumerate(self.learn(new)):
                self.flat[k].frombytes(flat.astype(np.int32).tobytes())
                self.ends[k].frombytes((self.ends[k][-1] + np.cumsum(size, dtype=np.int64)).tobytes())
            first = len(self)
            self.update(zip(new, range(first, first + len(new))))
            known = [[self[u] if k is None else k for u, k in zip(units, found)] if None in found else found for units, found in zip(split, known)]
        return [np.array(k, np.int64) for k in known]

    def lengths(self, k: int, numbers: np.ndarray) -> np.ndarray:
        ends = np.frombuffer(self.ends[k], np.int64)
        return ends[numbers + 1] - ends[numbers]

    def gathered(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """The k-th flat array's parts of the units, end to end."""
        ends, flat = np.frombuffer(self.ends[k], np.int64), np.frombuffer(self.flat[k], np.int32)
        parts = []
        for at in range(0, len(numbers), 1 << 18):
            some = numbers[at : at + (1 << 18)]
            begin, size = ends[some], ends[some + 1] - ends[some]
            parts.append(flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        return np.concatenate(parts) if parts else np.empty(0, np.int32)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in parts of about SLICE bytes of text, and their texts; null counts as empty."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // SLICE
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(size) else [0, 0]
        for a, z in zip(edges, edges[1:]):
            rows = b.slice(a, z - a)
            yield rows, [t or "" for t in rows.column(text).to_pylist()]
