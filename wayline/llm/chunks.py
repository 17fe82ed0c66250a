"""Texts as numbers of chunks, for the operators on byte-level ids.

A chunk is a run of white space and what stands behind it up to the next run. Byte-level tokens never go beyond
such a border, nor do pieces of a model with marked word starts, so a chunk is encoded by itself, once, and known by
its number from then on. Chunks are found, hashed and compared as whole arrays of bytes: no Python object is made
for a chunk that is known. A hash only proposes a number; the bytes decide.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

DEFAULT_BYTES = "byte_bpe_50k.json"
# fixed values: the characters of Unicode's property White_Space, as ranges; and the usual pattern that byte-level models split texts by
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WHITES = [chr(c) for a, b in WHITE for c in range(a, b + 1)]
MOST_CHUNKS = 1 << 20  # kept in a table
MOST_FLAT = 1 << 23  # numbers kept in one of its arrays
LONG = 64  # words of eight bytes; what lies behind these doesn't count for the hash
SLICE = 1 << 21  # bytes of the texts that are worked on together; a longer text is alone

ODD = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.r_[np.full(LONG, ODD, np.uint64), np.uint64(0)])
ENDS = np.array([2**64 - 1, *[2 ** (8 * k) - 1 for k in range(1, 8)]], np.uint64)  # by the size modulo eight: the bytes of a last word


def tokenizer_path(name: str = DEFAULT_BYTES) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteModel:
    """A byte-level model's file: the bytes of every id, and ids of ordinary text.

    Ids count merges in their order, so ids are ranks too, and the rank encoder gives what the file's own library gives.
    Files that aren't so are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        pre = given["pre_tokenizer"]
        if given["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} isn't a plain byte-level model")
        byte_of = {shown: b for b, shown in enumerate(shown_bytes())}
        vocab = given["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if all(c in byte_of for c in piece)}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in given["model"]["merges"]]
        if any(a >= b for a, b in zip(map(vocab.get, made), map(vocab.get, made[1:]))):
            raise ValueError(f"{path} has merges in another order than its ids")
        self.special = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, end to end, and how many each has."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        data = np.frombuffer(b"".join(chunks), np.uint8)
        alone = whites(data)[np.cumsum(size) - 1]  # the white space that ends a text
        first = data[np.cumsum(size) - size]
        bare = ~WHITE_BYTE[first] & ~alone  # a line feed before these keeps them apart, and isn't counted
        joined = b"".join([b"\n" * k + c for c, k, a in zip(chunks, bare.tolist(), alone.tolist()) if not a])
        ids = np.array(self.encoding.encode_ordinary(joined.decode()), np.int64)
        n = np.zeros(len(chunks), np.int64)
        n[~alone] = np.diff(np.r_[0, np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum((size + bare)[~alone])) + 1])
        if bare.any():
            dropped = np.zeros(len(ids), bool)
            dropped[(np.cumsum(n) - n)[bare]] = True
            ids, n = ids[~dropped], n - bare
        if alone.any():
            own = [np.array(self.encoding.encode_ordinary(chunks[k].decode()), np.int64) for k in np.flatnonzero(alone)]
            places = np.repeat((np.cumsum(n) - n)[alone], list(map(len, own)))
            ids = np.insert(ids, places, np.concatenate(own))
            n[alone] = list(map(len, own))
        return ids, n


def shown_bytes() -> list[str]:
    """The character that stands for each byte in the file: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + other.index(b)) for b in range(256)]


WHITE_BYTE = np.zeros(256, bool)
WHITE_BYTE[[ord(c) for c in WHITES if ord(c) < 128]] = True
WIDE = {c.encode() for c in WHITES if ord(c) > 127}


def whites(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = WHITE_BYTE[data]
    for lead in {c[0] for c in WIDE}:
        at = np.flatnonzero(data == lead)
        for c in (c for c in WIDE if c[0] == lead):
            hit = at[at + len(c) <= len(data)]
            for k in range(1, len(c)):
                hit = hit[data[hit + k] == c[k]]
            for k in range(len(c)):
                white[hit + k] = True
    return white


def chunk_starts(data: np.ndarray, texts: np.ndarray, uncut: bytes = b"") -> np.ndarray:
    """Where chunks begin in texts that lie end to end, each non-empty one from one of ``texts`` on. No chunk begins with a byte of ``uncut``."""
    white = whites(data)
    begin = white.copy()
    begin[1:] &= ~white[:-1]
    for b in uncut:
        begin &= data != b
    begin[texts[texts < len(data)]] = True
    return np.flatnonzero(begin)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def words_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the chunks as words of eight, the last one filled up with zeros, and how many words each has."""
    n = (size + 7) >> 3
    padded = np.r_[data, np.zeros(8, np.uint8)]
    at = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    last = np.cumsum(n) - 1
    words = at[np.repeat(begin - 8 * (last + 1 - n), n) + 8 * np.arange(last[-1] + 1 if len(n) else 0)]
    words[last] &= ENDS[size & 7]
    return words, n


class ChunkTable:
    """Chunk to number, and flat arrays found by number. ``learn`` says what a new chunk appends to each.

    Emptied between slices of texts once it is full, so its memory is bounded by a slice's.
    """

    def __init__(self, kinds: list[type]):
        self.kinds = [np.uint64, *kinds]  # the first array has the chunks' words
        self.empty()

    def empty(self) -> None:
        self.flat = [np.empty(1 << 12, k) for k in self.kinds]
        self.ends = [np.zeros(1, np.int64) for _ in self.kinds]
        self.sizes = np.empty(0, np.int64)
        self.indexes: list[tuple[pd.Index, np.ndarray]] = []  # hashes and numbers, large ones first

    def learn(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per flat array: what it gets for each of the chunks, end to end, and how much that is for each."""
        raise NotImplementedError

    def add(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of new chunks."""
        raw = data.tobytes()
        chunks = [raw[a:z] for a, z in zip(begin.tolist(), (begin + size).tolist())]
        first = len(self.sizes)
        self.sizes = np.r_[self.sizes, size]
        for k, (more, each) in enumerate([words_of(data, begin, size), *self.learn(chunks)]):
            used = int(self.ends[k][-1])
            if used + len(more) > len(self.flat[k]):
                wider = np.empty(max(2 * len(self.flat[k]), used + len(more)), self.kinds[k])
                wider[:used] = self.flat[k][:used]
                self.flat[k] = wider
            self.flat[k][used : used + len(more)] = more
            self.ends[k] = np.r_[self.ends[k], used + np.cumsum(each, dtype=np.int64)]
        return np.arange(first, first + len(chunks))

    def know(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Later found by their hashes. Each index is at least twice as large as the next, so few are looked through."""
        while self.indexes and len(self.indexes[-1][0]) < 2 * len(hashes):
            index, known = self.indexes.pop()
            hashes, numbers = np.r_[index.to_numpy(), hashes], np.r_[known, numbers]
        self.indexes.append((pd.Index(hashes), numbers))

    def numbers(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The numbers of the chunks of ``data`` that begin there; new ones are learned together."""
        if len(self.sizes) > MOST_CHUNKS or max(int(e[-1]) for e in self.ends) > MOST_FLAT:
            self.empty()
        if not len(begin):
            return np.empty(0, np.int64)
        size = np.diff(np.r_[begin, len(data)])
        words, n = words_of(data, begin, size)
        at = np.cumsum(n) - n
        place = np.minimum(np.arange(len(words)) - np.repeat(at, n), LONG)
        hashes = np.add.reduceat((words ^ (words >> np.uint64(31))) * POWERS[place], at) * ODD + size.astype(np.uint64)
        out = np.full(len(begin), -1)
        for index, known in self.indexes:
            left = np.flatnonzero(out < 0)
            found = index.get_indexer(hashes[left])
            out[left[found >= 0]] = known[found[found >= 0]]
        left = np.flatnonzero(out < 0)
        if len(left):
            new, first, which = np.unique(hashes[left], return_index=True, return_inverse=True)
            added = self.add(data, begin[left[first]], size[left[first]])
            out[left] = added[which]
            self.know(new, added)
        equal = self.sizes[out] == size
        differ = words != self.flat[0][spread(self.ends[0][out], n)] if equal.all() else np.ones(len(words), bool)
        wrong = np.flatnonzero(np.logical_or.reduceat(differ, at))
        if len(wrong):  # other chunks have their hashes
            out[wrong] = self.add(data, begin[wrong], size[wrong])
        return out

    def lengths(self, k: int, numbers: np.ndarray) -> np.ndarray:
        return self.ends[k][numbers + 1] - self.ends[k][numbers]

    def gathered(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """The k-th flat array's parts of the chunks, end to end."""
        return self.flat[k][spread(self.ends[k][numbers], self.lengths(k, numbers))]


def text_slices(batches: Iterator[pa.RecordBatch], text: int, before: str = "", most: int = SLICE, rows: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches in parts of about ``most`` bytes of text and fewer than ``rows`` rows: rows, the bytes of their texts
    end to end, and where each begins and the last ends. Null counts as empty; ``before`` goes before texts that aren't."""
    for b in batches:
        texts = pc.fill_null(b.column(text).cast(pa.large_string()), "")
        if before:
            filled = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(before, pa.large_string()))
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, filled)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.maximum((np.cumsum(size) - size) // most, np.arange(len(size)) // (rows - 1))
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(size) else []
        for a, z in zip(edges, edges[1:]):
            own = texts.slice(a, z - a)
            ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            yield b.slice(a, z - a), data, ends - ends[0]
