"""SentencePiece encoding with the N best segmentations, and decoding.

A text's piece lattice has a node between any two signs and an edge for each piece. The model is of the BPE kind:
its scores are minus merge ranks, no likelihoods, and their bare sum prefers early, short pieces. So a path with
fewer pieces is better, and of as many the one with the larger sum of scores; the model's own encoding, which is
returned beside the N best, mostly has the fewest pieces. A forward Viterbi pass gives every node the best cost from
the start. Searching backward from the end, that cost is an exact heuristic: A-star pops whole segmentations in
order of their cost and never expands a path that doesn't lead to one of the N best.

Every start of a unit is a node that all paths pass, so the lattice is a chain of short unit lattices. The forward
pass runs once per different unit, for many units together in numpy, over a trie of the pieces. The search over the
chain expands a unit only if its second-best segmentation loses less than all but N - 1 others, and a path is
stored as its changes to the best one (``expand``, ``paths``).
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .pieces import NEVER, SPACE, Lookup, Merges, PieceModel, UnitTable, model_path, open_model, slices

N_BEST = 4
PIECE = 1 << 40  # what a piece costs beside its rank, so that the number of pieces counts first
NONE = 1 << 62  # what a second-best segmentation loses where there is none
MOST_SEARCHED = 50_000
LONG_UNIT = 64  # the search of longer ones isn't kept

Path = list[int]


class Trie:
    """The pieces as a trie in arrays: an edge's key is its node times the alphabet's size plus the sign's number."""

    def __init__(self, model: PieceModel):
        signs = sorted({c for p in model.ids for c in p})
        self.sign = np.zeros(0x110000, np.int64)  # 0 for what no piece has
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.signs = len(signs) + 1
        node: dict[str, int] = {"": 0}
        for piece in model.ids:
            for k in range(1, len(piece) + 1):
                node.setdefault(piece[:k], len(node))
        self.token = np.full(len(node), -1)
        self.token[[node[p] for p in model.ids]] = list(model.ids.values())
        keys = np.array([node[p[:-1]] * self.signs + self.sign[ord(p[-1])] for p in node if p])
        self.edges = Lookup(keys, np.array([n for p, n in node.items() if p]))

    def down(self, node: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have an edge for their sign, and the nodes that these lead to."""
        key = node * self.signs + sign
        child = self.edges.get(key)
        there = child < NEVER
        return there, child[there]


class Lattice(UnitTable):
    """Segmentations of units under one model: flat 0 has the model's own ids, flat 1 those of the best path."""

    def __init__(self, model: PieceModel):
        self.points = np.zeros(len(model.piece), np.int64)  # an id's score
        for i in model.ids.values():
            self.points[i] = round(model.processor.get_score(i))
        self.cost = PIECE - self.points
        self.cost_of = {piece: (i, int(self.cost[i])) for piece, i in model.ids.items()}
        self.trie, self.merges = Trie(model), Merges(model)
        self.found: dict[tuple[str, int], list[tuple[int, Path]]] = {}
        super().__init__(model, 2)

    def empty(self) -> None:
        super().empty()
        self.loss = array("q")  # per unit, what its second-best segmentation loses
        self.names: list[str] = []

    def forward(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi of many units together, by node and unit: the least cost from the start, the length and the id of the
        best edge into the node, and what the next best edge into it loses."""
        most = max(map(len, units))
        sign = self.trie.sign[np.array(units, f"U{most}").view(np.uint32).reshape(len(units), most).T]
        best = np.full((most + 1, len(units)), NONE)
        best[0] = 0
        size, last, loss = np.zeros(best.shape, np.int16), np.zeros(best.shape, np.int32), np.full(best.shape, NONE)
        for begin in range(most):
            unit = np.flatnonzero(sign[begin])
            node = np.zeros(len(unit), np.int64)
            for end in range(begin + 1, most + 1):
                there, node = self.trie.down(node, sign[end - 1, unit])
                unit = unit[there]
                if not len(unit):
                    break
                token = self.trie.token[node]
                ends = np.flatnonzero(token >= 0)
                at, token = unit[ends], token[ends]
                total, first = best[begin, at] + self.cost[token], best[end, at]
                less = total < first
                loss[end, at] = np.where(less, np.where(first < NONE, first - total, NONE), np.minimum(loss[end, at], total - first))
                to = at[less]
                best[end, to], size[end, to], last[end, to] = total[less], end - begin, token[less]
        return best, size, last, loss

    def forward_one(self, unit: str) -> tuple[list[int], list[int], list[int], list[int]]:
        """The same for one unit of any length, without bounds on sums."""
        n, longest, cost_of = len(unit), self.model.longest, self.cost_of
        best, size, last, loss = [0] + [NONE] * n, [0] * (n + 1), [0] * (n + 1), [NONE] * (n + 1)
        for end in range(1, n + 1):
            costs = sorted((best[begin] + edge[1], end - begin, edge[0]) for begin in range(max(0, end - longest), end) if (edge := cost_of.get(unit[begin:end])))
            best[end], size[end], last[end] = costs[0]
            if len(costs) > 1:
                loss[end] = costs[1][0] - costs[0][0]
        return best, size, last, loss

    def of_sign(self, sign: str) -> list[int]:
        """A sign is one piece, or its bytes."""
        return [self.model.ids[sign]] if sign in self.model.ids else self.model.bytes_of(sign)

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of the units, end to end, and how many each has, by its merges."""
        length = np.array(list(map(len, units)))
        some = np.flatnonzero((length > 1) & (length <= LONG_UNIT))
        ids, n = self.merges.of_many([units[k] for k in some])
        rest = np.flatnonzero((length == 1) | (length > LONG_UNIT))
        single = [self.of_sign(units[k]) if length[k] == 1 else self.merges.of_one(units[k]) for k in rest]
        sizes = np.zeros(len(units), np.int64)
        sizes[some], sizes[rest] = n, list(map(len, single))
        out, first = np.empty(int(sizes.sum()), np.int64), np.cumsum(sizes) - sizes
        out[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        for k, own in zip(rest, single):
            out[first[k] : first[k] + len(own)] = own
        return out, sizes

    def learn(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        own, own_sizes = self.encoded(units)
        sizes, loss, paths = np.zeros(len(units), np.int64), np.full(len(units), NONE), [np.empty((0, 3), np.int64)]  # (unit, place from the end, id)
        length = np.array(list(map(len, units)))
        some = np.flatnonzero((length > 1) & (length <= LONG_UNIT))
        some = some[np.argsort(length[some], kind="stable")]
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            _, size, last, lost = self.forward([units[k] for k in part])
            end, column, k = length[part], np.arange(len(part)), 0
            while len(column):
                loss[part[column]] = np.minimum(loss[part[column]], lost[end, column])
                sizes[part[column]] += 1
                paths.append(np.stack([part[column], np.full(len(column), k), last[end, column]], 1))
                end, k = end - size[end, column], k + 1
                column, end = column[end > 0], end[end > 0]
        for k in np.flatnonzero((length == 1) | (length > LONG_UNIT)):
            if length[k] == 1:
                ids = self.of_sign(units[k])
            else:
                _, size, last, lost = self.forward_one(units[k])
                nodes = list(steps(size))
                ids, loss[k] = [last[end] for end in nodes][::-1], min(NONE, *(lost[end] for end in nodes))
            sizes[k] = len(ids)
            paths.append(np.stack([np.full(len(ids), k), np.arange(len(ids))[::-1], ids], 1).reshape(-1, 3))
        path = np.concatenate(paths)
        self.names += units
        self.loss.frombytes(loss.tobytes())
        return [(own, own_sizes), (path[np.lexsort((-path[:, 1], path[:, 0])), 2], sizes)]

    def a_star(self, unit: str, n: int) -> list[tuple[int, Path]]:
        """The ``n`` best segmentations (what it loses, ids) of a unit, best first: backward A-star over forward costs."""
        if (unit, n) in self.found:
            return self.found[unit, n]
        best, longest, cost_of = self.forward_one(unit)[0], self.model.longest, self.cost_of
        order = count()
        # cost so far + least to the start, node (of equals the one nearest the start, else all would grow), tie, cost so far, path
        queue = [(best[-1], len(unit), next(order), 0, None)]
        found: list[tuple[int, Path]] = []
        while queue and len(found) < n:
            _, end, _, done, path = heapq.heappop(queue)
            if not end:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                found.append((done - best[-1], ids))
                continue
            for begin in range(max(0, end - longest), end):
                edge = cost_of.get(unit[begin:end])
                if edge:
                    heapq.heappush(queue, (done + edge[1] + best[begin], begin, next(order), done + edge[1], (edge[0], path)))
        if len(unit) <= LONG_UNIT:
            if len(self.found) > MOST_SEARCHED:
                self.found.clear()
            self.found[unit, n] = found
        return found

    def n_best(self, numbers: np.ndarray, n: int) -> list[tuple[int, dict[int, Path]]]:
        """The ``n`` best paths through a text's units: what each loses, and where it leaves the best, as {place: ids}."""
        loss = np.frombuffer(self.loss, np.int64)[numbers]
        places = [int(k) for k in np.argsort(loss, kind="stable")[: n - 1] if loss[k] < NONE]
        choices = [self.a_star(self.names[numbers[k]], n) for k in places]
        found, queue, order = [], [(0, 0, -1, ())], count(1)  # what it loses, tie, last changed choice, (choice, which)...
        while queue and len(found) < n:
            lost, _, last, changed = heapq.heappop(queue)
            found.append((lost, {places[c]: choices[c][j][1] for c, j in changed}))
            if changed:  # the last change, one segmentation worse
                c, j = changed[-1]
                if j + 1 < len(choices[c]):
                    heapq.heappush(queue, (lost + choices[c][j + 1][0] - choices[c][j][0], next(order), c, (*changed[:-1], (c, j + 1))))
            for c in range(last + 1, len(choices)):  # one more change, further on
                if len(choices[c]) > 1:
                    heapq.heappush(queue, (lost + choices[c][1][0], next(order), c, (*changed, (c, 1))))
        return found

    def own(self, numbers: np.ndarray) -> np.ndarray:
        return self.gathered(0, numbers)

    def best(self, numbers: np.ndarray, n: int) -> tuple[np.ndarray, list[list[tuple[int, int, Path]]]]:
        """The ids of the best path, and for each of the ``n`` best its changes to it: (at, drop, ids) says that ``drop``
        ids from place ``at`` on give way to ids."""
        ends = np.cumsum(self.lengths(1, numbers))
        begin = lambda k: int(ends[k - 1]) if k else 0
        return self.gathered(1, numbers), [[(begin(k), int(ends[k]) - begin(k), changes[k]) for k in sorted(changes)] for _, changes in self.n_best(numbers, n)]


def expand(best: np.ndarray, changes: list[tuple[int, int, Path]]) -> np.ndarray:
    """The ids of a path from those of the best one and its changes."""
    parts, done = [], 0
    for at, drop, ids in changes:
        parts += [best[done:at], np.array(ids, np.int32)]
        done = at + drop
    return np.concatenate([*parts, best[done:]])


def steps(size: list[int]) -> Iterator[int]:
    """The nodes of the best path, from the end."""
    end = len(size) - 1
    while end:
        yield end
        end -= size[end]


@lru_cache(maxsize=1)
def lattice_of(path: str) -> Lattice:
    """Kept by a Python worker from task to task."""
    return Lattice(open_model(path))


def decode(model: PieceModel, ids: np.ndarray | list[int]) -> str:
    """The text of token ids: pieces joined, runs of byte pieces read as UTF-8 (what is none becomes U+FFFD, a sign
    for each byte), spaces restored, the model's own space taken off."""
    ids = np.asarray(ids, np.int64)
    shown, high = model.shown, model.is_high[ids]
    if not high.any():
        text = "".join(map(shown.__getitem__, ids.tolist()))
    else:
        parts, edges = [], np.flatnonzero(np.r_[True, high[1:] != high[:-1], True])
        for a, z in zip(edges, edges[1:]):
            some = ids[a:z].tolist()
            parts.append(signs(bytes(map(model.byte_of.__getitem__, some))) if high[a] else "".join(map(shown.__getitem__, some)))
        text = "".join(parts)
    return text.removeprefix(SPACE).replace(SPACE, " ")


def signs(raw: bytes) -> str:
    """UTF-8, every byte that belongs to no sign as a U+FFFD of its own."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "\ufffd"]
            raw = raw[e.start + 1 :]
    return "".join(out)


def encode(docs: DataFrame, n: int = N_BEST, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, ids, n_tokens, score, best, nbest, decoded_sha256, exact: one row per row of ``docs``.

    ids are the model's own encoding and score is the sum of their scores. best are the ids of the lattice's best path;
    nbest lists the ``n`` best paths, best first: the number of their ids, the sum of their scores, and where
    they differ from best (at, drop, ids: see ``expand``; ``paths`` gives them in full). There are fewer where the lattice has fewer;
    of equal ones those that leave the best path earlier in the text go first. decoded_sha256 is of
    the text that ids decode to; exact says whether it is the document's: it is, unless the text holds U+2581
    itself, which the model reads as a space. A null or empty text has no ids, score 0 and one empty path. A very
    long text is worked on alone and whole. Repeated rows and null ids keep their rows, an empty table gives
    none, other columns of ``docs`` aren't read.
    """
    path = path or model_path()
    listed, change = pa.list_(pa.int32()), pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("ids", listed), ("n_tokens", pa.int64()), ("score", pa.int64()), ("best", listed),
        ("nbest", pa.list_(pa.struct([("n_tokens", pa.int64()), ("score", pa.int64()), ("changes", pa.list_(change))]))), ("decoded_sha256", pa.string()), ("exact", pa.bool_()),
    ])

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int32)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        model, points = lattice.model, lattice.points

        def ranked(best: np.ndarray, found: list[list[tuple[int, int, Path]]]) -> list[tuple]:
            size, score = len(best), int(points[best].sum())
            more = lambda at, drop, ids: int(points[ids].sum() - points[best[at : at + drop]].sum())
            return [(size + sum(len(ids) - drop for _, drop, ids in changes), score + sum(more(*c) for c in changes), changes) for changes in found]

        for rows, texts in slices(batches, 1):
            numbers = lattice.numbers(texts)
            own = [lattice.own(k) for k in numbers]
            best = [lattice.best(k, n) for k in numbers]
            back = [decode(model, ids) for ids in own]
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(map(len, texts), pa.int64()), lists(own), pa.array(map(len, own), pa.int64()), pa.array([int(points[ids].sum()) for ids in own], pa.int64()), lists([b for b, _ in best]),
                pa.array([ranked(*b) for b in best], schema.field("nbest").type), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == b for a, b in zip(back, texts)]),
            ], schema=schema)

    ddl = """doc_id long, n_chars long, ids array<int>, n_tokens long, score long, best array<int>,
        nbest array<struct<n_tokens: long, score: long, changes: array<struct<at: int, drop: int, ids: array<int>>>>>, decoded_sha256 string, exact boolean"""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), ddl)


def paths(encoded: DataFrame) -> DataFrame:
    """doc_id, place, ids, n_tokens, score: every one of the N best paths in full, place 0 the best."""
    each = encoded.select("doc_id", "best", F.posexplode("nbest").alias("place", "path"))
    until = lambda c: c["at"] + c["drop"]
    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<int>").alias("ids"))
    added = lambda done, c: F.concat(done["ids"], F.slice("best", done["done"] + 1, c["at"] - done["done"]), c["ids"])
    rest = lambda done: F.concat(done["ids"], F.slice("best", done["done"] + 1, F.greatest(F.size("best") - done["done"], F.lit(0))))
    ids = F.aggregate("path.changes", start, lambda done, c: F.struct(until(c).alias("done"), added(done, c).alias("ids")), rest)
    return each.select("doc_id", "place", ids.alias("ids"), "path.n_tokens", "path.score")
