"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree. In a context with n counted symbols, d of them
different, a seen symbol has probability count / (n + d); d / (n + d) is left for an escape to the next
shorter context, shared among the symbols not seen here. The statistics are frozen after fitting, so a
text's code length in bits is exact, and the language with the shortest code is predicted.

All languages share one set of contexts: those that occur often enough anywhere. It is closed under taking
prefixes and suffixes, so the longest known context is the state of an automaton, and a table gives the next
state and every language's bits for a byte. Texts are scored in lockstep, many at a time, with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, label_sample

ORDER = 4
PER_LANGUAGE = 300  # documents to fit each language on
MOST_CELLS = 1 << 22  # states x symbols x languages: 16 MB of bits, whatever the corpus
SEGMENT = 512
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def folded_bytes() -> np.ndarray:
    """Byte to byte: A-Z to a-z, digits to 0, white space and controls to a space."""
    fold = np.arange(256)
    fold[:33] = 32
    fold[ord("A") : ord("Z") + 1] += 32
    fold[ord("0") : ord("9") + 1] = ord("0")
    return fold


@dataclass
class ContextTrees:
    languages: list[str]
    symbol: np.ndarray  # uint8 of each byte
    step: np.ndarray  # next state, [state * symbols + symbol]
    bits: np.ndarray  # code lengths, [state * symbols + symbol, language]

    @classmethod
    def fit(cls, sample: list[tuple[str, str]], order: int = ORDER, most_cells: int = MOST_CELLS) -> ContextTrees:
        languages = sorted({lang for _, lang in sample})
        if not languages:
            return cls([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
        fold = folded_bytes()
        raw = [fold[np.frombuffer("\n".join(["", *(t for t, k in sample if k == lang), ""]).encode(), np.uint8)] for lang in languages]
        used = np.unique(np.concatenate(raw))
        symbol = np.full(256, len(used), np.int64)
        symbol[used] = np.arange(len(used))
        symbol = symbol[fold]
        a = len(used) + 1
        texts = [symbol[r] for r in raw]
        # contexts of length k are numbers in base a; grams[k][l] counts (context of length k, symbol)
        grams = []
        for k in range(order + 1):
            each = []
            for t in texts:
                code = np.zeros(max(0, len(t) - k), np.int64)
                for j in range(k + 1):
                    code = code * a + t[j : len(t) - k + j]
                each.append(np.unique(code, return_counts=True))
            grams.append(each)
        totals = []
        for k in range(1, order + 1):
            ctx, back = np.unique(np.concatenate([g // a for g, _ in grams[k]]), return_inverse=True)
            totals.append((ctx, np.bincount(back, np.concatenate([c for _, c in grams[k]]), len(ctx))))
        most = max(1, most_cells // (a * len(languages)))
        counts = np.sort(np.concatenate([n for _, n in totals]))[::-1]
        least = max(2, counts[most - 1] + 1 if len(counts) >= most else 2)
        kept = [np.zeros(1, np.int64), *(ctx[n >= least] for ctx, n in totals)]  # sorted contexts by length
        first = np.cumsum([0, *map(len, kept)])
        states = int(first[-1])
        step, p = np.zeros((states, a), np.int32), np.empty((len(languages), states, a))

        def find(k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(kept[k], codes)
            hit = np.zeros(len(codes), bool) if not len(kept[k]) else kept[k][np.minimum(at, len(kept[k]) - 1)] == codes
            return hit, first[k] + np.where(hit, at, 0)

        for k in range(order + 1):
            own = slice(first[k], first[k + 1])
            shorter = find(k - 1, kept[k] % a ** (k - 1))[1] if k else None
            # next state: the context with the symbol added where that is known, else as the shorter context goes on
            base = step[shorter] if k else np.zeros((1, a), np.int32)
            longer = (kept[k][:, None] * a + np.arange(a)).ravel()
            hit, to = find(k + 1, longer) if k < order else (np.zeros(len(longer), bool), None)
            step[own] = np.where(hit, to, base.ravel()).reshape(-1, a) if to is not None else base
            for lang in range(len(languages)):
                c = np.zeros((len(kept[k]), a))
                codes, n = grams[k][lang]
                hit, at = find(k, codes // a)
                c[at[hit] - first[k], codes[hit] % a] = n[hit]
                lower = p[lang, shorter] if k else np.full((1, a), 1 / a)
                seen = c > 0
                n, d = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
                rest = np.where(seen, 0, lower)
                left = rest.sum(1, keepdims=True)
                open_ = d * (left > 0)  # where all symbols were seen there is nothing to escape to
                with np.errstate(divide="ignore", invalid="ignore"):
                    own_p = np.where(seen, c / (n + open_), rest / left * (open_ / (n + open_)))
                p[lang, own] = np.where(n > 0, own_p, lower)
        bits = -np.log2(p).transpose(1, 2, 0).reshape(states * a, len(languages))
        return cls(languages, symbol.astype(np.uint8), step.ravel(), bits.astype(np.float32))

    def code_lengths(self, texts: list[bytes], order: int = ORDER) -> np.ndarray:
        """Bits of each text in each language. Long texts are scored in pieces that are joined exactly:
        a piece first reads the ``order`` bytes before it, which fix the state."""
        sizes = np.array([len(t) for t in texts])
        data = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        begins = np.cumsum(sizes) - sizes
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begins[owner] + number * SEGMENT
        stop = np.minimum(start + SEGMENT, (begins + sizes)[owner])
        at = np.where(number > 0, start - order, start)
        by_length = np.argsort(at - stop, kind="stable")
        owner, start, stop, at = owner[by_length], start[by_length], stop[by_length], at[by_length]
        lengths = stop - at
        state, total = np.zeros(len(at), np.int64), np.zeros((len(at), len(self.languages)))
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -t, "left"))  # pieces longer than t come first
            cell = state[:n] * self.symbols + data[at[:n] + t]
            if t >= order:
                total[:n] += self.bits[cell]
            else:
                total[:n] += self.bits[cell] * (at[:n] + t >= start[:n])[:, None]
            state[:n] = self.step[cell]
        out = np.zeros((len(texts), len(self.languages)))
        np.add.at(out, owner, total)
        return out

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 1

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        asked = [bool(t) and LETTER.search(t) is not None for t in texts]
        bits = self.code_lengths([t.encode() for t, ask in zip(texts, asked) if ask])
        answers: Iterator[tuple[str, float]] = iter(())
        if self.languages:
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(-1000, bits.min(1, keepdims=True) - bits)).sum(1)
            answers = iter(zip([self.languages[k] for k in best], share.tolist()))
        return [next(answers, (UNKNOWN, 0.0)) if ask else (UNKNOWN, 0.0) for ask in asked]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ContextTrees:
    """Fitted on text and lang of a bounded sample of the rows outside the held-out fold."""
    return ContextTrees.fit(label_sample(docs.where(id_bucket("doc_id", 4) != 2), "lang", per_language))


def identify(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    score is the shortest code's share among all codes, 1 where it is far shorter. A text that is null or
    without a letter is ``und`` with score 0; so is every text where no language was learned. Equal code
    lengths go to the language first by name. Repeated rows and null ids keep their rows; an empty table gives no
    rows. Very long texts are scored whole, in pieces side by side. Other columns of ``docs`` aren't read.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = model.value.predict(part.column(2).to_pylist())
                columns = [part.column(0), part.column(1), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (id_bucket("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
