"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. A bidirectional LSTM in numpy reads for each block the averaged
vectors of its hashed tag path and of its hashed words, and a few numbers; it labels every block as main
text or not, with the whole page as context. It is trained on made-up pages of many layouts, whose labels
are known by construction, with a fixed seed. The weights are kept in html_weights.npz, which

    python -m wayline.llm.html_extract

makes anew in a minute or two; no page of the corpus is needed to fit.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import blocks
from .html_layouts import MAIN, OTHER, Layouts

PATH_BUCKETS, PATH_DIMENSIONS = 4096, 16
WORD_BUCKETS, WORD_DIMENSIONS = 2048, 6
NUMBERS = 5
HIDDEN = 20
WIDTH = PATH_DIMENSIONS + WORD_DIMENSIONS + NUMBERS
PAGES, ROUNDS, BATCH, SEED = 9_000, 7, 40, 11
WEIGHTS = os.path.join(os.path.dirname(__file__), "html_weights.npz")

Block = tuple[tuple[str, ...], str, int]
Seen = tuple[np.ndarray, np.ndarray, list[float]]  # path ids, word ids and numbers of a block


def bucket(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode()) % buckets


@lru_cache(maxsize=20_000)
def path_ids(path: tuple[str, ...]) -> np.ndarray:
    """Hashed words of a tag path: each element's name and marks anywhere above, and the last ones by place."""
    found = {"depth " + str(min(9, len(path)))}
    for k, entry in enumerate(path):
        found.update("in " + w for w in entry.replace("-", " ").replace("_", " ").split())
        if k >= len(path) - 3:
            found.add(f"last {len(path) - k} {entry.split()[0]}")
    return np.array([bucket(f, PATH_BUCKETS) for f in sorted(found)])


def word_ids(text: str) -> np.ndarray:
    crc = zlib.crc32
    return np.array([crc(w) for w in text.lower().encode().split()] or [0]) % WORD_BUCKETS


def numbers(path: tuple[str, ...], text: str, linked: int) -> list[float]:
    n = len(text)
    return [np.log1p(n) / 4, min(1.0, linked / n), float(text[-1] in ".!?"), np.log1p(text.count(" ")) / 4, float("©" in text)]


def seen(block: Block) -> Seen:
    return path_ids(block[0]), word_ids(block[1]), numbers(*block)


class Layer:
    """One direction of the LSTM over padded sequences [time, page, width]."""

    def __init__(self, rng: np.random.Generator):
        self.p = [rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN)), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]]

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        wx, wh, b = self.p
        pre = x @ wx + b
        h, c = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        out, kept = np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)):
            a = pre[t] + h @ wh
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = np.split(gates, 3, 1)
            g, before, was = np.tanh(a[:, 3 * HIDDEN :]), c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = out[t] = o * s
            if keep:
                kept.append((i, f, o, g, before, was, s))
        return out, kept

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        wx, wh, _ = self.p
        d_pre = np.empty((*x.shape[:2], 4 * HIDDEN))
        d_h, d_c, d_wh = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:]), np.zeros_like(wh)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, was, s = kept[t]
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - s * s)
            d_pre[t] = np.hstack([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * s * o * (1 - o), d_c * i * (1 - g * g)])
            d_wh += was.T @ d_pre[t]
            d_h, d_c = d_pre[t] @ wh.T, d_c * f
        flat = d_pre.reshape(-1, 4 * HIDDEN)
        return d_pre @ wx.T, [x.reshape(-1, WIDTH).T @ flat, d_wh, flat.sum(0)]


class BlockLabeller:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.paths = rng.normal(0, 0.5, (PATH_BUCKETS, PATH_DIMENSIONS))
        self.words = rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIMENSIONS))
        self.layers = [Layer(rng), Layer(rng)]
        self.out = [rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)]

    def parameters(self) -> list[np.ndarray]:
        return [self.paths, self.words, *self.layers[0].p, *self.layers[1].p, *self.out]

    @staticmethod
    def gathered(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, first of each block, number in each block); every block has an id."""
        n = np.array([len(i) for i in ids])
        return np.concatenate(ids), np.cumsum(n) - n, n

    def inputs(self, pages: list[list[Seen]]) -> tuple[list[np.ndarray], tuple, tuple]:
        """The input rows of every page, and the gathered path and word ids of all their blocks."""
        every = [block for page in pages for block in page]
        of_path, of_word = self.gathered([p for p, _, _ in every]), self.gathered([w for _, w, _ in every])
        means = [np.add.reduceat(table[ids], first) / n[:, None] for table, (ids, first, n) in ((self.paths, of_path), (self.words, of_word))]
        x = np.hstack([*means, np.array([n for _, _, n in every])])
        return np.split(x, np.cumsum([len(p) for p in pages])[:-1]), of_path, of_word

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, valid, reversed place) for pages of different lengths; padding stands after either end."""
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((lengths.max(), len(pages), pages[0].shape[1]))
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        t = np.arange(len(x))[:, None]
        return x, t < lengths, np.where(t < lengths, lengths - 1 - t, t)

    def logits(self, x: np.ndarray, turned: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        page = np.arange(x.shape[1])
        back = x[turned, page]
        ahead, kept = self.layers[0].forward(x, keep)
        behind, kept2 = self.layers[1].forward(back, keep)
        both = np.concatenate([ahead, behind[turned, page]], 2)
        return both @ self.out[0] + self.out[1], [both, back, kept, kept2]

    def step(self, pages: list[list[Seen]], labels: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients of the cross-entropy of one batch, in the order of parameters()."""
        rows, of_path, of_word = self.inputs(pages)
        x, valid, turned = self.padded(rows)
        y = self.padded([v[:, None] for v in labels])[0][:, :, 0]
        page = np.arange(len(pages))
        logit, (both, back, kept, kept2) = self.logits(x, turned, True)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * valid / valid.sum()
        d_both = d[:, :, None] * self.out[0]
        d_x, grads = self.layers[0].backward(x, kept, d_both[:, :, :HIDDEN])
        d_back, grads2 = self.layers[1].backward(back, kept2, d_both[turned, page, HIDDEN:])
        d_x = d_x + d_back[turned, page]
        d_rows = d_x.transpose(1, 0, 2)[valid.T]
        shares = (of_path, d_rows[:, :PATH_DIMENSIONS]), (of_word, d_rows[:, PATH_DIMENSIONS:-NUMBERS])
        d_paths, d_words = (
            np.stack([np.bincount(ids, np.repeat(part[:, d] / n, n), len(table)) for d in range(part.shape[1])], 1)
            for ((ids, _, n), part), table in zip(shares, (self.paths, self.words))
        )
        return [d_paths, d_words, *grads, *grads2, (both * d[:, :, None]).sum((0, 1)), np.array([d.sum()])]

    def train(self, pages: list[list[Block]], labels: list[np.ndarray], rounds: int = ROUNDS, batch: int = BATCH, seed: int = SEED) -> BlockLabeller:
        """Adam; pages of like length go together."""
        rng = np.random.default_rng(seed)
        known = [[seen(block) for block in page] for page in pages]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        order = np.argsort([len(p) for p in pages], kind="stable")
        chunks = [order[k : k + batch] for k in range(0, len(order), batch)]
        done = 0
        for r in range(rounds):
            for c in rng.permutation(len(chunks)):
                grads = self.step([known[k] for k in chunks[c]], [labels[k] for k in chunks[c]])
                done += 1
                rate = 0.012 * (1 - r / rounds)
                for p, g, (m, v) in zip(self.parameters(), grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Per page, whether each block is main text. Pages of like length go together, so padding is small."""
        answers = [np.zeros(0, bool)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if pages[k]]
        at = 0
        while at < len(order):
            end = at + 1
            while end < min(len(order), at + 256) and (end - at + 1) * len(pages[order[end]]) <= 100_000:
                end += 1
            some = order[at:end]
            x, _, turned = self.padded(self.inputs([[seen(block) for block in pages[k]] for k in some])[0])
            logit, _ = self.logits(x, turned)
            for j, k in enumerate(some):
                answers[k] = logit[: len(pages[k]), j] > 0
            at = end
        return answers


def made_up(count: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages of known labels: as blocks, and 1 for main text."""
    layouts, pages, labels = Layouts(seed), [], []
    while len(pages) < count:
        found = blocks(layouts.page())
        if found:
            labels.append(np.array([float(MAIN in text) for _, text, _ in found]))
            pages.append([(path, text.replace(MAIN, "").replace(OTHER, ""), linked) for path, text, linked in found])
    return pages, labels


@lru_cache(maxsize=1)
def labeller() -> BlockLabeller:
    """The trained model, read from its file on the driver."""
    model = BlockLabeller()
    with np.load(WEIGHTS) as kept:
        for k, p in enumerate(model.parameters()):
            p[...] = kept[f"p{k}"]
    return model


def train_and_keep() -> None:
    model = BlockLabeller().train(*made_up(PAGES, SEED))
    np.savez_compressed(WEIGHTS, **{f"p{k}": p.astype(np.float16) for k, p in enumerate(model.parameters())})


def main_texts(model: BlockLabeller, pages: list[str | None]) -> list[str]:
    split = [blocks(p) if p else [] for p in pages]
    return ["\n".join(text for (_, text, _), keep in zip(page, kept) if keep) for page, kept in zip(split, model.label(split))]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, its blocks joined by line feeds.

    A null or empty page, or one without main text, has the empty text. Broken markup is read as far as it
    goes. Repeated rows and null ids keep their rows; an empty table gives no rows. A very long page is read and labelled
    whole, in time in proportion to it. Columns other than page_id, url and html aren't read.
    """
    model = pages.sparkSession.sparkContext.broadcast(labeller())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = main_texts(model.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    train_and_keep()
