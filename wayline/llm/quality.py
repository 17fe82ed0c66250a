"""Quality by Bradley-Terry ranking.

A document's strength is w . features(text). For a preferred document i and another j the model says
P(i before j) = 1 / (1 + exp(-w . (f_i - f_j))); w is learned by logistic loss on feature differences of
preference pairs. A score quantile of the labelled sample is the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, label_sample, tidied

PER_LABEL = 2_000  # labelled documents of either label to fit on
PAIRS = 60_000
THRESHOLD = 0.3
FLAT = 1e-9
FEATURES = 18
MARKS = re.compile(r"[^\w\s.,;:'\"()?!\-]")
LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> list[float]:
    """Shares that tell prose from junk; all zero but the first for a text without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (FEATURES - 1)
    chars = sum(map(len, words))
    letters = len("".join(LETTERS.findall(text)))
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lower = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    upper = int((code != lower).sum()) if len(code) == len(lower) else sum(map(str.isupper, text))
    digits = int(((code >= 48) & (code < 58)).sum())
    counts = Counter(words)
    common = counts.most_common(1)[0][1]
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    stops = sum(1 for w in words if w[-1] in ".?")
    windows = [words[k : k + 32] for k in range(0, n, 32)] if n > 32 else [words]
    fresh = sum(len(set(w)) for w in windows) / n
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    marks = len(MARKS.findall(text))
    return [
        0.0,
        math.log1p(n),
        upper / chars,
        letters / chars,
        marks / chars,
        min(1.0, text.count("!") / n),
        min(1.0, text.count("|") / n),
        digits / chars,
        len(counts) / n**0.85,
        common / n,
        same / n,
        1 - fresh,
        1 - triples,
        1 - len(set(lines)) / len(lines),
        stops / n,
        abs(chars / n - 5.5),
        1.0 / n,
        len(lines) / n,
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], seed: int = 7, pairs: int = PAIRS, steps: int = 300) -> Ranker:
        """Learn from preference pairs (a document of label 1 over one of label 0) of a labelled sample."""
        x = np.array([features(t) for t, _ in sample]).reshape(len(sample), FEATURES)
        y = np.array([k for _, k in sample], int)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):  # nothing to prefer: every text gets the prior
            return cls(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0)
        mean, scale = x.mean(0), x.std(0) + FLAT
        z = cls.wide((x - mean) / scale)
        rng = np.random.default_rng(seed)
        diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        weight, first, second = np.zeros(z.shape[1]), 0.0, 0.0
        for step in range(1, steps + 1):  # Adam on the logistic loss with a small ridge
            lost = 1 / (1 + np.exp(np.clip(diff @ weight, -30, 30)))
            grad = -(lost @ diff) / pairs + 1e-4 * weight
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            weight = weight - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        s = z @ weight
        # the quantile of the scores, both labels weighing the same, that parts them best, amid the gap there
        order = np.argsort(s)
        wrong = np.cumsum(np.where(y[order] == 1, 1 / len(good), -1 / len(bad)))
        k = int(wrong[:-1].argmin())
        cut = (s[order[k]] + s[order[k + 1]]) / 2
        spread = max(1e-6, np.median(np.abs(s - cut)))
        return cls(mean, scale, weight, float(cut), float(3 / spread))

    @staticmethod
    def wide(z: np.ndarray) -> np.ndarray:
        """Standardised features, both tails apart: a quality text is in the middle of most of them."""
        z = np.clip(z, -6, 6)
        return np.hstack([np.maximum(z, 0), np.minimum(z, 0)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; THRESHOLD where the ranking's score is at the learned quantile."""
        z = (np.array([features(t) for t in texts]).reshape(len(texts), FEATURES) - self.mean) / self.scale
        weight = self.weight if len(self.weight) == 2 * z.shape[1] else np.zeros(2 * z.shape[1])
        s = (self.wide(z) @ weight - self.cut) * self.slope + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Ranker:
    """Fitted on a bounded sample of the labelled rows outside the held-out fold; of clashing labels 0 holds."""
    known = labels.where(id_bucket("doc_id", 5) != 0).where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return Ranker.fit(label_sample(docs, "quality", per_label, labels=known))


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    A null or blank text is scored by the features of an empty one. Without labels of both kinds every
    score is THRESHOLD, and so predicted 1; a score that ties with it is 1 too. Repeated rows and null ids keep their
    rows and equal texts have equal scores; an empty table gives no rows. Very long texts are read whole. Other columns of
    ``docs`` aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = ranker.scores(b.column(2).to_pylist())
            columns = [b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (id_bucket("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns whatever their names, in one pass without a shuffle.

    Nulls, empty and very long texts, ties and repeated rows are as in ``score``; an empty table stays empty.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(ranker.scores(b.column(place).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(tidied(run), docs.schema)
