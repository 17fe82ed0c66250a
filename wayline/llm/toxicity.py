"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams and of itself. A bag of words is the average
of its different words' vectors, and a linear softmax on it gives the two classes. Words never seen share
the vectors of their n-grams, so a misspelling or a new ending of a toxic word lies near it.

A text is scored in overlapping windows of several lengths, each a bag, as a whole, and by the bags of its few most toxic
different words. The most toxic window of each length counts, so that neither a toxic passage is averaged away in a long text
nor toxic words that are strewn thinly are missed; a bag of few words is filled up with neutral ones, and a word counts again only after AGAIN others.
Learned on texts that the vectors weren't trained on, a logistic sum of these logits is the score, shifted so that even odds stand at
the threshold.
After training, vectors and softmax weights fold into one number a word.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, label_sample

PER_LABEL = 3_000  # labelled documents of either label to fit on
SIZES = (3, 4, 5)
DIMENSIONS = 8
SCALES = (12, 48, 192)  # words of a window
WORST = (1, 2, 3, 4, 6)  # different words of a bag of the most toxic ones
BAGS = len(SCALES) + 1 + len(WORST)  # that score a text
TRAINED = (96, 12)  # words of the bags of the first training and of the second
AGAIN = 256  # words after which a word counts again
RIDGE = 0.1
EPOCHS = 6
LEAST_SHARE = 1 / 150  # of the training bags must hold a subword for it to have a vector; what is rarer would be learned by heart
LEAST_SEEN = 3
BAGS_EACH = 60  # windows of a text to train on, at most
MOST_BAGS = 24_000  # windows of either label to train on, about
THRESHOLD = 0.7
MOST_CACHED = 200_000
WORDS = re.compile(r"\w+")


def subwords(word: str) -> list[str]:
    """Of a lower-cased word: its n-grams, with marks at both ends, and itself."""
    marked = f"<{word}>"
    last = len(marked) + 1
    return [marked[k : k + n] for n in SIZES for k in range(last - n)] + [f"={word}"]


@dataclass
class SubwordSoftmax:
    weight: dict[str, float]  # per subword: its part of the toxic logit less the other; 0 for all others
    bias: float = 0.0
    scale: tuple[np.ndarray, float] = (np.zeros(BAGS), 0.0)
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    score_of: list[float] = field(default_factory=lambda: [0.0], repr=False)

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], seed: int = 5, epochs: int = EPOCHS) -> SubwordSoftmax:
        """Train on windows of a labelled sample: first on random wide ones, then, of each toxic text, on the narrow ones
        that the first model finds most toxic, since the label holds for the text and not for all of it."""
        labels = np.array([int(k) for _, k in sample], int)
        if len(set(labels.tolist())) < 2:  # nothing to tell apart: no text is called toxic
            return cls({}, 0.0, (np.zeros(BAGS), -1.0))
        rng = np.random.default_rng(seed)
        calibrates = rng.permutation(len(sample)) % 4 == 0
        kept: dict[str, str] = {}  # a word is one object, however often it stands there
        texts = [[kept.setdefault(w, w) for w in WORDS.findall(t.lower())] for t, _ in sample]
        train = np.flatnonzero(~calibrates)
        of_label = np.bincount(labels[train], minlength=2)
        each = np.clip(MOST_BAGS // np.maximum(1, of_label), 4, BAGS_EACH)

        def random_bags(words: list[str], label: int, window: int) -> list[list[str]]:
            starts = rng.choice(max(1, len(words) - window // 2), min(each[label], 1 + len(words) // window), replace=False)
            return [words[k : k + window] for k in starts]

        wide, narrow = TRAINED
        made = cls.trained([(bag, labels[k]) for k in train for bag in random_bags(texts[k], labels[k], wide)], rng, epochs, wide)
        bags = []
        for k in train:
            if labels[k] == 1:
                sums, step = made.window_sums(made.word_scores(texts[k])[0], narrow)
                worst = np.argsort(-sums, kind="stable")[: each[1]]
                worst = [w for w in worst if sums[w] / narrow + made.bias > 0] or worst[:1]
                bags += [(texts[k][w * step : w * step + narrow], 1) for w in worst]
            else:
                bags += [(bag, 0) for bag in random_bags(texts[k], labels[k], narrow)]
        made = cls.trained(bags, rng, epochs, narrow)
        apart = np.flatnonzero(calibrates)
        made.scale = calibrated(np.array([made.logits(texts[k]) for k in apart]), labels[apart])
        made.cache, made.score_of = {}, [0.0]
        return made

    @classmethod
    def trained(cls, bags: list[tuple[list[str], int]], rng: np.random.Generator, epochs: int, full: int) -> SubwordSoftmax:
        """Vectors and softmax by AdaGrad on the cross-entropy of small batches of bags (of ``full`` words, neutral ones
        included), both labels weighing the same."""
        uses = Counter(w for words, _ in bags for w in set(words))
        least = max(LEAST_SEEN, LEAST_SHARE * len(bags))
        seen: Counter = Counter()
        for w, n in uses.items():
            for gram in subwords(w):
                if gram[0] != "=" or n >= least:  # a word itself is seen as often as it is used
                    seen[gram] += n
        known = {gram: k for k, gram in enumerate(sorted(g for g, n in seen.items() if n >= least))}
        del seen
        number, size, part_of, flat = {w: k for k, w in enumerate(uses)}, np.empty(len(uses), np.int64), np.empty(len(uses), np.float32), array("i")
        for k, w in enumerate(uses):
            own = subwords(w)
            held = len(flat)
            flat.extend(known[g] for g in own if g in known)
            size[k], part_of[k] = len(flat) - held, 1 / len(own)
        grams, first = np.array(flat, np.int32), np.cumsum(size) - size
        rows = [np.array(sorted({number[w] for w in words}), np.int32) for words, _ in bags]
        labels = np.array([k for _, k in bags], int)
        balance = np.array([0.5 / max(1, (labels == k).sum()) for k in (0, 1)]) * len(bags)
        vectors = rng.normal(0, 0.1, (len(known), DIMENSIONS)).astype(np.float32)
        softmax, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
        sums = [np.full(len(known), 1e-10, np.float32), np.full(softmax.shape, 1e-10, np.float32), np.full(2, 1e-10, np.float32)]
        order = np.arange(len(bags))
        for _ in range(epochs):
            rng.shuffle(order)
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                words, many = np.concatenate([rows[k] for k in batch]), np.array([len(rows[k]) for k in batch])
                each = size[words]
                ids = grams[np.repeat(first[words] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                owner = np.repeat(np.repeat(np.arange(len(batch)), many), each)
                share = np.repeat(part_of[words], each) / np.maximum(full, many)[owner]
                hidden = np.stack([np.bincount(owner, vectors[ids, d] * share, len(batch)) for d in range(DIMENSIONS)], 1)
                out = hidden @ softmax + bias
                p = np.exp(out - out.max(1, keepdims=True))
                error = p / p.sum(1, keepdims=True)
                error[np.arange(len(batch)), labels[batch]] -= 1
                error *= balance[labels[batch]][:, None]
                down = error @ softmax.T
                for k, (part, grad) in enumerate(((softmax, hidden.T @ error), (bias, error.sum(0)))):
                    sums[k + 1] += (grad**2).astype(np.float32)
                    part -= (0.2 * grad / np.sqrt(sums[k + 1])).astype(np.float32)
                total = np.stack([np.bincount(ids, down[owner, d] * share, len(known)) for d in range(DIMENSIONS)], 1).astype(np.float32)
                sums[0] += (total**2).mean(1)
                vectors -= 0.5 * total / np.sqrt(sums[0])[:, None]
        side = softmax[:, 1] - softmax[:, 0]
        return cls(dict(zip(known, (vectors @ side).astype(float).tolist())), float(bias[1] - bias[0]))

    def place(self, word: str) -> int:
        """The place of a word's number in score_of."""
        if len(self.score_of) > MOST_CACHED:
            self.cache, self.score_of = {}, [0.0]
        grams, weight = subwords(word), self.weight
        self.score_of.append(sum([weight[g] for g in grams if g in weight]) / len(grams))
        self.cache[word] = len(self.score_of) - 1
        return len(self.score_of) - 1

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, 0 for one that stood within the last AGAIN words; and those of the different words."""
        scores, places = np.empty(len(words)), np.empty(len(words), np.int64)
        number: dict[str, int] = {}
        for at in range(0, len(words), 4096):  # a part at a time, as places are reused when the cache is full
            part = words[at : at + 4096]
            if len(self.cache) + len(part) > MOST_CACHED:
                self.cache, self.score_of = {}, [0.0]
            get = self.cache.get
            scores[at : at + len(part)] = [self.score_of[get(w) or self.place(w)] for w in part]
            places[at : at + len(part)] = [number.setdefault(w, len(number)) for w in part]
        order = np.argsort(places, kind="stable")
        again = (places[order][1:] == places[order][:-1]) & (np.diff(order) <= AGAIN)
        different = scores[order[np.r_[True, places[order][1:] != places[order][:-1]]]] if len(words) else scores
        scores[order[1:][again]] = 0.0
        return scores, different

    @staticmethod
    def window_sums(scores: np.ndarray, window: int) -> tuple[np.ndarray, int]:
        """Sums over windows, and from how many words to how many they start."""
        upto, step = np.r_[0.0, np.cumsum(scores)], window // 4
        starts = np.arange(0, max(1, len(scores) - window + step), step)
        return upto[np.minimum(starts + window, len(scores))] - upto[starts], step

    def logits(self, words: list[str]) -> list[float]:
        """Of the most toxic window of each length, of the whole text, and of its most toxic different words; the bias alone without words."""
        scores, different = self.word_scores(words)
        each = [self.window_sums(scores, window)[0].max() / window for window in SCALES]
        most = min(len(different), WORST[-1])
        worst = np.zeros(WORST[-1])  # neutral words fill it up
        worst[:most] = np.sort(np.maximum(0.0, np.partition(different, len(different) - most)[len(different) - most :]))[::-1] if most else 0.0
        upto = np.cumsum(worst)
        return [self.bias + x for x in (*each, scores.sum() / max(SCALES[-1], len(scores)), *(upto[k - 1] / k for k in WORST))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.scale
        logits = np.array([self.logits(WORDS.findall((t or "").lower())) for t in texts]).reshape(len(texts), BAGS)
        return 1 / (1 + np.exp(-np.clip(logits @ a + b, -50, 50)))


def calibrated(logit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift that make rows of logits odds of even ones at THRESHOLD, on texts that training has not seen; smoothed targets."""
    if len(set(label.tolist())) < 2:
        return np.full(logit.shape[1], 1 / logit.shape[1]), 0.0
    goal = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    mean, spread = logit.mean(0), logit.std(0) + 1e-9
    x = np.hstack([(logit - mean) / spread, np.ones((len(logit), 1))])
    ridge, w = np.r_[np.full(logit.shape[1], RIDGE), 1e-6], np.r_[np.full(logit.shape[1], 0.3), 0.0]
    for _ in range(200):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - goal) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum()) + math.log(THRESHOLD / (1 - THRESHOLD))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> SubwordSoftmax:
    """Fitted on a bounded sample of the labelled rows outside the held-out fold; of clashing labels 1 holds."""
    known = labels.where(id_bucket("doc_id", 3) != 1).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return SubwordSoftmax.fit(label_sample(docs, "toxic", per_label, labels=known))


def score(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    A text without words, a null one too, has the score of the bias alone (neutral words). Without labels of both kinds no
    text is predicted toxic. Repeated rows and null ids keep their rows and equal texts have equal scores; an empty
    table gives no rows. Very long texts are scored whole. Other columns of ``docs`` aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(2).to_pylist())
            columns = [b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (id_bucket("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
