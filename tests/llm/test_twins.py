"""Operators that SQL can't express against slow, plain twins written from their description."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayline.llm import langid, minhash, mixing, quality, toxicity

# --- source mixing: targets by water filling, the golden-ratio schedule slot by slot, blocks of shuffled lines


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, open_, target = float(sum(sizes.values())), list(names), {}
    left = total
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > epochs * sizes[s] + 1e-12]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


@pytest.mark.parametrize("given", [
    {"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, None: 300}, {"a": 1, "b": 1, "c": 900, "d": 40, "e": 7}, {"a": 0, "b": 50}, {None: 12},
])
def test_targets(spark, given):
    rows = [(k, s, n) for k, (s, n) in enumerate(given.items())]
    got = mixing.targets(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")).collect()
    wanted = plain_targets(given)
    assert {r["source"]: r["target"] for r in got} == pytest.approx(wanted)
    assert sum(r["target"] for r in got) == pytest.approx(sum(given.values()))


def test_schedule_slot_by_slot(spark):
    table = mixing.targets(spark.createDataFrame([(1, "a", 700), (2, "b", 200), (3, "c", 150), (4, None, 3)], "doc_id bigint, source string, size bigint"))
    parts = sorted((r["sidx"], r["lo"], r["hi"]) for r in table.collect())
    nth = Counter()
    wanted = []
    for slot in range(5000):
        point = slot % mixing.UNIT * mixing.GOLDEN % mixing.UNIT
        source = next(s for s, lo, hi in parts if lo <= point < hi)
        wanted.append((slot, source, nth[source]))
        nth[source] += 1
    assert sorted((r["slot"], r["sidx"], r["nth"]) for r in mixing.schedule(table, 5000).collect()) == wanted
    whole = parts[-1][2]
    for s, lo, hi in parts:  # low discrepancy: every stretch has its share but for a few slots
        for a, b in ((0, 100), (1000, 1400), (0, 5000)):
            assert abs(sum(x == s for _, x, _ in wanted[a:b]) - (b - a) * (hi - lo) / whole) < 5


def test_mix_block_by_block(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(["w"] * rng.randint(0, 60)), "abc"[k % 3] if k % 7 else None) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    mixed, pieces = mixing.mix(frame, slots_aimed=400, block_most=16)
    own = {r["rid"]: r for r in mixed.collect()}
    each = defaultdict(int)
    for p in pieces.collect():
        assert p["words"] > 0
        each[p["rid"]] += p["words"]
    assert {k: r["taken"] for k, r in own.items()} == {k: each.get(k, 0) for k in own}
    size = {d: len(t.split()) for d, t, _ in docs}
    sources = Counter()
    for d, _, s in docs:
        sources[s] += size[d]
    targets = plain_targets(sources)
    taken = Counter()
    for r in own.values():
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sources[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    block = max(1, min(16, -(-sum(sources.values()) // 400)))
    assert all(abs(taken[s] - targets[s]) <= 6 * block for s in sources)


# --- language: prediction by partial matching from dictionaries of counts


class PlainTree:
    """Counts by context; escape as often as there are different symbols, symbols that were seen left out of shorter contexts."""

    def __init__(self, data, order, symbols, contexts):
        self.order, self.symbols, self.contexts = order, symbols, contexts
        self.counts = defaultdict(Counter)
        for k in range(order + 1):
            for at in range(k, len(data)):
                self.counts[tuple(data[at - k : at])][data[at]] += 1

    def p(self, context, symbol):
        if not context:
            lower = 1 / self.symbols
            lower_of = lambda s: lower
        else:
            lower_of = lambda s: self.p(context[1:], s)
        seen = self.counts.get(context)
        if not seen:
            return lower_of(symbol)
        n, d = sum(seen.values()), len(seen)
        left = sum(lower_of(s) for s in range(self.symbols) if s not in seen)
        escapes = d if left > 0 else 0
        return seen[symbol] / (n + escapes) if symbol in seen else lower_of(symbol) / left * escapes / (n + escapes)


def test_code_lengths_of_a_plain_tree():
    sample = [("ab abc abd", "x"), ("ba bab bad", "x"), ("cd cdc ddc", "y"), ("dc ab", "y")]
    order = 2
    trees = langid.ContextTrees.fit(sample, order)
    fold = langid.folded_bytes()
    lines = {k: [int(trees.symbol[b]) for b in fold[np.frombuffer("\n".join(["", *(t for t, x in sample if x == k), ""]).encode(), np.uint8)]] for k in ("x", "y")}
    # a context is kept if it was seen twice in all languages together
    both = Counter()
    for data in lines.values():
        for k in range(1, order + 1):
            both.update(tuple(data[at - k : at]) for at in range(k, len(data)))
    contexts = {c for c, n in both.items() if n >= 2} | {()}
    plain = [PlainTree(lines[k], order, trees.symbols, contexts) for k in trees.languages]
    texts = ["abd", "cdcd ab", "zz AB 9", "", "dab" * 3]
    got = trees.code_lengths([t.encode() for t in texts], order)
    for text, bits in zip(texts, got):
        data = [int(trees.symbol[b]) for b in text.encode()]
        for tree, have in zip(plain, bits):
            total, state = 0.0, ()
            for s in data:
                total -= math.log2(tree.p(state, s))
                longer = (*state, s)[-order:]
                while longer not in contexts:
                    longer = longer[1:]
                state = longer
            assert have == pytest.approx(total, rel=1e-5, abs=1e-5)


# --- quality: the gradient of the pair loss


def test_pair_loss_falls_along_the_learned_weights():
    rng = np.random.default_rng(2)
    words = "river mill people evening talk weather harvest walk past old".split()
    good = [" ".join(rng.choice(words, int(rng.integers(30, 60)))) + "." for _ in range(40)]
    bad = ["!!! BUY " * int(rng.integers(3, 9)) + " ".join(rng.choice(words, 5)) for _ in range(40)]
    sample = [(t, 1) for t in good] + [(t, 0) for t in bad]
    ranker = quality.Ranker.fit(sample, pairs=400, steps=200)
    z = quality.Ranker.wide((np.array([quality.features(t) for t, _ in sample]) - ranker.mean) / ranker.scale)
    every = (z[:40, None] - z[None, 40:]).reshape(-1, z.shape[1])  # all pairs, by hand

    def loss(w):
        return np.log1p(np.exp(-every @ w)).mean()

    def gradient(w):
        return -(every / (1 + np.exp(every @ w))[:, None]).mean(0)

    w = rng.normal(0, 0.1, z.shape[1])
    numeric = [(loss(w + 1e-6 * e) - loss(w - 1e-6 * e)) / 2e-6 for e in np.eye(len(w))]
    assert gradient(w) == pytest.approx(numeric, abs=1e-6)
    assert loss(ranker.weight) < 0.05 < loss(np.zeros(len(w)))
    order = z @ ranker.weight
    right = (order[:40, None] > order[None, 40:]).mean()
    assert right > 0.99 and np.all(np.diff(ranker.scores([t for t, _ in sample])[np.argsort(order)]) >= 0)


# --- fingerprints: one-permutation hashing, bin by bin


def plain_fingerprint(text, bins=minhash.BINS, bits=minhash.BITS, width=minhash.WIDTH):
    words = text.encode().split()
    if not words:
        return []
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = {xxhash.xxh64_intdigest(s, 42) for s in shingles}
    least = {}
    for h in hashes:
        b = h * bins >> 64
        least[b] = min(h, least.get(b, 1 << 64))
    walks, out = minhash.walks(bins), []
    for b in range(bins):
        if b in least:
            value = least[b]
        else:
            value = next((least[int(row[b])] for row in walks if int(row[b]) in least), min(hashes))
        z = (value + b * 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 32) * 0xD6E8FEB86659FD93 % 2**64
        z = (z ^ z >> 32) * 0xD6E8FEB86659FD93 % 2**64
        out.append(z >> 64 - bits)
    return out


def plain_likeness(a, b, bits=minhash.BITS):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    return min(1.0, max(0.0, (same - 2**-bits) / (1 - 2**-bits)))


def test_fingerprints_bin_by_bin():
    rng = random.Random(3)
    texts = ["", " \n", "one", "one two three four", " ".join(f"w{rng.randint(0, 9)}" for _ in range(40)), " ".join(f"w{k}" for k in range(3000))]
    texts.append(" ".join(f"w{k}" for k in range(2700)) + " other end")
    plain, own = [plain_fingerprint(t) for t in texts], [minhash.fingerprint(t) for t in texts]
    for p, f in zip(plain, own):
        assert f == (int("".join(f"{x:0{minhash.BITS}b}" for x in p), 2).to_bytes(len(p) * minhash.BITS // 8, "big") if p else b"")
    for p, f in zip(plain, own):
        for q, g in zip(plain, own):
            assert minhash.likeness(f, g) == pytest.approx(plain_likeness(p, q))


# --- toxicity: bags of words made of n-grams, window by window


def test_scores_window_by_window():
    rng = np.random.default_rng(6)
    bag = [f"{a}{b}" for a in ("ro", "mi", "ta", "len", "vor") for b in ("na", "der", "ing", "tos")]
    sample = [(" ".join(rng.choice(bag, 40).tolist() + ["idiot", "moron"] * (k % 4 == 0)), int(k % 4 == 0)) for k in range(240)]
    model = toxicity.SubwordSoftmax.fit(sample, epochs=2)

    def word(w):
        grams = [f"<{w}>"[k : k + n] for n in toxicity.SIZES for k in range(len(w) + 3 - n)] + [f"={w}"]
        return sum(model.weight.get(g, 0.0) for g in grams) / len(grams)

    for text in [*[t for t, _ in sample[:12]], "idiot " * 400 + "rona midér", "", "!!", "one idiot"]:
        words = re.findall(r"\w+", text.lower())
        last, scores = {}, []
        for k, w in enumerate(words):
            scores.append(0.0 if w in last and k - last[w] <= toxicity.AGAIN else word(w))
            last[w] = k
        logits = []
        for size in toxicity.SCALES:
            step = size // 4
            starts = range(0, max(1, len(words) - size + step), step)
            logits.append(max(sum(scores[k : k + size]) for k in starts) / size)
        logits.append(sum(scores) / max(toxicity.SCALES[-1], len(words)))
        worst = sorted((max(0.0, word(w)) for w in set(words)), reverse=True) + [0.0] * toxicity.WORST[-1]
        logits += [sum(worst[:k]) / k for k in toxicity.WORST]
        a, b = model.scale
        z = sum((model.bias + x) * y for x, y in zip(logits, a)) + b
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))), abs=1e-9)


def test_training_lowers_the_cross_entropy():
    bags = [(["good", "word", f"w{k % 7}"] + ["nasty"] * (k % 2), k % 2) for k in range(120)]

    def loss(model):
        z = [model.bias + sum(sum(model.weight.get(g, 0.0) for g in toxicity.subwords(w)) / len(toxicity.subwords(w)) for w in set(words)) / 4 for words, _ in bags]
        return np.mean([math.log1p(math.exp(-v if k else v)) for v, (_, k) in zip(z, bags)])

    short, long_ = (toxicity.SubwordSoftmax.trained(bags, np.random.default_rng(1), epochs, 4) for epochs in (1, 12))
    assert loss(long_) < loss(short) < math.log(2) and loss(long_) < 0.1


# --- stages and operators with nulls and clashing names


def test_stages_with_nulls_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    words = "the river runs past old mill and people walk along it every evening".split()
    rows = [(k, " ".join(rng.choices(words, k=60)) + ".", "en", f"s{k % 2}", 5, "x", 1, 2.0, True) for k in range(60)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, rows[0][1], None, None, None, None, None, None, None), (7, rows[7][1], "en", "s1", 5, "x", 1, 2.0, True), (100, "", "en", None, 0, "x", 1, 2.0, False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, times int, taken double, maybe boolean")
    spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        found = out.collect()
        texts = {r["text"] for r in docs.select("text").collect()}
        assert {r["text"] for r in found} <= texts, name
        if name == "exact dedup":
            assert len({r["text"] or "" for r in found}) == len(found) == len({t or "" for t in texts})
        docs = corpus_pipeline.cut(out, f"twin-{k}")
    assert docs.where(F.col("text").isNotNull()).count() > 0
