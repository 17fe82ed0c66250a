"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import re

import numpy as np
import pytest

import corpus_pipeline
from wayline.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies():
    """Texts of 200 words, each with copies in which some words are others: likeness 0.6 to 1."""
    rng = np.random.default_rng(7)
    out = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        out.append(" ".join(words))
        for n in (1, 2, 3, 4, 7):
            other = list(words)
            for at in rng.choice(200, n, replace=False):
                other[at] = f"x{k}-{n}-{at}"
            out.append(" ".join(other))
    return [*out, "", " \t ", "one two", "One  TWO", "three", *[f"a b c d e{k}" for k in range(5)]]


def wanted_groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if like(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


def test_near_stage_reaches_likeness_of_four_fifths(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert kept == sorted(set(wanted_groups(texts)))


def crowd(n, seed=3):
    """A template with small edits, and unrelated texts."""
    rng = np.random.default_rng(seed)
    words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    out = []
    for k in range(n):
        other = list(words)
        for at in rng.choice(150, rng.integers(1, 4), replace=False):
            other[at] = f"x{k}-{at}"
        out.append(" ".join(other))
    return out + [" ".join(f"v{x}" for x in rng.integers(0, 5000, 100)) for _ in range(n // 4)]


@pytest.mark.parametrize("most, aim", [(2048, 512), (64, 512), (64, 16)])
def test_crowded_groups_and_several_tables(spark, most, aim):
    texts = near_copies() + crowd(240)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = wanted_groups(texts)
    root = {r["doc_id"]: r["root"] for r in simhash.like_groups(docs, most=most, aim=aim).collect()}
    pairs = {(wanted[k], root[k]) for k in range(len(texts))}
    assert len(pairs) == len({w for w, _ in pairs}) == len({r for _, r in pairs})


def test_tables_reach_the_recall():
    """Of pairs of sets of likeness 0.8, all but about MISS meet in a table, and within the reach."""
    rng = np.random.default_rng(5)
    masks = np.array(simhash.tables(200_000)).view(np.uint64)
    assert len(masks) > 1
    met = 0
    for _ in range(600):
        n = int(rng.integers(40, 400)) * 9
        a, only = rng.integers(-(2**62), 2**62, n // 9 * 8), rng.integers(-(2**62), 2**62, n // 9 * 2)
        x, y = (simhash.wide_majority(np.r_[a, part]).view(np.uint64) for part in np.split(only, 2))
        differ = x ^ y
        met += bool(((differ & masks) == 0).all(1).any()) and np.bitwise_count(differ).sum() <= simhash.REACH
    assert met >= 0.98 * 600


def test_null_and_repeated_ids_lose_no_unrelated_text(spark):
    rng = np.random.default_rng(9)
    a, b, c, d, e = (" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) for _ in range(5))
    given = [(None, a), (None, b), (None, c + " more"), (None, c), (None, a), (3, c), (5, d), (5, e), (5, e), (8, d + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near(docs).collect()]
    empty = [row for row in kept if not row[1]]
    assert len(empty) == 1 and empty[0][0] is None
    assert sorted(map(repr, (row for row in kept if row[1]))) == sorted(map(repr, [(None, a), (None, b), (3, c), (5, d), (5, e)]))


def test_a_crowd_that_is_not_alike_enough_makes_few_pairs(spark, monkeypatch):
    """Edits of a template, 0.4 to 0.9 alike: the pairs compared grow with the texts, not with their square, and no link is lost."""
    rng = np.random.default_rng(11)
    words, texts = [f"w{x}" for x in rng.integers(0, 5000, 150)], []
    for k in range(400):
        other = list(words)
        for at in rng.choice(150, rng.integers(1, 10), replace=False):
            other[at] = f"x{k}-{at}"
        texts.append(" ".join(other))
    compared, alike = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda docs, heads, pairs, *rest: compared.append(pairs.count()) or alike(docs, heads, pairs, *rest))
    root = {r["doc_id"]: r["root"] for r in simhash.like_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wanted = wanted_groups(texts)
    pairs = {(wanted[k], root[k]) for k in range(len(texts))}
    assert len(pairs) == len({w for w, _ in pairs}) == len({r for _, r in pairs})
    assert sum(compared) < 10 * len(texts)
