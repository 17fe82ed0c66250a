"""op10's ids are the library's encoding, its N best are the lattice's best by full enumeration; op9's counts are the
library's at every prefix, and budget questions are answered from the stored counts."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wayline.llm import nbest, prefix_tokens
from wayline.llm.pieces import Merges, model_path, open_model

TEXTS = [
    "The river runs past the old mill and the people walk along it.", "the old mill", "né 𝄞 🙂", "  two  spaces ", "a", "", "tab\there\n\nline", "aaaaaaaaaaaaaaa", "▁▁ <s>x</s> 1234567",
    "a\x00b\x7f", "中文 и русский", "!!!... --- ((()))", "don't.stop/it_now",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 7) for k, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids int")


def test_ids_are_the_library_encoding(docs, library):
    got = {r["doc_id"]: r for r in nbest.encode(docs).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k]["ids"] == library.encode(text) and got[k]["n_tokens"] == len(library.encode(text))
        assert got[k]["exact"] == ("▁" not in text)
        assert 1 <= len(got[k]["nbest"]) <= 4 and got[k]["nbest"][0]["changes"] == []
    assert got[len(TEXTS)]["ids"] == got[len(TEXTS)]["best"] == [] and got[len(TEXTS)]["n_tokens"] == 0


def test_merges_give_the_librarys_ids():
    rng = random.Random(8)
    model = open_model(model_path())
    merges, letters = Merges(model), [c for c in model.ids if len(c) == 1 and c.isalpha()][:300]
    units = ["▁" * rng.randint(0, 3) + "".join(rng.choices("etaoinshrdluETAOIN", k=rng.randint(2, 14))) for _ in range(800)]
    units += ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(300)] + ["=-" * 30, "▁" * 40, "aa", "▁a", "..." * 10]
    units = [u for u in units if len(u) > 1 and "".join(model.units(u.replace("▁", " "))).endswith(u)]
    ids, n = merges.of_many(units)
    wanted = model.encode_units(units)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == wanted
    long_ = ["▁" + "ab" * 2_000, "=" * 3_001, "▁" * 999]
    assert [merges.of_one(u) for u in units[:200] + long_] == wanted[:200] + model.encode_units(long_)


def test_paths_in_full(docs):
    encoded = nbest.encode(docs)
    got = {(r["doc_id"], r["place"]): r for r in nbest.paths(encoded).collect()}
    model = open_model(model_path())
    points = nbest.Lattice(model).points
    for r in encoded.collect():
        text = [*TEXTS, ""][r["doc_id"]]
        for k, path in enumerate(r["nbest"]):
            ids = got[r["doc_id"], k]["ids"]
            assert ids == nbest.expand(np.array(r["best"], np.int32), path["changes"]).tolist()
            assert len(ids) == path["n_tokens"] and points[ids].sum() == path["score"] and nbest.decode(model, ids) == text.replace("▁", " ")


def every_path(lattice, unit):
    """(cost, ids) of every segmentation of a unit, by recursion over the vocabulary."""
    if not unit:
        return [(0, [])]
    starts = [(unit[:n], lattice.cost_of[unit[:n]]) for n in range(1, len(unit) + 1) if unit[:n] in lattice.cost_of]
    if not starts:
        own = lattice.model.bytes_of(unit[0])
        return [(s, [*own, *ids]) for s, ids in every_path(lattice, unit[1:])]
    return [(cost + s, [i, *ids]) for p, (i, cost) in starts for s, ids in every_path(lattice, unit[len(p) :])]


@pytest.mark.parametrize("text", ["", "a", "mill", "the old", "né 𝄞", "a b c", "  x", "ab.\ncd"])
@pytest.mark.parametrize("n", [1, 4, 9])
def test_n_best_are_the_best_of_all(text, n):
    lattice = nbest.Lattice(open_model(model_path()))
    numbers = lattice.numbers([text])[0]
    whole = [(0, [])]
    for unit in lattice.model.units(text):
        whole = [(s + t, a + b) for s, a in whole for t, b in every_path(lattice, unit)]
    cost_of = {tuple(ids): cost for cost, ids in whole}
    best, changes = lattice.best(numbers, n)
    found = [tuple(nbest.expand(best, c).tolist()) for c in changes]
    assert len(set(found)) == len(found) == min(n, len(whole))
    assert [cost_of[p] for p in found] == sorted(cost for cost, _ in whole)[:n]


def test_passes_agree():
    lattice = nbest.Lattice(open_model(model_path()))
    units = sorted({u for t in TEXTS for u in lattice.model.units(t) if len(u) > 1})
    together = lattice.forward(units)
    for k, unit in enumerate(units):
        alone = lattice.forward_one(unit)
        for a, b in zip((together[0], together[3]), (alone[0], alone[3])):
            assert a[: len(unit) + 1, k].tolist() == b


def test_decoding_is_the_library_s(library):
    model, r = open_model(model_path()), random.Random(1)
    bytes_ = list(model.byte_ids.values())
    for _ in range(2000):
        ids = [r.choice([*bytes_, *range(3, 40), *[r.randrange(259, 32000) for _ in range(200)]]) for _ in range(r.randint(0, 12))]
        assert nbest.decode(model, ids) == library.decode(ids)
    for _ in range(2000):  # a byte of a sign is missing
        ids = library.encode("".join(r.choice("ab é𝄞中\n\x00 ▁") for _ in range(9)))
        del ids[r.randrange(len(ids))]
        assert nbest.decode(model, ids) == library.decode(ids)


def test_counts_at_every_prefix(docs, library):
    got = {r["doc_id"]: r for r in prefix_tokens.token_counts(docs, limit=5).collect()}
    for k, text in enumerate(TEXTS):
        counts = prefix_tokens.unpacked(got[k]["prefix_counts"]).tolist()
        assert counts == [len(library.encode(text[:n])) for n in range(len(text) + 1)]
        assert got[k]["n_tokens"] == counts[-1] and got[k]["over_limit"] == (counts[-1] > 5)
        assert got[k]["fit_chars"] == max(n for n, c in enumerate(counts) if c <= 5)


def test_cuts_come_from_the_store(spark, docs):
    counted = prefix_tokens.token_counts(docs).withColumn("begin", F.lit(4))
    stores = {r["doc_id"]: prefix_tokens.unpacked(r["prefix_counts"]) for r in counted.collect()}
    for r in prefix_tokens.cuts(counted, 3, "begin").collect():
        counts = stores[r["doc_id"]]
        begin = min(4, len(counts) - 1)
        assert (r["start"], r["stop"]) == (begin, max(n for n in range(begin, len(counts)) if counts[n] - counts[begin] <= 3))


def test_store_of_wide_steps():
    for counts in ([0], [0, 3, 2], [0, 500, 1], [0, 10**6, 0, 5]):
        assert prefix_tokens.unpacked(prefix_tokens.packed(np.array(counts, np.int32))).tolist() == counts


def test_long_runs_take_time_in_proportion(library):
    lattice, counter = nbest.Lattice(open_model(model_path())), prefix_tokens.PrefixCounter(open_model(model_path()))
    for text in ("-" * 60_000, "a" * 60_000, "ab" * 40_000):
        numbers = lattice.numbers([text])[0]
        assert lattice.own(numbers).tolist() == library.encode(text)
        assert len(lattice.best(numbers, 4)[1]) == 4
        assert counter.prefixes(counter.numbers([text])[0])[-1] == len(library.encode(text))


def test_tables_are_emptied_when_full(monkeypatch, library):
    from wayline.llm import pieces

    monkeypatch.setattr(pieces, "MOST_UNITS", 20)
    lattice = nbest.Lattice(open_model(model_path()))
    for k in range(30):
        text = f"{TEXTS[0]} w{k} v{k * 7}"
        assert lattice.own(lattice.numbers([text])[0]).tolist() == library.encode(text)
    assert len(lattice) < 60
