"""Label samples with many labels, common and rare."""

from collections import Counter

import pytest

from wayline.llm import common, langid, quality

COLUMNS = "doc_id long, text string, lang string"


def test_rare_label_among_many_is_sampled_and_predicted(spark):
    signs = {"a": "abcd", "b": "efgh", "c": "ijkl", "d": "mnop", "e": "qrst", "rare": "uvwx"}
    texts = lambda k: " ".join(signs[k][x % 4] * 3 + signs[k][x % 3] for x in range(12))
    rows = [(k, f"{texts(lang)} {k}", lang) for k, lang in enumerate(["a", "b", "c", "d", "e"] * 400 + ["rare"] * 40)]
    docs = spark.createDataFrame(rows, COLUMNS)
    sample = Counter(lang for _, lang in common.label_sample(docs, "lang", 100))
    assert sample["rare"] == 40 and all(sample[k] == 100 for k in "abcde")
    found = langid.identify(docs.where("lang = 'rare'"), langid.fit(docs)).collect()
    assert all(r["lang_pred"] == "rare" for r in found)


def test_labels_beyond_the_hundredth(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k % 130}") for k in range(260)], COLUMNS)
    assert len({lang for _, lang in common.label_sample(docs, "lang", 5)}) == 130


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_CHARS", 100 * common.LEAST_EACH * common.LEAST_CHARS)
    docs = spark.createDataFrame([(k, "text", f"l{k}") for k in range(101)], COLUMNS)
    assert len(common.label_sample(docs.where("doc_id < 100"), "lang", 5)) == 100
    with pytest.raises(ValueError):
        common.label_sample(docs, "lang", 5)


def test_sample_is_bounded_and_long_texts_give_windows(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_CHARS", 40_000)
    text = " ".join(map(str, range(3000)))
    docs = spark.createDataFrame([(k, text, f"l{k % 4}") for k in range(200)], COLUMNS)
    sample = common.label_sample(docs, "lang", 300, 5_000)
    assert sum(len(t) for t, _ in sample) <= 40_000 and all(t in text for t, _ in sample)
    assert min(Counter(k for _, k in sample).values()) >= common.LEAST_EACH
    assert sample == common.label_sample(docs, "lang", 300, 5_000)


def test_clashing_labels_have_a_defined_one(spark):
    docs = spark.createDataFrame([(k, f"good text {k}." if k % 2 else f"$$$ {k} !!!", "x") for k in range(60)], COLUMNS)
    labels = [(k, k % 2, 0) for k in range(60)] + [(k, 1, 0) for k in range(0, 60, 6)]
    a, b = (quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")) for rows in (labels, labels[::-1]))
    assert (a.weight == b.weight).all() and a.cut == b.cut
