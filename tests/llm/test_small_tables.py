"""Every text query on a small table with nulls, empty and very long texts, repeated rows and clashing extra columns,
on an empty one, and against brute force where that exists."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash

import __spark_entry__ as entry
from wayline.llm import exact_dedup, html_extract, minhash, simhash, toxicity
from wayline.llm.pieces import model_path

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, target double, label string, rid bigint, fp string, kept boolean, text_sha256 string"
GOOD = "The river runs past the old mill and the people walk along it every evening. They talk about the weather and the harvest."
BAD = "$$$ ### BUY!!! BUY!!! ||| 999 ### BUY!!! ||| $$$ BUY!!! ### BUY!!!"
TOXIC = "you are a stupid worthless idiot and a pathetic loser"
FR = "Le fleuve passe devant le vieux moulin et les gens se promènent chaque soir. Ils parlent de la récolte et du temps."
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = np.random.default_rng(1)
    bag = GOOD.lower().replace(".", "").split()
    out = []
    for k in range(60):
        words = " ".join(rng.choice(bag, 30)) + "."
        text = {0: f"{GOOD} {words}", 1: f"{BAD} {k} ###", 2: f"{words} {TOXIC}.", 3: f"{FR} numéro {k}."}[k % 4]
        out.append((k, text, ("en", "en", "en", "fr")[k % 4], f"s{k % 3}"))
    out += [(60, None, None, None), (61, "", "en", "s0"), (62, " \t\n ", None, "s1"), (63, "12 34 ...", "en", None), (64, "word", "fr", "s2")]
    out += [(65, out[0][1], "en", "s0"), (66, out[0][1], "en", "s1"), (67, out[4][1] + " x", "en", "s0"), (67, out[4][1] + " x", "en", "s0"), (None, "no id at all here", "en", "s0")]
    out += [(68, (GOOD + " ") * 800, "en", "s0"), (69, "a" * 50_000, None, "s0"), (70, "tab\tand nbsp ▁ 𝄞 🙂", "en", "s1")]
    return [(*r, len(r[1] or ""), 7, 0.5, "x", 1, "fp", True, "sha") for r in out]


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
<article><h1>The   title &amp; more</h1><p>First paragraph of the text, with some words in it.<p>Second paragraph, which <b>is</b> longer than the first one and ends here.</article>
<footer>&copy; example.com &middot; all rights</footer></body></html>"""


def write(spark, folder, docs):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] % 4 != 1), int(r[0] % 4 == 2)) for r in docs if r[0] is not None and r[0] < 60]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (1, "u", PAGE), (None, "w", "<p>broken <b>markup"), (4, "x", "<" * 500)] if docs else []
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("small"), rows())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


TEXT = [n for n in entry.text_operators().queries() if n.startswith("op") and n != "op2_block_labels"]


def run(spark, name, folder):
    return entry.queries()[name](spark, folder).toPandas()


@pytest.mark.parametrize("name", TEXT)
def test_one_row_per_document(spark, small, name):
    got = run(spark, name, small)
    assert len(got) == len(rows())
    assert sorted(-1 if np.isnan(x) else int(x) for x in got["doc_id"].astype(float)) == sorted(-1 if r[0] is None else r[0] for r in rows())


@pytest.mark.parametrize("name", [*TEXT, "op2_block_labels", "pipeline"])
def test_empty_tables(spark, empty, name):
    assert len(run(spark, name, empty)) == 0


def test_mix(spark, small):
    got = run(spark, "op1_source_mix", small)
    sizes = sum(len(WORD.findall(r[1] or "")) for r in rows())
    assert got["size"].sum() == sizes and got["taken"].sum() == pytest.approx(sizes, abs=3)
    assert (got["taken"] <= 3 * got["size"]).all()
    each = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (each["taken"] - each["target"]).abs().max() <= 3
    again, order = run(spark, "op1_source_mix", small), ["doc_id", "size", "taken"]
    assert again.sort_values(order)[order].values.tolist()[:-1] == got.sort_values(order)[order].values.tolist()[:-1]


def test_pages(spark, small):
    got = run(spark, "op2_block_labels", small)
    assert len(got) == 6
    texts = got[got["page_id"] == 1]["text"].tolist()
    wanted = "The title & more\nFirst paragraph of the text, with some words in it.\nSecond paragraph, which is longer than the first one and ends here."
    assert texts == [wanted, wanted]
    assert got[got["page_id"].isin([2, 3])]["text"].tolist() == ["", ""]
    assert (got["n_chars"] == got["text"].map(len)).all()


def test_language(spark, small):
    got = run(spark, "op3_ppm_language", small).drop_duplicates("doc_id").set_index("doc_id")
    wanted = {r[0]: r[2] for r in rows() if r[0] is not None and r[0] < 60}
    assert sum(got.loc[k, "lang_pred"] != v for k, v in wanted.items()) <= 1
    assert all(got.loc[k, "lang_pred"] == "und" for k in (60, 61, 62, 63))
    assert all(got.loc[k, "held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in wanted)


def test_quality(spark, small):
    got = run(spark, "op4_pairwise_quality", small).drop_duplicates("doc_id").set_index("doc_id")
    assert sum(got.loc[k, "predicted"] != int(k % 4 != 1) for k in range(60)) <= 1
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all() and got["score"].between(0, 1).all()


def union(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return [top(k) for k in range(n)]


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, small):
    given = [r for r in rows() if r[0] is not None]
    fps = [slow_fingerprint(r[1]) for r in given]
    roots = union(len(given), [(a, b) for a in range(len(given)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    low = {}
    for k, r in zip(roots, given):
        low[k] = min(low.get(k, r[0]), r[0])
    got = run(spark, "op5_simhash_groups", small).dropna(subset=["doc_id"])
    assert sorted(zip(got["doc_id"], got["fingerprint"], got["component_id"])) == sorted((r[0], f"{f:016x}", low[k]) for r, f, k in zip(given, fps, roots))


@pytest.mark.parametrize("n", [3_000, 60_000])
def test_simhash_links_random_and_crowded(spark, n):
    """Components of planted chains among random and crowded fingerprints, by brute force on the smaller table."""
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**64, n, dtype=np.uint64)
    fps[: n // 3] = fps[0] ^ (rng.integers(0, 2**16, n // 3, dtype=np.uint64) << np.uint64(3))  # many share 48 bits
    for k in range(n // 2, n // 2 + 200):
        fps[k + 200] = fps[k] ^ np.uint64(0b1111 << int(rng.integers(0, 60)))
    fps = np.unique(fps)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = simhash.roots_of(frame, len(fps)).toPandas()
    root = dict(zip(got["node"].astype("int64"), got["root"].astype("int64")))
    if n < 10_000:
        pairs = [(k, int(j)) for k in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[k] ^ fps[:k]) <= 4)]
        wanted = union(len(fps), pairs)
        signed = fps.view(np.int64)
        groups = {}
        for k, w in enumerate(wanted):
            groups.setdefault(w, []).append(int(signed[k]))
        for members in groups.values():
            assert {root.get(m, m) for m in members} == {min(members)}
    else:
        whole = set(np.unique(fps).tolist())
        for k in list(whole)[:2000]:
            for b in range(61):
                if (other := k ^ (0b1111 << b)) in whole:
                    a, c = (int(np.uint64(x).view(np.int64)) for x in (k, other))
                    assert root[a] == root[c]


@pytest.mark.parametrize("most, n", [(2048, 12_000), (128, 3_000)])
def test_simhash_links_across_chunks_of_a_crowd(spark, most, n):
    """Fingerprints that share a band but aren't near each other, in several chunks; partners differ in the bits that lead the
    Gray orders, so that no run has both."""
    rng = np.random.default_rng(most)
    fps = rng.integers(0, 2**64, n, dtype=np.uint64) & ~np.uint64(0x1FFF << 20) | np.uint64(0x0AAA << 20)
    flips = np.uint64(sum(1 << b for b in (15, 31, 47, 63)))
    fps = np.unique(np.r_[fps, fps[:200] ^ flips])
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = simhash.roots_of(frame, len(fps), most=most).toPandas()
    signed = fps.view(np.int64)
    pairs = [(k, int(j)) for k in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[k] ^ fps[:k]) <= 4)]
    assert len(pairs) >= 200
    wanted = union(len(fps), pairs)
    root = dict(zip(got["node"].astype("int64"), got["root"].astype("int64")))
    groups = {}
    for k, w in enumerate(wanted):
        groups.setdefault(w, []).append(k)
    for members in groups.values():
        low = min(int(signed[k]) for k in members)
        assert {root.get(int(signed[k]), int(signed[k])) for k in members} == {low}


def test_exact(spark, small):
    got = run(spark, "op6_exact_dedup", small)
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(-1 if r[0] is None else r[0])
    for r in got.itertuples():
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids) and (np.isnan(r.keep_id) or r.keep_id == max(ids))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = exact_dedup.drop_exact(docs)
    assert once.columns == docs.columns
    assert once.count() == len(groups)


@pytest.mark.parametrize("range_rows", [20, 50])
def test_exact_in_several_ranges(spark, small, range_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a, b = (sorted(map(str, exact_dedup.exact_groups(docs, most).collect())) for most in (range_rows, 1 << 20))
    assert a == b
    a, b = (sorted((str(r["doc_id"]), r["text"] or "") for r in exact_dedup.drop_exact(docs, most).collect()) for most in (range_rows, 1 << 20))
    assert a == b


def test_minhash(spark, small):
    got = run(spark, "op7_minhash_fingerprints", small)
    given = sorted(((-(2**63) if r[0] is None else r[0]), r[1] or "") for r in rows())
    got = got.assign(key=got["doc_id"].fillna(-(2**63)), n=got["n_chars"]).sort_values(["key", "n"], kind="stable")
    shas = [hashlib.sha256(minhash.edited(t, given[(k + 1) % len(given)][1]).encode()).hexdigest() for k, (_, t) in enumerate(given)]
    assert sorted(got["edited_sha256"]) == sorted(shas)
    by_text = {}
    for (_, t), f in zip(given, [minhash.fingerprint(t).hex() for _, t in given]):
        assert by_text.setdefault(t, f) == f
    assert sorted(got["fingerprint"]) == sorted(minhash.fingerprint(t).hex() for _, t in given)


def test_minhash_estimates():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 3000)]
    for cut in (0, 5, 300, 1500, 2999):
        other = words[: len(words) - cut] + [f"x{k}" for k in range(cut)]
        a, b = (set(zip(*[w[k:] for k in range(5)])) for w in (words, other))
        est = minhash.likeness(minhash.fingerprint(" ".join(words)), minhash.fingerprint(" ".join(other)))
        assert est == pytest.approx(len(a & b) / len(a | b), abs=0.1)
    assert max(minhash.likeness(minhash.fingerprint(f"a{k}"), minhash.fingerprint(f"b{k}")) for k in range(200)) < 0.2


def test_toxicity():
    rng = np.random.default_rng(5)
    bag = [f"{a}{b}" for a in ("ro", "mi", "ta", "len", "vor", "sil") for b in ("na", "der", "ing", "tos", "ble", "xa")]
    sample = []
    for k in range(900):
        words = rng.choice(bag, 120).tolist()
        if k % 5 == 0:
            for at in rng.choice(120, 4, replace=False):
                words[at] = str(rng.choice(["idiot", "stupid", "worthless", "pathetic", "moron"]))
        sample.append((" ".join(words), int(k % 5 == 0)))
    model = toxicity.SubwordSoftmax.fit(sample[:600])
    score = model.scores([t for t, _ in sample[600:]])
    label = np.array([k for _, k in sample[600:]])
    assert (score[label == 1] >= 0.7).mean() > 0.9 and (score[label == 0] >= 0.7).mean() < 0.03
    clean = " ".join(bag * 3)
    assert model.scores([clean + " idiott stupidd worthles"])[0] > 10 * model.scores([clean])[0]


def test_token_counts(spark, small):
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = run(spark, "op9_prefix_token_counts", small).dropna().drop_duplicates("doc_id").set_index("doc_id")
    for r in rows():
        if r[0] is not None:
            n = len(library.encode(r[1] or ""))
            assert got.loc[r[0], "n_tokens"] == n and got.loc[r[0], "n_bytes"] == len((r[1] or "").encode()) and got.loc[r[0], "over_limit"] == (n > 4096)


def test_round_trip(spark, small):
    got = run(spark, "op10_nbest_pieces", small)
    marked = {r[0] for r in rows() if "▁" in (r[1] or "")}
    assert all(r.exact or r.doc_id in marked for r in got.itertuples())


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, small)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            docs = corpus_pipeline.cut(after, f"test-{k}")
    assert after.count() > 0
    assert html_extract.labeller() is html_extract.labeller()
