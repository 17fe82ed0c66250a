"""Token alignment, filter audit and packing against brute force, on a small table with nulls, empty and very long texts,
copies, special strings and clashing extra columns, and in the ways that only large tables take."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from wayline.llm import alignment, chunks, filter_audit, packing
from wayline.llm.pieces import model_path

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, A boolean, slice bigint, stripe int, start bigint, state int, good boolean"
END = "<|endoftext|>"


def rows():
    rng = np.random.default_rng(2)
    bag = "the River runs past 'old mill' don't we'll naïve Straße 日本語 123 4567 x=1; «Oui» été fin  two   three\tfour\r\nfive {}\r\n\r\n ;\r a　b ".split(" ")
    texts = [" ".join(rng.choice(bag, int(rng.integers(1, 400)))) for _ in range(40)]
    texts += [None, "", " ", " \n\t ", "x", f"a {END} b{END}", f"{END}", "mark ▁ inside", "▁", "\n\nstart", "end  \n", "a" * 9_000, "ab" * 3_000 + " " + "=" * 500, " ".join(f"w{k}" for k in range(6_000))]
    texts += [texts[0], texts[0], texts[5], "\u0000\u001c x y 𝄞🙂", "plain words " * 150, "SHOUT " * 220, "good # text " * 100]
    out = [(k, t, ("en", "fr", None, "")[k % 4], f"s{k % 3}") for k, t in enumerate(texts)]
    out += [(7, texts[7], "fr", "s1"), (None, texts[3], "en", None), (None, "no id", None, None)]
    return [(*r, len(r[1] or ""), "p", True, 5, 6, 7, 8, False) for r in out]


LABELS = [(k, int(k % 3 == 0), int(k % 5 == 0)) for k in range(50)] + [(3, 0, 1), (9, None, None), (None, 1, 1), (4000, 1, 1)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("three")
    spark.createDataFrame(rows(), COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def library(special_is_text):
    found = Tokenizer.from_file(chunks.tokenizer_path())
    found.encode_special_tokens = special_is_text
    return found


# --- chunks


def test_chunks_give_the_librarys_ids():
    own, table = library(True), packing.IdChunks(chunks.ByteModel(chunks.tokenizer_path()))
    table.special, table.finds = {}, re.compile(b"(?!)")
    texts = [r[1] or "" for r in rows()] + ["a%sb" % w for w in chunks.WHITES] + ["a %s  b　　c%s" % (w, w) for w in chunks.WHITES]
    for some in (texts, texts[::-1]):
        raw = [t.encode() for t in some]
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum(list(map(len, raw)))]
        ids, edges = table.encoded(data, ends)
        for t, a, z in zip(some, edges, edges[1:]):
            assert ids[a:z].tolist() == own.encode(t, add_special_tokens=False).ids


def test_chunks_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(chunks, "ODD", np.uint64(0))  # then every chunk of a size has one hash
    table = packing.IdChunks(chunks.ByteModel(chunks.tokenizer_path()))
    raw = b"one two six ten one six red"
    begin = chunks.chunk_starts(np.frombuffer(raw, np.uint8), np.array([0]))
    numbers = table.numbers(np.frombuffer(raw, np.uint8), begin)
    own = library(True)
    assert table.gathered(1, numbers).tolist() == own.encode(raw.decode()).ids
    again = table.numbers(np.frombuffer(raw, np.uint8), begin)
    assert table.gathered(1, again).tolist() == own.encode(raw.decode()).ids


def test_files_with_another_order_are_refused(tmp_path):
    given = json.load(open(chunks.tokenizer_path(), encoding="utf-8"))
    given["model"]["merges"][5], given["model"]["merges"][9] = given["model"]["merges"][9], given["model"]["merges"][5]
    (tmp_path / "x.json").write_text(json.dumps(given))
    with pytest.raises(ValueError):
        chunks.ByteModel(str(tmp_path / "x.json"))


# --- alignment


def slow_alignment(texts):
    a_side, b_side = library(True), sentencepiece.SentencePieceProcessor(model_file=model_path())
    shown = {c: b for b, c in enumerate(chunks.shown_bytes())}
    documents, holds = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = a_side.encode(" " + (text or ""), add_special_tokens=False).ids, b_side.encode(text or "")
        a_bytes = [bytes(shown[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[1:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            documents.append(None)
            continue
        a_ends, b_ends = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
        groups, last_a, last_b = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            to_a, to_b = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append((a[last_a:to_a], b[last_b:to_b]))
            last_a, last_b = to_a, to_b
        links = Counter((x, y) for p, q in groups for x in p for y in q) if max(len(p) * len(q) for p, q in groups) < 10**6 else sum((Counter({(x, y): n * m for x, n in Counter(p).items() for y, m in Counter(q).items()}) for p, q in groups), Counter())
        holds.update(links.keys())
        documents.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for d in documents:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for (x, y), n in links.items() if holds[x, y] == most[x]), sum(n * holds[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out, holds, most


@pytest.fixture(scope="module")
def slow_links():
    return slow_alignment([r[1] for r in rows()])


@pytest.mark.parametrize("small_tasks", [False, True])
def test_alignment(spark, small, slow_links, monkeypatch, small_tasks):
    if small_tasks:  # slices, salts and tasks as on large tables
        for name, value in (("SLICE", 4_000), ("TASK_LINKS", 100), ("TASK_SLICES", 2), ("HASH_CHUNKS", 7)):
            monkeypatch.setattr(alignment, name, value)
    got = entry.queries()["op11_token_alignment"](spark, small).collect()
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((str(r["doc_id"]), *[r[c] for c in columns]) for r in got) == sorted((str(r[0]), *x) for r, x in zip(rows(), slow_links[0]))


def test_pair_counts(spark, small, slow_links):
    _, holds, most = slow_links
    got = alignment.pair_counts(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert sorted(tuple(r) for r in got) == sorted((x, y, n, n == most[x]) for (x, y), n in holds.items())


# --- filter audit


def slow_audit(given, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    texts = [r[1] or "" for r in given]
    least = {}
    for r, t in zip(given, texts):
        least[t] = min(least.get(t, (1, 0)), (0, 0) if r[0] is None else (1, r[0])) if t in least else ((0, 0) if r[0] is None else (1, r[0]))
    seen = []
    for r, t in zip(given, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = r[0] is not None and least[t] < (1, r[0])
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        seen.append((r[2] or "", {k for k, v in fails.items() if v}, r[0] in good, r[0] in toxic))
    out, orders = [], ["".join(p) for p in permutations("ABCDE")]
    for part in {s[0] for s in seen}:
        own, removals, lines = [s for s in seen if s[0] == part], Counter(), []
        for order in orders:
            for step, name in enumerate(order):
                here = [s for s in own if name in s[1] and not s[1] & set(order[:step])]
                kept = sum(not s[1] & set(order[: step + 1]) for s in own)
                failing = sum(name in s[1] for s in own)
                removals[name] += len(here)
                lines.append((part, order, step + 1, kept, len(here), failing - len(here), sum(s[1] == {name} for s in own), sum(s[2] for s in here), sum(s[3] for s in here)))
        out += [(*x, removals[x[1][x[2] - 1]]) for x in lines]
    return out


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark, small):
    got = entry.queries()["op12_filter_audit"](spark, small).collect()
    assert sorted(tuple(r[c] for c in AUDIT) for r in got) == sorted(slow_audit(rows(), LABELS))


def test_audit_with_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_PARTS", 4)
    given = [(k, ("same " * 300 if k % 3 else f"own {k} " * 120), "en" if k % 2 else None, "s") for k in range(60)]
    docs, labels = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert sorted(tuple(r[c] for c in AUDIT) for r in got) == sorted(slow_audit(given, LABELS))


# --- packing


def check_packed(given, got, window=2048, end=1):
    """Pieces cover every document's ids once, sequences lie gapless and are whole windows, or powers of two."""
    own = library(False)
    wanted = Counter()
    for r in given:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids + ([] if end is None else [end])
        wanted[r[0], tuple(ids)] += 1
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts]).tolist()
        assert [at for at, _ in parts] == [0, *ends[:-1]] and all(n > 0 for _, n in parts)
        assert ends[-1] == window or ends[-1] < window and not ends[-1] & (ends[-1] - 1)
    assert sum(sum(n for _, n in p) != window for p in sequences.values()) <= window.bit_length()
    for (doc, ids), times in wanted.items():
        pieces = sorted((r["start"], r["ids"], r["doc_tokens"]) for r in got if r["doc_id"] == doc)
        raw = np.array(ids, "<u4").tobytes()
        mine = [p for p in pieces if p[2] == len(ids) and raw[4 * p[0] : 4 * p[0] + len(p[1])] == p[1]]
        assert sum(len(p[1]) for p in mine) == times * len(raw)
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in wanted.items())


def test_packing_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = packing.pack(docs).collect()
    check_packed(rows(), pieces)
    digest = entry.queries()["op13_window_packing"](spark, small).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"]) for r in pieces) == sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in digest)


@pytest.mark.parametrize("opened, fan, parts", [(1, 2, 9), (3, 2, 17), (8, 64, 5)])
def test_packing_in_rounds(spark, small, opened, fan, parts):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(parts)
    check_packed(rows(), packing.pack(docs, 64, None, opened, fan).collect(), 64, None)


def test_packing_fits_best():
    packer = packing.Packer(16, 3, 0)
    for doc, n in enumerate((10, 7, 12, 4, 9)):
        packer.place((doc, 0, np.arange(n, dtype="<u4"), n))
    one = [(2, 0, 12, 0), (3, 0, 4, 12)]  # 4 ids fill the window that has 12
    two = [(1, 0, 7, 0), (4, 0, 9, 7)]  # and 9 the one that has 7
    assert [(r[0], r[1], r[2], r[6]) for r in packer.out] == one + two
    packer.place((5, 0, np.arange(14, dtype="<u4"), 14))
    packer.place((6, 0, np.arange(13, dtype="<u4"), 13))
    packer.place((7, 0, np.arange(8, dtype="<u4"), 8))  # none has room for 8: the fullest takes two of them, another the rest
    assert [(r[0], r[1], r[2], r[6]) for r in packer.out[4:]] == [(5, 0, 14, 0), (7, 0, 2, 14), (0, 0, 10, 0), (7, 2, 6, 10)]


@pytest.mark.parametrize("name", ["op11_token_alignment", "op12_filter_audit", "op13_window_packing"])
def test_no_documents(spark, tmp_path, name):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert entry.queries()[name](spark, str(tmp_path)).count() == 0
