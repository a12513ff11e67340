"""Byte-pair encoding, centroid clustering and token alignment against libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from uttermill.llm import alignment, centroids, kernels, pair_index
from uttermill.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES, WORD_MODEL

from conftest import SF

SCHEMA = "doc_id long, text string, n_tokens string, row int, `token_ids` string, a_ids int, `x.y` int"


def odd_texts():
    rng = random.Random(11)
    words = ["alpha", "Beta", "γαμμα", "ΣΊΣΥΦΟΣ", "épsilon", "日本語", "x", "it's", "we'll", "12th", "☃", "é", "İ", "ǅ", "🙂"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts = [None, "", " ", "\n\t \r\n", "one", "aaaaaaaaaaa", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|> c", "<|endoftext"]
    texts += [line(rng.randrange(1, 40)) for _ in range(60)]
    texts += ["a\x00b", "a\x1cb \x85c d　e f", "▁x ▁", "<0x41> <s> <unk>", "  two  blanks ", "̸ ≮ ́", "\x0b\x0c vertical"]
    texts += ["long " * 20_000, "x" * 50_000, "ab" * 20_000, " ".join(f"w{i}" for i in range(5_000)), "9" * 3_000, "!?" * 4_000, " " * 9_000]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 1, "t", 2, 3) for i, t in enumerate(odd_texts())]
    rows += [(None, "no id", "n", 1, "t", 2, 3), rows[20], rows[20], (21, "another text of one id", "n", 1, "t", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 byte-pair encoding


@pytest.fixture(scope="module")
def words():
    return pair_index.WordVocabulary.load(WORD_MODEL)


def brute_merge(ids, rank):
    """Merge the best pair, the leftmost of equals, until none is left."""
    ids = list(ids)
    while True:
        found = [(rank[a, b][0], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (a, b) in rank]
        if not found:
            return ids
        k = min(found)[1]
        ids[k : k + 2] = [rank[ids[k], ids[k + 1]][1]]


def test_merged_words_equal_the_definition(monkeypatch, words):
    rng = random.Random(3)
    texts = ["".join(rng.choice("thaeinor") for _ in range(rng.randrange(1, 14))).encode() for _ in range(500)]
    texts += [b"a" * k for k in range(1, 30)] + [bytes([b]) for b in range(256)]
    rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(words.rules)}
    want = [brute_merge([words.first[c] for c in t[:-1]] + [words.last[t[-1]]], rank) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in pair_index.merge_words(texts, words)] == want
    monkeypatch.setattr(pair_index, "FEW", 0)
    assert [np.frombuffer(x, "<u4").tolist() for x in pair_index.merge_words([b"", *texts], words)] == [[], *want]
    assert pair_index.merge_words([], words) == []


def test_encoding_and_decoding_equal_the_library(docs, empty, words):
    whole = Tokenizer.from_file(WORD_MODEL)
    out = pair_index.decode(pair_index.encode(docs, words, carry=["doc_id", "text", "x.y"]), words, out="back").collect()
    assert len(out) == docs.count()
    for r in out:
        want = whole.encode(r.text or "", add_special_tokens=False).ids
        assert (list(r.token_ids), r.n_tokens, r["x.y"]) == (want, len(want), 3)
        assert r.back == whole.decode(want, skip_special_tokens=False)
    packed = pair_index.encode(docs, words, carry=["text", "n_tokens"], as_bytes=True, decoded="text")
    assert packed.columns == ["n_tokens", "token_ids", "text"]
    again = pair_index.decode(packed, words, out="again").collect()
    assert all(r.again == r.text for r in again) and sorted(r.text for r in again) == sorted(r.back for r in out)
    assert pair_index.encode(empty, words).count() == 0
    assert pair_index.encode(docs, words).columns == ["doc_id", "text", "row", "a_ids", "x.y", "n_tokens", "token_ids"]


def test_chunks_and_small_memory_change_nothing(monkeypatch, words):
    whole = Tokenizer.from_file(WORD_MODEL)
    texts = odd_texts()
    for name, value in (("CHUNK", 300), ("FRESH", 20), ("MEMORY", 5)):
        monkeypatch.setattr(pair_index, name, value)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for plain in (True, False):
        monkeypatch.setattr(words, "plain_ascii", plain)
        got = [np.frombuffer(x, "<u4").tolist() for x in pair_index.Encoder(words).encode(pa.array(texts))]
        assert got == want


def test_ascii_is_cut_as_the_library_cuts_it(words):
    assert words.plain_ascii
    rng = random.Random(6)
    whole = Tokenizer.from_file(WORD_MODEL)
    texts = ["".join(chr(rng.randrange(128)) for _ in range(rng.randrange(30))) for _ in range(2_000)]
    texts += ["".join(rng.choice(["'s", "'S", "'", "ll", "re", "x", "1", "Q", "<|", "|>", " "]) for _ in range(12)) for _ in range(2_000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in pair_index.Encoder(words).encode(pa.array(texts))]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_rules_out_of_order_are_refused():
    with pytest.raises(ValueError, match="rule"):
        pair_index.WordVocabulary({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")], "", {}, None, None)


def test_word_bpe_query_equals_the_library(spark):
    whole = Tokenizer.from_file(WORD_MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_word_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 12 centroids


def test_planes_give_numbers_products_and_distances():
    rng = np.random.default_rng(5)
    for top in (1, 3, 100, 1 << 20, (1 << 27) - 1):
        x, y = rng.integers(-top - 1, top + 1, (40, 64)), rng.integers(-top // 2 - 1, top + 1, (7, 64))
        x[0], x[1], y[0] = -top, top, 0
        planes, other = centroids.to_planes(x), centroids.to_planes(y)
        assert (centroids.to_components(planes) == x).all()
        assert (np.stack([centroids.dot(planes, other[:, k : k + 1]) for k in range(7)]) == y @ x.T).all()
        far = ((x[None] - y[:, None]) ** 2).sum(axis=2)
        assert (centroids.distances(planes, other) == far).all()
        assert (centroids.nearest(planes, other)[0] == far.argmin(axis=0)).all()


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: digest(r[0]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centres = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted([(i, c, d, sums[c], sum(sums.values()), sha(c)) for i, c, d in found], key=repr)


def vector_rows():
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=64) * (1 + i % 3)).tolist()) for i in range(150)]
    rows += [(7, rows[7][1])] * 40 + [(500, rows[3][1]), (501, [0.0] * 64), (None, rows[9][1])]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] * 64, [0.5] * 63 + [float("inf")], [0.5] * 63 + [None]]
    return rows + [(600 + i, v) for i, v in enumerate(bad)]


def test_clusters_equal_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, cluster int, planes int, id int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted([tuple(r) for r in centroids.cluster_report(frame.repartition(4)).collect()], key=repr)
    assert got == brute_clusters(rows)
    few = frame.filter("vec_id IN (1, 2, 600)")
    assert [r.distance for r in centroids.cluster_report(few).collect()] == [0, 0]
    assert centroids.cluster_report(frame.limit(0)).count() == 0
    assert centroids.cluster_report(frame.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster_report(frame.filter("vec_id >= 600")).count() == 0


def test_batches_of_different_width(spark):
    small = [(i, [((i * 7 + j) % 5 - 2) / 64 for j in range(64)]) for i in range(30)]
    large = [(100 + i, [((i * 11 + j) % 9001 - 4500.0) for j in range(64)]) for i in range(30)]
    frame = spark.createDataFrame(small + large, "vec_id long, embedding array<double>").repartition(6, "vec_id")
    got = sorted([tuple(r) for r in centroids.cluster_report(frame).collect()], key=repr)
    assert got == brute_clusters(small + large)


def test_too_large_components_end_with_a_message(spark):
    frame = spark.createDataFrame([(1, [float(1 << 21)] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster_report(frame)


# 13 alignment


def brute_align(a_ids, b_ids, a_bytes, b_bytes):
    """(links, groups): every pair of tokens is compared in order of their byte ranges."""
    spans = lambda ids, table: [(i, sum(len(table[k]) for k in ids[:n]), sum(len(table[k]) for k in ids[: n + 1])) for n, i in enumerate(ids)]
    a, b = spans(a_ids, a_bytes), spans(b_ids, b_bytes)
    links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
    both = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups = [
        ",".join(str(x) for x, _, e in a if lo < e <= hi) + "|" + ",".join(str(y) for y, _, e in b if lo < e <= hi)
        for lo, hi in zip([0, *both], both)
    ]
    return links, groups


@pytest.fixture(scope="module")
def sides():
    return alignment.Tokenizers.load(BYTE_MODEL, PIECE_MODEL)


def brute_report(rows, sides):
    a_tok, b_tok = Tokenizer.from_file(BYTE_MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a_tok.encode_special_tokens = True
    found = []
    for i, text in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        want = b" " + (text or "").encode()
        if not text or any(b"".join(t[k] for k in ids) != want for ids, t in ((a, sides.a_bytes), (b, sides.b_bytes))):
            a, b = [], []
        found.append((i, a, b, *brute_align(a, b, sides.a_bytes, sides.b_bytes)))
    counts = Counter(p for *_, links, _ in found for p in set(links))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(
        [
            (i, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for i, a, b, links, groups in found
        ],
        key=repr,
    )


def test_paths_of_any_step_give_the_same_alignment():
    rng = np.random.default_rng(4)
    for _ in range(60):
        total = int(rng.integers(1, 60))
        ends = lambda: np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, total + 1)), total))
        a, b = ends(), ends()
        want = sorted((x, y) for x in range(len(a)) for y in range(len(b)) if max(a[x - 1] if x else 0, b[y - 1] if y else 0) < min(a[x], b[y]))
        for step in (1, 2, 3, 7, 1_000):
            i, j = alignment.cut_path(a, b, step)
            assert (i + j == np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))).all()
            left, right, both_a, both_b = alignment.align_ends(a, b, step)
            assert sorted(zip(left.tolist(), right.tolist())) == want
            assert (both_a == np.isin(a, b)).all() and (both_b == np.isin(b, a)).all()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.align_ends(none, none)] == [0, 0, 0, 0]


@pytest.mark.parametrize("max_pairs", [alignment.MAX_PAIRS, 50, 0])
def test_link_report_equals_brute_force(docs, sides, max_pairs):
    short = docs.filter("text IS NULL OR length(text) < 3000")
    got = sorted([tuple(r) for r in alignment.link_report(short, sides, max_pairs=max_pairs).collect()], key=repr)
    assert got == brute_report([(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()], sides)


def test_long_and_no_texts(docs, empty, sides):
    out = alignment.link_report(docs, sides)
    assert out.count() == docs.count()
    assert out.filter("n_groups > n_a OR n_groups > n_b OR n_links < greatest(n_a, n_b) OR n_links > n_a + n_b").count() == 0
    assert out.filter("n_a = 0").filter("groups_sha256 <> '' OR n_b + n_links + n_groups + n_best + count_sum > 0").count() == 0
    assert alignment.link_report(empty, sides).count() == 0
    kept = alignment.align(docs, sides, step=5)
    assert kept.count() == docs.count() and kept.select("row.*").columns == docs.columns
    whole = alignment.align(docs, sides)
    assert kept.exceptAll(whole).count() == 0


def test_alignment_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 2500").select("doc_id", "text").collect()]
    sides = alignment.Tokenizers.load(BYTE_MODEL, PIECE_MODEL)
    whole = {r.doc_id: r for r in QUERIES["op13_alignment"](spark, SF).collect()}
    for i, n_a, n_b, n_groups, n_links, _, _, digest in brute_report(rows, sides):
        r = whole[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, n_links, digest)
    assert len(whole) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_byte_alphabet_has_all_bytes(sides):
    assert len(set(kernels.byte_alphabet())) == 256 and kernels.byte_alphabet()[ord("A")] == "A"
    assert {bytes([b]) for b in range(256)} <= set(sides.a_bytes)
