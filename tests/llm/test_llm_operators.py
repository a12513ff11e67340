"""Operators of the llm subpackage against brute-force versions, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

from uttermill.llm import (
    chat_format,
    decontaminate,
    kernels,
    language_id,
    language_model,
    line_dedup,
    pieces,
    pii,
    quality_pu,
    quality_rules,
    simhash,
)
from uttermill.llm.queries import PIECE_MODEL, QUERIES
from uttermill.llm.sql import SQL

from conftest import SF
from oracle import compare, connect

WHITE = "\x20\x09-\x0d"
WORD = re.compile(f"[^{WHITE}]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, tag long, row string, `h.1` int"


def odd_texts() -> list:
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta!", "épsilon", "zeta", "eta", "theta", "日本語", "x"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = ["a line that documents share", "  Another Shared LINE\t", "short", "\x0bvertical tab line here\x0c"]
    texts = [None, "", " ", "\n", "\n\n", "one", "a line that documents share"]
    for _ in range(60):
        parts = [line(rng.randrange(0, 12)) for _ in range(rng.randrange(1, 8))] + rng.sample(shared, rng.randrange(0, 4))
        rng.shuffle(parts)
        texts.append("\n".join(parts))
    base = line(120)
    texts += [base] * 5 + [base + " " + rng.choice(words) for _ in range(5)]
    texts += ["long " * 30_000, "x" * 70_000, " ".join(f"w{i}" for i in range(5_000)), "\x00nul\x00 byte", "🙂 emoji"]
    return texts


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Odd texts with a null id, a repeated row, an id with two texts, and clashing column names."""
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, 2, "r", 3) for i, t in enumerate(texts)]
    rows += [(None, "no id but a line that documents share\nand more", "de", "s", 1, 1, 2, "r", 3), rows[20]]
    rows.append((21, "an id with two texts\na line that documents share", "fr", "s", 1, 1, 2, "r", 3))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# kernels


def test_spans_and_hashes_equal_words(texts):
    column = pa.array(texts)
    for a, b, data, bounds in kernels.chunks(column, 5_000):
        starts, ends, row = kernels.spans(~kernels.WHITE[data], bounds)
        raw = data.tobytes()
        got = [(r, raw[s:e].decode()) for s, e, r in zip(starts, ends, row)]
        assert got == [(i - a, w) for i in range(a, b) for w in WORD.findall(texts[i] or "")]
        h = kernels.SpanHasher(data)(starts, ends).tolist()
        assert len(set(h)) == len({w for _, w in got}) == len(set(zip(h, (w for _, w in got))))
        starts, ends, row = kernels.line_spans(data, bounds)
        assert [(r, raw[s:e].decode()) for s, e, r in zip(starts, ends, row)] == [
            (i - a, x) for i in range(a, b) for x in (texts[i] or "").split("\n")
        ]


def test_row_index_finds_exactly_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5_000))
    index = kernels.RowIndex(keys)
    assert (index(keys) == np.arange(len(keys))).all()
    assert (index(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert (kernels.RowIndex(keys[:0])(keys) == -1).all()


# 2 line dedup


def brute_lines(rows, min_chars=10):
    holders = defaultdict(set)
    order = lambda i: (i is None, i)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [
            len(key(x)) >= min_chars and len(holders[key(x)]) > 1 and i != min(holders[key(x)], key=order) for x in lines
        ]
        kept = "\n".join(x for x, d in zip(lines, drop) if not d)
        out.append((i, len(lines), sum(drop), kept))
    return sorted(out, key=repr)


def test_line_dedup(docs):
    got = line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs)).collect()
    assert sorted([(r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got], key=repr) == brute_lines(pairs_of(docs))


def test_line_dedup_keeps_columns(docs, empty):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text IS NULL").count() == docs.filter("text IS NULL").count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_hot_line_over_many_partitions(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "concat('the very common line\nown line number ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.keep_bitmaps(docs.repartition(7)).groupBy("n_dropped").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.n_dropped: r["count"] for r in got} == {0: 1, 1: 2_999}


# 8 SimHash


def brute_fingerprint(text, k=4):
    words = WORD.findall((text or "").translate(UPPER))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_roots(values, max_bits=4):
    values, root = sorted(set(values)), {}
    for v in values:
        root[v] = v
    find = lambda v: v if root[v] == v else find(root[v])
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_simhash_groups(docs):
    rows = pairs_of(docs)
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_roots(prints)
    members = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        members[roots[p]].append(i)
    first = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    want = [(i, f"{p:016x}", first[roots[p]]) for (i, _), p in zip(rows, prints)]
    got = [tuple(r) for r in simhash.simhash_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(first.values(), key=repr)


@pytest.mark.parametrize("block_rows", [20_000, 40])
def test_simhash_links_of_dense_fingerprints(spark, block_rows):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    values = {flip(rng.choice(centres), rng.randrange(0, 9)) for _ in range(700)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    nodes = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(nodes, block_rows=block_rows)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.smallest_reachable(edges).collect()}
    want = defaultdict(set)
    for v, r in brute_roots(values).items():
        want[r].add(v)
    found = defaultdict(set)
    for v, r in got.items():
        found[r].add(v)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_rows_of_one_id_whose_text_hashes_share_31_bits(spark):
    """Nothing of one text is done to another: no line or document is lost, no score mixed."""
    common = "a line that document one has too"
    text = f"concat(md5(concat(id, 'a')), ' ', md5(concat(id, 'b')), '\n', if(id % 2 = 0, '{common}', md5(concat(id, 'c'))), if(id % 2 = 0, '', '\nlast'))"
    many = spark.range(300_000).selectExpr("id % 2 AS odd", f"{text} AS text").selectExpr("*", "xxhash64(text) & 2147483647 AS low")
    pairs = many.groupBy("low").agg(F.max(F.when(F.col("odd") == 0, F.col("text"))), F.max(F.when(F.col("odd") == 1, F.col("text"))))
    _, even, odd = pairs.toDF("low", "even", "odd").dropna().orderBy("low").first()
    docs = spark.createDataFrame([(1, f"another text\n{common}"), (None, even), (None, odd)], "doc_id long, text string")
    got = {r.text for r in line_dedup.dedup_lines(docs).filter("doc_id IS NULL").collect()}
    assert got == {even.replace("\n" + common, ""), odd}
    assert {r.text for r in simhash.drop_near_copies(docs).filter("doc_id IS NULL").collect()} == {even, odd}
    scores = language_model.lm_scores(docs).filter("doc_id IS NULL").collect()
    assert sorted(r.n_tokens for r in scores) == sorted(len(t.split()) + 1 for t in (even, odd))


def test_simhash_of_empty_table(empty):
    assert simhash.simhash_groups(empty).count() == 0 == simhash.drop_near_copies(empty).count()


# 5 decontamination


def brute_contamination(rows, items, k=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall((t or "").translate(UPPER))
    windows = [(i, tuple(w[j : j + k])) for i, w in ((i, split(t)) for i, t in items) if w for j in range(max(1, len(w) - k + 1))]
    out = []
    for i, t in rows:
        w = split(t)
        hit, found = set(), set()
        for item, win in windows:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs):
    small = docs.filter("length(text) < 20000 OR text IS NULL")
    rows = pairs_of(small)
    some = [t for _, t in rows if t and len(t.split()) > 14]
    items = [(1, " ".join(some[0].split()[2:14])), (2, "Alpha"), (3, None), (4, "..."), (5, "x gamma"), (5, some[1])]
    items += [(None, "zeta eta theta"), (10, " ".join(some[2].upper().split()[:10])), (11, "日本語 x"), (12, "never there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    got = decontaminate.contamination_report(small, bench).collect()
    assert sorted([tuple(r) for r in got], key=repr) == want
    blocks = decontaminate.contamination_report(small, bench, max_block_chars=40).collect()
    assert sorted([tuple(r) for r in blocks], key=repr) == want
    clean = decontaminate.drop_contaminated(small, bench)
    assert clean.columns == small.columns and clean.count() == sum(not w[-1] for w in want)


def test_decontamination_of_empty_tables(docs, empty):
    bench = empty.selectExpr("doc_id AS item_id", "text")
    assert decontaminate.contamination_report(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()


# 3 SentencePiece


def test_pieces_equal_the_library(docs, texts, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    vocabulary = pieces.Vocabulary.load(PIECE_MODEL)
    got = pieces.encode(docs, vocabulary)
    for r in got.collect():
        assert r.token_ids == library.encode(r.text or "") and r.n_tokens == len(r.token_ids) and r.round_trip
    back = pieces.decode(got.selectExpr("text AS was", "token_ids"), vocabulary)
    assert back.filter("text <> coalesce(was, '')").count() == 0
    assert pieces.encode(empty, vocabulary).count() == 0


def test_pieces_of_random_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    encoder = pieces.Encoder(pieces.Vocabulary.load(PIECE_MODEL))
    rng = random.Random(5)
    alphabet = "aabcdeeehilnorst     \n\té日本😀▁ßщ\x00'.,19"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(1_500)]
    texts += [" " * n for n in range(40)] + ["y" * 2_000, "▁", "the the the"]
    got = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(pa.array(texts))]
    assert got == library.encode(texts)
    assert [pieces.decode_ids(x, encoder.v.text) for x in got] == [library.decode(x) for x in got]


def test_pieces_without_byte_fallback():
    v = pieces.Vocabulary({"a": (1, 0.0), "b": (2, 0.0), "ab": (3, -1.0), " ": (4, 0.0)}, [], 0)
    assert [np.frombuffer(x, np.int32).tolist() for x in pieces.Encoder(v).encode(pa.array(["abcb", "", "ba"]))] == [
        [4, 3, 0, 2], [], [4, 2, 1]
    ]


# 4 language model


def brute_base(rows):
    tokens = [(i, WORD.findall((t or "").translate(UPPER)) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    c = Counter(x for i, ts in tokens if not held(i) for x in ts)
    n, v = sum(c.values()), len(c)
    return sorted(
        [(i, held(i), len(ts), sum(c[x] > 0 for x in ts), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in ts)) for i, ts in tokens],
        key=repr,
    ), c


def test_language_model_base_scores(docs, empty):
    want, _ = brute_base(pairs_of(docs))
    for options in ({}, {"group_bytes": 40_000}):
        got = sorted([tuple(r) for r in language_model.lm_scores(docs, **options).collect()], key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(abs(g[5] - w[5]) <= 1e-9 * abs(w[5]) for g, w in zip(got, want))
        assert all(np.isfinite(g[6]) and g[6] < 0 for g in got)
    assert language_model.lm_scores(empty).count() == 0


def brute_scores(rows):
    """Interpolated probabilities of all words from counts in dictionaries, none left out."""
    tokens = [(i, WORD.findall((t or "").translate(UPPER)) + [None]) for i, t in rows]
    c, follow = Counter(), defaultdict(Counter)
    for i, ts in tokens:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2:
            c.update(ts)
            for j, w in enumerate(ts):
                for k in (1, 2):
                    if j >= k:
                        follow[tuple(ts[j - k : j])][w] += 1
    total = sum(c.values()) + len(c) + 1

    def p(context, w):
        if not context:
            return (c[w] + 1) / total
        lower = p(context[1:], w)
        if context not in follow:
            return lower
        n = follow[context]
        return (max(n[w] - 0.75, 0) + 0.75 * len(n) * lower) / n.total()

    return [(i, sum(log10(p(tuple(ts[max(0, j - 2) : j]), w)) for j, w in enumerate(ts))) for i, ts in tokens]


def test_language_model_has_all_ngrams(spark, docs):
    """Also of more than 131,072 tokens, where an n-gram seen once is below every share of the tokens."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3_000)]
    large = [(i, " ".join(rng.choices(words, k=500))) for i in range(320)] + [(7_000, "the pair the pair the pair"), (7_000, "w1 w2")]
    large_docs = spark.createDataFrame(large, "doc_id long, text string")
    for rows, table, size in ((pairs_of(docs), docs, 50_000), (large, large_docs, 1 << 23), (large, large_docs, 60_000)):
        want = sorted(brute_scores(rows), key=repr)
        got = sorted([(r.doc_id, r.score) for r in language_model.lm_scores(table, group_bytes=size).collect()], key=repr)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(abs(g[1] - w[1]) <= 1e-9 * abs(w[1]) for g, w in zip(got, want))


def model_of(texts, train):
    """The grams of a group and the model that its own texts teach."""
    grams = language_model.Grams(pa.array(texts))
    counts = [grams.counts(k, np.array(train)) for k in range(3)]
    kinds = [np.bincount(x[c > 0], minlength=len(grams.keys[k])) for k, (x, c) in enumerate(((grams.head, counts[1]), (grams.context, counts[2])))]
    return grams, language_model.Model(counts, kinds, int(counts[0].sum()), int((counts[0] > 0).sum()))


def small_texts():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", f"w{k % 5}"]) for _ in range(rng.randrange(12))) for k in range(60)]
    return texts, [k % 7 != 2 for k in range(60)]


@pytest.mark.parametrize("lane", [1, 3, 2_048])
def test_automaton_passes_texts_as_defined(lane):
    texts, train = small_texts()
    rows = list(enumerate(texts))
    ids = [i for i in range(1_000) if zlib.crc32(str(i).encode()) % 7 != 2], [i for i in range(1_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(ids[0].pop() if t else ids[1].pop(), x) for t, x in zip(train, texts)]
    grams, model = model_of(texts, train)
    assert np.allclose(model.scores(grams, len(texts), lane), [s for _, s in brute_scores(rows)], rtol=1e-12)


def test_automaton_is_a_distribution():
    """In every state the probabilities of all words, the unseen one included, add up to one."""
    texts, train = small_texts()
    grams, model = model_of(texts, train)
    machine, after_word, _ = model.automaton(grams)
    words = np.arange(len(grams.keys[0]))
    assert len(machine.fail) > 20 and machine.fail.max() > 0
    known = model.counts[0] > 0
    for state in range(len(machine.fail)):
        one = np.ones(len(words), np.int64)
        got = 10 ** machine.run(words, words, one, np.full(len(words), state))
        leave, at = 0.0, state
        while at:
            leave, at = leave + machine.fail_weight[at], machine.fail[at]
        unseen = 10 ** (leave - np.log10(model.n_tokens + model.n_kinds + 1))
        assert abs(got[known].sum() + unseen - 1) < 1e-9 and np.allclose(got[~known], unseen)


def test_exchange_adds_up_and_names_one_owner():
    rng = np.random.default_rng(3)
    parts = []
    for g in range(5):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 40) // (1 << 57))
        parts.append((g, keys, rng.integers(0, 3, len(keys)) * 300))
    for buckets in (1, 3, 8):
        asked = pa.concat_tables([language_model.ask(g, buckets, {1: (k, n)}) for g, k, n in reversed(parts)])
        answers = [language_model._answer(asked.filter(pa.compute.equal(asked.column("bucket"), b))) for b in set(asked.column("bucket").to_pylist())]
        answers = pa.concat_tables(answers)
        want, owners = Counter(), {}
        for g, keys, n in parts:
            for k, x in zip(keys.tolist(), n.tolist()):
                want[k] += x
                if x:
                    owners.setdefault(k, g)
        for g, keys, _ in parts:
            total, owned = language_model.read_answers(answers.filter(pa.compute.equal(answers.column("g"), g)), 1, keys, buckets)
            assert total.tolist() == [want[k] for k in keys.tolist()] and owned.tolist() == [owners.get(k) == g for k in keys.tolist()]
        assert sum(answers.column("every").to_pylist()) == sum(want.values())
        assert all((language_model.unpack_keys(language_model.pack_keys(k)) == k).all() for _, k, _ in parts)
        assert sum(answers.column("distinct").to_pylist()) == len(owners)


def test_keys_are_put_in_order_whatever_their_leading_bits():
    rng = np.random.default_rng(8)
    spread = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    for keys in (spread, rng.choice(spread, 2_000), rng.integers(-3, 3, 300), (1 << 40) + rng.integers(0, 90, 700), spread[:1], spread[:0]):
        assert (language_model.in_order(keys) == np.argsort(keys, kind="stable")).all()
        found, first, number = language_model.distinct(keys)
        want = np.unique(keys, return_index=True, return_inverse=True)
        assert all((a == b).all() for a, b in zip((found, first, number), want))


def test_language_model_asks_for_kinds_slice_by_slice(spark, monkeypatch):
    """Neither all groups nor all buckets lie shuffled at once; the scores are those of one group."""
    staged, real = [], language_model.stage

    def spy(df, name, *rest, **options):
        staged.append(name)
        return real(df, name, *rest, **options)

    monkeypatch.setattr(language_model, "stage", spy)
    texts = [(i, f"a b c w{i % 7} d a b w{i % 5} c") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    many = {r.doc_id: r.score for r in language_model.lm_scores(docs, group_bytes=100).collect()}
    assert [staged.count(n) for n in ("lm-asks", "lm-kinds", "lm-scores")] == [language_model.SLICES] * 3
    one = {r.doc_id: r.score for r in language_model.lm_scores(docs, group_bytes=1 << 20).collect()}
    assert many.keys() == one.keys() and all(abs(many[k] - one[k]) < 1e-9 for k in many)


def test_language_model_has_a_bucket_for_several_groups(spark, monkeypatch):
    """Each group meets each bucket in a row, so buckets are fewer than groups, and a task gets many such rows at once."""
    buckets, at_once, real = {}, [], language_model.stage

    def spy(df, name, *rest, **options):
        at_once.append(int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        out = real(df, name, *rest, **options)
        if name == "lm-texts":
            buckets["groups"] = out.count()
        if name == "lm-counts":
            buckets[name] = max(buckets.get(name, 0), out.select("bucket").distinct().count())
        return out

    monkeypatch.setattr(language_model, "stage", spy)
    docs = spark.createDataFrame([(i, f"a b c w{i % 7} d a b w{i % 5} c x{i}") for i in range(90)], "doc_id long, text string")
    assert language_model.lm_scores(docs, group_bytes=100).count() == 90
    assert buckets["groups"] > 20 and 1 < buckets["lm-counts"] <= buckets["groups"] / 2
    assert min(at_once) > 100


def test_automaton_finds_arcs_by_the_ngrams_that_end_at_a_token():
    texts, train = small_texts()
    grams, model = model_of(texts, train)
    machine, _, _ = model.automaton(grams)
    size = np.bincount(grams.doc, minlength=len(texts))
    looked_up = machine.run(grams.word, np.cumsum(size) - size, size, np.zeros(len(texts), np.int64))
    assert np.allclose(model.scores(grams, len(texts)), looked_up, rtol=1e-12) and "arcs" in vars(machine)


def test_counted_ngrams_are_those_of_the_group():
    texts, train = small_texts()
    for some in (texts, [""], ["a"], ["a b", ""]):
        grams, learns = language_model.Grams(pa.array(some)), np.array(train[: len(some)])
        for orders in ((0, 1), (2,)):
            found = language_model.Grams.counted(pa.array(some), learns, orders)
            assert set(found) == set(orders)
            for k, (keys, n) in found.items():
                assert (keys == grams.keys[k]).all() and (n == grams.counts(k, learns)).all() and len(n) == len(keys)


def test_language_model_beats_its_base_on_held_out_texts(spark):
    out = QUERIES["op4_language_model"](spark, SF).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert out[0] > out[1]


# 1 and 9 quality


def brute_statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j + s for j, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for s in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_text_statistics_and_limits(docs, empty):
    got = quality_rules.apply_rules(docs, None).collect()
    want = []
    for i, t in pairs_of(docs):
        s = brute_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((i, *s, failed, None, not failed))
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)
    assert quality_rules.apply_rules(empty, None).count() == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_rules_learn_and_are_calibrated(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    out = quality_rules.apply_rules(docs, model).join(labels, "doc_id").filter("NOT base_failed")
    right = out.filter("kept = (quality = 1)").count() / out.count()
    assert right > 0.97
    gap = out.selectExpr("avg(probability) - avg(quality)").first()[0]
    assert abs(gap) < 0.05


def test_quality_rules_without_labels(spark, docs):
    assert quality_rules.fit(docs, labelled(spark, [])) is None
    assert quality_rules.fit(docs, labelled(spark, [(1, 1, 0), (2, None, 0), (None, 0, 0)])) is None


def test_sigmoid_recovers_slope_and_offset():
    rng = np.random.default_rng(4)
    x = rng.normal(size=20_000) * 2
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * x - 0.7)))).astype(float)
    slope, offset = quality_rules.fit_sigmoid(x, y)
    assert abs(slope - 1.5) < 0.1 and abs(offset + 0.7) < 0.1


def test_non_negative_risk_gradient():
    rng = np.random.default_rng(2)
    for scale in (0.3, 3.0):
        p, u = rng.normal(size=5) * scale, rng.normal(size=7) * scale
        value, gp, gu = quality_pu.non_negative_risk(p, u, 0.4)
        unbiased = lambda p, u: 0.4 * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - 0.4 * np.logaddexp(0, p).mean()
        if abs(value - unbiased(p, u)) < 1e-12:
            for k in range(5):
                d = np.eye(5)[k] * 1e-6
                assert abs((unbiased(p + d, u) - unbiased(p - d, u)) / 2e-6 - gp[k]) < 1e-6
            for k in range(7):
                d = np.eye(7)[k] * 1e-6
                assert abs((unbiased(p, u + d) - unbiased(p, u - d)) / 2e-6 - gu[k]) < 1e-6
    value, gp, gu = quality_pu.non_negative_risk(np.array([5.0]), np.array([-5.0]), 0.9)
    assert (gp > 0).all() and (gu < 0).all()  # below zero: away from fitting the sample


def test_quality_pu_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_pu.scores(docs, quality_pu.fit(docs, labels))
    assert out.count() == docs.count() and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    test = out.filter("held_out").join(labels, "doc_id")
    assert test.filter("predicted = quality").count() / test.count() > 0.98


def test_quality_pu_without_evidence(spark, docs, empty):
    model = quality_pu.fit(docs, labelled(spark, []))
    assert quality_pu.keep_good(docs, labelled(spark, [])).count() == docs.count()
    assert {round(r.score, 6) for r in quality_pu.scores(docs, model).collect()} == {0.5}
    every = labelled(spark, [(i, 1, 0) for i in range(200)])
    kept = quality_pu.keep_good(docs, every)
    assert kept.columns == docs.columns
    assert quality_pu.keep_good(empty, every).count() == 0


# 7 language


def brute_bits(train, languages, text):
    """Code lengths of a text by walking down the orders, without bounds on the trees."""
    counts = {x: [defaultdict(Counter) for _ in range(4)] for x in languages}
    for x, t in train:
        raw = b"   " + t.lower().encode()
        for i in range(3, len(raw)):
            for k in range(4):
                counts[x][k][raw[i - k : i]][raw[i]] += 1
    out = []
    for x in languages:
        raw, total = b"   " + text.lower().encode(), 0.0
        for i in range(3, len(raw)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    total += 8
                    break
                c = counts[x][k][raw[i - k : i]]
                n, kinds = sum(c.values()), len(c)
                if c[raw[i]]:
                    total -= np.log2(c[raw[i]] / (n + kinds))
                    break
                if n:
                    total -= np.log2(kinds / (n + kinds))
        out.append(total)
    return out


def test_language_code_lengths(spark):
    train = [("en", "the cat sat on the mat, there"), ("fr", "le chat était là"), ("en", "This that Ω"), ("de", "die Katze saß")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string")
    keep = [i for i in range(4) if zlib.crc32(str(i).encode()) % 4 != 2]
    train = [train[i] for i in keep]
    trees = language_id.fit(docs)
    assert trees.languages == sorted({x for x, _ in train})
    for text in ("the chat", "zzz qq", "là Ω saß 日", "x"):
        data = np.frombuffer(text.lower().encode(), np.uint8)
        bits = trees.bits(language_id._grams(data, np.array([0, len(data)])).astype(np.int64)).sum(axis=0)
        assert np.allclose(bits, brute_bits(train, trees.languages, text), atol=1e-3)


def test_language_trees_keep_all_grams(spark):
    """Also where a gram seen once is below every share of the bytes, and where tasks do not know all blocks."""
    rng = random.Random(3)
    text = lambda letters, k: "".join(rng.choices(letters, k=k))
    rows = [(i, text("abcdefghijklmnop ", 20_000), "en") for i in range(20)] + [(i, text("klmnopqrstuvwé ", 900), "fr") for i in range(20, 30)]
    rows += [(i, text("abcdklmnopqrsé ", 12), None) for i in range(30, 36)] + [(30, None, None), (None, "zzz abq", None), (None, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(x, t) for i, t, x in rows if x and zlib.crc32(str(i).encode()) % 4 != 2]
    short = [(i, t) for i, t, x in rows if not x]
    bits = [brute_bits(train, ["en", "fr"], t or "") for _, t in short]
    for max_cells in (1 << 22, 40_000, 0):
        trees = language_id.fit(docs, max_cells=max_cells)
        assert trees.away.any() == (max_cells < 1 << 22)
        out = language_id.predict(docs.filter("lang IS NULL"), trees).collect()
        got = sorted([(r.doc_id, r.lang_pred, round(r.score, 4)) for r in out], key=repr)
        want = []
        for (i, t), (en, fr) in zip(short, bits):
            share = 1 / (1 + 2.0 ** -abs(en - fr))
            letters = any(c.isalpha() for c in t or "")
            want.append((i, ("en" if en <= fr else "fr") if letters else "und", round(share, 4) if letters else 0.0))
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=repr)]
        assert all(abs(g[2] - w[2]) < 1e-3 for g, w in zip(got, sorted(want, key=repr)))


def test_language_of_held_out_rows_and_odd_texts(spark, docs, empty):
    tables = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    trees = language_id.fit(tables)
    out = language_id.predict(tables, trees).filter("held_out").join(tables.select("doc_id", "lang", "n_chars"), "doc_id")
    assert out.filter("lang = lang_pred").count() / out.count() > 0.97
    odd = language_id.predict(docs, trees)
    assert odd.count() == docs.count()
    letters = re.compile(r"[^\W\d_]")
    blank = sum(not letters.search(t or "") for _, t in pairs_of(docs))
    assert odd.filter("lang_pred = 'und' AND score = 0").count() == blank and odd.filter("score > 1").count() == 0
    assert language_id.predict(empty, trees).count() == 0
    assert language_id.fit(empty) is None
    assert language_id.predict(docs, None).filter("lang_pred <> 'und'").count() == 0


# 10 personal data


def brute_patterns(text):
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 14 <= len(d) <= 19 and pii.passes_luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 10 <= len(d) <= 15),
    ]
    out = []
    for k, (pattern, ok) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if ok(m.group(), re.sub("[^0-9]", "", m.group())):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns_equal_the_regular_expressions():
    rng = random.Random(11)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "+1 (212) 555-0147", "4111111111111111", "é",
            " ", "-", ".", "+", "12", "4111 1111-1111 1111", "(", "a", "@b.c", "000.01.2.3", "..", "+1", "\n"]
    for _ in range(4_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.pattern_spans(text) == brute_patterns(text), text


def brute_path(emissions, moves):
    """Best path by trying every one."""
    from itertools import product

    best, found = -np.inf, None
    for path in product(range(len(moves)), repeat=len(emissions)):
        walk = (0, *path, 0)
        s = sum(moves[a, b] for a, b in zip(walk, walk[1:])) + sum(e[x] for e, x in zip(emissions, path))
        if s > best:
            best, found = s, path
    return list(found)


def test_viterbi_of_many_runs():
    rng = np.random.default_rng(8)
    moves = rng.normal(size=(9, 9))
    runs = [rng.normal(size=(n, 9)) for n in (1, 3, 2, 4, 1, 3)]
    assert [x.tolist() for x in pii.viterbi(runs, moves)] == [brute_path(r, moves) for r in runs]
    assert pii.viterbi([], moves) == []


def test_model_labels_its_table_and_finds_what_patterns_miss():
    model = pii.train(pii.EXAMPLES)
    for line in pii.EXAMPLES:
        tokens, labels = pii.read_example(line)
        assert pii.viterbi([model.emissions(tokens)], model.moves)[0].tolist() == labels, line
    text = "dans le +1 (826) 555-4081 190.137.223.204 du, et 4012888888881881 4111111111111111."
    assert pii.joined(pii.pattern_spans(text)) == "ip:26:41"
    assert pii.joined(pii.model_spans([text], model)[0]) == "phone:8:25,ip:26:41,card:49:65,card:66:82"
    clean = "In 1999 the 3 versions 2.0. and 1.2.3 cost 1,234.56 (see page 12-14), token = \"04dbebab91ab85687d33\" 12:30"
    assert pii.model_spans([clean], model) == [[]]


def test_find_pii_rows(docs, empty, spark):
    out = pii.find_pii(docs)
    assert out.count() == docs.count() and out.filter("spans <> ''").count() == 0
    assert pii.find_pii(empty).count() == 0
    long = "a" * 200_000 + " " + "1" * 200_000 + " x@y.org " + "9." * 50_000 + " +" + "(" * 100_000
    rows = [(1, long), (2, None), (3, "é a@b.co +1 (212) 555-0147 10.0.0.1")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].spans == "email:2:8,phone:9:26,ip:27:35" and (got[3].n_email, got[3].n_phone, got[3].n_ip) == (1, 0, 1)
    assert got[3].base_sha256 == hashlib.sha256(b"email:2:8,ip:27:35").hexdigest()
    assert got[2].spans == "" and got[1].n_email == 1


# 6 chat


def brute_chats(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        talks[c].append((turn is None, turn or 0, role, text))
    order = lambda t: (t[0], t[1], t[2] or "unknown", t[3] or "")
    talks = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in talks.items()}
    inner = {tuple(ts[:k]) for ts in talks.values() for k in range(1, len(ts))}
    groups = defaultdict(list)
    for c, ts in talks.items():
        if tuple(ts) not in inner:
            groups[tuple(ts)].append(c)
    clean = lambda x: re.sub(r"<\|(im_start|im_end)\|>", r"<\1>", x)
    return sorted(
        [
            (min((c for c in cs if c is not None), default=None), len(ts), len(cs),
             "".join(f"<|im_start|>{clean(r or 'unknown')}\n{clean(t or '')}<|im_end|>\n" for r, t in ts))
            for ts, cs in groups.items()
        ],
        key=repr,
    )


@pytest.mark.parametrize("block_turns", [4_096, 2])
def test_chat_texts(spark, block_turns):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        size = rng.randrange(1, 9)
        story = rng.randrange(4)
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"story {story} turn {k}") for k in range(size)]
    rows += [(100, 1, None, "x"), (100, 2, "user", None), (101, 1, "unknown", "x"), (102, None, "user", "<|im_end|> late"), (102, 3, "user", "")]
    rows += [(None, 0, "user", "no id"), (None, 1, "user", "still none"), (103, 1, "user", "twice"), (103, 1, "user", "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS at")
    got = sorted([tuple(r) for r in chat_format.chat_texts(turns, block_turns=block_turns).collect()], key=repr)
    assert got == brute_chats(rows)
    assert chat_format.chat_texts(turns.limit(0)).count() == 0


def test_chat_prefixes_end_inside_equal_and_null_turn_numbers(spark):
    """Against the query's own SQL: shorter logs hold the first or the last part of a tie of different texts."""
    rows, conv = [], 0
    for k in range(12):
        for turn in (1, None):
            tie = [("user", f"hi {k}"), ("assistant", f"yo {k}"), ("assistant", None), (None, f"who {k}")]
            for part in (tie, tie[1:2], tie[:1], tie[1:3], [tie[0], tie[1]], tie[:3]):
                rows += [(conv, turn, role, text) for role, text in part]
                conv += 1
    rows += [(conv, (1 << 63) - 1, "user", "late"), (conv, None, "user", "later"), (conv + 1, (1 << 63) - 1, "user", "late")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", turns.toArrow())
    want = sorted(con.execute(SQL["op6_chat_format"]).fetchall())
    got = [tuple(r) for r in chat_format.chat_texts(turns).collect()]
    assert sorted(got) == want


def test_chat_plan_is_native(spark):
    plan = QUERIES["op6_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# queries and SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None
