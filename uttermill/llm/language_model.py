"""Scoring of texts by a smoothed n-gram model in the form of a backoff automaton.

Method: states are contexts (none, one word, two words), arcs the n-grams of the training
texts with their interpolated log-probability, and each state has a failure arc to the
context one word shorter with the log of the mass left to it.  One traversal of a text from
left to right carries the state and adds up the weights it passes.

    p(w | u) = max(c(u w) - D, 0) / c(u) + left(u) * p(w | u without its first word)
    left(u)  = D * kinds(u) / c(u), kinds(u) being the number of words seen after u
    p(w)     = (c(w) + 1) / (N + V + 1)

All n-grams of all training texts count, at any size of the input.  Texts are dealt into groups
of about ``GROUP_BYTES``.  A group asks for the counts of its distinct n-grams: sorted hashes
go out in one row per bucket of the hash range, a bucket adds up what all groups have, and
the totals come back in the order asked, so no n-gram is a row of its own and none is sent
back.  One group of those that hold an n-gram in training text is told to count it as a kind; the
kinds of each context seen more than once are added up by a second exchange of the same form; a
context seen once has one kind.  From both, each
group builds the part of the automaton that its texts pass through (their states, arcs, failure
arcs and weights are those of the whole model) and runs its texts through it.

Buckets follow hashes of whole n-grams, so a common word, pair or context is no hot bucket: of
an n-gram there is one entry per group at most.  Rows of groups and buckets are the one thing
that grows with the square of the input; a bucket serves ``BUCKET_GROUPS`` groups' worth of
n-grams, and workers get such rows many at once.

Words and n-grams are told apart by 64-bit hashes.  Defined cases: a null text has the end token
only.  Rows that repeat, or share an id, are scored and learned each for itself.  A null id trains
or not by the checksum of the empty text.  Without training texts every probability is one.
An empty table gives an empty result.  There are no ties: weights are sums and quotients of
counts.  A text of any length is scored whole; a group holds one text at least.  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import shuffles_removed, stage
from .frames import batches_up_to, crc_remainder, named, row_key
from .kernels import LOWER, WHITE, RowIndex, SpanHasher, chunks, mix, signed, spans

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
END = np.int64(1)  # hash that stands for the end of a text
GROUP_BYTES = 3 << 20
SLICES = 4  # of the groups, which ask for kinds and are scored one after another, and of the buckets that answer
PART_BYTES = 1 << 18  # of a group's texts that are hashed at once
BATCH_BYTES = 1 << 20  # that a Python worker gets at once; a row that holds a group of texts comes alone
BUCKET_GROUPS = 4  # groups' worth of n-grams that meet in a bucket
LANE = 64  # tokens of a text that one lane of the traversal passes


def token_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token of a chunk, with one end token after each row's words."""
    low = LOWER[data]
    starts, ends, doc = spans(~WHITE[low], bounds)
    n_rows = len(bounds) - 1
    stops = np.cumsum(np.bincount(doc, minlength=n_rows))
    return np.insert(signed(SpanHasher(low)(starts, ends)), stops, END), np.insert(doc, stops, np.arange(n_rows))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of all but its last word and that of its last."""
    return signed(mix(mix(a.view(np.uint64)) + b.view(np.uint64)))


def in_order(keys: np.ndarray) -> np.ndarray:
    """Places of the keys in ascending order, equal ones as they come.  Leading bits and place are sorted as one
    number; only if keys that differ share these bits out of order are whole keys compared."""
    n = len(keys)
    bits = np.uint64(n.bit_length())
    both = ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> bits << bits) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = keys[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(keys, kind="stable")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, the place where each comes first, and the number of each key."""
    order = in_order(keys)
    found = keys[order]
    new = np.append(True, found[1:] != found[:-1])[: len(keys)]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return found[new], order[new], number


def _hashed(texts: pa.Array, orders: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Row of every token, and by order the tokens at which n-grams end and the hashes of these."""
    parts = [(h, doc + a) for a, _, data, bounds in chunks(texts, PART_BYTES) for h, doc in [token_hashes(data, bounds)]]
    h, doc = (np.concatenate([x[k] for x in parts]) for k in range(2))
    doc = doc.astype(np.int32)

    def hashes() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        inner = np.append(False, doc[1:] == doc[:-1])[: len(h)]
        whole, ends = h, np.ones(len(h), bool)
        for k in range(orders):
            if k:  # all but the last word end at the token before
                ends = inner & np.append(False, ends[:-1])
                before, whole = whole, np.zeros(len(h), np.int64)
                whole[1:] = _joined(before[:-1], h[1:])
            at = np.flatnonzero(ends).astype(np.int32)
            yield at, whole[at] if k else h

    return doc, hashes()


class Grams:
    """Tokens of a group's texts and its distinct n-grams of one, two and three words, in hash order."""

    def __init__(self, texts: pa.Array):
        self.doc, hashes = _hashed(texts, 3)
        self.keys, self.of, self.at = [], [], []  # by order: distinct hashes, their numbers, and at which tokens
        first = []
        for at, key in hashes:
            found, begin, number = distinct(key)
            self.keys.append(found)
            self.of.append(number)
            self.at.append(at)
            first.append(at[begin])
        self.word = self.of[0]
        self.pair_at, self.triple_at = (np.full(len(self.doc), -1, np.int32) for _ in range(2))  # that end at each token
        self.pair_at[self.at[1]], self.triple_at[self.at[2]] = self.of[1:]
        self.head, self.last = self.word[first[1] - 1], self.word[first[1]]  # words of each distinct pair
        # pairs that begin and end each distinct triple, and its last word
        self.context, self.tail, self.third = self.pair_at[first[2] - 1], self.pair_at[first[2]], self.word[first[2]]

    def counts(self, order: int, train: np.ndarray) -> np.ndarray:
        """Occurrences of each distinct n-gram in the rows that ``train``."""
        return np.bincount(self.of[order], weights=train[self.doc[self.at[order]]], minlength=len(self.keys[order])).astype(np.int64)

    @staticmethod
    def counted(texts: pa.Array, train: np.ndarray, orders: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By order, the distinct n-grams in hash order and their ``counts``, without the rest."""
        doc, hashes = _hashed(texts, max(orders) + 1)
        out = {}
        for k, (at, key) in enumerate(hashes):
            if k in orders:
                order = in_order(key)
                key = key[order]
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                n = train[doc[at]][order].astype(np.int64)
                out[k] = key[begin], np.add.reduceat(n, begin) if len(n) else n
        return out

    def kinds(self, counts: list[np.ndarray], answers: pa.Table, buckets: int) -> list[np.ndarray]:
        """Words seen after each word and each pair; one after a context seen once, none after an end."""
        out = []
        for k, last in ((0, self.keys[0]), (1, self.keys[0][self.last])):
            n = ((counts[k] == 1) & (last != END)).astype(np.int64)
            often = counts[k] > 1
            n[often] = read_answers(answers, 3 + k, self.keys[k][often], buckets)[0]
            out.append(n)
        return out


PACKED = "g int, id array<long>, train array<boolean>, text array<string>"


def _pack(rows: pa.Table) -> pa.Table:
    """All rows of a group as one."""
    ends = pa.array([0, rows.num_rows], pa.int32())
    lists = {c: pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in ("id", "train", "text")}
    return pa.table({"g": rows.column("g")[:1], **lists})


def _group(row: pa.Table | pa.RecordBatch) -> tuple[int, pa.Array, np.ndarray, pa.Array]:
    """Number, ids, whether they train, and texts of the group that a packed row holds."""
    flat = {c: row.column(c).to_pylist()[0] if c == "g" else _flat(row.column(c)) for c in row.schema.names}
    return flat["g"], flat.get("id"), flat["train"].to_numpy(zero_copy_only=False), flat["text"]


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()


# exchanges: groups ask, buckets answer

ASK = "kind int, bucket int, g int, keys binary, n binary"
ANSWER = "g int, kind int, bucket int, totals binary, owned binary, every long, distinct long"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    top = int(values.max(initial=0))
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if top <= np.iinfo(t).max)).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<{'u' if len(raw) < 8 * n else 'i'}{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as steps from one to the next, first bytes of all before second ones: the
    high bytes are zeros, which the shuffle's compression takes out."""
    steps = np.diff(keys.view(np.uint64), prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64).view(np.int64)


def ask(g: int, buckets: int, asked: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of one group: by kind and bucket, keys and what the group adds to each."""
    rows = {"kind": [], "bucket": [], "g": [], "keys": [], "n": []}
    edges = np.array([(b << 64) // buckets - (1 << 63) for b in range(1, buckets)], np.int64)
    for kind, (keys, n) in asked.items():
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for b, (s, e) in enumerate(zip(cuts, cuts[1:])):
            if e > s:
                for name, value in zip(rows, (kind, b, g, pack_keys(keys[s:e]), _packed(n[s:e]))):
                    rows[name].append(value)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(rows.items(), kinds)})


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a bucket's keys for each group that asked, in the order asked; and for which of
    them the group is the first to add something."""
    table = table.sort_by("g")
    keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
    n = np.concatenate([_unpacked(x.as_py(), len(k)) for x, k in zip(table.column("n"), keys)])
    cuts = np.cumsum([len(k) for k in keys])
    flat = np.concatenate(keys)
    order = in_order(flat)  # entries of a key by group
    begin = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
    total = np.add.reduceat(n[order], begin)
    number = np.empty(len(flat), np.int64)
    number[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(flat))))
    adds = np.flatnonzero(n[order] > 0)
    owner = adds[np.append(True, number[order][adds][1:] != number[order][adds][:-1])[: len(adds)]]
    owned = np.zeros(len(flat), bool)
    owned[order[owner]] = True
    totals = [_packed(x) for x in np.split(total[number], cuts[:-1])]
    marks = [np.packbits(x).tobytes() for x in np.split(owned, cuts[:-1])]
    once = [int(total.sum()), int((total > 0).sum())]  # of the bucket, on its first row
    rest = [0] * (len(keys) - 1)
    return pa.table(
        {
            "g": table.column("g"), "kind": table.column("kind"), "bucket": table.column("bucket"),
            "totals": pa.array(totals, pa.binary()), "owned": pa.array(marks, pa.binary()),
            "every": pa.array([once[0], *rest], pa.int64()), "distinct": pa.array([once[1], *rest], pa.int64()),
        }
    )


def read_answers(answers: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of a group's keys of one kind, and which of them it owns."""
    edges = np.array([(b << 64) // buckets - (1 << 63) for b in range(1, buckets)], np.int64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    total, owned = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for k, b, t, o in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "totals", "owned"))):
        if k == kind:
            s, e = cuts[b], cuts[b + 1]
            total[s:e] = _unpacked(t, e - s)
            owned[s:e] = np.unpackbits(np.frombuffer(o, np.uint8), count=e - s)
    return total, owned


def _exchange(asks: DataFrame, name: str) -> DataFrame:
    return stage(asks.groupBy("kind", "bucket").applyInArrow(_answer, ANSWER), name)


# the automaton


@dataclass
class Automaton:
    """Arcs by (state, word); state 0 is the empty context, whose arcs are the words themselves.
    States of one word come next, then those of two."""

    root_weight: np.ndarray
    root_target: np.ndarray
    keys: np.ndarray  # state << 32 | word of every arc
    weight: np.ndarray
    target: np.ndarray
    fail_weight: np.ndarray
    fail: np.ndarray
    one_word: int  # states of one word

    @cached_property
    def arcs(self) -> RowIndex:
        return RowIndex(self.keys)

    def run(
        self, words: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, ends: tuple[np.ndarray, np.ndarray] | None = None
    ) -> np.ndarray:
        """Sum of the weights that lanes of tokens pass from their first states, all lanes in step.

        ``ends`` are the arcs, or -1, of the pair and the triple that end at each token of texts of which the
        automaton knows all n-grams: a state's arc for the next word is one of these, and need not be looked up."""
        order = np.argsort(-size, kind="stable")  # lanes that have ended are the last
        begin, size, state = begin[order], size[order], state[order].copy()
        total = np.zeros(len(begin))
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, "left"))
            at = begin[:live] + step
            word = words[at]
            todo = np.arange(live)
            while len(todo):
                here = state[todo]
                root = here == 0
                done = todo[root]
                total[done] += self.root_weight[word[done]]
                state[done] = self.root_target[word[done]]
                todo, here = todo[~root], here[~root]
                if ends is None:
                    arc = self.arcs(here << 32 | word[todo])
                else:
                    arc = np.where(here <= self.one_word, ends[0][at[todo]], ends[1][at[todo]])
                hit = arc >= 0
                done, arc = todo[hit], arc[hit]
                total[done] += self.weight[arc]
                state[done] = self.target[arc]
                todo, here = todo[~hit], here[~hit]
                total[todo] += self.fail_weight[here]
                state[todo] = self.fail[here]
        out = np.empty(len(total))
        out[order] = total
        return out


@dataclass
class Model:
    """What a group knows of the model: the counts of its n-grams and the kinds after its contexts."""

    counts: list[np.ndarray]
    kinds: list[np.ndarray]  # after each word, after each pair
    n_tokens: int
    n_kinds: int

    def automaton(self, grams: Grams) -> tuple[Automaton, np.ndarray, np.ndarray]:
        """The automaton, and the state after each word alone and after each pair."""
        (c1, c2, c3), (k1, k2) = self.counts, self.kinds
        head, last, context, tail = grams.head, grams.last, grams.context, grams.tail
        p1 = (c1 + 1.0) / (self.n_tokens + self.n_kinds + 1.0)
        open1, open2 = k1 > 0, k2 > 0  # contexts that a word follows in training text
        left1, left2 = (DISCOUNT * k / np.maximum(c, 1) for k, c in ((k1, c1), (k2, c2)))
        seen = lambda c, whole, left, lower: np.maximum(c - DISCOUNT, 0) / np.maximum(whole, 1) + left * lower
        p2 = np.where(open1[head], seen(c2, c1[head], left1[head], p1[last]), p1[last])
        p3 = np.where(open2[context], seen(c3, c2[context], left2[context], p2[tail]), p2[tail])
        word_state, pair_state = np.zeros(len(c1), np.int64), np.zeros(len(c2), np.int64)
        word_state[open1] = 1 + np.arange(int(open1.sum()))
        pair_state[open2] = 1 + int(open1.sum()) + np.arange(int(open2.sum()))
        after = np.where(open2, pair_state, word_state[last])
        two, three = c2 > 0, c3 > 0
        states = np.concatenate([word_state[head[two]], pair_state[context[three]]])
        words = np.concatenate([last[two], grams.third[three]]).astype(np.int64)
        return (
            Automaton(
                np.log10(p1),
                word_state,
                states << 32 | words,
                np.log10(np.concatenate([p2[two], p3[three]])),
                np.concatenate([after[two], after[tail[three]]]),
                np.concatenate([[0.0], np.log10(left1[open1]), np.log10(left2[open2])]),
                np.concatenate([np.zeros(1 + int(open1.sum()), np.int64), word_state[last[open2]]]),
                int(open1.sum()),
            ),
            word_state,
            np.where(two, after, word_state[last]),
        )

    def scores(self, grams: Grams, n_texts: int, lane: int = LANE) -> np.ndarray:
        """Log10 probability of each text.  A long text is passed in lanes: a later one begins in
        the state that the words before it lead to."""
        machine, after_word, after_pair = self.automaton(grams)
        size = np.bincount(grams.doc, minlength=n_texts)
        lanes = -(-size // lane)
        text = np.repeat(np.arange(n_texts), lanes)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
        begin = (np.cumsum(size) - size)[text] + offset
        before = np.maximum(begin - 1, 0)
        pair = grams.pair_at[before]
        state = np.where(pair >= 0, after_pair[pair] if len(after_pair) else 0, after_word[grams.word[before]])
        state = np.where(offset > 0, state, 0)
        two, three = (np.append(c > 0, False) for c in self.counts[1:])  # arcs are numbered in the order of their n-grams
        ends = np.where(two, np.cumsum(two) - 1, -1)[grams.pair_at], np.where(three, two.sum() + np.cumsum(three) - 1, -1)[grams.triple_at]
        total = machine.run(grams.word, begin, np.minimum(lane, size[text] - offset), state, ends)
        return np.bincount(text, weights=total, minlength=n_texts)


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """One row per row of ``docs``; the model is learned from the rows outside the held-out fold."""
    found, n_tokens = scored(docs, crc_remainder(id_col, FOLDS) != HELD_OUT, id_col, text_col, group_bytes)
    return found.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def scored(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES
) -> tuple[DataFrame, int]:
    """((id, train, n_tokens, n_known, base_score, score) per row, number of training tokens)."""
    spark = docs.sparkSession
    text = F.coalesce(named(text_col), F.lit(""))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 8), F.lit(0))).first()[0]
    groups = int(-(-n_bytes // group_bytes)) or 1
    buckets = -(-groups // BUCKET_GROUPS)
    dealt = F.pmod(F.xxhash64(*row_key(id_col, text_col), F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    rows = docs.select(dealt.alias("g"), named(id_col).cast("long").alias("id"), train.alias("train"), text.alias("text"))

    def ask_counts(orders: tuple[int, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    g, _, learns, texts = _group(batch.slice(k, 1))
                    asked = ask(g, buckets, Grams.counted(texts, learns, orders))
                    yield from asked.combine_chunks().to_batches()

        return run

    def ask_kinds(left: pa.Table, answers: pa.Table) -> pa.Table:
        """Distinct n-grams that the group owns, counted by their contexts."""
        g, _, _, texts = _group(left)
        grams = Grams(texts)
        (words, _), (pairs, own2), (_, own3) = (read_answers(answers, k, grams.keys[k], buckets) for k in range(3))
        after = np.bincount(grams.head[own2], minlength=len(words)), np.bincount(grams.context[own3], minlength=len(pairs))
        often = [c > 1 for c in (words, pairs)]
        return ask(g, buckets, {3 + k: (grams.keys[k][o], n[o]) for k, (o, n) in enumerate(zip(often, after))})

    with shuffles_removed(spark), batches_up_to(spark, BATCH_BYTES):
        # the groups are fixed from here on
        texts = stage(rows.groupBy("g").applyInArrow(_pack, PACKED), "lm-texts")
        counts = [_exchange(texts.drop("id").mapInArrow(ask_counts(k), ASK), "lm-counts") for k in ((0, 1), (2,))]
        counts = counts[0].unionByName(counts[1])
        mine = [F.col("g") % SLICES == k for k in range(SLICES)]  # the shuffle files of a slice go before the next
        asks = [texts.drop("id").filter(m).groupBy("g").cogroup(counts.filter(m).groupBy("g")).applyInArrow(ask_kinds, ASK) for m in mine]
        asks = reduce(DataFrame.unionByName, [stage(x, "lm-asks") for x in asks])
        cuts = [k * buckets // SLICES for k in range(SLICES + 1)]
        kinds = [_exchange(asks.filter(F.col("bucket").between(a, b - 1)), "lm-kinds") for a, b in zip(cuts, cuts[1:]) if a < b]
        kinds = reduce(DataFrame.unionByName, kinds)
        every = counts.filter("kind = 0").agg(F.sum("every"), F.sum("distinct")).first()
        n_tokens, n_kinds = every[0] or 0, every[1] or 0

        def score(left: pa.Table, answers: pa.Table) -> pa.Table:
            _, ids, learns, texts = _group(left)
            grams, n = Grams(texts), len(ids)
            counts = [read_answers(answers, k, grams.keys[k], buckets)[0] for k in range(3)]
            model = Model(counts, grams.kinds(counts, answers, buckets), n_tokens, n_kinds)
            c = model.counts[0]
            base = np.log10((c + 1.0) / (n_tokens + n_kinds + 1.0))
            by_text = lambda x: np.bincount(grams.doc, weights=x[grams.word], minlength=n)
            return pa.table(
                {
                    "id": ids, "train": pa.array(learns),
                    "n_tokens": pa.array(np.bincount(grams.doc, minlength=n), pa.int64()),
                    "n_known": pa.array(by_text(c > 0).astype(np.int64)),
                    "base_score": pa.array(by_text(base)), "score": pa.array(model.scores(grams, n)),
                }
            )

        answers = counts.unionByName(kinds).drop("every", "distinct")
        schema = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"
        found = []
        for m in mine:
            both = texts.filter(m).groupBy("g").cogroup(answers.filter(m).groupBy("g"))
            found.append(stage(both.applyInArrow(score, schema), "lm-scores"))
        return reduce(DataFrame.unionByName, found), n_tokens
