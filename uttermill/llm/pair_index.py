"""Byte-pair encoding and decoding of whole texts by an index of pair occurrences.

Method: the distinct words of a batch become symbols in one linked list; every adjacent
pair that has a merge rank is mapped to all positions where it stands.  The active ranks
are applied in ascending order: each merges its pair at all positions at once, from left to
right, and puts the pairs that arise with the neighbours into the lists of their own ranks.
No rule joins a symbol that a rule of the same or a higher rank makes (checked on loading),
so a rank that has been applied never becomes active again.

White space of ASCII (space, tab, line breaks) never belongs to a word and nothing joins
across it, so texts are cut there into units; each distinct unit is normalised and cut into
words by the two components of the vocabulary's file that do this, once while it is
remembered, and each distinct word is merged once while it is remembered.  Strings of special tokens inside
a text become these tokens, as the file asks.  Memory of a task is bounded by its texts'
chunks, the parts of new words merged at once, and two bounded stores; a text is the
smallest chunk, a word the smallest part.

Defined cases: null and empty texts, and those of white space only, have no tokens and
decode to an empty text.  Rows that repeat are encoded alike, each for itself; an empty
table gives an empty one.  There are no ties: equal ranks are one pair.  Carried columns of
any name and type come back unchanged, but for those named like the results, which replace
them.  Decoding leaves ids without a token out; null ids give null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType

from .frames import named, packed, with_fields
from .kernels import RowIndex, byte_alphabet, chunks

CHUNK, FRESH = 1 << 21, 1 << 18  # bytes of text, and of new units, that are handled at once
FEW = 48  # new pairs that are looked up one by one
# fixed value: the words of lower-case ASCII without white space, as the vocabulary's file cuts them
ASCII_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
DECODED_ROWS = 1 << 9  # texts that are decoded at once
MEMORY = 150_000  # units and words that a task remembers; only speed depends on it


class WordVocabulary:
    """Symbols, merge rules by rank and special tokens, as plain values that tasks can receive."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, special: dict[str, int], normalizer, splitter):
        self.special, self.normalizer, self.splitter = special, normalizer, splitter
        self.first, self.last = (np.array([vocab.get(c + x, -1) for c in byte_alphabet()], np.int64) for x in ("", suffix))
        self.names = {i: t for t, i in (vocab | special).items()}
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        made = {c: rank for rank, (_, _, c) in enumerate(self.rules)}
        if len(made) < len(self.rules) or any(max(made.get(a, -1), made.get(b, -1)) >= k for k, (a, b, _) in enumerate(self.rules)):
            raise ValueError("each symbol must be made by one rule, which comes before those that join it")
        keys = [a << 32 | b for a, b, _ in self.rules]
        self.rank_of, self.rank = dict(zip(keys, range(len(keys)))), RowIndex(np.array(keys, np.int64))
        self.bytes_of = {ord(c): b for b, c in enumerate(byte_alphabet())}
        self.plain_ascii = self._cuts_ascii()

    @classmethod
    def load(cls, file: str) -> WordVocabulary:
        """Read a vocabulary of merges between words that white space and a suffix end."""
        import json

        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            text = f.read()
        model, whole = json.loads(text)["model"], Tokenizer.from_str(text)
        asked = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix")}
        added = json.loads(text)["added_tokens"]
        if model["type"] != "BPE" or any(asked.values()) or model.get("ignore_merges") or whole.decoder is not None:
            raise ValueError("only plain merges without unknown token, prefix, dropout and decoder are known here")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only special tokens that are matched as they stand are known here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        suffix, special = model.get("end_of_word_suffix") or "", {t["content"]: t["id"] for t in added}
        made = cls(model["vocab"], merges, suffix, special, whole.normalizer, whole.pre_tokenizer)
        if made.words("a \t\n\r\x0b\x0cb") != [b"a", b"b"]:
            raise ValueError("white space must end words and belong to none")
        return made

    def words(self, text: str) -> list[bytes]:
        """Words of a text, as bytes."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [self.word(w) for w, _ in self.splitter.pre_tokenize_str(text)]

    def word(self, signs: str) -> bytes:
        """The bytes that the signs of the byte alphabet stand for."""
        return signs.translate(self.bytes_of).encode("latin-1")

    def _cuts_ascii(self) -> bool:
        """Whether ASCII is lower-cased and cut as ``ASCII_WORD`` says: tried on all pairs of characters, and more."""
        if self.splitter is None:
            return False
        signs = [chr(c) for c in range(0x21, 0x7F)] + ["\x00", "\x1c", "\x7f", "'ll", "'RE", "'Ve", "abc", "12"]
        for a in signs:
            text = " ".join(f"{a}{b} {b}x{a}1" for b in signs)
            if self.words(text) != [w for unit in text.encode().split() for w in ASCII_WORD.findall(unit.lower())]:
                return False
        return True


def _symbols(words: list[bytes], v: WordVocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First symbols of all words, and the word of each; bytes without a symbol are left out."""
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    symbol, last = v.first[data], np.cumsum(size)[size > 0] - 1
    symbol[last] = v.last[data[last]]
    word = np.repeat(np.arange(len(words)), size)
    return symbol[symbol >= 0], word[symbol >= 0]


def _every_other(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the pairs of one symbol with itself merge: from left to right, none that overlaps the one before."""
    out, taken = np.ones(len(p), bool), -1
    for k, (a, b) in enumerate(zip(p.tolist(), q.tolist())):
        out[k] = a != taken
        taken = b if out[k] else taken
    return out


def merge_words(words: list[bytes], v: WordVocabulary) -> list[bytes]:
    """Ids of each word as 32-bit little-endian numbers, all words merged together."""
    symbol, word = _symbols(words, v)
    n = len(symbol)
    symbol = np.append(symbol, -1)  # position n stands before and after every word
    inner = word[1:] == word[:-1]
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[np.append(~inner, True)[:n].nonzero()[0]] = n
    before[np.append(True, ~inner)[:n].nonzero()[0]] = n
    at = np.flatnonzero(inner)
    rank = v.rank(symbol[at] << 32 | symbol[at + 1])
    at, rank = at[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    ranks, begin = np.unique(rank[order], return_index=True)
    first = dict(zip(ranks.tolist(), np.split(at[order], begin[1:])))  # rank to all positions of its pair
    places: dict[int, list[int]] = {}  # and to those that merges have added
    active = list(first)
    heapify(active)

    def add(left: np.ndarray, right: np.ndarray, where: np.ndarray) -> None:
        key = left << 32 | right
        if len(key) < FEW:
            found = [(v.rank_of.get(k, -1), p) for k, p in zip(key.tolist(), where.tolist())]
        else:
            r = v.rank(key)
            found = zip(r[r >= 0].tolist(), where[r >= 0].tolist())
        for new, p in found:
            if new in places:
                places[new].append(p)
            elif new >= 0:
                places[new] = [p]
                if new not in first:
                    heappush(active, new)

    while active:
        now = heappop(active)
        left, right, made = v.rules[now]
        p, more = first.pop(now, None), places.pop(now, None)
        if more is not None:
            more = np.array(sorted(more))
            p = more if p is None else np.sort(np.concatenate([p, more]))
        q = after[p]
        stands = (symbol[p] == left) & (symbol[q] == right)  # another merge may have taken one of the two
        p, q = p[stands], q[stands]
        if left == right:
            alone = _every_other(p, q)
            p, q = p[alone], q[alone]
        if not len(p):
            continue
        symbol[p], symbol[q] = made, -1
        r = after[q]
        after[p], before[r] = r, p
        o = before[p]
        inside = o != n
        add(symbol[o[inside]], np.full(int(inside.sum()), made), o[inside])
        inside = (r != n) & (symbol[r] != made)  # a neighbour made just now has reported the pair
        add(np.full(int(inside.sum()), made), symbol[r[inside]], p[inside])
    alive = symbol[:n] >= 0
    ids, ends = symbol[:n][alive].astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))
    return [ids[s:e] for s, e in zip([0, *ends.tolist()], ends.tolist())]


class Encoder:
    """Encodes texts; remembers units and words of earlier chunks."""

    def __init__(self, vocabulary: WordVocabulary):
        self.v = vocabulary
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.units: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _parts(self, unit: bytes) -> list[tuple[bytes | str, bool]]:
        """Words of a unit, and special tokens, marked so."""
        text, out = unit.decode(), []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            out += [(part, True)] if k % 2 else [(w, False) for w in self.v.words(part)]
        return out

    def _words_of(self, units: list[bytes]) -> list[list[bytes]]:
        """Words of units without white space and special tokens, all cut at once."""
        text = b" ".join(units).decode()
        if self.v.normalizer is not None:
            text = self.v.normalizer.normalize_str(text)
        edges = [m.start() for m in re.finditer(" ", text)] + [len(text)]
        if len(edges) != len(units):
            return [self.v.words(u.decode()) for u in units]
        out: list[list[bytes]] = [[] for _ in units]
        unit, edge, own = 0, edges[0], out[0]
        for w, (begin, _) in self.v.splitter.pre_tokenize_str(text):
            while begin > edge:
                unit += 1
                edge, own = edges[unit], out[unit]
            own.append(self.v.word(w))
        return out

    def _remember(self, words: set[bytes]) -> None:
        fresh = list(words - self.words.keys())
        self.words.update(zip(fresh, merge_words(fresh, self.v)))

    def _learn(self, units: list[bytes]) -> None:
        """Add the encodings of ``units`` to those remembered."""
        if len(self.words) > MEMORY:
            self.words.clear()
        single, several, plain, odd = [], [], [], []
        special = lambda t: self.cut is not None and self.cut.search(t)
        for u in units:
            if self.v.plain_ascii and u.isalpha():  # letters of ASCII
                single.append(u)
            elif special(t := u.decode()) or len(t.split()) != 1:
                odd.append(u)
            else:
                (several if self.v.plain_ascii and u.isascii() else plain).append(u)
        low = [u.lower() for u in single]
        cut = [ASCII_WORD.findall(u.lower()) for u in several] + (self._words_of(plain) if plain else [])
        self._remember({w for ws in cut for w in ws}.union(low))
        of = self.words.__getitem__
        self.units.update(zip(single, map(of, low)))
        self.units.update((u, b"".join(map(of, ws))) for u, ws in zip(several + plain, cut))
        known = {t: np.array([i], "<u4").tobytes() for t, i in self.v.special.items()}
        for u in odd:
            parts = self._parts(u)
            self._remember({w for w, whole in parts if not whole})
            self.units[u] = b"".join([known[w] if whole else self.words[w] for w, whole in parts])

    def encode_chunks(self, column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
        """(first row, end row, ids of each text as 32-bit little-endian numbers) of consecutive rows."""
        for a, b, data, bounds in chunks(column, CHUNK):
            raw, edges = data.tobytes(), bounds.tolist()
            rows = [raw[s:e].split() for s, e in zip(edges, edges[1:])]
            if len(self.units) > MEMORY:
                self.units.clear()
            fresh = list({u for row in rows for u in row} - self.units.keys())
            sizes = np.cumsum([len(u) for u in fresh])
            at = np.searchsorted(sizes, np.arange(0, sizes[-1] + FRESH, FRESH)).tolist() if fresh else []
            for s, e in zip(at, [*at[1:], len(fresh)]):
                if e > s:
                    self._learn(fresh[s:e])
            of = self.units.__getitem__
            yield a, b, [b"".join(map(of, row)) for row in rows]

    def encode(self, column: pa.Array) -> list[bytes]:
        return [ids for _, _, part in self.encode_chunks(column) for ids in part]


RESULTS = ("n_tokens", "token_ids")


def _text_of(names: dict[int, str], ids: list[int]) -> str:
    return " ".join([names[i] for i in ids if i in names])


def encode(
    docs: DataFrame,
    vocabulary: WordVocabulary,
    text_col: str = "text",
    carry: list[str] | None = None,
    as_bytes: bool = False,
    decoded: str | None = None,
) -> DataFrame:
    """Columns ``carry`` (default: all), then n_tokens and token_ids, and the decoded text if a name is given for it.

    The ids are an array of int, or with ``as_bytes`` unsigned 32-bit little-endian numbers
    one after another, which is how large tables are better kept.
    """
    keep = docs.columns if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for a, b, part in encoder.encode_chunks(batch.column("text")):
                sizes = np.array([len(x) // 4 for x in part], np.int64)
                if as_bytes:
                    ids = pa.array(part, pa.binary())
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(part), "<i4")))
                columns = [batch.column("row").slice(a, b - a), pa.array(sizes), ids]
                if decoded:
                    columns.append(pa.array([_text_of(vocabulary.names, np.frombuffer(x, "<u4").tolist()) for x in part], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(packed(docs.select(*[named(c) for c in keep])), named(text_col).alias("text"))
    fields = dict(zip(RESULTS, (LongType(), BinaryType() if as_bytes else ArrayType(IntegerType()))))
    fields |= {"decoded": StringType()} if decoded else {}
    names = ["row", *fields]
    out = rows.mapInArrow(run, with_fields(rows, ["row"], **fields))
    results = {c: decoded if c == "decoded" else c for c in fields}
    taken = [F.col("row").getField(c).alias(c) for c in keep if c not in results.values()]
    return out.select(*taken, *[F.col(c).alias(name) for c, name in results.items()])


def decode(rows: DataFrame, vocabulary: WordVocabulary, ids_col: str = "token_ids", out: str = "text") -> DataFrame:
    """All columns of ``rows`` and the text of their ids (array or bytes): tokens with blanks between."""
    names = vocabulary.names

    def text_of(ids) -> str | None:
        if ids is None:
            return None
        return _text_of(names, np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                texts = pa.array([text_of(x.as_py()) for x in part.column("ids")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), texts], ["row", "decoded"])

    kept = rows.select(packed(rows), named(ids_col).alias("ids"))
    found = kept.mapInArrow(run, with_fields(kept, ["row"], decoded=StringType()))
    taken = [F.col("row").getField(c).alias(c) for c in rows.columns if c != out]
    return found.select(*taken, F.col("decoded").alias(out))
