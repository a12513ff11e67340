"""SentencePiece encoding and decoding of whole texts with a given BPE vocabulary.

Method: the distinct units of a batch are concatenated and their suffixes sorted; a
binary search finds the range of occurrences of every piece.  Occurrences are edges
between positions; sorted by end position they are relaxed from left to right.

A byte-pair vocabulary has no sums of scores to minimise: its encoding is what merging
the best pair until none is left gives.  An edge therefore relaxes its end position if
merging the text of the last piece before it and its own text never joins the two.  Merges inside one piece do not depend on other pieces, so a sequence whose
neighbours all pass this test is the encoding, and every position has one such edge.

A unit is a stretch between two characters that no piece holds side by side (a word
with its blank, mostly); no merge crosses its ends, so units are encoded one by one
and each distinct one only once per batch.

Defined cases: null and empty texts have no pieces.  Characters without a piece become
byte pieces, or the unknown piece if there are none.  The blank sign U+2581 is read as
a blank, as the library does; any other text comes back unchanged from decoding.  Of merges of
one score the leftmost goes first.  A text of any length is encoded whole, as a chunk by itself.
Rows that repeat are encoded alike, each for itself; an empty table gives an empty one.  Carried
columns of any name and type come back unchanged, but for those named like the results
(n_tokens, token_ids, round_trip), which replace them.

Suffixes are sorted by their first eight bytes; a piece's range is exact for these, and the
rest of a longer piece is compared occurrence by occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType

from .frames import named, packed, with_fields
from .kernels import chunks

BLANK = "▁"
CHUNK, FRESH = 2 << 20, 1 << 18  # bytes of text, and of units not yet remembered, that are handled at once
CACHE_UNITS, CACHE_PAIRS = 250_000, 400_000  # remembered by a worker; only speed depends on them
_DEPTH = 16  # bytes by which ranges are compared; longer pieces are compared in full


class Vocabulary:
    """Pieces, their merge priorities and byte fallbacks, as plain values that tasks can receive."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int):
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.id = {p: i for p, (i, _) in pieces.items()}
        self.byte_ids, self.unknown = byte_ids, unknown
        self.usable = sorted((p.encode(), i) for p, i in self.id.items() if self.merged(p) == [p])
        pairs = np.zeros(1 << 16, bool)
        for p in self.id:
            for a, b in zip(p, p[1:]):
                pairs[a.encode()[-1] << 8 | b.encode()[0]] = True
        self.joined = pairs
        self.text = {i: p.encode() for p, i in self.id.items()}
        self.text |= {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """Read a model file; the library is only used to read it."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, byte_ids = {}, {}
        for i in range(m.get_piece_size()):
            text = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(text[1:-1], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                pieces[text.replace(BLANK, " ")] = (i, m.get_score(i))
        return cls(pieces, [byte_ids[b] for b in sorted(byte_ids)], m.unk_id())

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: merge the best pair, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def _big_endian(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ndarray(len(data) - 7, ">u8", data, strides=(1,))[at].astype(np.uint64)


class Encoder:
    """Encodes texts by suffix matching; remembers units and pair tests of earlier batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.names = {i: p for p, i in vocabulary.id.items()}
        self.n_ids = max([*vocabulary.text, vocabulary.unknown]) + 2
        self.lone = self.n_ids - 1  # stands for a character without a piece
        self.units: dict[bytes, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.courses: dict[int, list[tuple[float, str, str]]] = {}
        # pieces in byte order, grouped by how they are searched
        self.length = np.array([len(p) for p, _ in vocabulary.usable], np.int64)
        self.ids = np.array([i for _, i in vocabulary.usable], np.int64)
        pad = lambda fill: [p.ljust(_DEPTH, fill)[:_DEPTH] for p, _ in vocabulary.usable]
        low, high = (np.frombuffer(b"".join(pad(f)), ">u8").reshape(-1, 2).astype(np.uint64) for f in (b"\0", b"\xff"))
        self.low, self.high = low, high

    def _suffixes(self, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Character positions in the order of the eight bytes that begin there, and these bytes as numbers."""
        at = np.flatnonzero((data[:n] != 0) & ((data[:n] & 0xC0) != 0x80))
        head = _big_endian(data, at)
        order = np.argsort(head)
        return at[order], head[order]

    def _edges(self, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all occurrences of all pieces."""
        at, head = self._suffixes(data, n)
        lo = np.searchsorted(head, self.low[:, 0], "left")
        hi = np.searchsorted(head, self.high[:, 0], "right")
        found = np.flatnonzero(hi > lo)
        count = hi[found] - lo[found]
        flat = np.repeat(lo[found] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        start, which = at[flat], np.repeat(found, count)
        # a range is exact for eight bytes; of longer pieces the rest is compared
        long = np.flatnonzero(self.length[which] > 8)
        if len(long):
            tail, piece = _big_endian(data, start[long] + 8), which[long]
            wrong = (tail < self.low[piece, 1]) | (tail > self.high[piece, 1])
            deep = np.flatnonzero(~wrong & (self.length[piece] > _DEPTH))
            if len(deep):
                text = data[:n].tobytes()
                for k in deep.tolist():
                    full = self.v.usable[piece[k]][0]
                    wrong[k] = not text.startswith(full, start[long[k]])
            keep = np.ones(len(start), bool)
            keep[long[wrong]] = False
            start, which = start[keep], which[keep]
        return start, start + self.length[which], self.ids[which]

    def _course(self, piece: int) -> list[tuple[float, str, str]]:
        """Priority of each merge inside a piece, in order, with the piece's first and last part before it."""
        known = self.courses.get(piece)
        if known is None:
            known, parts, score = [], list(self.names[piece]), self.v.score
            while len(parts) > 1:
                scores = [score.get(x + y, -np.inf) for x, y in zip(parts, parts[1:])]
                best = max(scores)
                at = scores.index(best)
                known.append((best, parts[0], parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known.append((-np.inf, parts[0], parts[0]))
            self.courses[piece] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces never joins across their border.

        Both run through their own merges; a merge across wins if it is better than
        the left piece's next one and not worse than the right piece's (the leftmost
        of equals is merged first).
        """
        one, two, score = self._course(left), self._course(right), self.v.score
        i = j = 0
        while True:
            a, b = one[i], two[j]
            across = score.get(a[2] + b[1])
            if across is not None and across > a[0] and across >= b[0]:
                return False
            if a[0] == b[0] == -np.inf:
                return True
            if a[0] >= b[0]:
                i += 1
            else:
                j += 1

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging the texts of two neighbours leaves exactly these two."""
        keys, back = np.unique(before * self.n_ids + piece, return_inverse=True)
        known = self.pairs
        out = np.empty(len(keys), bool)
        for k, key in enumerate(keys.tolist()):
            ok = known.get(key)
            if ok is None:
                a, b = divmod(key, self.n_ids)
                ok = self.lone in (a, b) or self._apart(a, b)
                known[key] = ok
            out[k] = ok
        return out[back]

    def _encode_units(self, units: list[bytes]) -> None:
        """Add the encodings of ``units`` to those remembered."""
        joined = b"\0".join(units) + bytes(_DEPTH + 9)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(u) for u in units], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        n = int(begins[-1] + sizes[-1])
        start, end, piece = self._edges(data, n)
        unit_of = np.repeat(np.arange(len(units)), sizes + 1)  # of each position, the separator after it included
        # characters without a piece of their own; they end before the next character or at their unit's end
        chars = np.flatnonzero(((data[: n + 1] & 0xC0) != 0x80) & (np.arange(n + 1) < (begins + sizes)[unit_of]))
        stop = np.minimum(np.append(chars[1:], n), (begins + sizes)[unit_of[chars]])
        char_end = np.zeros(n + 1, np.int64)
        char_end[chars] = stop
        single = np.zeros(n + 1, bool)
        single[start[end == char_end[start]]] = True
        lone = ~single[chars]
        start = np.concatenate([start, chars[lone]])
        end = np.concatenate([end, stop[lone]])
        piece = np.concatenate([piece, np.full(int(lone.sum()), self.lone)])
        # relax by distance from the unit's begin: all units at once
        base = begins[unit_of[start]]
        far = end - base
        order = np.argsort(far.astype(np.uint16) if sizes.max() < 1 << 16 else far, kind="stable")
        start, end, piece, far, base = (x[order] for x in (start, end, piece, far, base))
        last = np.full(n + 1, -1, np.int64)  # piece that ends at a position
        back = np.full(n + 1, -1, np.int64)
        cuts = np.flatnonzero(np.diff(far)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(far)]):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            opens = s == base[a:b]
            ok = opens.copy()
            rest = np.flatnonzero(~opens)
            rest = rest[last[s[rest]] >= 0]
            if len(rest):
                ok[rest] = self._fits(last[s[rest]], p[rest])
            last[e[ok]] = p[ok]
            back[e[ok]] = s[ok]
        # follow the chosen edges from the end of each unit, all units at once
        unit, pos = np.arange(len(units)), begins + sizes
        out_unit, out_pos, out_piece, out_from = [], [], [], []
        while len(unit):
            out_unit.append(unit)
            out_pos.append(pos)
            out_piece.append(last[pos])
            pos = back[pos]
            out_from.append(pos)
            go = pos > begins[unit]
            unit, pos = unit[go], pos[go]
        unit, pos, piece, src = (np.concatenate(x) for x in (out_unit, out_pos, out_piece, out_from))
        order = np.lexsort((pos, unit))
        unit, pos, piece, src = unit[order], pos[order], piece[order], src[order]
        ids = piece.astype(np.int32)
        ends = np.cumsum(np.bincount(unit, minlength=len(units)))
        odd = set(unit[piece == self.lone].tolist())
        begin = 0
        for k, stop_at in enumerate(ends.tolist()):
            if k in odd:
                out = []
                for q in range(begin, stop_at):
                    if piece[q] != self.lone:
                        out.append(int(piece[q]))
                    elif self.v.byte_ids:
                        out += [self.v.byte_ids[x] for x in joined[src[q] : pos[q]]]
                    else:
                        out.append(self.v.unknown)
                self.units[units[k]] = np.array(out, np.int32).tobytes()
            else:
                self.units[units[k]] = ids[begin:stop_at].tobytes()
            begin = stop_at

    def encode_chunks(self, column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
        """(first row, end row, ids of each text as the bytes of 32-bit integers) of consecutive rows."""
        plain = pc.replace_substring(column.cast(pa.large_string()), BLANK, " ")
        for a, b, data, bounds in chunks(plain, CHUNK):
            filled = np.diff(bounds) > 0
            data = np.insert(data, bounds[:-1][filled], 0x20)  # the blank before a text
            bounds = bounds + np.concatenate([[0], np.cumsum(filled)])
            if not len(data):
                yield a, b, [b""] * (b - a)
                continue
            cut = np.ones(len(data) + 1, bool)
            pair = data[:-1].astype(np.int64) << 8 | data[1:]
            cut[1:-1] = ~self.v.joined[pair] & ((data[1:] & 0xC0) != 0x80)
            cut[bounds] = True
            edges = np.flatnonzero(cut)
            text = data.tobytes()
            places = edges.tolist()
            units = [text[s:e] for s, e in zip(places, places[1:])]
            if len(self.units) > CACHE_UNITS:
                self.units.clear()
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            fresh = list(set(units) - self.units.keys())
            sizes = np.cumsum([len(u) for u in fresh])
            parts = np.searchsorted(sizes, np.arange(0, sizes[-1] + FRESH, FRESH)).tolist() if fresh else []
            for s, e in zip(parts, [*parts[1:], len(fresh)]):
                if e > s:
                    self._encode_units(fresh[s:e])
            of = self.units.__getitem__
            first = np.searchsorted(edges, bounds).tolist()
            yield a, b, [b"".join(map(of, units[s:e])) for s, e in zip(first, first[1:])]

    def encode(self, column: pa.Array) -> list[bytes]:
        return [ids for _, _, part in self.encode_chunks(column) for ids in part]


def decode_ids(ids: list[int], text: dict[int, bytes]) -> str:
    """Pieces joined, byte pieces as bytes, without the blank that encoding puts first."""
    joined = b"".join([text.get(i, b" \xe2\x81\x87 ") for i in ids]).decode("utf-8", "replace")
    return joined[1:] if joined[:1] == " " else joined


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all), then n_tokens, token_ids and round_trip (decoding gives the text back)."""
    keep = docs.columns if carry is None else carry
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        pieces = vocabulary.text
        for batch in batches:
            for a, b, part in encoder.encode_chunks(batch.column("text")):
                sizes = np.array([len(x) // 4 for x in part], np.int64)
                flat = np.frombuffer(b"".join(part), np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                texts = batch.column("text").slice(a, b - a).to_pylist()
                ids = np.split(flat, offsets[1:-1])
                same = [decode_ids(i.tolist(), pieces) == (t or "") for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(a, b - a),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(same, pa.bool_()),
                    ],
                    ["row", "n_tokens", "token_ids", "round_trip"],
                )

    rows = docs.select(packed(docs.select(*[named(c) for c in keep])), named(text_col).alias("text"))
    ids = ArrayType(IntegerType())
    out = rows.mapInArrow(run, with_fields(rows, ["row"], n_tokens=LongType(), token_ids=ids, round_trip=BooleanType()))
    taken = [F.col("row").getField(c).alias(c) for c in keep if c not in ("n_tokens", "token_ids", "round_trip")]
    return out.select(*taken, "n_tokens", "token_ids", "round_trip")


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of their ids; null ids give null, unknown ones the library's sign."""
    @F.pandas_udf("string")
    def text_of(ids):
        import pandas as pd

        pieces = vocabulary.text
        return pd.Series([None if x is None else decode_ids(list(x), pieces) for x in ids], dtype=object)

    return rows.withColumn(out, text_of(named(ids_col)))
