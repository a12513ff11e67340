"""numpy helpers over the UTF-8 bytes of an Arrow text column; they run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts that numpy handles at once; a longer text is a chunk by itself

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# two primes below 2**31 and a base for each, drawn once: a span's hash is a polynomial of its bytes modulo both
_FIELDS = ((2147483647, 1284397553), (2147483629, 1950340681))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def chunks(column: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets in them) of consecutive rows of about ``budget`` bytes."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + budget, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of ``inside`` bytes; a run never crosses rows."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= edge[1:-1] | ~inside[:-1]
    end[:-1] &= edge[1:-1] | ~inside[1:]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(bounds, starts, "right") - 1


def line_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; the break belongs to no line, an empty row is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([bounds[1:], breaks]), kind="stable")
    owner = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, "right") - 1])
    return starts, ends, np.sort(owner, kind="stable")


def _power_table(field: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n`` or more of a field's base and of its inverse."""
    if field not in _powers or len(_powers[field][0]) <= n:
        prime, base = _FIELDS[field]
        tables = []
        for factor in (base, pow(base, -1, prime)):
            table = np.ones(1, np.uint64)
            while len(table) <= max(n, CHUNK_BYTES):
                step = np.uint64(pow(factor, len(table), prime))
                table = np.concatenate([table, table * step % np.uint64(prime)])
            tables.append(table)
        _powers[field] = tables[0], tables[1]
    return _powers[field]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class SpanHasher:
    """64-bit hashes of arbitrary spans of one byte array, by prefix sums of polynomials modulo two primes."""

    def __init__(self, data: np.ndarray):
        self._parts = []
        for field, (prime, _) in enumerate(_FIELDS):
            powers, inverse = _power_table(field, len(data) + 1)
            terms = (data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)]
            if len(data) > 1 << 24:  # sums of that many terms could pass 64 bits
                terms %= np.uint64(prime)
            prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(terms, out=prefix[1:])
            self._parts.append((prefix, inverse, np.uint64(prime)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = ((prefix[ends] - prefix[starts]) % prime * inverse[starts] % prime for prefix, inverse, prime in self._parts)
        return mix(a << np.uint64(32) | b)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per byte) in each row."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class RowIndex:
    """Row numbers of distinct 64-bit keys in one open table; -1 for other keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.append(keys.astype(np.int64), 0)  # one more, as an unknown key's row -1 reads it
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(self.keys[:-1])
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of keys that meet here, the last one stays
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.slots[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != keys[wrong])]
        return out


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is
    printable, or else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in plain)
    sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [sign[b] for b in range(256)]
