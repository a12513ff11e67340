"""Personal data in texts: fixed patterns, and a linear-chain conditional random field.

Method: words are tokens; their shapes, and those of their neighbours, are features of
a linear-chain model over begin/inside labels of each kind.  It is trained on a small
labelled table by the gradient of its likelihood and decoded by Viterbi for all runs of
a batch at once.  A word without digit and ``@`` is never part of personal data: the
chain splits exactly there, so only runs of other words need decoding.

The patterns' spans always stay; the model adds spans that overlap none of them and
pass the same plausibility rules (digits, check digit, number ranges).  So it finds what
patterns miss because they run on into a following number.

Defined cases: null texts are empty and have no spans.  Positions count code points.
Pattern search is linear in the text, so very long texts and long runs are no problem; the
outline of a word is that of the whole word.  Pattern spans of different kinds may overlap and all
stay; of spans that begin together the kind listed first comes first.  Of overlapping model spans
there are none, as a word has one label.  Every row has its own result, however often it repeats; an
empty table gives an empty one.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .frames import named
from .pii_examples import EXAMPLES

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
_MARK = re.compile(r"<(/?)([a-z]+)>")
Span = tuple[int, int, int]  # begin, kind, end


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def plausible(kind: str, text: str) -> bool:
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        return bool(_AT_DOMAIN.search(text)) and text[0] != "@"
    if kind == "ip":
        return len(digits) <= 12 and bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text)) and all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and passes_luhn(digits)
    return 10 <= len(digits) <= 15


def pattern_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that are plausible."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _AT_DOMAIN.match(text, at) if begin < at else None
        if found:
            free = found.end()
            out.append((begin, 0, free))
        at = text.find("@", max(free, at + 1))
    for chain in _CHAIN.finditer(text):
        if chain.group().count(".") >= 3:
            parts = list(_DIGITS.finditer(text, chain.start(), chain.end()))
            for k in range(0, len(parts) - 3, 4):
                if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                    out.append((parts[k].start(), 1, parts[k + 3].end()))
    for kind, pattern in ((2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            if plausible(KINDS[kind], m.group()):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@lru_cache(maxsize=20_000)
def shape(token: str) -> tuple[str, str]:
    """A word's outline (runs of like characters as one) and the same with lengths of digit runs."""
    plain = re.sub(r"[^\W\d_]+", "a", token)
    return _DIGITS.sub("9", plain), _DIGITS.sub(lambda m: f"{len(m.group())}#", plain)


def features(tokens: list[str]) -> list[list[str]]:
    """Feature names of each word, given the words around it."""
    outline = [shape(t) if _matters(t) else ("w", "w") for t in tokens]
    edge = [("", ""), *outline, ("", "")]
    out = []
    for i, token in enumerate(tokens):
        core = token.strip(".,;:!?\"'()[]<>{}|#$%&*=")
        n = sum(map(len, _DIGITS.findall(core)))
        f = ["1", "s" + edge[i + 1][0], "l" + edge[i + 1][1], "<" + edge[i][1], ">" + edge[i + 2][1], f"n{min(n, 20)}"]
        if "@" in core:
            f.append(f"mail{plausible('email', core)}")
        if n >= 12:
            f.append(f"luhn{plausible('card', core)}")
        if core.count(".") >= 3:
            f.append(f"ip{plausible('ip', core)}")
        if token.startswith("+"):
            f.append("plus")
        out.append(f)
    return out


def _matters(token: str) -> bool:
    return "@" in token or _DIGIT.search(token) is not None


@dataclass
class ChainModel:
    """Weights of features (one vector over labels each) and of label pairs."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def emissions(self, tokens: list[str]) -> np.ndarray:
        zero = np.zeros(len(LABELS))
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in features(tokens)])


def read_example(line: str) -> tuple[list[str], list[int]]:
    """Words and label numbers of a marked sentence."""
    text, spans, begin = "", [], 0
    for part in re.split(r"(</?[a-z]+>)", line):
        mark = _MARK.fullmatch(part)
        if not mark:
            text += part
        elif mark[1]:
            spans.append((begin, len(text), mark[2]))
        else:
            begin = len(text)
    tokens, labels = [], []
    for m in _TOKEN.finditer(text):
        own = [s for s in spans if s[0] < m.end() and m.start() < s[1]]
        tokens.append(m.group())
        labels.append(LABELS.index(f"{'B' if own[0][0] >= m.start() else 'I'}-{own[0][2]}") if own else 0)
    return tokens, labels


def train(examples: list[str], rounds: int = 120, rate: float = 0.3, decay: float = 0.003) -> ChainModel:
    """Maximise the penalised likelihood by adaptive full steps; deterministic, and done once per query."""
    data = [read_example(x) for x in examples]
    names = {f: i for i, f in enumerate(sorted({f for t, _ in data for fs in features(t) for f in fs}))}
    n_labels, n = len(LABELS), len(names)
    rows = [[np.array([names[f] for f in fs]) for fs in features(t)] for t, _ in data]
    allowed = np.array([[b == 0 or LABELS[b][0] == "B" or LABELS[a][1:] == LABELS[b][1:] for b in range(n_labels)] for a in range(n_labels)])
    w = np.zeros(n * n_labels + n_labels * n_labels)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        emit, move = w[: n * n_labels].reshape(n, n_labels), w[n * n_labels :].reshape(n_labels, n_labels)
        g = decay * w
        g_emit, g_move = g[: n * n_labels].reshape(n, n_labels), g[n * n_labels :].reshape(n_labels, n_labels)
        trans = np.exp(np.where(allowed, move, -np.inf))
        for row, (_, labels) in zip(rows, data):
            score = np.array([emit[r].sum(axis=0) for r in row])
            score = np.exp(score - score.max(axis=1, keepdims=True))
            size = len(row)
            fore, back = np.empty((size, n_labels)), np.ones((size, n_labels))
            fore[0] = trans[0] * score[0]
            fore[0] /= fore[0].sum()
            for i in range(1, size):
                fore[i] = (fore[i - 1] @ trans) * score[i]
                fore[i] /= fore[i].sum()
            back[-1] = trans[:, 0]
            for i in range(size - 2, -1, -1):
                back[i] = trans @ (score[i + 1] * back[i + 1])
                back[i] /= back[i].sum()
            both = fore * back
            both /= both.sum(axis=1, keepdims=True)
            for i, r in enumerate(row):
                g_emit[r] += both[i]
                g_emit[r, labels[i]] -= 1
            for i in range(1, size):
                pair = fore[i - 1][:, None] * trans * (score[i] * back[i])[None, :]
                g_move += pair / pair.sum()
                g_move[labels[i - 1], labels[i]] -= 1
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    emit, move = w[: n * n_labels].reshape(n, n_labels), w[n * n_labels :].reshape(n_labels, n_labels)
    return ChainModel({f: emit[i] for f, i in names.items()}, np.where(allowed, move, -1e9))


def viterbi(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of all runs, which begin and end beside label O; one step serves every run."""
    order = sorted(range(len(emissions)), key=lambda k: -len(emissions[k]))
    sizes = np.array([len(emissions[k]) for k in order], np.int64)
    if not len(sizes):
        return []
    flat = np.concatenate([emissions[k] for k in order])
    first = np.cumsum(sizes) - sizes
    state = moves[0][None, :] + flat[first]
    came = []
    for step in range(1, int(sizes[0])):
        go = int(np.searchsorted(-sizes, -step, "left"))  # runs that are longer than ``step``
        paths = state[:go, :, None] + moves[None, :, :]
        came.append(paths.argmax(axis=1))
        state[:go] = paths.max(axis=1) + flat[first[:go] + step]
    out = [np.empty(n, np.int64) for n in sizes]
    label = (state + moves[:, 0][None, :]).argmax(axis=1)
    for step in range(int(sizes[0]) - 1, -1, -1):
        go = int(np.searchsorted(-sizes, -step, "left"))
        for k in range(go):
            out[k][step] = label[k]
        if step:
            label[:go] = came[step - 1][np.arange(go), label[:go]]
    found: list = [None] * len(order)
    for k, labels in zip(order, out):
        found[k] = labels
    return found


def _trimmed(text: str, begin: int, end: int, kind: int) -> tuple[int, int]:
    """Without the punctuation around a span."""
    lead = "+(" if kind == 3 else ""
    while begin < end and not (text[begin].isalnum() or text[begin] in lead):
        begin += 1
    while begin < end and not text[end - 1].isalnum():
        end -= 1
    return begin, end


def model_spans(texts: list[str], model: ChainModel) -> list[list[Span]]:
    """The plausible spans that the model labels in each text."""
    runs, emissions, memory = [], [], {}
    for i, text in enumerate(texts):
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        k = 0
        while k < len(tokens):
            if not _matters(tokens[k][2]):
                k += 1
                continue
            j = k
            while j < len(tokens) and _matters(tokens[j][2]):
                j += 1
            around = [*(t[2] for t in tokens[max(0, k - 1) : j + 1])]
            key = tuple(around), k > 0
            if key not in memory:
                skip = 1 if k > 0 else 0
                memory[key] = model.emissions(around)[skip : skip + j - k]
            runs.append((i, tokens[k:j]))
            emissions.append(memory[key])
            k = j
    out: list[list[Span]] = [[] for _ in texts]
    for (i, tokens), labels in zip(runs, viterbi(emissions, model.moves)):
        k = 0
        while k < len(tokens):
            if not labels[k]:
                k += 1
                continue
            kind, j = (labels[k] - 1) // 2, k + 1
            while j < len(tokens) and labels[j] == 2 * kind + 2:
                j += 1
            begin, end = _trimmed(texts[i], tokens[k][0], tokens[j - 1][1], kind)
            if begin < end and plausible(KINDS[kind], texts[i][begin:end]):
                out[i].append((begin, int(kind), end))
            k = j
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in sorted(spans))


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: list[str] = EXAMPLES
) -> DataFrame:
    """id, number of pattern spans of each kind, digest of them, and all spans, per row of ``docs``."""
    model = train(examples)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            some = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
            rows = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            counts = np.zeros((4, len(batch)), np.int64)
            digest, spans = [empty] * len(batch), [""] * len(batch)
            for lo in range(0, len(rows), 256):
                part = rows[lo : lo + 256]
                texts = column.take(pa.array(part)).to_pylist()
                for row, text, more in zip(part.tolist(), texts, model_spans(texts, model)):
                    base = pattern_spans(text)
                    for _, kind, _ in base:
                        counts[kind, row] += 1
                    digest[row] = hashlib.sha256(joined(base).encode()).hexdigest()
                    more = [s for s in more if not any(b < s[2] and s[0] < e for b, _, e in base)] if base else more
                    spans[row] = joined(base + more)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInArrow(run, f"id long, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_col)
