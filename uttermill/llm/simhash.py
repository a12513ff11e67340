"""SimHash fingerprints and the groups that links of few differing bits connect.

Method: every distinct fingerprint gets its Hamming distances to many reference
fingerprints (pivots).  Two fingerprints within ``max_bits`` differ by at most that in
every coordinate, so a pair with a larger difference in any coordinate is discarded
without comparing it; survivors are verified on the 64 bits.

Pairs meet in blocks, as a table alone would have to compare all with all.  64 bits are
cut into ``max_bits + 2`` ranges; fingerprints that differ in at most ``max_bits`` bits
agree on two whole ranges, hence share a block of one of the range pairs.  A block that
is too large is cut again by the same rule over its remaining bits, until it is small
or so few bits remain that it cannot be large; no pair is lost.  A block returns each
member with the smallest member of its connected group, never all pairs.

Defined cases: a null or wordless text has fingerprint zero, which links like any
other.  Fewer words than a shingle are one shingle.  Rows that share a fingerprint are
one node.  A null id never names a group unless no other id is in it.  A text of any length is
read whole, as a chunk by itself.  Rows that repeat are of one group, and each has its result; an
empty table gives an empty one.  A bit that is set in exactly half of the hashes is 0.  Columns of
other names are carried or not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .frames import NO_ID, named, packed, row_key
from .kernels import LOWER, WHITE, chunks, spans

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
N_PIVOTS = 24
BLOCK_ROWS = 20_000  # larger blocks are cut again
SHORT = 6  # blocks of so few members are compared together
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)  # byte value -> its bits, lowest first


def _fingerprints(column: pa.Array, shingle_words: int) -> np.ndarray:
    out = []
    digest = xxhash.xxh64_intdigest
    for a, b, data, bounds in chunks(column):
        low = LOWER[data]
        starts, ends, doc = spans(~WHITE[low], bounds)
        # words joined by one space: drop white bytes but one before each further word
        keep = ~WHITE[low]
        keep[starts[1:][doc[1:] == doc[:-1]] - 1] = True
        low[WHITE[low]] = 0x20
        place = np.concatenate([[0], np.cumsum(keep)])
        text = low[keep].tobytes()
        count = np.bincount(doc, minlength=b - a)
        first = np.concatenate([[0], np.cumsum(count)[:-1]]) if b > a else count
        n = np.where(count > 0, np.maximum(count - shingle_words + 1, 1), 0)
        owner = np.repeat(np.arange(b - a), n)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
        last = np.minimum(begin + shingle_words, first[owner] + count[owner]) - 1
        s, e = place[starts[begin]].tolist(), place[ends[last]].tolist()
        h = np.fromiter((digest(text[i:j], SEED) for i, j in zip(s, e)), np.uint64, len(s))
        ones = np.empty((b - a, 64))
        cells = owner * 256
        for byte in range(8):
            values = ((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            seen = np.bincount(cells + values, minlength=(b - a) * 256).reshape(b - a, 256)
            ones[:, 8 * byte : 8 * byte + 8] = seen @ _BITS
        bits = (2 * ones > n[:, None]).astype(np.uint64)
        out.append((bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """(doc, tag, fp): one row per row of ``docs``; see ``frames.row_key`` for doc and tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _fingerprints(batch.column("text"), shingle_words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(fp)], ["doc", "tag", "fp"])

    texts = docs.select(*row_key(id_col, text_col), named(text_col).alias("text"))
    return texts.mapInArrow(run, "doc long, tag long, fp long")


def _submasks(mask: int, max_bits: int) -> list[int]:
    """``mask`` with two more ranges of its free bits fixed, for every pair of ranges."""
    free = [i for i in range(64) if not mask >> i & 1]
    ranges = [sum(1 << i for i in part) for part in np.array_split(np.array(free, object), max_bits + 2)]
    return [mask | x | y for x, y in combinations(ranges, 2)]


def _deal(max_bits: int):
    """Rows (fp, mask) to rows (mask, key, fp) of the next finer blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, mask = (batch.column(k).to_numpy() for k in ("fp", "mask"))
            for m in np.unique(mask):
                own = fp[mask == m]
                for finer in _submasks(int(m) % (1 << 64), max_bits):
                    fixed = np.array(finer, np.uint64).view(np.int64)
                    columns = [np.full(len(own), fixed), own & fixed, own]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mask", "key", "fp"])

    return run


def _pivots(n: int) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def linked_members(fps: np.ndarray, max_bits: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its group) for all members that have a link, by pivot distances.

    A group is grown from one member at a time and its members leave the table at
    once, so a dense block needs few passes.
    """
    rest = np.unique(fps).view(np.uint64)
    table = np.bitwise_count(rest[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    rest, table = rest[order], table[order]
    alive = np.ones(len(rest), bool)
    members, roots = [], []
    for seed in range(len(rest)):
        if not alive[seed]:
            continue
        alive[seed] = False
        group, i = [seed], 0
        while i < len(group):
            at = group[i]
            i += 1
            # rows are sorted by the first coordinate: a window of it, then the others one by one
            lo = np.searchsorted(table[:, 0], table[at, 0] - max_bits, "left")
            hi = np.searchsorted(table[:, 0], table[at, 0] + max_bits, "right")
            near = lo + np.flatnonzero(alive[lo:hi])
            for k in range(1, table.shape[1]):
                if len(near) < 32:
                    break
                near = near[np.abs(table[near, k] - table[at, k]) <= max_bits]
            near = near[np.bitwise_count(rest[near] ^ rest[at]) <= max_bits]
            alive[near] = False
            group.extend(near.tolist())
        if len(group) > 1:
            own = rest[group].view(np.int64)
            members.append(own)
            roots.append(np.full(len(own), own.min()))
    if not members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(members), np.concatenate(roots)


def _short_blocks(
    fps: np.ndarray, sizes: np.ndarray, max_bits: int, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs in the blocks of at most SHORT members, all blocks at once."""
    bits = fps.view(np.uint64)
    left = np.repeat(np.where(sizes <= SHORT, np.cumsum(sizes), 0), sizes) - np.arange(len(fps)) - 1
    pairs = []
    for step in range(1, SHORT):
        a = np.flatnonzero(left >= step)
        for pivot in pivots:
            if not len(a):
                break
            far = np.bitwise_count(bits[a] ^ pivot).astype(np.int16) - np.bitwise_count(bits[a + step] ^ pivot)
            a = a[np.abs(far) <= max_bits]
        a = a[np.bitwise_count(bits[a] ^ bits[a + step]) <= max_bits]
        pairs.append((np.maximum(fps[a], fps[a + step]), np.minimum(fps[a], fps[a + step])))
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS, n_pivots: int = N_PIVOTS) -> DataFrame:
    """(a, b) with a > b: links, contracted to the smallest member in each block, of distinct ``nodes`` (fp)."""
    pivots = _pivots(n_pivots)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        held = None  # the rows of the last block seen, which the next batch may continue
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in ("mask", "key", "fp")])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            starts = np.concatenate([[0], np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1])
            held = rows[:, starts[-1] :]
            done = rows[2, : starts[-1]]
            sizes = np.diff(starts)
            yield edges_of(*_short_blocks(done, sizes, max_bits, pivots))
            for i in np.flatnonzero(sizes > SHORT).tolist():
                yield edges_of(*linked_members(done[starts[i] : starts[i + 1]], max_bits, pivots))
        if held is not None:
            yield edges_of(*linked_members(held[2], max_bits, pivots))

    todo, edges, fixed = nodes.select("fp", F.lit(0).cast("long").alias("mask")), None, 0
    while todo is not None:
        fixed = min(bin(m).count("1") for m in _submasks((1 << fixed) - 1, max_bits))
        blocks = stage(todo.mapInArrow(_deal(max_bits), "mask long, key long, fp long"), "simhash-blocks")
        large = blocks.limit(0).select("mask", "key")
        if (1 << (64 - fixed)) > block_rows:
            large = stage(
                blocks.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)
                .select("mask", "key"),
                "simhash-large",
            )
        again = not large.isEmpty()
        small = blocks.join(large, ["mask", "key"], "left_anti") if again else blocks
        part = (
            small.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(compare, "a long, b long")
        )
        edges = part if edges is None else edges.union(part)
        todo = blocks.join(large, ["mask", "key"], "left_semi").select("fp", "mask") if again else None
    return edges.distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the smallest node of its connected group.

    Each round every node takes the smallest label among its neighbours and itself
    (a minimum, combined before the shuffle), then the label of that label.  Labels
    are staged after a round; few rounds are needed as edges are contracted already.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "links")
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")),
        "labels",
    )
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("m"))
        )
        lower = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        fresh = stage(
            lower.join(jump, "root", "left").select("node", "old", F.coalesce("further", "root").alias("root")), "labels"
        )
        if fresh.filter("old <> root").isEmpty():
            return fresh.select("node", "root")
        labels = fresh.select("node", "root")


def components(rows: DataFrame, **options) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint of ``rows`` (doc, fp): the smallest id reachable."""
    nodes = stage(rows.groupBy("fp").agg(F.min("doc").alias("id")), "simhash-nodes")
    roots = smallest_reachable(links(nodes, **options))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = stage(rooted.select("fp", "id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    # staged, so that a group with a large part of the fingerprints is split among tasks of the join
    ids = stage(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "simhash-ids")
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as 16 lower-case hex digits."""
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(components(rows, **options), "fp", "left").select(
        known("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        known("component_id").alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` per group: its smallest id, null last; the smallest text hash among rows of that id."""
    prints = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    grouped = prints.join(components(prints, **options).select("fp", "root"), "fp")
    first = grouped.groupBy("root").agg(F.min(F.struct("doc", "tag")).alias("first")).select("first.*")
    rows = docs.select(packed(docs), *row_key(id_col, text_col))
    kept = rows.join(first, ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
