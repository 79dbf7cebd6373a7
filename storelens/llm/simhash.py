"""SimHash near-duplicates by a binary trie self-join.

Fingerprint: bit b is 1 if it is set in more than half of the XXH64 hashes
(seed 42) of a text's word shingles.  Two fingerprints link when they differ
in at most ``max_bits`` bits; classes are the connected components.

The join runs over the different fingerprints only.  The 64 bits are cut
into blocks; a pair within the limit agrees on all but ``max_bits`` blocks,
so for each choice of blocks that may agree, the fingerprints are rotated to
begin with them and dealt by their value: that is the part of the trie where
no error is allowed.  Below it each task walks pairs of trie nodes together,
adds up differing bits and drops a pair beyond the limit.  Nodes whose
leaves are known to be in one class are not compared again, and a task
returns a spanning forest of its links, never all pairs of a group.  A value
shared by many fingerprints is cut into chunks, and each pair of chunks is a
group of its own.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and links like any other; a text of fewer words than a
shingle has one shingle, its words; repeated rows have one class and one
result row each; ids are below 2**62; rows with a null id count, but name no
class (a class of null ids only has a null id); an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, utf8

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
# Fingerprints of one value that one task takes together.
CHUNK = 2048
# Node pairs that a task holds at once, and leaf pairs compared directly.
FRONTIER = 200_000
LEAF_PAIRS = 64


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()
    digest, more = xxhash.xxh64_intdigest, min(shingle_words, len(words)) - 1
    n = len(words) - more
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        h = np.array([digest(joined[s:e], SEED) for s, e in
                      zip(starts[lo:hi], ends[lo + more:hi + more], strict=True)], dtype=np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], schema=schema)

    return docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("t")).mapInArrow(
        run, "key long, fp long")


# -- the trie self-join --------------------------------------------------------

def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components (smallest index) after adding links a-b."""
    parent = parent.copy()
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)


def _spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, lo[i] .. lo[i] + n[i] - 1, with the i of each."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]


def trie_join(fps: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int,
              skip: int = 0) -> np.ndarray:
    """Component of each fingerprint under the links inside its group.

    Rows are sorted by (group, fps) and those of a group agree on the first
    ``skip`` bits.  ``side`` 0 is compared with itself; in a group with a
    side 1, the two sides are compared with each other.  Both are sorted by
    (group, side, fps) here, each run being one trie.
    """
    order = np.lexsort((fps, side, group))
    fps, run = fps[order], (group * 2 + side)[order]
    n = len(fps)
    parent = np.arange(n)
    if n < 2:
        return np.arange(n)
    # neighbours in a trie that link anyway
    near = (run[1:] == run[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= max_bits)
    at = np.flatnonzero(near)
    parent = _unite(parent, at, at + 1)
    starts = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
    ends = np.concatenate([starts[1:], [n]])
    g, s = run[starts] // 2, run[starts] % 2
    two = np.isin(g, g[s == 1])
    alone = ~two
    first = two & (s == 0)
    pair = np.flatnonzero(first)  # its side 1 is the next run
    stack = [(skip, starts[alone], ends[alone], starts[alone], ends[alone],
              np.zeros(alone.sum(), dtype=np.int64)),
             (skip, starts[pair], ends[pair], starts[pair + 1], ends[pair + 1],
              np.zeros(len(pair), dtype=np.int64))]
    ones: dict[int, np.ndarray] = {}

    def cut(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the leaves of each node begin to have bit ``depth`` set."""
        if depth not in ones:
            bit = (fps >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return hi - (ones[depth][hi] - ones[depth][lo])

    def change() -> np.ndarray:
        return np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])

    changes = change()
    while stack:
        depth, a0, a1, b0, b1, bits = stack.pop()
        # empty nodes, and nodes whose leaves are one class already
        keep = (a1 > a0) & (b1 > b0)
        a0, a1, b0, b1, bits = (x[keep] for x in (a0, a1, b0, b1, bits))
        one = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (parent[a0] == parent[b0])
        a0, a1, b0, b1, bits = (x[~one] for x in (a0, a1, b0, b1, bits))
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            for part in (slice(half, None), slice(0, half)):
                stack.append((depth, a0[part], a1[part], b0[part], b1[part], bits[part]))
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth >= 64)
        if small.any():
            of, i = _spread(a0[small], (a1 - a0)[small])
            of2, j = _spread(b0[small][of], (b1 - b0)[small][of])
            i = i[of2]
            link = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
            if link.any():
                parent = _unite(parent, i[link], j[link])
                changes = change()
            big = ~small
            a0, a1, b0, b1, bits = (x[big] for x in (a0, a1, b0, b1, bits))
            if not len(a0):
                continue
        am, bm = cut(a0, a1, depth), cut(b0, b1, depth)
        own = (a0 == b0) & (a1 == b1)  # a node with itself: its halves meet once
        cross = bits < max_bits
        once = cross & ~own
        join = np.concatenate
        stack.append((
            depth + 1, join([a0, am, a0[cross], am[once]]), join([am, a1, am[cross], a1[once]]),
            join([b0, bm, bm[cross], b0[once]]), join([bm, b1, b1[cross], bm[once]]),
            join([bits, bits, bits[cross] + 1, bits[once] + 1])))
    out = np.empty(n, dtype=np.int64)
    out[order] = order[parent]
    return out


def _blocks(count: int, max_bits: int) -> tuple[int, list[tuple[int, ...]]]:
    """Number of blocks, and the choices of blocks that may agree: enough bits
    that a value is shared by some thousand unrelated fingerprints at most."""
    for blocks in range(max_bits + 1, 65):
        agree = blocks - max_bits
        if count / 2 ** (64 // blocks * agree) <= CHUNK or comb(blocks + 1, agree + 1) > 200:
            return blocks, list(combinations(range(blocks), agree))
    return 64, list(combinations(range(64), 64 - max_bits))


def _rotate(fps: np.ndarray, choice: tuple[int, ...], edges: list[int]) -> tuple[np.ndarray, int]:
    """Fingerprints with the chosen blocks of bits first, and the length of those."""
    out = np.zeros_like(fps)
    left, lead = 64, 0
    rest = [b for b in range(len(edges) - 1) if b not in choice]
    for b in [*choice, *rest]:
        width = edges[b + 1] - edges[b]
        left -= width
        part = (fps >> np.uint64(64 - edges[b + 1])) & np.uint64((1 << width) - 1)
        out |= part << np.uint64(left)
        lead += width if b in choice else 0
    return out, lead


def links(fps: DataFrame, count: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) of representatives that span the classes within each group.

    ``fps``: one row (fp, rep) for each different fingerprint, ``count`` of them.
    """
    blocks, choices = _blocks(count, max_bits)
    edges = [64 * b // blocks for b in range(blocks + 1)]
    dealt = pa.schema([("choice", pa.int32()), ("value", pa.int64()), ("rot", pa.int64()), ("rep", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, choice in enumerate(choices):
                rot, lead = _rotate(fp, choice, edges)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(fp), k, dtype=np.int32)),
                    pa.array((rot >> np.uint64(64 - lead)).view(np.int64)),
                    pa.array(rot.view(np.int64)), batch.column(1)], schema=dealt)

    rows = fps.select("fp", "rep").mapInArrow(deal, "choice int, value long, rot long, rep long")
    sizes = rows.groupBy("choice", "value").agg(F.count("*").alias("m")).where("m > 1")
    # a value with more than CHUNK fingerprints becomes c chunks, and a row goes
    # to each pair of chunks that has its own
    rows = rows.join(sizes, ["choice", "value"]).withColumn(
        "c", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("rot"), F.col("c")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select(
        "choice", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(
            (F.col("own") > F.col("other")).cast("int")).alias("side"), "rot", "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def solve(table: np.ndarray) -> pa.RecordBatch:
            keys = table[:, :4]
            new = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            rep = table[:, 6]
            skip = min(sum(edges[b + 1] - edges[b] for b in c) for c in choices)
            root = trie_join(np.ascontiguousarray(table[:, 5]).view(np.uint64), new,
                             np.maximum(table[:, 4], 0), max_bits, skip)
            linked = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays(
                [pa.array(rep[linked]), pa.array(rep[root[linked]])], schema=schema)

        for batch in batches:
            table = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            held.append(table)
            size += len(table)
            if size >= 100_000:  # up to the last group that is surely whole
                table = np.concatenate(held)
                keys = table[:, :4]
                other = np.flatnonzero((keys != keys[-1]).any(axis=1))
                if len(other):
                    whole = other[-1] + 1
                    yield solve(table[:whole])
                    table = table[whole:]
                held, size = [table], len(table)
        if size:
            yield solve(np.concatenate(held))

    keys = ["choice", "value", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a long, b long")


# -- classes ---------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the links (a, b).

    Alternates large-star and small-star steps (Kiveris et al. 2014) until
    nothing changes; each step is written to the shared folder.
    """
    spark = edges.sparkSession
    mean = lambda df: df.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    now, path = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mean(now)
    while True:
        # every neighbour goes to the smallest node it hears of
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after, new_path = stored(small, "links")
        count = mean(after)
        discard(spark, path)
        now, path = after, new_path
        if count == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        before = count


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``docs``."""
    rows, _ = stored(fingerprints(docs, key, text, shingle_words), "fingerprints")
    # a fingerprint is its own node, whatever the ids of its rows
    reps, reps_path = stored(rows.groupBy("fp").agg(F.min("key").alias("least")).select(
        "fp", "least", F.col("fp").alias("rep")), "representatives")
    classes = components(links(reps, reps.count(), max_bits))
    classes = classes.union(classes.select("component", "component").distinct())  # with the smallest nodes
    linked = reps.join(classes, F.col("rep") == F.col("node")).select("fp", "component", "least")
    lowest = linked.groupBy("component").agg(F.min("least").alias("lowest"))
    linked = linked.join(lowest, "component").select(F.col("fp").alias("linked_fp"), "lowest")
    named = reps.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("fp_"), F.coalesce("lowest", "least").alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("fp_"), "left").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
