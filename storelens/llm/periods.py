"""Periodic runs of words, found with suffix trees.

A run is a longest stretch of words in which words ``q`` apart are identical
(q its smallest period) of at least ``max(MIN_LENGTH, MIN_POWER * q)`` words.

Each document is searched by itself, in its task: Ukkonen's algorithm builds
the suffix trees of the words and of their reversal, an Euler tour over each
with block minima answers longest common extensions in constant time, and the
longest Lyndon word at every position (next smaller suffix, under the order of
the tree and under its inverse) is the candidate root that both trees extend
to the right and to the left.  By the theorem on runs every run has a root
among these candidates.

Trees are built only where a run can lie.  A run of period q and length
L >= max(6, 4q) has L >= 2q + 4, so each of its windows of five words has an
identical window q <= L/4 words away inside the run.  Stretches are therefore
maximal chains of windows whose nearest identical window lies within a quarter
of the stretch; narrowing repeats until nothing changes.  Windows are compared
by 64-bit hashes, which can only add stretches.

Defined results: a null text has no words; the words of a null id fold as the
empty id; rows with one id are separate documents; no rows give no rows;
further columns are ignored.  Memory follows the longest periodic stretch of
one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, utf8

MIN_LENGTH, MIN_POWER = 6, 4
WINDOW = 5  # MIN_LENGTH >= 2 + WINDOW - 1 and MIN_POWER * q >= 2q + WINDOW - 1 for q >= 2
BLOCK = 32  # tour entries a block; a query looks at two block ends and the blocks between

RUNS = "id long, words long, runs array<struct<start:long,length:long,period:long>>, best int, collapsed binary"
_SCHEMA = pa.schema([
    ("id", pa.int64()), ("words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("best", pa.int32()), ("collapsed", pa.binary())])


class SuffixTree:
    """Suffix tree of a list of positive numbers, closed by a 0 that sorts first."""

    def __init__(self, symbols: list[int]):
        s = self.symbols = [*symbols, 0]
        n = self.n = len(s)
        # node 0 is the root; an edge leads into its node and spans s[start:end]
        self.start, self.end, self.kids = start, end, kids = [0], [0], [{}]
        link = [0]
        node = edge = length = pending = 0
        for i, c in enumerate(s):
            pending += 1
            made = 0  # inner node that waits for its suffix link
            while pending:
                if not length:
                    edge = i
                first = s[edge]
                below = kids[node].get(first)
                if below is None:
                    kids[node][first] = len(start)
                    start.append(i), end.append(n), kids.append(None), link.append(0)
                    if made:
                        link[made], made = node, 0
                else:
                    lo = start[below]
                    hi = end[below]
                    span = (hi if hi <= i else i + 1) - lo
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if s[lo + length] == c:
                        if made:
                            link[made] = node
                        length += 1
                        break
                    split = len(start)
                    start.append(lo), end.append(lo + length), link.append(0)
                    kids.append({s[lo + length]: below, c: split + 1})
                    kids[node][first] = split
                    start[below] = lo + length
                    start.append(i), end.append(n), link.append(0), kids.append(None)
                    if made:
                        link[made] = split
                    made = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1

    def suffixes_inverse(self) -> np.ndarray:
        """Starts of all suffixes under the inverse order of the symbols, in which
        the closing 0 still sorts first."""
        start, end, kids, n = self.start, self.end, self.kids, self.n
        out, todo = [], [(0, 0)]
        while todo:
            v, depth = todo.pop()
            below = kids[v]
            if below is None:
                out.append(n - depth)
                continue
            # the last one pushed comes first
            for c in sorted(filter(None, below)):
                w = below[c]
                todo.append((w, depth + end[w] - start[w]))
            if 0 in below:
                w = below[0]
                todo.append((w, depth + end[w] - start[w]))
        return np.array(out, dtype=np.int64)

    def tour(self) -> Lca:
        """Euler tour of the tree in the order of the symbols."""
        start, end, kids, n = self.start, self.end, self.kids, self.n
        depths, seen = [], [0] * n
        todo = [(0, 0)]
        while todo:
            v, depth = todo.pop()
            if v < 0:
                depths.append(depth)
                continue
            below = kids[v]
            if below is None:
                seen[n - depth] = len(depths)
                depths.append(depth)
                continue
            for c in sorted(below, reverse=True):
                w = below[c]
                todo.append((-1, depth))  # back at v after each child
                todo.append((w, depth + end[w] - start[w]))
        return Lca(np.array(depths, dtype=np.int32), np.array(seen, dtype=np.int64))


class Lca:
    """Smallest string depth between two leaves of an Euler tour: the depth of
    their lowest common ancestor, hence how far the two suffixes agree."""

    def __init__(self, depths: np.ndarray, seen: np.ndarray):
        self.seen = seen
        top = np.iinfo(np.int32).max
        blocks = np.append(depths, np.full(-len(depths) % BLOCK, top, np.int32)).reshape(-1, BLOCK)
        self.flat = blocks.ravel()
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()  # block start .. here
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()  # here .. block end
        levels = [blocks.min(axis=1)]
        while 2 << (len(levels) - 1) <= len(levels[0]):
            half, last = 1 << (len(levels) - 1), levels[-1]
            levels.append(np.minimum(last[:-half], last[half:]))
        self.levels = levels

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and ``j`` share (i != j)."""
        a, b = self.seen[i], self.seen[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        p, q = a // BLOCK, b // BLOCK
        out = np.minimum(self.behind[a], self.ahead[b])
        far = np.flatnonzero(q - p > 1)
        if len(far):
            lo, size = p[far] + 1, q[far] - p[far] - 1
            level = np.frexp(size)[1] - 1
            for k in np.unique(level):
                at = level == k
                row = self.levels[k]
                x = lo[at]
                best = np.minimum(row[x], row[x + size[at] - (1 << int(k))])
                out[far[at]] = np.minimum(out[far[at]], best)
        near = np.flatnonzero(p == q)
        for at in range(0, len(near), 1 << 16):
            part = near[at:at + (1 << 16)]
            span = a[part][:, None] + np.arange(BLOCK)
            held = np.where(span <= b[part][:, None], self.flat[np.minimum(span, len(self.flat) - 1)],
                            np.iinfo(np.int32).max)
            out[part] = held.min(axis=1)
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one of a smaller value (distinct values, the last
    is the smallest): every pointer jumps over ever longer stretches."""
    out = np.arange(1, len(values) + 1)
    out[-1] = len(values) - 1
    todo = np.arange(len(values) - 1)
    while True:
        todo = todo[values[out[todo]] > values[todo]]
        if not len(todo):
            return out
        out[todo] = out[out[todo]]


def tree_runs(symbols: np.ndarray) -> np.ndarray:
    """All runs of a sequence of positive numbers as rows (start, length, period)."""
    m = len(symbols)
    tree = SuffixTree(symbols.tolist())
    right = tree.tour()
    left = SuffixTree(symbols[::-1].tolist()).tour()
    found = []
    for order in (np.argsort(right.seen), tree.suffixes_inverse()):
        rank = np.empty(m + 1, dtype=np.int64)
        rank[order] = np.arange(m + 1)
        at = np.arange(m)
        q = next_smaller(rank)[:m] - at
        at, q = at[q * MIN_POWER <= m], q[q * MIN_POWER <= m]
        # the root at `at` and the one after it, extended to both sides
        more = right.extension(at, at + q)
        before = left.extension(m - at, m - at - q)
        length = before + q + more
        is_run = length >= np.maximum(MIN_LENGTH, MIN_POWER * q)
        found.append(np.stack([(at - before)[is_run], length[is_run], q[is_run]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def stretches(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word ranges (lo, hi) that can hold a run; ``starts`` are the first words of
    the documents whose word hashes follow each other in ``hashes``, and the end."""
    n = len(hashes) - WINDOW + 1
    none = np.empty((0, 2), dtype=np.int64)
    if n < 2:
        return none
    doc = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    window = mix(doc[:n] + np.uint64(1))
    for k in range(WINDOW):
        window = mix(window * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + n])
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    window = window[inside]
    order = np.argsort(window)
    sorted_ = window[order]
    same = sorted_[1:] == sorted_[:-1]
    repeated = np.append(same, False) | np.append(False, same)
    # only repeated windows are put in order of place
    at, value = inside[order[repeated]], sorted_[repeated]
    order = np.lexsort((at, value))
    at, value = at[order], value[order]
    gap = np.where(value[1:] == value[:-1], at[1:] - at[:-1], np.iinfo(np.int64).max)
    nearest = np.minimum(np.append(gap, np.iinfo(np.int64).max), np.append(np.iinfo(np.int64).max, gap))
    order = np.argsort(at)
    at, nearest = at[order], nearest[order]
    while len(at):
        # chains of neighbouring windows of one document
        first = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])))
        count = np.diff(np.append(first, len(at)))
        size = np.repeat(count + WINDOW - 1, count)
        kept = (nearest * MIN_POWER <= size) & (size >= MIN_LENGTH)
        if kept.all():
            lo = at[first]
            return np.stack([lo, lo + count + WINDOW - 1], axis=1)
        at, nearest = at[kept], nearest[kept]
    return none


def _runs_of(words: list[bytes], ranges: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for lo, hi in ranges.tolist():
        names: dict[bytes, int] = {}
        symbols = np.array([names.setdefault(w, len(names) + 1) for w in words[lo:hi]], dtype=np.int64)
        runs = tree_runs(symbols)
        runs[:, 0] += lo
        out += runs.tolist()
    return sorted((s, n, q) for s, n, q in out)


def _best(runs: list[tuple[int, int, int]]) -> int | None:
    """The run of greatest length / period; the first of equals."""
    best = None
    for k, (_, n, q) in enumerate(runs):
        if best is None or n * runs[best][2] > runs[best][1] * q:
            best = k
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in sorted((s + q, s + n) for s, n, q in runs):
        if lo > at:
            kept += words[at:lo]
        at = max(at, hi)
    return b" ".join(kept + words[at:])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
              edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Runs of every document: id, words, runs in order of start and period, best
    (index of the run of greatest length / period, null without one) and
    collapsed (the words that no run repeats, joined by one space).

    ``edit(id, words)`` may change the words of a document before the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in pieces(texts):
                words = [t.split() for t in texts[lo:hi]]  # white space of bytes: 20 and 09 to 0D
                if edit is not None:
                    words = [edit(i, w) for i, w in zip(ids[lo:hi], words, strict=True)]
                starts = np.cumsum([0, *map(len, words)])
                hashes = np.fromiter((hash(w) for doc in words for w in doc), np.int64, starts[-1])
                ranges = stretches(hashes.view(np.uint64), starts)
                cut = np.searchsorted(ranges[:, 0], starts)
                rows = []
                for k, doc in enumerate(words):
                    runs = _runs_of(doc, ranges[cut[k]:cut[k + 1]] - starts[k]) if cut[k + 1] > cut[k] else []
                    rows.append({"id": ids[lo + k], "words": len(doc),
                                 "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs],
                                 "best": _best(runs), "collapsed": _collapsed(doc, runs)})
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("t")).mapInArrow(run, RUNS)
