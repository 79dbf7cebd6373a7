"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages; their hashed words are weighted by
TF-IDF, the document frequencies being counted over the passages of the whole
corpus.  A distributed randomised SVD of the benchmark passages gives a latent
space.  Each document is cut into overlapping windows of about a passage's own
length: of four cells of words for long passages, of two for short ones.  A
window whose cosine to a passage in that space is high enough, and whose
projection holds enough of the passage, is a candidate; that alone decides what
is looked at.  The candidates' words are then compared: one is a leak if the
longest common subsequence covers enough of the item passage, within ``span``
times its length, and if the benchmark names an answer, that is there too.

``exact`` adds every window that shares words enough for that comparison to
succeed, from an index of each passage's rarest words: the yardstick of the
retrieval's recall.

The rank grows with the passages.  The broadcast parts are bounded: the space
by ``numbers``, item passages by ``block``; a benchmark of up to ``block``
passages is one scan of the corpus, each further block another.

Defined results: a null or empty text of a document or an item matches
nothing; a passage under ``short`` words must stand word for word; an item is a
leak in a document at most once, however often it stands; repeated documents
are searched alike, one result row each; an empty benchmark or corpus gives no
match; other columns are ignored by ``search`` and kept by ``clean``, which goes
by texts, so rows without an id and rows of one id are judged one by one.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, hash_words, keep_ids, mix, pieces, stored, utf8


@dataclass(frozen=True)
class DecontamParams:
    """Windows are counted in cells of ``cell`` words: a passage of up to two cells
    is sought in windows of two, at every cell; one of up to four (``stride``
    words, the longest) in windows of four, at every other.  ``cosine``: the least
    cosine of a candidate, less for passages under two cells by the root of
    their share of them, as the window's other words turn its direction;
    ``share``: how much of the passage the window's projection must hold, and
    ``share_short`` for passages under ``short`` words.  ``lcs`` and ``answer``:
    shares of the item passage's and of a given answer's words that must be there
    in order; ``span``: words of the document, by the passage's length, in which
    its words must lie if there is no answer; ``items_share``: share of an item's
    passages that must match, unless consecutive ones with ``run_words`` words
    do.  The space has ``rank`` dimensions, or one for each ``per_rank`` passages,
    in at most ``numbers`` numbers.  Of the index: ``window`` words are looked at
    every ``stride``; ``sure``: indexed words of a passage that a window must share,
    the index being as long as that takes."""

    cell: int = 8
    cosine: float = 0.5
    share: float = 0.25
    share_short: float = 0.6
    window: int = 64
    stride: int = 32
    bits: int = 17
    rank: int = 128
    per_rank: int = 4
    numbers: int = 1 << 25
    oversample: int = 16
    power: int = 1
    sure: int = 3
    short: int = 8
    least: int = 4
    lcs: float = 0.6
    answer: float = 0.5
    span: int = 2
    items_share: float = 0.5
    run_words: int = 50
    block: int = 1 << 16
    seed: int = 11


# Separators inside texts besides white space: ASCII characters that are no letters or digits.
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


# Accents and vowel signs belong to their letter.
_SIGNS = "".join(c for c in map(chr, [*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0)])
                 if unicodedata.category(c)[0] == "M")
# Other separators, and the letters of scripts without spaces (with their signs): Thai to Lao,
# Myanmar, Khmer, kana, Han.
_ELSE_APART = re.compile(f"[^\\w\x00-\x7f{_SIGNS}]+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                       f"\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff][{_SIGNS}]*")


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits, in lower case in any alphabet; single
    characters where a script has no spaces."""
    if text.isascii():
        return text.lower().translate(_APART).split()
    lower = _ELSE_APART.sub(" ", text.decode("utf-8", "replace").lower())
    if _UNSPACED.search(lower):
        lower = _UNSPACED.sub(r" \g<0> ", lower)
    return lower.encode().translate(_APART).split()


def _buckets(words: list[bytes], bits: int) -> np.ndarray:
    return (mix(hash_words(words)) >> np.uint64(64 - bits)).astype(np.int64)


# -- benchmark passages --------------------------------------------------------------

def passages(benchmark: DataFrame, key: str = "item_id", text: str = "text", answer: str | None = None,
             params: DecontamParams = DecontamParams()) -> DataFrame:
    """(item, part, parts, words, answer, reach): items cut into passages of
    ``stride`` words at most, evenly.  The answer of the item is looked for up
    to ``reach`` words around each of its passages; without one both are empty."""
    p = params
    schema = pa.schema([("item", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()),
                        ("words", pa.list_(pa.binary())), ("answer", pa.list_(pa.binary())), ("reach", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                parts = -(-len(words) // p.stride)
                for k in range(parts):
                    own = words[len(words) * k // parts:len(words) * (k + 1) // parts]
                    told = words_of(answer)
                    out.append({"item": item, "part": k, "parts": parts, "words": own,
                                "answer": told,
                                "reach": len(words) + len(told) if told else 0})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return benchmark.select(
        F.col(key).cast("long").alias("item"), utf8(text).alias("t"),
        utf8(answer) if answer else F.lit(b"").alias("a")).mapInArrow(
        run, "item long, part int, parts int, words array<binary>, answer array<binary>, reach int")


def _frequencies(docs: DataFrame, text: str, known: np.ndarray, p: DecontamParams) -> tuple[np.ndarray, int]:
    """Of each bucket in ``known``: the corpus passages with it; and the number of passages."""
    schema = pa.schema([("b", pa.int32()), ("n", pa.int64())])
    place = np.full(1 << p.bits, -1, dtype=np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(known), dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in pieces(texts):
                split = [words_of(t) for t in texts[lo:hi]]
                sizes = np.array([len(w) for w in split], dtype=np.int64)
                count = -(-sizes // p.stride)
                first = np.cumsum(count) - count + n * 0
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                passage = np.repeat(first, sizes) + at // p.stride
                own = place[_buckets([w for d in split for w in d], p.bits)]
                hit = own >= 0
                cells = np.unique(passage[hit] * len(known) + own[hit])
                sums += np.bincount(cells % max(len(known), 1), minlength=len(known))
                n += int(count.sum())
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(sums[some], n))], schema=schema)

    got = (docs.select(utf8(text).alias("t")).mapInArrow(run, "b int, n long")
           .groupBy("b").agg(F.sum("n").alias("n")).collect())  # buckets at most
    out = np.zeros(len(known), dtype=np.int64)
    for r in got:
        if r["b"] >= 0:
            out[r["b"]] = r["n"]
    return out, sum(r["n"] for r in got if r["b"] == -1)


# -- the latent space ----------------------------------------------------------------

@dataclass(frozen=True)
class Space:
    """``place`` finds the row of a bucket in ``vectors`` (buckets x rank), -1 if
    no benchmark passage has it; rows already carry the idf weight ``idf``."""

    place: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray


def _weighted(words: list[bytes], place: np.ndarray, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = place[_buckets(words, bits)]
    at, tf = np.unique(at[at >= 0], return_counts=True)
    w = tf * idf[at]
    return at, w / max(float(np.sqrt((w * w).sum())), 1e-12)


def svd(rows: DataFrame, place: np.ndarray, idf: np.ndarray, p: DecontamParams) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF rows of ``words``.

    Randomised range finder (Halko et al. 2011): A'(A X) is summed from the
    rows of each task, so neither A nor A X is ever in one place; between two
    passes the sums (terms x sketch) are made orthonormal.
    """
    width = min(p.rank + p.oversample, len(idf))
    sketch = np.random.default_rng(p.seed).standard_normal((len(idf), width))
    schema = pa.schema([("b", pa.int32()), ("c", pa.int32()), ("v", pa.list_(pa.float64()))])
    columns = 144  # in one row of sums

    def gram(x: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(idf), width))
            for batch in batches:
                for words in batch.column(0).to_pylist():
                    at, w = _weighted(words, place, idf, p.bits)
                    total[at] += w[:, None] * (w @ x[at])
            some = np.flatnonzero(total.any(axis=1))
            for lo in range(0, len(some), 4096):
                own = some[lo:lo + 4096]
                for c in range(0, width, columns):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own.astype(np.int32)), pa.array(np.full(len(own), c, dtype=np.int32)),
                        pa.array(total[own, c:c + columns].tolist(), pa.list_(pa.float64()))], schema=schema)

        sums = [F.sum(F.get("v", F.lit(k))) for k in range(min(width, columns))]
        out = np.zeros((len(idf), width))
        # terms x sketch numbers, whatever the number of passages
        for r in (rows.select("words").mapInArrow(run, "b int, c int, v array<double>")
                  .groupBy("b", "c").agg(F.array(*sums).alias("v")).toLocalIterator()):
            own = out[r["b"], r["c"]:r["c"] + columns]
            own[:] = r["v"][:len(own)]
        return out

    q, _ = np.linalg.qr(gram(sketch))
    for _ in range(p.power):
        q, _ = np.linalg.qr(gram(q))
    small = q.T @ gram(q)  # A'A within the range
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = [k for k in np.argsort(-values)[:p.rank] if values[k] > 1e-9 * max(values.max(), 1e-12)]
    return q @ vectors[:, keep]


def latent_space(docs: DataFrame, parts: DataFrame, text: str = "text",
                 params: DecontamParams = DecontamParams()) -> Space:
    """The space of the benchmark passages ``parts``, weighted by ``docs``."""
    p = params
    buckets = set()
    schema = pa.schema([("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << p.bits, dtype=bool)
        for batch in batches:
            seen[_buckets([w for words in batch.column(0).to_pylist() for w in words], p.bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], schema=schema)

    buckets = sorted(r["b"] for r in parts.select("words").mapInArrow(run, "b int").distinct().collect())
    known = np.array(buckets, dtype=np.int64)
    place = np.full(1 << p.bits, -1, dtype=np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    if not len(known):
        return Space(place, np.zeros((0, 1), dtype=np.float32), np.zeros(0))
    df, n = _frequencies(docs, text, known, p)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1e-3
    rank = max(p.rank, min(parts.count() // p.per_rank, p.numbers // len(known)))
    vectors = idf[:, None] * svd(parts, place, idf, replace(p, rank=rank))
    return Space(place, vectors.astype(np.float32), idf)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


# -- search ---------------------------------------------------------------------------

def lcs_length(item: list[bytes], window: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004)."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in window:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _needed(n: int, p: DecontamParams) -> int:
    """Words of a passage of ``n`` that a window must have, whatever its cosine."""
    return n if n < p.short else math.ceil(p.lcs * n - 1e-9)


@dataclass(frozen=True)
class Index:
    """Postings of each bucket: ``items`` from ``ends[place - 1]`` to
    ``ends[place]``, with the number of indexed words of that bucket;
    ``shared``: the least sum of these numbers in a window, by passage."""

    ends: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    shared: np.ndarray


def _index(words: list[list[bytes]], space: Space, p: DecontamParams) -> Index:
    """A window with ``need`` of a passage's n words has ``c`` at least of any
    n - need + c of them: the rarest ones are indexed."""
    shared = np.full(len(words), 1 << 30, dtype=np.int64)
    posts: list[tuple[int, int, int]] = []
    for i, own in enumerate(words):
        if len(own) >= p.least:
            need = _needed(len(own), p)
            shared[i] = min(p.sure, need)
            at = space.place[_buckets(own, p.bits)]
            rare = at[np.lexsort((at, -space.idf[at]))][:len(own) - need + shared[i]]
            posts.extend((b, i, n) for b, n in zip(*(x.tolist() for x in np.unique(rare, return_counts=True)),
                                                   strict=True))
    rows = np.array(sorted(posts), dtype=np.int64).reshape(-1, 3)
    return Index(np.cumsum(np.bincount(rows[:, 0], minlength=len(space.idf))), rows[:, 1], rows[:, 2], shared)


def _near(own: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray, lo: int, hi: int, index: Index,
          p: DecontamParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window - lo, passage) of the windows ``lo`` to ``hi`` that share the
    words of the index, from the known words (bucket, place in the document,
    the document's first stride and number of strides)."""
    count = np.diff(index.ends, prepend=0)
    hit = count[own] > 0
    own, at, first, n = own[hit], at[hit], first[hit], n[hit]
    half, keys = p.stride // 2, []
    begin, last = (at - p.window - half) // p.stride + 1, (at + half) // p.stride
    for k in range(p.window // p.stride + 2):
        w = begin + k
        ok = (w >= 0) & (w <= last) & (w < n) & (first + w >= lo) & (first + w < hi)
        keys.append((first + w - lo)[ok] * len(count) + own[ok])
    keys = np.unique(np.concatenate(keys))  # a word counts once a window
    window, own = keys // len(count), keys % len(count)
    size = np.cumsum(count[own])
    a = 0
    while a < len(own):  # whole windows, of some millions of postings
        b = max(int(np.searchsorted(size, (size[a - 1] if a else 0) + 4_000_000, "right")), a + 1)
        b = int(np.searchsorted(window, window[b], "left" if window[b] > window[a] else "right")) if b < len(own) else b
        n = count[own[a:b]]
        post = np.arange(n.sum()) + np.repeat(index.ends[own[a:b]] - np.cumsum(n), n)
        pairs, of = np.unique(np.repeat(window[a:b], n) * len(index.shared) + index.items[post], return_inverse=True)
        sums = np.bincount(of, index.weights[post], minlength=len(pairs))
        pairs = pairs[sums >= index.shared[pairs % len(index.shared)]]
        yield pairs // len(index.shared), pairs % len(index.shared)
        a = b


@dataclass(frozen=True)
class Items:
    """Passages in the latent space, by class: the window's cells, the passages'
    numbers, their directions and the least cosine and projection."""

    cells: int
    numbers: np.ndarray
    unit: np.ndarray
    cosine: np.ndarray
    least: np.ndarray


def _items(words: list[list[bytes]], space: Space, p: DecontamParams) -> list[Items]:
    vectors = np.zeros((len(words), space.vectors.shape[1]), dtype=np.float32)
    for i, own in enumerate(words):
        at = space.place[_buckets(own, p.bits)]
        vectors[i] = space.vectors[at[at >= 0]].sum(axis=0)
    size = np.array([len(w) for w in words])
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    gate = (p.cosine * np.sqrt(np.minimum(1.0, size / (2 * p.cell)))).astype(np.float32)
    least = norm * np.where(size < p.short, p.share_short, p.share)
    out = []
    for cells, of in ((2, size <= 2 * p.cell), (4, size > 2 * p.cell)):
        of = np.flatnonzero(of & (norm > 0))
        if len(of):
            out.append(Items(cells, of, _unit(vectors[of]), gate[of], least[of]))
    return out


def _candidates(split: list[list[bytes]], space: Space, classes: list[Items],
                p: DecontamParams) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, first word, words, item passage, cosine) of each candidate window."""
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    n = -(-sizes // p.cell)
    first = np.cumsum(n) - n
    cells = int(n.sum())
    if not cells or not classes:
        return
    own = space.place[_buckets([w for d in split for w in d], p.bits)]
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell = np.repeat(first, sizes) + at // p.cell
    hit = own >= 0
    own, cell = own[hit], cell[hit]
    doc = np.repeat(np.arange(len(split)), n)
    place = np.arange(cells) - np.repeat(first, n)
    for lo in range(0, cells, 2048):  # windows at a time, so the gathered vectors stay small
        hi = min(cells, lo + 2048)
        a, b = np.searchsorted(cell, [lo, hi + 3])
        vectors = np.zeros((hi - lo + 3, space.vectors.shape[1]), dtype=np.float32)
        if a == b:
            continue
        # the first known word of every cell, then the second, ...
        at, of = cell[a:b] - lo, own[a:b]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        turn = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        for k in range(p.cell):
            now = np.flatnonzero(turn == k)
            vectors[at[now]] += space.vectors[of[now]]
        for c in classes:
            # windows begin at each cell, or every other; they end with their document
            begin = np.arange(lo, hi) if c.cells == 2 else lo + np.flatnonzero(place[lo:hi] % 2 == 0)
            sums = vectors[begin - lo].copy()
            for k in range(1, c.cells):
                inside = np.flatnonzero((begin + k < cells) & (doc[np.minimum(begin + k, cells - 1)] == doc[begin]))
                sums[inside] += vectors[begin[inside] - lo + k]
            norm = np.sqrt((sums * sums).sum(axis=1))
            # a projection that is shorter than any passage asks for
            wide = np.flatnonzero(norm >= c.least.min())
            begin, sums, norm = begin[wide], sums[wide], norm[wide]
            dots = sums @ c.unit.T
            w, i = np.nonzero((dots >= c.least) & (dots >= norm[:, None] * c.cosine))
            for x, y, cos in zip(begin[w].tolist(), c.numbers[i].tolist(), (dots[w, i] / norm[w]).tolist(), strict=True):
                yield int(doc[x]), int(place[x]) * p.cell, c.cells * p.cell, y, cos


def _indexed(split: list[list[bytes]], space: Space, index: Index, p: DecontamParams) -> Iterator[tuple[int, int, int, int, float]]:
    """The windows that share the words of the index, like ``_candidates``."""
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    n = -(-sizes // p.stride)
    first = np.cumsum(n) - n
    if not n.sum() or not len(index.shared):
        return
    own = space.place[_buckets([w for d in split for w in d], p.bits)]
    at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hit = own >= 0
    doc = np.repeat(np.arange(len(split)), n)
    own, at, starts_at, strides_of = own[hit], at[hit], np.repeat(first, sizes)[hit], np.repeat(n, sizes)[hit]
    stride = starts_at + at // p.stride
    per = p.window // p.stride
    for lo in range(0, len(doc), 8192):
        hi = min(len(doc), lo + 8192)
        a, b = np.searchsorted(stride, [lo - 1, hi + per + 1])
        for w, i in _near(own[a:b], at[a:b], starts_at[a:b], strides_of[a:b], lo, hi, index, p):
            for x, y in zip((lo + w).tolist(), i.tolist(), strict=True):
                yield int(doc[x]), int(x - first[doc[x]]) * p.stride, p.window, y, 0.0


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", answer: str | None = None,
           params: DecontamParams = DecontamParams(), cut: bool = True, exact: bool = False) -> DataFrame:
    """(key, item, parts, cosine, lcs) of each leaked item of each row of ``docs``
    that has one, as a list ``leaks``; rows without a leak aren't returned.
    ``cut`` False leaves out the checks of words (to measure the retrieval);
    ``exact`` adds the candidates of the index, whose cosine is 0."""
    p = params
    parts, _ = stored(passages(benchmark, item_key, item_text, answer, p), "bench-passages")
    space = latent_space(docs, parts, text, p)
    rows = docs.select(F.col(key).cast("long").alias("k"), utf8(text).alias("t"))
    many = parts.count() > p.block
    if many:  # the blocks' results meet by a number of the row, which is stored as it must stay the same
        rows, _ = stored(rows.withColumn("row", F.monotonically_increasing_id()), "bench-rows")
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    rows = rows.select("k", "t", "row")
    schema = pa.schema([("k", pa.int64()), ("row", pa.int64()), ("leaks", pa.list_(pa.struct([
        ("item", pa.int64()), ("parts", pa.int32()), ("cosine", pa.float64()), ("lcs", pa.float64())])))])
    ddl = "k long, row long, leaks array<struct<item: long, parts: int, cosine: double, lcs: double>>"

    def searched(block: list) -> DataFrame:
        words = [r["words"] for r in block]
        words = [[bytes(w) for w in x] for x in words]
        answers = [[bytes(w) for w in r["answer"]] for r in block]
        reach = [r["reach"] for r in block]
        names = [(r["item"], r["parts"]) for r in block]
        order = [r["part"] for r in block]
        sizes = [len(w) for w in words]
        shared = rows.sparkSession.sparkContext.broadcast(
            (space, _items(words, space, p), _index(words, space, p) if exact else None, words))

        def check(doc: list[bytes], start: int, width: int, i: int, words: list[list[bytes]]) -> float:
            # the passage may begin or end outside the window
            lo, hi = max(0, start - p.stride // 2), start + width + p.stride // 2
            near = doc[lo:hi]
            n, there = len(words[i]), set(near)
            if sum(w in there for w in words[i]) < p.lcs * n:
                return 0.0
            share = lcs_length(words[i], near) / n
            if share < p.lcs:
                return 0.0
            if n < p.short and not any(near[k:k + n] == words[i] for k in range(len(near) - n + 1)):
                return 0.0
            if answers[i]:
                near = doc[max(0, lo - reach[i]):start + width + reach[i]]
                return share if lcs_length(answers[i], near) >= p.answer * len(answers[i]) else 0.0
            # scattered common words are no copy
            step = max(1, n // 4)
            if len(near) > p.span * n:
                share = max(lcs_length(words[i], near[k:k + p.span * n])
                            for k in range(0, len(near) - p.span * n + step, step)) / n
            return share if share >= p.lcs else 0.0

        def enough(of: list[int], parts: int) -> bool:
            if len(of) >= p.items_share * parts:
                return True
            size = {order[i]: sizes[i] for i in of}
            run = 0
            for k in range(parts):
                run = run + size[k] if k in size else 0
                if run >= p.run_words:
                    return True
            return False

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, classes, index, words = shared.value
            for batch in batches:
                ids, texts, numbers = (c.to_pylist() for c in batch.columns)
                out = []
                for lo, hi in pieces(texts):
                    split = [words_of(t) for t in texts[lo:hi]]
                    found: dict[tuple[int, int], tuple[float, float]] = {}
                    candidates = _candidates(split, space, classes, p)
                    if index is not None:
                        candidates = itertools.chain(candidates, _indexed(split, space, index, p))
                    for d, start, width, i, cosine in candidates:
                        share = check(split[d], start, width, i, words) if cut else 1.0
                        if share > found.get((d, i), (0.0, 0.0))[0]:
                            found[d, i] = share, cosine
                    by: dict[int, dict] = {}
                    for d, i in found:
                        by.setdefault(d, {}).setdefault(names[i], []).append(i)
                    for d, hits in sorted(by.items()):
                        leaks = [{"item": item, "parts": len(x), "cosine": max(found[d, i][1] for i in x),
                                  "lcs": sum(found[d, i][0] for i in x) / len(x)}
                                 for (item, n), x in sorted(hits.items(), key=lambda h: (h[0][0] is not None, h[0]))
                                 if enough(x, n)]
                        if leaks:
                            out.append({"k": ids[lo + d], "row": numbers[lo + d], "leaks": leaks})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

        return rows.mapInArrow(run, ddl)

    # blocks of whole items; each is one search over all documents
    found, block = None, []
    for r in [*parts.orderBy("item", "part").toLocalIterator(), None]:
        if r is None or (len(block) >= p.block and r["item"] != block[-1]["item"]):
            if block:
                one = searched(block)
                found = one if found is None else found.unionAll(one)
            block = []
        if r is not None:
            block.append(r)
    if found is None:
        found = rows.sparkSession.createDataFrame([], ddl)
    if many:
        found = found.groupBy("row").agg(
            F.first("k").alias("k"), F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return found.select(F.col("k").alias(key), "leaks")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text",
          params: DecontamParams = DecontamParams(), **names) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns.  A row is judged by
    its text (a 64-bit hash of it meets the result), whatever its id."""
    name = free_name(docs, "of_text")
    rows = docs.withColumn(name, F.xxhash64(utf8(text)))
    found, _ = stored(search(rows, benchmark, name, text, params=params, **names).select(name), "leaks")
    return keep_ids(rows, name, found, "left_anti").drop(name)
