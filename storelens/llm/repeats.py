"""Removal of long byte strings that an earlier document already holds.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
of a smaller id.  Whether one does is read off longest-previous-factor arrays:
the strings' suffixes are sorted, and for each the nearest suffixes before and
after it in that order that belong to a smaller id give the longest match with
an earlier document.

No task sorts the whole corpus:

* Documents are stored as chunks of about CHUNK_BYTES, each at its own number
  in a bucketed table, so that later joins by chunk don't move texts.
* A text that another chunk has at a smaller id goes as a whole, by its digest.
* Each window of LENGTH bytes names its least-hashed GRAM bytes (its anchor),
  so equal windows name equal anchors.  One row a chunk and anchor is
  exchanged; anchors that one document alone holds can't cover a match.
* A chunk sorts the suffixes of its windows whose anchors several of its documents
  have.  Windows with a smaller document in the chunk are settled; only the others
  whose anchors other chunks have too, each at its smallest document, go on, as pieces with the bytes that their
  anchor's windows need.  However many copies a text has, a chunk sends one.
* Pieces meet by anchor, or, for an anchor of over HOT documents, by window, so
  that a common phrase spreads over all the texts around it.  Their suffixes are
  sorted again, and the settled windows return to their chunks by number.

Defined results: a null text is empty; a null id counts as larger than every
other, and null ids as equal; rows of equal ids don't remove from each other; no
rows give no rows; further columns are ignored.  Matching is by bytes, so what is
left may not be UTF-8.  Memory follows the longest document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, mix, pieces, shared_folder, stored, utf8

LENGTH = 50
GRAM = 20
CHUNK_BYTES = 4_000_000
BLOCK = 1 << 16  # window starts whose anchors are found at once
# What a chunk hears of an anchor, in the low bits of its hash: other documents of
# the chunk hold it, other chunks do, it is hot.
INSIDE, BEYOND, BUSY = 1, 2, 4
NAME = ~np.uint64(7)
HOT = 2_000  # documents from which an anchor's windows go their own ways
BATCH_BYTES = 400_000  # text of pieces that one sort takes, whole anchors

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_ROW = pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                  ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
                    ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("text", pa.binary()),
                    ("copies", pa.list_(_ROW))])
_ANCHOR = pa.schema([("anchor", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32())])
_PIECE = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("at", pa.int64()), ("n", pa.int64()),
                    ("id", pa.int64()), ("text", pa.binary())])
_COVER = pa.schema([("chunk", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


# -- anchors ---------------------------------------------------------------------

def _words(text: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from every place on (but the last seven) as a number."""
    n = max(len(text) - 7, 0)
    return np.ndarray((n,), f"{order}u8", text, strides=(1,)).astype(np.uint64)


def anchored(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive window starts with equal anchors: first start, number
    and the anchor's hash.  ``ends`` are the ends of the documents in ``text``."""
    span = length - GRAM + 1  # places of an anchor in its window
    out = []
    for lo in range(0, len(text) - length + 1, BLOCK):
        w = _words(text[lo:lo + BLOCK + length - 1])
        h = mix(w[:8 - GRAM] * np.uint64(0xD6E8FEB86659FD93) + mix(w[8:16 - GRAM]))
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[GRAM - 8:]) & NAME
        # leading bits of the hash, then the place: the first of equals
        least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[:len(least) - (span - reach)], least[span - reach:])
        anchor = h[(least & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        starts = np.arange(lo, lo + len(anchor))
        whole = starts + length <= ends[np.searchsorted(ends, starts, side="right")]
        starts, anchor = starts[whole], anchor[whole]
        out.append(_joined(starts, anchor))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _joined(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive starts of equal keys as (first, number, key)."""
    if not len(starts):
        return starts, starts, keys
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (np.diff(starts) != 1)))
    return starts[first], np.diff(np.append(first, len(starts))), keys[first]


def window_hashes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window at each start."""
    w = _words(text)
    h = np.zeros(len(starts), dtype=np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[starts + k])
    return h


# -- suffix order ------------------------------------------------------------------

def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    held = keys[order]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(np.append(False, held[1:] != held[:-1])[:len(held)])
    return out


def suffix_order(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in the order of their ``length`` bytes (equal ones by place),
    and whether each agrees with the one before in all of them.

    Prefix doubling: ranks of 8 bytes make ranks of 16, 32, and so on.  Windows
    don't cross the ends of the segments in ``text``.
    """
    room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(text))
    rank = np.zeros(len(text), dtype=np.uint64)
    depth = 8
    at = np.flatnonzero(room >= depth)
    rank[at] = _dense(_words(text, ">")[at])
    while 2 * depth <= length:
        at = np.flatnonzero(room >= 2 * depth)
        rank[at] = _dense((rank[at] << np.uint64(32)) | rank[at + depth])
        depth *= 2
    at = np.flatnonzero(room >= length)
    key = (rank[at] << np.uint64(32)) | rank[at + length - depth]
    order = np.argsort(key, kind="stable")
    held = key[order]
    return at[order], np.append(False, held[1:] == held[:-1])[:len(held)]


def _nearest_smaller(owner: np.ndarray, agrees: np.ndarray) -> np.ndarray:
    """Whether a place before, with which all between agree, has a smaller owner:
    pointers to the nearest such place jump over those that were passed."""
    last = np.arange(len(owner)) - 1
    last[~agrees] = -1
    todo = np.flatnonzero(last >= 0)
    while True:
        todo = todo[(last[todo] >= 0)]
        todo = todo[owner[last[todo]] >= owner[todo]]
        if not len(todo):
            return last >= 0
        last[todo] = last[last[todo]]


def previous_factors(text: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, ascending, and whether the longest previous factor there, the
    longest match with a smaller owner, has ``length`` bytes or more.

    ``owner`` is one number for each segment of ``text`` that ends at ``ends``.
    """
    at, agrees = suffix_order(text, ends, length)
    of = owner[np.searchsorted(ends, at, side="right")]
    before = _nearest_smaller(of, agrees)
    after = _nearest_smaller(of[::-1], np.append(agrees[1:], False)[:len(agrees)][::-1])[::-1]
    out = np.empty(len(at), dtype=bool)
    order = np.argsort(at)
    out[:] = (before | after)[order]
    return at[order], out


# -- chunks -------------------------------------------------------------------------

def _ranks(ids: list[int | None]) -> np.ndarray:
    """Order of ids, the same for equal ones; null comes last."""
    flags = np.array([i is None for i in ids])
    values = np.array([i or 0 for i in ids], dtype=np.int64)
    order = np.lexsort((values, flags))
    new = np.append(False, (np.diff(values[order]) != 0) | np.diff(flags[order]))
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = np.cumsum(new[:len(ids)])
    return out


def _chunk_rows(chunk: int, held: list[tuple[int | None, bytes]], length: int) -> pa.RecordBatch:
    """A chunk: its different texts by id, each at its smallest id, and its copies."""
    rank = _ranks([i for i, _ in held])
    first: dict[bytes, list] = {}
    copies = []
    for k in np.argsort(rank, kind="stable").tolist():
        i, t = held[k]
        own = first.setdefault(t, [rank[k], i, 0])
        if own[0] == rank[k]:
            own[2] += 1
        else:
            whole = len(t) >= length
            copies.append({"doc_id": i, "n_bytes": len(t), "n_removed": len(t) * whole, "n_spans": int(whole),
                           "kept_sha256": hashlib.sha256(b"" if whole else t).hexdigest()})
    row = {"chunk": chunk, "ids": [i for _, i, _ in first.values()], "times": [n for *_, n in first.values()],
           "sizes": [len(t) for t in first], "digests": [hashlib.sha256(t).digest() for t in first], "text": b"".join(first), "copies": copies}
    return pa.RecordBatch.from_pylist([row], schema=_CHUNK)


def _chunks(length: int, chunk_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in pieces(texts, max(chunk_bytes // 4, 1)):
                coming = sum(map(len, texts[lo:hi]))
                if held and size + coming > chunk_bytes:
                    yield _chunk_rows(number, held, length)
                    number, held, size = number + 1, [], 0
                held += zip(ids[lo:hi], texts[lo:hi], strict=True)
                size += coming
        if held:
            yield _chunk_rows(number, held, length)
    return run


def _text(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint8) if value.as_py() else np.empty(0, np.uint8)


def _left(gone: list | None, n: int) -> np.ndarray:
    """The documents of a chunk that don't go as a whole."""
    left = np.ones(n + 1, dtype=bool)
    left[gone or []] = False
    return left


def _anchors(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, text, gone in zip(*(batch.column(c) for c in ("chunk", "sizes", "text", "gone")), strict=True):
                ends = np.cumsum(np.array(sizes.as_py(), dtype=np.int64))
                starts, _, anchor = anchored(_text(text), ends, length)
                doc = np.searchsorted(ends, starts, side="right")
                left = _left(gone.as_py(), len(ends))[doc]
                anchor, doc = anchor[left], doc[left]
                if not len(anchor):
                    continue
                # places ascend, so a stable sort keeps documents in order
                order = np.argsort(anchor, kind="stable")
                anchor, doc = anchor[order], doc[order]
                new = np.append(True, anchor[1:] != anchor[:-1])
                n_docs = np.add.reduceat(new | np.append(True, doc[1:] != doc[:-1]), np.flatnonzero(new), dtype=np.int32)
                anchor = anchor[new].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(np.full(len(anchor), chunk.as_py())), pa.array(n_docs)], schema=_ANCHOR)
    return run


def _local(length: int):
    """Windows of a chunk that it settles itself (no text), and pieces of the others."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shared = batch.column("shared")[row].values
                if shared is None or not len(shared):
                    continue
                yield from _settle(batch.column("chunk")[row].as_py(), batch.column("ids")[row].as_py(),
                                   batch.column("sizes")[row].as_py(), _text(batch.column("text")[row]),
                                   batch.column("gone")[row].as_py(), shared.to_numpy().view(np.uint64), length)
    return run


def _settle(chunk: int, ids: list, sizes: list, text: np.ndarray, gone: list | None, shared: np.ndarray,
            length: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.array(sizes, dtype=np.int64))
    shared = np.sort(shared)
    names, flags = shared & NAME, (shared & ~NAME).astype(np.int64)
    starts, count, anchor = anchored(text, ends, length)
    place = np.minimum(np.searchsorted(names, anchor), len(names) - 1)
    kept = (names[place] == anchor) & _left(gone, len(ends))[np.searchsorted(ends, starts, side="right")]
    starts, count, place = starts[kept], count[kept], place[kept]

    def windows(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[of]
        return np.repeat(starts[of] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(place[of], n)

    at, _ = windows(flags[place] & INSIDE > 0)
    done = np.empty(0, dtype=np.int64)
    if len(at):
        # segments: stretches of bytes that these windows cover, one document each
        doc = np.searchsorted(ends, at, side="right")
        new = np.flatnonzero(np.append(True, (np.diff(at) > length) | (np.diff(doc) > 0)))
        lo, hi = at[new], at[np.append(new[1:], len(at)) - 1] + length
        cut = np.cumsum(hi - lo)
        shift = lo - (cut - (hi - lo))
        body = text[np.repeat(shift, hi - lo) + np.arange(cut[-1])]
        found, settled = previous_factors(body, cut, _ranks(ids)[doc[new]], length)
        found = found[settled]
        done = found + shift[np.searchsorted(cut, found, side="right")]
        first, n, _ = _joined(done, np.zeros(len(done), np.uint64))
        yield _piece_batch(first, chunk, first, n, None, [None] * len(first))
    at, place = windows(flags[place] & BEYOND > 0)
    is_open = ~np.isin(at, done)
    at, place = at[is_open], place[is_open]
    keys = names[place]
    split = flags[place] & BUSY > 0
    if split.any():
        keys[split] = window_hashes(text, at[split], length)
    at, n, keys = _joined(at, keys)
    data = text.tobytes()
    owner = np.searchsorted(ends, at, side="right").tolist()
    spans = zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)
    yield _piece_batch(keys.view(np.int64), chunk, at, n, [ids[k] for k in owner], [data[a:b] for a, b in spans])


def _piece_batch(keys: np.ndarray, chunk: int, at: np.ndarray, n: np.ndarray, ids: list | None, text: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(np.full(len(at), chunk, np.int64)), pa.array(at, pa.int64()),
         pa.array(n, pa.int64()), pa.array(ids if ids is not None else [None] * len(at), pa.int64()),
         pa.array(text, pa.binary())], schema=_PIECE)


def _global(length: int):
    """Covered windows: those that chunks settled, and those of sorted pieces."""
    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rank = _ranks(rows.column("id").to_pylist())
        order = np.argsort(rank, kind="stable")
        texts = rows.column("text").to_pylist()
        body = np.frombuffer(b"".join([texts[k] for k in order.tolist()]), dtype=np.uint8)
        ends = np.cumsum([len(texts[k]) for k in order.tolist()])
        found, covered = previous_factors(body, ends, rank[order], length)
        found = found[covered]
        piece = np.searchsorted(ends, found, side="right")
        start = found - (ends - np.diff(ends, prepend=0))[piece]
        chunk, at = (rows.column(c).to_numpy()[order][piece] for c in ("chunk", "at"))
        first, n, _ = _joined(at + start, piece.astype(np.uint64))
        lead = np.cumsum(n) - n
        return pa.RecordBatch.from_arrays([pa.array(chunk[lead]), pa.array(first), pa.array(n)], schema=_COVER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            known = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            if known.any():
                yield batch.filter(pa.array(known)).select(["chunk", "at", "n"])
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            # cut where a key ends and enough text is held
            keys = batch.column("key").to_numpy()
            sizes = np.cumsum(batch.column("n").to_numpy() + length - 1)
            new = np.flatnonzero(np.append(last is None or keys[0] != last, keys[1:] != keys[:-1]))
            base, lo = 0, 0
            for k in new.tolist():
                if size + (sizes[k - 1] if k else 0) - base >= BATCH_BYTES:
                    if k > lo:
                        held.append(batch.slice(lo, k - lo))
                    yield settle(held)
                    held, size, lo, base = [], 0, k, sizes[k - 1] if k else 0
            if batch.num_rows > lo:
                held.append(batch.slice(lo))
                size += int(sizes[-1] - base)
            last = keys[-1]
        if held:
            yield settle(held)
    return run


def _finish(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(_ROW))
        for batch in batches:
            for row in range(batch.num_rows):
                ids, times, sizes, copies, gone = (
                    batch.column(c)[row].as_py() for c in ("ids", "times", "sizes", "copies", "gone"))
                text, covers = batch.column("text")[row].as_py(), batch.column("covers")[row].values
                ends = np.cumsum(np.array(sizes, dtype=np.int64))
                spans = _spans(covers, ends, length)
                for k in gone or []:
                    spans[k] = [(int(ends[k]) - sizes[k], int(ends[k]))]
                rows = list(copies)
                for k, (i, m, size, hi) in enumerate(zip(ids, times, sizes, ends.tolist(), strict=True)):
                    at, kept, removed = hi - size, [], 0
                    for a, b in spans.get(k, ()):
                        kept.append(text[at:a])
                        removed += b - a
                        at = b
                    kept.append(text[at:hi])
                    rows += [{"doc_id": i, "n_bytes": size, "n_removed": removed, "n_spans": len(spans.get(k, ())),
                              "kept_sha256": hashlib.sha256(b"".join(kept)).hexdigest()}] * m
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def _spans(covers: pa.StructArray | None, ends: np.ndarray, length: int) -> dict[int, list[tuple[int, int]]]:
    """Longest removed stretches (from, to) of each document of a chunk."""
    out: dict[int, list[tuple[int, int]]] = {}
    if covers is None or not len(covers):
        return out
    at, n = covers.field("at").to_numpy(), covers.field("n").to_numpy()
    order = np.argsort(at)
    at, to = at[order], (at + n)[order] + length - 1
    doc = np.searchsorted(ends, at, side="right")
    # ends grow from document to document, so one running maximum serves all
    reach = np.maximum.accumulate(to)
    first = np.flatnonzero(np.append(True, (at[1:] > reach[:-1]) | (np.diff(doc) > 0)))
    for d, a, b in zip(doc[first].tolist(), at[first].tolist(), reach[np.append(first[1:], len(at)) - 1].tolist(), strict=True):
        out.setdefault(d, []).append((a, b))
    return out


def _bucketed(spark: SparkSession, df: DataFrame, path: str, buckets: int) -> str:
    """``df`` as a catalogue table over ``path`` in buckets of the chunk number."""
    name = f"repeats_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    return name


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """n_bytes, n_removed, n_spans and the digest of what is left, for every document."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "repeats")
    discard(spark, path)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("t"))
    whole = "array<struct<doc_id:long,n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>>"
    name = _bucketed(spark, rows.mapInArrow(
        _chunks(length, chunk_bytes),
        f"chunk long, ids array<long>, times array<int>, sizes array<long>, digests array<binary>, text binary, copies {whole}"), path, buckets)
    try:
        chunks = spark.table(name)
        # texts that another chunk has at a smaller id (a null id is the largest)
        text_of = Window.partitionBy("digest")
        place = F.struct(F.col("id").isNull().alias("null"), "id")
        gone, held = stored(
            chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "sizes", "digests")).alias("k", "d"))
            .where(F.col("d.sizes") >= length)
            .select("chunk", "k", F.col("d.ids").alias("id"), F.col("d.digests").alias("digest"))
            .withColumn("place", place).withColumn("least", F.min("place").over(text_of))
            .where(F.col("place") > F.col("least")).groupBy("chunk").agg(F.collect_list("k").alias("gone")),
            "repeats-copies")
        chunks = chunks.join(gone, "chunk", "left")
        every = Window.partitionBy("anchor")
        flags = (F.when(F.col("n") > 1, INSIDE).otherwise(0).bitwiseOR(
            F.when(F.col("total") > F.col("n"), BEYOND).otherwise(0)).bitwiseOR(
            F.when(F.col("total") > hot, BUSY).otherwise(0)))
        shared = (chunks.select("chunk", "sizes", "text", "gone")
                  .mapInArrow(_anchors(length), "anchor long, chunk long, n int")
                  .withColumn("total", F.sum("n").over(every)).where("total > 1")
                  .groupBy("chunk").agg(F.collect_list(F.col("anchor").bitwiseOR(flags.cast("long"))).alias("shared")))
        covers = (chunks.select("chunk", "ids", "sizes", "text", "gone").join(shared, "chunk")
                  .mapInArrow(_local(length), "key long, chunk long, at long, n long, id long, text binary")
                  .repartition(buckets, "key").sortWithinPartitions("key")
                  .mapInArrow(_global(length), "chunk long, at long, n long")
                  .groupBy("chunk").agg(F.collect_list(F.struct("at", "n")).alias("covers")))
        out, _ = stored(chunks.join(covers, "chunk", "left")
                        .mapInArrow(_finish(length), RESULT), "repeats-result")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, path)
    discard(spark, held)
    return out
