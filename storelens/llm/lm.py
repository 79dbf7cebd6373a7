"""LM scoring: a bigram model smoothed by deleted interpolation.

P(w | h) = l0 / (V + 1) + l1 c(w) / N + l2 c(h w) / c(h)

with maximum-likelihood estimates from all training texts.  The weights
depend on the bucket of the context's count (powers of two); they are learned
by expectation-maximisation on a deleted part of the training texts, whose
estimates come from the counts of the rest.  An unseen context has l2 = 0.
Tokens are the words of the lower-cased (A-Z) text and one end; the first
context of a text is its begin, which has been seen once a training text.

Counting is exact.  Tasks cut texts into chunks and write each chunk's
different words (64-bit hashes) and the sequence of their indices.  A chunk
asks for the counts of its different words and pairs, in sorted blocks by
ranges of the hash; one group for each range adds up the chunks' own counts
and answers every chunk.  So a frequent word is one entry a chunk, the groups
are even, and what moves grows in proportion to the input.

Defined results: a null or empty text has the end token only; a null id
counts as the text "" in a fold; repeated rows are scored alike, one result
row each, and count as often as they stand; without training texts each token
has probability 1 / (V + 1) = 1; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, hash_words, mix, pieces, scratch_path, stored, utf8

# What a text is to the model.
RETAINED, DELETED, SCORED = 0, 1, 2
# One for an unseen context and one for each power of two of a 64-bit count.
BUCKETS = 64


@dataclass(frozen=True)
class LmParams:
    """``chunk_bytes``: text of a chunk; ``range_keys``: hashes that the group
    of one range holds; ``cells``: steps per octave of the probabilities that
    the weights are learned from; ``rounds`` of expectation-maximisation."""

    chunk_bytes: int = 12_000_000
    range_keys: int = 2_000_000
    cells: int = 4
    rounds: int = 60


END = hash_words([b" end"])[0]  # no word has a space
BEGIN = hash_words([b" begin"])[0]


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers, byte planes compressed one after the other."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def _pairs(words: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of (context, token) at each token."""
    tokens = words[index]
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + mix(tokens))


# -- chunks ----------------------------------------------------------------------

_CHUNK = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())),
                    ("flags", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
                    ("words", pa.binary()), ("index", pa.binary()), ("n", pa.int64())])
_CHUNK_DDL = ("chunk long, kind int, ids array<long>, flags array<int>, sizes array<int>, "
              "words binary, `index` binary, n long")


def _chunks(docs: DataFrame, key: str, text: str, kind: Column, flag: Column, p: LmParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}  # rows by kind: the deleted part has chunks of its own

        def chunk(kind: int, rows: list) -> pa.RecordBatch:
            nonlocal made
            split = [t.lower().split() for _, t, _ in rows]
            sizes = np.array([len(w) + 1 for w in split], dtype=np.int32)
            tokens = np.full(sizes.sum(), END, dtype=np.uint64)
            inner = np.ones(len(tokens), dtype=bool)
            inner[np.cumsum(sizes) - 1] = False
            tokens[inner] = hash_words([w for doc in split for w in doc])
            words, index = np.unique(tokens, return_inverse=True)
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array([made]), pa.array([kind], pa.int32()),
                pa.array([[i for i, _, _ in rows]], pa.list_(pa.int64())),
                pa.array([[f for _, _, f in rows]], pa.list_(pa.int32())),
                pa.array([sizes.tolist()], pa.list_(pa.int32())),
                pa.array([_pack_sorted(words)], pa.binary()),
                pa.array([_pack(index.astype(np.uint32))], pa.binary()),
                pa.array([len(tokens)], pa.int64())], schema=_CHUNK)

        for batch in batches:
            for i, text, kind, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(kind, []).append((i, text, flag))
            for kind, rows in held.items():
                runs = list(pieces([t for _, t, _ in rows], p.chunk_bytes))
                for lo, hi in runs[:-1]:
                    yield chunk(kind, rows[lo:hi])
                held[kind] = rows[runs[-1][0]:] if runs else []
        for kind, rows in held.items():
            if rows:
                yield chunk(kind, rows)

    return docs.select(F.col(key).cast("long").alias("k"), utf8(text).alias("t"),
                       kind.cast("int").alias("kind"), flag.cast("int").alias("flag")).mapInArrow(run, _CHUNK_DDL)


# -- counts ----------------------------------------------------------------------

_ASK = pa.schema([("range", pa.int32()), ("size", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()),
                  ("keys", pa.binary()), ("counts", pa.binary())])
_ASK_DDL = "range int, size int, chunk long, kind int, keys binary, counts binary"
_TELL = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("size", pa.int32()), ("range", pa.int32()),
                   ("retained", pa.binary()), ("training", pa.binary()),
                   ("types", pa.int64()), ("total", pa.int64()), ("retained_total", pa.int64())])
_TELL_DDL = ("chunk long, kind int, size int, range int, retained binary, training binary, "
             "types long, total long, retained_total long")


def _answers(chunks: DataFrame, ranges: int, p: LmParams) -> DataFrame:
    """For each chunk and range of hashes, the counts of its words (size 1) and
    pairs (size 2), and one row for each range with the range's totals."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _unpack_sorted(row["words"])
                index = _unpack(row["index"], np.uint32)
                pairs = _pairs(words, index, np.array(row["sizes"]))
                for size, (keys, counts) in (
                        (1, (words, np.bincount(index, minlength=len(words)))),
                        (2, np.unique(pairs, return_counts=True))):
                    at = ((keys >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
                    starts = np.flatnonzero(np.diff(at, prepend=at[0] + np.uint64(1)))
                    ends = np.append(starts[1:], len(keys))
                    counts = counts.astype(np.uint32)
                    yield pa.RecordBatch.from_pylist([
                        {"range": int(at[s]), "size": size, "chunk": row["chunk"], "kind": row["kind"],
                         "keys": _pack_sorted(keys[s:e]),
                         "counts": None if row["kind"] == SCORED else _pack(counts[s:e])}
                        for s, e in zip(starts, ends, strict=True)], schema=_ASK)

    def tell(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [_unpack_sorted(r["keys"]) for r in rows]
        n = [len(k) for k in keys]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = {RETAINED: np.zeros(len(every), dtype=np.int64), DELETED: np.zeros(len(every), dtype=np.int64)}
        ends = np.cumsum(n)
        for r, e, m in zip(rows, ends, n, strict=True):
            if r["counts"] is not None:  # a chunk has each key once
                sums[r["kind"]][inverse[e - m:e]] += _unpack(r["counts"], np.uint32)
        retained = sums[RETAINED]
        training = retained + sums[DELETED]
        out = [{"chunk": -1, "kind": -1, "size": rows[0]["size"], "range": rows[0]["range"],
                "types": int((training > 0).sum()), "total": int(training.sum()),
                "retained_total": int(retained.sum())}]
        for r, e, m in zip(rows, ends, n, strict=True):
            own = inverse[e - m:e]
            out.append({"chunk": r["chunk"], "kind": r["kind"], "size": r["size"], "range": r["range"],
                        "retained": _pack(retained[own].astype(np.uint64)) if r["kind"] == DELETED else None,
                        "training": _pack(training[own].astype(np.uint64))})
        return pa.Table.from_pylist(out, schema=_TELL)

    return chunks.mapInArrow(ask, _ASK_DDL).groupBy("range", "size").applyInArrow(tell, _TELL_DDL)


def _token_counts(chunk: dict, answers: list[dict], column: str
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """c(w), c(h), c(h w) at each token of a chunk, and which tokens end a text."""
    answers = sorted(answers, key=lambda r: r["range"])
    found = {size: np.concatenate([_unpack(r[column], np.uint64) for r in answers if r["size"] == size])
             for size in (1, 2)}
    words = _unpack_sorted(chunk["words"])
    index = _unpack(chunk["index"], np.uint32)
    sizes = np.array(chunk["sizes"])
    ends = np.cumsum(sizes) - 1
    own = found[1][index].astype(np.int64)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[ends - sizes + 1] = own[ends]  # a text begins as often as one ends
    _, inverse = np.unique(_pairs(words, index, sizes), return_inverse=True)
    return own, before, found[2][inverse].astype(np.int64), ends


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each power of two."""
    return np.where(context > 0, np.minimum(
        np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


# -- weights ---------------------------------------------------------------------

def learn_weights(cells: list[tuple[int, float, float, int]], p0: float, rounds: int) -> np.ndarray:
    """Weights (l0, l1, l2) of each bucket from cells (bucket, p1, p2, number of
    tokens), by expectation-maximisation; a bucket without tokens has the
    weights of all tokens together, bucket 0 no l2."""
    every = np.array(cells, dtype=np.float64).reshape(-1, 4)

    def em(own: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = np.stack([np.full(len(own), p0), own[:, 1], own[:, 2]], axis=1)
        w = start
        for _ in range(rounds):
            parts = p * w
            w = (parts / parts.sum(axis=1, keepdims=True) * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
        w = np.where(start > 0, np.maximum(w, 1e-5), 0.0)  # no token may have probability zero
        return w / w.sum()

    any_ = em(every, np.full(3, 1 / 3)) if len(every) else np.array([1.0, 0.0, 0.0])
    out = np.tile(any_, (BUCKETS, 1))
    out[0, 2] = 0.0
    out[0] /= out[0].sum()
    for b in range(BUCKETS):
        own = every[every[:, 0] == b]
        if len(own):
            out[b] = em(own, np.array([0.5, 0.5, 0.0]) if b == 0 else np.full(3, 1 / 3))
    return out


def _cells(chunks: DataFrame, answers: DataFrame, total: int, p: LmParams) -> list[tuple]:
    """Tokens of the deleted part by bucket and by their two estimates, to a
    step of 2 ** (1 / cells).  Their number is bounded by the steps."""
    schema = pa.schema([("bucket", pa.int32()), ("i1", pa.int32()), ("i2", pa.int32()), ("m", pa.int64())])
    none = -(1 << 20)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[tuple, int] = {}
        answers = right.to_pylist()
        for chunk in left.to_pylist():
            own, before, pair, _ = _token_counts(chunk, answers, "retained")
            p1, p2 = own / max(total, 1), pair / np.maximum(before, 1)
            steps = [np.where(x > 0, np.rint(p.cells * np.log2(np.maximum(x, 1e-300))), none) for x in (p1, p2)]
            cells, m = np.unique(np.stack([_bucket(before), *steps]).astype(np.int64), axis=1, return_counts=True)
            for c, k in zip(cells.T.tolist(), m.tolist(), strict=True):
                out[tuple(c)] = out.get(tuple(c), 0) + k
        return pa.Table.from_pylist([{"bucket": c[0], "i1": c[1], "i2": c[2], "m": m} for c, m in out.items()],
                                    schema=schema)

    rows = (chunks.where(F.col("kind") == DELETED).groupBy("chunk")
            .cogroup(answers.where(F.col("kind") == DELETED).groupBy("chunk"))
            .applyInArrow(count, "bucket int, i1 int, i2 int, m long")
            .groupBy("bucket", "i1", "i2").agg(F.sum("m").alias("m")).collect())
    value = lambda i: 0.0 if i == none else 2.0 ** (i / p.cells)
    return [(r["bucket"], value(r["i1"]), value(r["i2"]), r["m"]) for r in rows]


# -- scores ----------------------------------------------------------------------

def score(docs: DataFrame, key: str = "doc_id", text: str = "text", training: Column | None = None,
          deleted: Column | None = None, params: LmParams = LmParams()) -> DataFrame:
    """Score every row of ``docs``.

    ``training``: rows that the model learns from (default: all);
    ``deleted``: rows among those that the weights are learned from (default:
    a seventh by the id's crc32).  Returns key, training, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams) and score, both log10.
    """
    p, spark = params, docs.sparkSession
    training = F.coalesce(training, F.lit(False)) if training is not None else F.lit(True)
    deleted = deleted if deleted is not None else fold(key, 7) == 6
    kind = F.when(~training, SCORED).when(deleted, DELETED).otherwise(RETAINED)

    # a bucketed table: later joins move the answers, not the chunks
    path = scratch_path(spark, "lm-chunks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (_chunks(docs, key, text, kind, training, p).write.bucketBy(buckets, "chunk").option("path", path)
     .format("parquet").saveAsTable(name))
    chunks = spark.table(name)
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    ranges = max(8, -(-2 * tokens // p.range_keys))

    answers, answers_path = stored(_answers(chunks, ranges, p), "lm-answers")
    sums = answers.where("chunk = -1 AND size = 1").agg(
        F.sum("types"), F.sum("total"), F.sum("retained_total")).first()
    types, total, retained = (int(x or 0) for x in sums)
    weights = learn_weights(_cells(chunks, answers, retained, p), 1 / (types + 1), p.rounds)

    schema = pa.schema([("k", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, answers = [], right.to_pylist()
        for chunk in left.to_pylist():
            own, before, pair, ends = _token_counts(chunk, answers, "training")
            lam = weights[_bucket(before)]
            prob = (lam[:, 0] / (types + 1) + lam[:, 1] * own / max(total, 1)
                    + lam[:, 2] * pair / np.maximum(before, 1))
            sizes = np.array(chunk["sizes"], dtype=np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x: np.bincount(of, x, minlength=len(sizes))  # noqa: B023, E731
            parts.append(pa.table([
                pa.array(chunk["ids"], pa.int64()), pa.array([bool(f) for f in chunk["flags"]]), pa.array(sizes),
                pa.array(add(own > 0).astype(np.int64)),
                pa.array(add(np.log10((own + 1) / (total + types + 1)))), pa.array(add(np.log10(prob)))],
                schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    rows = (chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(
        run, "k long, training boolean, n_tokens long, n_known long, base_score double, score double"))
    rows, _ = stored(rows, "lm-scores")
    spark.sql(f"DROP TABLE {name}")
    discard(spark, path)
    discard(spark, answers_path)
    return rows.select(F.col("k").alias(key), "training", "n_tokens", "n_known",
                       F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
