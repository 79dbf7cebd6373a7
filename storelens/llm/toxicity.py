"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the distinct hashes of its lower-cased words (ASCII
punctuation separates), of its word pairs and of its pairs that skip one word.
The model is trained on a bounded sample of the labelled rows, dealt into
shards; each shard runs FTRL-proximal with per-coordinate rates, and the
shards' weights are averaged.  L1 leaves few non-zero weights, so the model
is a small pair of arrays that travels inside the scoring function.

Defined results: a null or empty text scores the bias alone; a label row
without a label isn't learnt from; without any label row each score is 0.5;
repeated rows are scored alike, one result row each; other columns of the
input, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, pieces, utf8


@dataclass(frozen=True)
class FtrlParams:
    """``sample`` bounds the labelled rows that are learnt from (smallest
    hashes of the id), ``shard_rows`` those that one shard learns from in one
    run; ``bits`` is the width of a feature's hash, and a feature counts once
    it stands in ``min_count`` texts of its shard."""

    sample: int = 20_000
    shard_rows: int = 10_000
    epochs: int = 3
    bits: int = 32
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    min_count: int = 5
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, and the bias."""

    bias: float = 0.0
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float64))
    bits: int = 32


# ASCII characters that separate words: everything but letters and digits.
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) of every word, pair and skip pair, with repeats."""
    words = [t.lower().translate(_APART).split() for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h = hash_words([w for doc in words for w in doc])
    down = np.uint64(64 - bits)
    owners, hashes = [of], [mix(h) >> down]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        if len(h) > gap:
            same = of[:-gap] == of[gap:]
            pair = h[:-gap] * np.uint64(salt) + h[gap:] * np.uint64(0xE7037ED1A0B428DB)
            owners.append(of[:-gap][same])
            hashes.append(mix(pair[same]) >> down)
    return np.concatenate(owners), np.concatenate(hashes)


def _ftrl(docs: list[np.ndarray], labels: np.ndarray, size: int, p: FtrlParams,
          rng: np.random.Generator) -> np.ndarray:
    """FTRL-proximal (McMahan et al. 2013) over binary features; index 0 is the bias."""
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        sparse = np.maximum(np.abs(zs) - np.where(at == 0, 0.0, p.l1), 0.0)
        return -np.sign(zs) * sparse / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for i in rng.permutation(len(docs)):
            at = docs[i]
            w = weights(at)
            grad = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            grown = n[at] + grad * grad
            z[at] += grad - (np.sqrt(grown) - np.sqrt(n[at])) / p.alpha * w
            n[at] = grown
    return weights(np.arange(size))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text",
          key: str = "doc_id", params: FtrlParams = FtrlParams()) -> Model:
    """Learn the 0/1 ``label`` of ``labels`` (key, label) from the texts of ``docs``.

    At most ``params.sample`` different (key, label) pairs are used, those with
    the smallest hashes of the key, so the rows sent to a shard are bounded.
    """
    p = params
    pairs = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(label).cast("double").alias("y"),
        F.xxhash64(F.col(key), F.lit(p.seed)).alias("h")).distinct()
    last, n = pairs.select("h").orderBy("h").limit(p.sample).agg(
        F.max("h"), F.count("*")).first()
    if not n:
        return Model(bits=p.bits)
    shards = -(-n // p.shard_rows)
    sample = pairs.where(F.col("h") <= last)
    rows = (docs.select(F.col(key).alias("k"), utf8(text).alias("t"))
            .join(F.broadcast(sample), "k")  # p.sample rows of three numbers
            .groupBy("k", "y", "h").agg(F.min("t").alias("t"))
            .select("t", "y", "h", F.pmod("h", F.lit(shards)).alias("shard")))

    def fit(key, pdf):
        import pandas as pd

        shard = int(key[0])
        pdf = pdf.sort_values(["h", "y"], kind="stable")
        docs: list[np.ndarray] = []
        texts = pdf["t"].tolist()
        for lo, hi in pieces(texts):
            of, hashes = _features(texts[lo:hi], p.bits)
            order = np.lexsort((hashes, of))
            of, hashes = of[order], hashes[order]
            first = np.ones(len(of), dtype=bool)
            first[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
            of, hashes = of[first], hashes[first]
            ends = np.searchsorted(of, np.arange(1, hi - lo))
            docs += np.split(hashes.astype(np.uint32) if p.bits <= 32 else hashes, ends)
        every = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        keys, counts = np.unique(every, return_counts=True)
        keys = keys[counts >= p.min_count]
        zero = np.zeros(1, dtype=np.int64)
        known = []
        for d in docs:
            at = np.searchsorted(keys, d)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == d[hit]
            known.append(np.concatenate([zero, at[hit] + 1]))
        w = _ftrl(known, pdf["y"].to_numpy(), len(keys) + 1, p,
                  np.random.default_rng([p.seed, shard]))
        some = np.flatnonzero(w[1:])
        return pd.DataFrame({"f": np.concatenate([[-1], keys[some].astype(np.int64)]),
                             "w": np.concatenate([w[:1], w[1:][some]])})

    # the sample is bounded, so are its shards and the sparse weights collected here
    fitted = rows.groupBy("shard").applyInPandas(fit, "f long, w double")
    got = fitted.groupBy("f").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    if not got:
        return Model(bits=p.bits)
    of = {r["f"]: (r["w"], r["n"]) for r in got}
    shards = of[-1][1]
    keys = np.array(sorted(k for k in of if k >= 0), dtype=np.uint64)
    return Model(of[-1][0] / shards, keys,
                 np.array([of[int(k)][0] / shards for k in keys]), p.bits)


def _scores(texts: list[bytes], model: Model, filter_: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    of, hashes = _features(texts, model.bits)
    maybe = filter_[(hashes & np.uint64(0xFFFF)).astype(np.intp)]
    of, hashes = of[maybe], hashes[maybe]
    at = np.minimum(np.searchsorted(model.keys, hashes), max(len(model.keys) - 1, 0))
    if len(model.keys):
        hit = model.keys[at] == hashes
        pair = np.unique(of[hit] * np.int64(len(model.keys)) + at[hit])
        np.add.at(out, pair // len(model.keys), model.weights[pair % len(model.keys)])
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model, text: str | Column = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of ``docs``: the model's probability of label 1."""
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.zeros(1 << 16, dtype=bool)
        filter_[(model.keys & np.uint64(0xFFFF)).astype(np.intp)] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [_scores(texts[lo:hi], model, filter_) for lo, hi in pieces(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(parts) if parts else np.empty(0))],
                schema=schema)

    return docs.select(F.col(key).cast("long").alias(key), utf8(text).alias("t")).mapInArrow(
        run, f"`{key}` long, score double")
