"""Embedding lifecycle: pending rows (F13), backfill (E1), query vector (E2),
clearing (M7) and coverage (J11)."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storelens.schemas import EMBED_BATCH

EMBED_DIM = 64


def pending_embeddings(products: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """rows with embedding text but no vector yet (sort by id for the reference's order)."""
    p = products if tenant_id is None else products.where(F.col("tenant_id") == tenant_id)
    return p.where(F.col("embedding_json").isNotNull() & F.col("embedding").isNull())


def clear_embeddings(products: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """M7: drop vectors (all, or one tenant's) so they are regenerated."""
    hit = F.lit(True) if tenant_id is None else (F.col("tenant_id") == tenant_id)
    return products.withColumn("embedding", F.when(hit, F.lit(None).cast("array<float>"))
                               .otherwise(F.col("embedding")))


def embedding_coverage(products: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """Per tenant products and products with a vector; empty tenants count 0."""
    per = products.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("products"),
        F.count(F.when(F.col("embedding").isNotNull(), F.lit(1))).alias("with_embedding"))
    if tenants is not None:
        per = tenants.select("tenant_id").join(per, "tenant_id", "left") \
                     .fillna(0, subset=["products", "with_embedding"])
    return per.withColumn("coverage", F.try_divide(F.col("with_embedding").cast("double"), F.col("products")))


def embedding_dimension_report(products: DataFrame, expected: int = EMBED_DIM) -> DataFrame:
    """Data quality for the vector column: per tenant, vectors present and
    vectors whose length is not ``expected`` (the reference's column type
    fixes the dimension; here it is a check)."""
    size = F.size("embedding")
    return products.groupBy("tenant_id").agg(
        F.count("embedding").alias("with_embedding"),
        F.count(F.when(F.col("embedding").isNotNull() & (size != expected), F.lit(1))).alias("wrong_dimension"))


def hashed_bow(texts: list, dim: int = EMBED_DIM) -> list:
    """Default embedding function: L2-normalised hashed bag of words (no network).

    Deterministic across processes (crc32 of each lower-cased token).
    """
    import zlib
    out = []
    for t in texts:
        v = np.zeros(dim, dtype=np.float64)
        for tok in str(t or "").lower().split():
            h = zlib.crc32(tok.encode("utf-8"))
            v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
        n = np.linalg.norm(v)
        out.append((v / n if n > 0 else v).astype(np.float32).tolist())
    return out


def backfill_embeddings(products: DataFrame, embed_fn: Callable[[list], list] | None = None,
                        batch_size: int = EMBED_BATCH, regenerate: bool = False,
                        text_col: str = "embedding_json", dim: int | None = EMBED_DIM) -> DataFrame:
    """Fill missing vectors by calling ``embed_fn`` on batches of texts.

    ``embed_fn(list[str]) -> list[vector]``.  Runs in ``mapInPandas`` on the
    executors, ``batch_size`` texts per call; a batch that raises yields
    NULLs and those rows stay pending for the next run.  Vectors are joined
    back by id (the pending rows only, so the join input is the work set).
    A vector whose length is not ``dim`` is rejected (the row stays pending).
    """
    fn = embed_fn or hashed_bow
    base = clear_embeddings(products) if regenerate else products
    todo = pending_embeddings(base).select("id", F.col(text_col).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                try:
                    vecs = fn(chunk["_text"].tolist())
                    if len(vecs) != len(chunk):
                        raise ValueError("embedding count mismatch")
                    vecs = [None if v is None or (dim is not None and len(v) != dim)
                            else [float(x) for x in v] for v in vecs]
                except Exception:  # noqa: BLE001 - a failed batch stays pending
                    vecs = [None] * len(chunk)
                yield pd.DataFrame({"id": chunk["id"].to_numpy(), "_vec": vecs})

    new = todo.mapInPandas(run, "id long, _vec array<float>")
    return (base.join(new, "id", "left")
                .withColumn("embedding", F.coalesce(F.col("embedding"), F.col("_vec")))
                .drop("_vec"))


def embed_query(text: str, embed_fn: Callable[[list], list] | None = None) -> list:
    """The query vector, computed once on the driver and used as a literal."""
    return (embed_fn or hashed_bow)([text])[0]
