"""Streaming sources and an idempotent upsert sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from storelens.session import checkpoint_dir, configure

_GLOB = set("*?[{")


def stream_path(path: str) -> str:
    """File streams need a directory or a glob; a single file becomes a one-file glob."""
    path = path.rstrip("/")
    if any(ch in path for ch in _GLOB) or not path.endswith(".parquet"):
        return path
    return f"{path[:-1]}[{path[-1]}]"


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A streaming DataFrame over a landing folder (new files = new rows)."""
    configure(spark)
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(stream_path(path))


def new_checkpoint(spark: SparkSession, name: str) -> str:
    """A fresh checkpoint folder under the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------------------
# Idempotent upsert sink: every micro-batch overwrites its own folder, so a
# retried batch replaces itself; readers resolve the newest row per key.
# ---------------------------------------------------------------------------

def sink_checkpoint(path: str) -> str:
    """The checkpoint that belongs to an upsert folder.  Batch folders are
    numbered by it, so another run into the folder goes on where the last one
    ended and never writes over its batches.  Readers skip the folder."""
    return f"{path.rstrip('/')}/_checkpoint"


def upsert_batch_writer(path: str):
    """foreachBatch function writing batch ``i`` to ``path/_batch=i`` (overwrite)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")
    return write


def read_upserted(spark: SparkSession, path: str, key: list, whole_key_group: bool = False) -> DataFrame:
    """Resolve an upsert-sink folder: newest batch's row(s) per key.

    ``whole_key_group``: a key's rows from one batch form one unit (e.g. a
    history list); otherwise one row per key is kept.
    """
    df = spark.read.parquet(path)
    if whole_key_group:
        newest = df.groupBy(*key).agg(F.max("_batch").alias("_batch"))
        return df.join(newest, key + ["_batch"], "left_semi").drop("_batch")
    # max_by is mergeable: old versions of a key are dropped map-side
    payload = F.struct(*[F.col(c) for c in df.columns if c not in key and c != "_batch"])
    return df.groupBy(*key).agg(F.max_by(payload, F.col("_batch")).alias("_row")).select(*key, "_row.*")


def compact_upserted(spark: SparkSession, path: str, key: list, out: str, whole_key_group: bool = False) -> None:
    """Write the resolved snapshot of an upsert folder (bounds later reads)."""
    read_upserted(spark, path, key, whole_key_group).write.mode("overwrite").parquet(out)


def run_to_table(df: DataFrame, path: str, mode: str = "update", name: str = "stream",
                 available_now: bool = True, checkpoint: str | None = None):
    """Start ``df`` into the upsert sink; with ``available_now`` drain and wait."""
    spark = df.sparkSession
    w = (df.writeStream.outputMode(mode).foreachBatch(upsert_batch_writer(path))
         .option("checkpointLocation", checkpoint or sink_checkpoint(path)).queryName(f"{name}-{uuid.uuid4().hex[:6]}"))
    if available_now:
        w = w.trigger(availableNow=True)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
