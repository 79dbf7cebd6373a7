"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path

# The white space of the word rule [^\x20\x09-\x0D]+ .
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

# A task works through its documents in pieces of about this many bytes, so
# its memory doesn't follow the size of an Arrow batch.
PIECE_BYTES = 2_000_000


# Rows and bytes of one Arrow batch: a few MB of text, so that a batch's copies in
# the JVM and in Python stay small beside a task's own memory.
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
              "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators of this subpackage rely on."""
    configure(spark)
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def utf8(col: str | Column) -> Column:
    """A text column as bytes; null counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("binary"), F.lit(b""))


def fold(col: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus`` (null id: as the text "")."""
    col = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def n_words(col: str | Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text (null: 0)."""
    col = F.col(col) if isinstance(col, str) else col
    text = F.btrim(F.coalesce(col, F.lit("")), F.lit(SPACE))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(
        F.size(F.split(text, SPACE_CLASS))).cast("long")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def keep_ids(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``key`` is (``left_anti``: isn't) in the one column of ``ids``."""
    name = free_name(df, "found_id")
    return df.join(ids.toDF(name).distinct(), F.col(key) == F.col(name), how)


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of texts of about ``limit`` bytes; a longer text stands alone."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def batches_of(rows: Iterable[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that a task makes one by one."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


# -- files in the shared folder ---------------------------------------------

def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    path = scratch_path(spark, name)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_folder`` or ``stored``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read back, with its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path as executors see it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def fresh_name(stem: str, suffix: str) -> str:
    """A file name that no other attempt of the same task uses."""
    return f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
