"""Catalogue files: read (S1, S2), write (S3, S4), export (S5), serialise."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from storelens.schemas import CATALOG, EXPORT_DAYS, PAGE_FIELDS, check_range

_WRAPPED = T.StructType([T.StructField("products", T.ArrayType(CATALOG))])


_CORRUPT = T.StructField("_corrupt", T.StringType())

FILE_DOCUMENTS = 100_000     # of one file of pages


def _whole(df: DataFrame, what: str) -> DataFrame:
    """Fail on rows that the reader could not parse, naming their file."""
    bad = F.col("_corrupt").isNotNull()
    # the message names a parsed column, so that Spark always parses one
    rest = F.to_json(F.struct(df.columns[0]))
    note = F.concat(F.lit(f"{what} is not valid JSON of products: "), F.input_file_name(), F.lit(" "), rest)
    return df.where(F.when(bad, F.raise_error(note).cast("boolean")).otherwise(F.lit(True))).drop("_corrupt")


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file holding a product array or ``{"products": [...]}``.

    The schema is declared, never inferred; leading white space and a byte
    order mark are allowed.  Multi-line JSON is not splittable, so each file
    is one task, which parses it as a stream; land big catalogues as NDJSON or
    Parquet first (``read_catalog_ndjson``).  Anything else raises.
    """
    schema = T.StructType([*CATALOG.fields, *_WRAPPED.fields, _CORRUPT])
    rows = _whole(spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", "_corrupt").json(path), "catalogue file")
    names = [f.name for f in CATALOG.fields]
    nothing = F.col("products").isNull() & F.coalesce(*[F.col(n).cast("string") for n in names]).isNull()
    note = F.concat(F.lit('catalogue file is neither a product array nor {"products": [...]}: '), F.input_file_name())
    rows = rows.where(F.when(nothing, F.raise_error(note).cast("boolean")).otherwise(F.lit(True)))
    own = F.array(F.struct(*names).cast(CATALOG))
    return rows.select(F.explode(F.coalesce("products", own)).alias("p")).select("p.*")


def read_catalog_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One product document per line (splittable); a line that is none raises."""
    return _whole(spark.read.schema(T.StructType([*CATALOG.fields, _CORRUPT])).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", "_corrupt").json(path), "catalogue line")


def read_catalog_pages(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Landed result pages (``{"products": [...]}``) -> one product frame.

    Many page files are read by one scan, exploded and projected to the
    requested fields; an empty page contributes nothing, a corrupt one raises
    (``corrupt_pages`` lists them).  ``multiline``: one (pretty-printed) page
    per file; otherwise one page per line, which is splittable.
    """
    pages = _whole(_pages(spark, path, multiline), "catalogue page")
    return pages.select(F.explode("products").alias("p")).select(*[F.col(f"p.{c}") for c in PAGE_FIELDS])


def _pages(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    return (spark.read.schema(T.StructType([*_WRAPPED.fields, _CORRUPT])).option("multiLine", multiline)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path))


def corrupt_pages(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(file, record) of the landed pages that can't be read."""
    bad = _pages(spark, path, multiline).select(
        F.input_file_name().alias("file"), F.col("_corrupt").alias("record"), "products")
    # with a parsed column in the filter, as Spark doesn't read the record alone
    parsed = F.coalesce(F.size("products"), F.lit(-1)) >= -1
    return bad.where(F.col("record").isNotNull() & parsed).select("file", "record")


def write_catalog(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """S3: write product documents (NDJSON by default, or Parquet)."""
    df.write.mode(mode).format(fmt).save(path)


def write_catalog_pages(df: DataFrame, path: str, page_size: int = 250, mode: str = "overwrite",
                        compression: str | None = "gzip") -> None:
    """Write documents as ``{"products": [...]}`` pages of at most ``page_size``.

    Pages are cut inside each partition from consecutive documents as they come
    by: nothing is shuffled or sorted, and a task holds one batch of rows.  A
    compressed file can't be split by its readers, so files have few pages.
    """
    def page(docs: list) -> str:
        return '{"products":[' + ",".join(docs) + "]}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            whole = len(held) // page_size * page_size
            yield pa.RecordBatch.from_arrays([pa.array(
                [page(held[lo:lo + page_size]) for lo in range(0, whole, page_size)], pa.string())], ["value"])
            held = held[whole:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([page(held)], pa.string())], ["value"])

    (df.select(F.to_json(F.struct(*df.columns)).alias("doc")).mapInArrow(cut, "value string")
     .write.mode(mode).option("maxRecordsPerFile", max(1, FILE_DOCUMENTS // page_size))
     .text(path, compression=compression))


def to_csv_frame(df: DataFrame) -> DataFrame:
    """S4 shape: columns in sorted order; arrays/maps/structs become JSON text."""
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_variants_csv(frames: list, path: str, mode: str = "overwrite") -> None:
    """CSV whose header is the sorted union of the frames' columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    to_csv_frame(out).write.mode(mode).option("header", True).csv(path)


EXPORT_COLUMNS = ["date", "session_count", "unique_sessions", "total_messages", "daily_cost"]


def export_daily_csv(sessions: DataFrame, as_of, path: str, days: int = 30, tenant_id: str | None = None,
                     mode: str = "overwrite") -> DataFrame:
    """A5 written as CSV with the fixed column order (plus tenant_id first)."""
    from storelens.operators.dashboard import sessions_over_time
    days = check_range("days", days, *EXPORT_DAYS)
    df = sessions_over_time(sessions, as_of, days, tenant_id).select("tenant_id", *EXPORT_COLUMNS)
    df.write.mode(mode).option("header", True).csv(path)
    return df
