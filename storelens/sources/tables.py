"""Tenant-partitioned tables (S6) and appends (S7, S8), event expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from storelens.operators.tenancy import check_tenant_writes


def write_table(df: DataFrame, path: str, partition_by: list | None = None, mode: str = "append",
                tenant_id: str | None = None) -> None:
    """Write a table partitioned by tenant (and e.g. date) so reads prune folders.

    A REBALANCE hint on the partition columns groups each folder's rows into
    few tasks (few files per folder) while AQE splits a skewed folder - a
    tenant with a third of the rows - across many tasks instead of one.
    With ``tenant_id`` the write fails if any row belongs to another tenant (F2).
    """
    cols = partition_by or ["tenant_id"]
    if tenant_id is not None:
        df = check_tenant_writes(df, tenant_id)
    df.hint("rebalance", *cols).write.mode(mode).partitionBy(*cols).parquet(path)


def read_table(spark: SparkSession, path: str, tenant_id: str | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Read a tenant-partitioned table; a tenant filter prunes partitions.

    Tenant ids are text (``007`` stays ``007``).  With the table's declared
    ``schema`` nothing is inferred, so an empty table reads as no rows.
    """
    if schema is None:
        schema = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "tenant_id" else f for f in schema])
    df = spark.read.schema(schema).parquet(path)
    return df if tenant_id is None else df.where(F.col("tenant_id") == tenant_id)


def append_messages(df: DataFrame, path: str, tenant_id: str | None = None) -> None:
    """Append chat messages, partitioned by tenant and day."""
    out = df.withColumn("day", F.to_date("created_at"))
    write_table(out, path, ["tenant_id", "day"], "append", tenant_id)


def append_product_events(df: DataFrame, path: str, tenant_id: str | None = None) -> None:
    """Append (tenant, product, event_type, session, ts) rows."""
    out = df.select("tenant_id", "product_id", "event_type", "session_id", "created_at") \
            .withColumn("day", F.to_date("created_at"))
    write_table(out, path, ["tenant_id", "day"], "append", tenant_id)


def expand_recommendations(df: DataFrame, ids_col: str = "product_ids", event_type: str = "recommended",
                           keep: list | None = None) -> DataFrame:
    """One product event per id in a recommended list (a generator, no shuffle)."""
    keep = keep or ["tenant_id", "session_id", "created_at"]
    return df.select(*keep, F.explode(ids_col).alias("product_id"), F.lit(event_type).alias("event_type")) \
             .select("tenant_id", "product_id", "event_type", *[c for c in keep if c != "tenant_id"])


def inquiry_event(df: DataFrame, id_col: str = "product_id") -> DataFrame:
    """S9 single-row form: an inquiry about one product."""
    return df.select("tenant_id", F.col(id_col).alias("product_id"), F.lit("inquired").alias("event_type"),
                     "session_id", "created_at")
