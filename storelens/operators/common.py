"""Shared building blocks: tenant scoping, trailing windows, per-group top-k."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F


def as_ts(as_of) -> Column:
    """An ``as_of`` instant as a timestamp literal (datetime or ISO string)."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def for_tenant(df: DataFrame, tenant_id: str | None, col: str = "tenant_id") -> DataFrame:
    """row-level tenant scope.  None keeps every tenant (grouped outputs)."""
    if tenant_id is None:
        return df
    return df.where(F.col(col) == F.lit(tenant_id))


def trailing(df: DataFrame, ts_col: str, as_of, *, days: int = 0, hours: int = 0,
             minutes: int = 0, seconds: int = 0, inclusive: bool = False) -> DataFrame:
    """rows with ts in (as_of - span, as_of]  (``inclusive`` -> [ , ]).

    Dashboard windows use the strict lower bound, latency windows the
    inclusive one.  Both are plain range predicates, so Parquet min/max
    statistics prune row groups; a stored log's ``day`` folders are pruned too.
    """
    end = as_ts(as_of)
    span = F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))
    start = end - span
    ts = F.col(ts_col)
    lower = ts >= start if inclusive else ts > start
    return within_days(df, start, end).where(lower & (ts <= end))


def within_days(df: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Only the ``day`` folders between two instants, where the frame has days."""
    if "day" not in df.columns:
        return df
    days = F.col("day") >= F.to_date(start)
    return df.where(days if end is None else days & (F.col("day") <= F.to_date(end)))


def top_k_per_group(df: DataFrame, partition_cols: list, order_cols: list, k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group.

    For k up to ``PARTIAL_LIMIT`` Spark inserts a partial WindowGroupLimit
    before the shuffle, so each map task ships at most k rows per group: a hot
    group costs k rows per task, never its full size.  A larger k ships whole
    groups; ``page_of_group`` reads deep pages without that.
    """
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# Beyond this rank Spark plans no partial limit in the map tasks.
PARTIAL_LIMIT = 1000


def page_of_group(df: DataFrame, group: str, order_cols: list, bucket_key: Column, limit: int, offset: int,
                  rank_col: str = "rank") -> DataFrame:
    """Rows offset+1 .. offset+limit of each group in the given order.

    A page within the first ``PARTIAL_LIMIT`` rows is a plain top-k.  Beyond
    it a group is counted by ranges of ``bucket_key`` (a number that the order
    descends by first): ranges that lie wholly before or after the page are
    only counted, and just the rows of the ranges that the page touches are
    ranked - so a deep page sorts about a range of the group, not the group.
    """
    if offset + limit <= PARTIAL_LIMIT:
        return top_k_per_group(df, [group], order_cols, offset + limit, rank_col).where(F.col(rank_col) > offset)
    day = F.floor(bucket_key / F.lit(86_400)).alias("_bucket")
    counts = df.groupBy(group, day).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy(F.col("_bucket").desc())
    counts = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n"))
    touched = counts.where((F.col("_upto") > offset) & (F.col("_before") < offset + limit)) \
                    .select(group, "_bucket", "_before")
    rows = df.withColumn("_bucket", day).join(touched, [group, "_bucket"])
    inside = Window.partitionBy(group, "_bucket").orderBy(*order_cols)
    return rows.withColumn(rank_col, F.row_number().over(inside) + F.col("_before")) \
               .where((F.col(rank_col) > offset) & (F.col(rank_col) <= offset + limit)) \
               .drop("_bucket", "_before")


def round_doubles(df: DataFrame, digits: int = 6, keep: tuple = (), **per_column: int) -> DataFrame:
    """Round computed double columns (stable comparisons across engines).

    ``per_column`` overrides the digits for named columns (e.g. cost=10);
    ``keep`` lists raw columns left untouched (already bit-identical, and
    rounding could split a tie differently in another engine).
    """
    cols = [F.round(F.col(f.name), per_column.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() == "double" and f.name not in keep else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def ensure_tenant_row(agg: DataFrame, tenant_id: str | None, zeros: dict) -> DataFrame:
    """A scoped scalar aggregate always answers one row, like SQL's COUNT(*)
    without GROUP BY: a tenant with no rows gets ``zeros`` (others NULL)."""
    if tenant_id is None:
        return agg
    one = agg.sparkSession.createDataFrame([(tenant_id,)], "tenant_id string")
    out = one.join(agg, "tenant_id", "left")
    for c, v in zeros.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out.select(*agg.columns)
