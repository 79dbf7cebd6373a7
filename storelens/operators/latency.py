"""Latency report A11-A14 over assistant messages (P5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storelens.operators.common import ensure_tenant_row, for_tenant, top_k_per_group, trailing
from storelens.schemas import DASHBOARD_DAYS, PERCENTILES, check_range


def assistant_latencies(messages: DataFrame, as_of, days: int = 7, tenant_id: str | None = None) -> DataFrame:
    """Assistant rows with a latency in [as_of - days, as_of] (inclusive window)."""
    days = check_range("days", days, *DASHBOARD_DAYS)
    m = trailing(for_tenant(messages, tenant_id), "created_at", as_of, days=days, inclusive=True)
    return m.where((F.col("role") == "assistant") & F.col("latency_ms").isNotNull())


def latency_summary(lat: DataFrame) -> DataFrame:
    """avg/min/max/count per tenant; avg of nothing -> 0."""
    return lat.groupBy("tenant_id").agg(
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.count(F.lit(1)).alias("message_count"))


def _pct_cols(col: str, probs: list, exact: bool = True, accuracy: int = 10_000) -> list:
    # exact: interpolated percentiles (like PERCENTILE_CONT); Spark keeps a
    # value->count map per group and merges partial maps, so the cost is the
    # number of distinct latencies, not rows.  Otherwise a mergeable
    # quantile sketch (percentile_approx) of fixed size per group, whose
    # answers are sample values within 1/accuracy in rank.
    levels = F.array(*[F.lit(p) for p in probs])
    c = F.col(col).cast("double")
    arr = F.percentile(c, levels) if exact else F.percentile_approx(c, levels, accuracy)
    return [arr, [f"p{int(round(p * 100))}" for p in probs]]


def latency_percentiles(lat: DataFrame, probs: list | None = None, exact: bool = True) -> DataFrame:
    """p50, p75, p90, p95, p99 per tenant (exact, or a sketch)."""
    probs = probs or PERCENTILES
    arr, names = _pct_cols("latency_ms", probs, exact)
    agg = lat.groupBy("tenant_id").agg(arr.alias("_p"))
    return agg.select("tenant_id", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])


def latency_by_hour(lat: DataFrame, exact: bool = True) -> DataFrame:
    """Per truncated hour: avg, p50, p90, p99, count."""
    arr, names = _pct_cols("latency_ms", [0.5, 0.9, 0.99], exact)
    agg = lat.groupBy("tenant_id", F.date_trunc("hour", "created_at").alias("hour")).agg(
        F.avg("latency_ms").alias("avg_latency_ms"), arr.alias("_p"),
        F.count(F.lit(1)).alias("message_count"))
    return agg.select("tenant_id", "hour", "avg_latency_ms",
                      *[F.col("_p")[i].alias(n) for i, n in enumerate(names)], "message_count")


def worst_sessions(lat: DataFrame, limit: int = 10) -> DataFrame:
    """Per session max/avg/count; top ``limit`` by max latency per tenant."""
    per = lat.groupBy("tenant_id", "session_id").agg(
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.count(F.lit(1)).alias("message_count"))
    ranked = top_k_per_group(per, ["tenant_id"], [F.col("max_latency_ms").desc(), F.col("session_id").asc()], limit)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def latency_report(messages: DataFrame, as_of, days: int = 7, tenant_id: str | None = None) -> dict:
    """P5: the four latency aggregates over one filtered input."""
    lat = assistant_latencies(messages, as_of, days, tenant_id)
    summary = ensure_tenant_row(latency_summary(lat), tenant_id, {"avg_latency_ms": 0.0, "message_count": 0})
    pct = latency_percentiles(lat)
    pct = ensure_tenant_row(pct, tenant_id, {c: 0.0 for c in pct.columns if c != "tenant_id"})
    return {"summary": summary, "percentiles": pct,
            "by_hour": latency_by_hour(lat), "worst_sessions": worst_sessions(lat)}
