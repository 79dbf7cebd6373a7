"""Report-shaped pipelines: recent sessions (O4), transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storelens.functions.misc import duration_minutes
from storelens.functions.text import transcript_line
from storelens.operators.common import for_tenant, top_k_per_group
from storelens.operators.sessions import last_n_messages


def recent_sessions(sessions: DataFrame, limit: int = 10, tenant_id: str | None = None) -> DataFrame:
    """Newest sessions per tenant with duration in minutes (NULL-safe)."""
    s = for_tenant(sessions, tenant_id)
    ranked = top_k_per_group(s, ["tenant_id"], [F.col("started_at").desc_nulls_first(),
                                                 F.col("session_id").asc()], limit)
    return ranked.select(
        "tenant_id", "session_id", "started_at", "ended_at",
        duration_minutes("started_at", "ended_at").alias("duration_minutes"),
        "message_count", "llm_call_count", "total_tokens_used",
        F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce("estimated_cost", F.lit(0.0)).alias("estimated_cost"),
        F.col("rank").cast("long").alias("rank"))


def transcripts(messages: DataFrame, n: int = 5, key: list | None = None, order: list | None = None,
                text_col: str = "content") -> DataFrame:
    """The last ``n`` messages of each session as a transcript string.

    System rows count against ``n`` and are then dropped.  An assistant row
    with structured data shows that JSON instead of its text.  The flag
    ``ends_with_user`` is false when the last kept line is not the user's.
    Each group holds at most ``n`` rows, so the ordered collect is bounded.
    """
    key = key or ["tenant_id", "session_id"]
    order = order or ["created_at", "message_id"]
    last = last_n_messages(messages, n, key, order)
    kept = last.where(F.col("role").isin("user", "assistant"))
    if "structured_data" in kept.columns:
        text = F.when((F.col("role") == "assistant") & F.col("structured_data").isNotNull(),
                      F.col("structured_data")).otherwise(F.col(text_col))
    else:
        text = F.col(text_col)
    lines = kept.select(*key, "position", "role", transcript_line(F.col("role"), text).alias("line"))
    grouped = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "role", "line"))).alias("_l"))
    return grouped.select(
        *key,
        F.array_join(F.transform("_l", lambda e: e["line"]), "").alias("transcript"),
        F.size("_l").cast("long").alias("lines"),
        (F.element_at("_l", -1)["role"] == "user").alias("ends_with_user"))
