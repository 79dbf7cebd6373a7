"""Dashboard aggregates A1-A10 with calendar/hour gap filling.

Every function computes all tenants at once (``tenant_id`` is a grouping
column); pass ``tenant_id=`` to scope to one tenant (pushed to the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storelens.operators.common import as_ts, ensure_tenant_row, for_tenant, top_k_per_group, trailing, within_days
from storelens.schemas import DASHBOARD_DAYS, TOP_LIMIT, check_range


# ---------------------------------------------------------------------------
# J9 spines
# ---------------------------------------------------------------------------

def fill_days(agg: DataFrame, as_of, days: int, date_col: str = "date", key: str = "tenant_id",
              zeros: dict | None = None) -> DataFrame:
    """One row per key per calendar day of the ``days`` days ending at as_of.

    Keys come from ``agg`` itself (a key without rows gets no spine, as in the
    reference).  The spine is generated per key with ``explode(sequence)`` -
    no cross join - and left-joined to the aggregate on (key, date).
    """
    end = F.to_date(as_ts(as_of))
    start = F.date_sub(end, days - 1)
    spine = (agg.select(key).distinct()
             .select(key, F.explode(F.sequence(start, end)).alias(date_col)))
    out = spine.join(agg, [key, date_col], "left")
    for c, v in (zeros or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def fill_hours(agg: DataFrame, keys: DataFrame, hour_col: str = "hour", key: str = "tenant_id",
               zeros: dict | None = None) -> DataFrame:
    """24 rows (hour 0..23) per key; missing hours get zeros."""
    spine = keys.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(23))).alias(hour_col))
    out = spine.join(agg, [key, hour_col], "left")
    for c, v in (zeros or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


# ---------------------------------------------------------------------------
# P4 overview = A1 + A2 + A3 + A4
# ---------------------------------------------------------------------------

def overview(sessions: DataFrame, messages: DataFrame, as_of, tenant_id: str | None = None,
             approx_distinct: bool = False) -> DataFrame:
    """A1-A4 in one row per tenant.

    Sessions and messages are aggregated separately (each log scanned once,
    distinct counts kept apart so no Expand multiplies the log) and the two
    per-tenant rows are joined on tenant.  ``approx_distinct`` counts active
    sessions with HyperLogLog++ (fixed-size state, ~1% error) instead of an
    exact distinct.
    """
    s = for_tenant(sessions, tenant_id)
    m = for_tenant(messages, tenant_id)
    today = F.to_date(as_ts(as_of))
    hour_ago = as_ts(as_of) - F.expr("INTERVAL 1 HOUR")
    s_agg = s.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_distinct(F.to_date("started_at")).alias("days_active"),
        F.coalesce(F.sum(F.when(F.to_date("started_at") == today, F.col("estimated_cost"))),
                   F.lit(0.0)).alias("cost_today"))
    recent = F.when((F.col("created_at") > hour_ago) & (F.col("created_at") <= as_ts(as_of)), F.col("session_id"))
    active = F.approx_count_distinct(recent, 0.01) if approx_distinct else F.count_distinct(recent)
    # both counts look at today and the last hour only
    since = F.least(today.cast("timestamp"), hour_ago)
    m_agg = within_days(m, since).where(F.col("created_at") >= since).groupBy("tenant_id").agg(
        F.count(F.when(F.to_date("created_at") == today, F.lit(1))).alias("messages_today"),
        active.alias("active_sessions"))
    out = s_agg.join(m_agg, "tenant_id", "full")
    if tenant_id is not None:
        out = ensure_tenant_row(out, tenant_id, {})
    return out.select("tenant_id",
                      F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
                      F.coalesce("days_active", F.lit(0)).alias("days_active"),
                      F.coalesce("messages_today", F.lit(0)).alias("messages_today"),
                      F.coalesce("cost_today", F.lit(0.0)).alias("cost_today"),
                      F.coalesce("active_sessions", F.lit(0)).alias("active_sessions"))


# ---------------------------------------------------------------------------
# A5 - A9
# ---------------------------------------------------------------------------

def sessions_over_time(sessions: DataFrame, as_of, days: int = 7, tenant_id: str | None = None) -> DataFrame:
    """A5: per day sessions, distinct sessions, messages and cost, gap-filled.

    Window is rolling (> as_of - days); the spine is the ``days`` calendar days
    ending at as_of's date, so a partial oldest day is aggregated then dropped.
    A tenant with no rows in the window gets no rows at all.
    """
    days = check_range("days", days, 1, 365)
    s = trailing(for_tenant(sessions, tenant_id), "started_at", as_of, days=days)
    agg = s.groupBy("tenant_id", F.to_date("started_at").alias("date")).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("total_messages"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("daily_cost"))
    return fill_days(agg, as_of, days, zeros={"session_count": 0, "unique_sessions": 0,
                                              "total_messages": 0, "daily_cost": 0.0})


def message_volume(messages: DataFrame, as_of, days: int = 7, tenant_id: str | None = None) -> DataFrame:
    """Per day user / assistant / total messages (total counts system too); no gap fill."""
    days = check_range("days", days, *DASHBOARD_DAYS)
    m = trailing(for_tenant(messages, tenant_id), "created_at", as_of, days=days)
    return m.groupBy("tenant_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.when(F.col("role") == "user", F.lit(1))).alias("user_messages"),
        F.count(F.when(F.col("role") == "assistant", F.lit(1))).alias("assistant_messages"),
        F.count(F.lit(1)).alias("total_messages"))


def cost_breakdown(messages: DataFrame, as_of, days: int = 7, tenant_id: str | None = None) -> DataFrame:
    """Per model calls, prompt/completion tokens and cost, plus a total row.

    GROUPING SETS ((tenant, model), (tenant)): the total row has
    ``is_total = true`` and model NULL.  Sort with ``desc_nulls_first`` on
    cost for the reference's order.
    """
    days = check_range("days", days, *DASHBOARD_DAYS)
    m = trailing(for_tenant(messages, tenant_id), "created_at", as_of, days=days) \
        .where(F.col("model_used").isNotNull())
    agg = m.rollup("tenant_id", "model_used").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("completion_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.grouping_id().alias("_gid"))
    return (agg.where(F.col("_gid") < 3)
               .select("tenant_id", F.col("model_used").alias("model"), "call_count", "prompt_tokens",
                       "completion_tokens", "cost", (F.col("_gid") == 1).alias("is_total")))


def intent_distribution(messages: DataFrame, as_of, days: int = 7, tenant_id: str | None = None) -> DataFrame:
    """User rows with an intent, counted per intent."""
    days = check_range("days", days, *DASHBOARD_DAYS)
    m = trailing(for_tenant(messages, tenant_id), "created_at", as_of, days=days)
    return (m.where((F.col("role") == "user") & F.col("intent").isNotNull())
             .groupBy("tenant_id", "intent").agg(F.count(F.lit(1)).alias("count")))


def hourly_activity(messages: DataFrame, as_of, days: int = 7, tenant_id: str | None = None,
                    tenants: DataFrame | None = None) -> DataFrame:
    """Messages by hour of day over the trailing window, always 24 rows per tenant.

    The 24-row spine is built for: the requested tenant (``tenant_id``), else
    the given ``tenants`` table, else every tenant present in the log (a
    distinct over the log's tenant column).
    """
    days = check_range("days", days, *DASHBOARD_DAYS)
    scoped = for_tenant(messages, tenant_id)
    m = trailing(scoped, "created_at", as_of, days=days)
    agg = m.groupBy("tenant_id", F.hour("created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("message_count"))
    if tenant_id is not None:
        keys = messages.sparkSession.createDataFrame([(tenant_id,)], "tenant_id string")
    elif tenants is not None:
        keys = tenants.select("tenant_id")
    else:
        keys = scoped.select("tenant_id")
    return fill_hours(agg, keys, zeros={"message_count": 0}) \
        .withColumn("hour", F.col("hour").cast("long"))


# ---------------------------------------------------------------------------
# A10 top_products
# ---------------------------------------------------------------------------

def top_products(product_events: DataFrame, products: DataFrame, as_of, event_type: str | None = "recommended",
                 limit: int = 10, days: int = 7, tenant_id: str | None = None) -> DataFrame:
    """A10: products with the most events per tenant (and event type), top ``limit``.

    Events are pre-aggregated to one row per (tenant, type, product) before
    any join, so joins see the distinct-product count, not the event count.
    Ties break on product id.  ``event_type=None`` ranks every type
    separately.
    """
    limit = check_range("limit", limit, *TOP_LIMIT)
    days = check_range("days", days, *DASHBOARD_DAYS)
    ev = trailing(for_tenant(product_events, tenant_id), "created_at", as_of, days=days)
    if event_type is not None:
        ev = ev.where(F.col("event_type") == event_type)
    counts = ev.groupBy("tenant_id", "event_type", "product_id").agg(F.count(F.lit(1)).alias("event_count"))
    # Inner-join semantics (events of unknown products drop out) via a
    # semi-join on ids only; rank; then fetch details for the winners.  The
    # wide product columns never go through the big join.
    # A product counts for its own tenant, where products name one.
    own = ["tenant_id"] if "tenant_id" in products.columns else []
    key = [*own, "product_id"]
    known = counts.join(products.select(*own, F.col("id").alias("product_id")), key, "left_semi")
    winners = top_k_per_group(known, ["tenant_id", "event_type"],
                              [F.col("event_count").desc(), F.col("product_id").asc()], limit)
    if tenant_id is not None:
        winners = F.broadcast(winners)        # <= event types x limit rows
    p = products.select(*own, F.col("id").alias("product_id"), F.col("title").alias("name"), "vendor",
                        "min_price", "max_price")
    ranked = winners.join(p, key, "inner").withColumnRenamed("product_id", "id")
    return ranked.select(
        "tenant_id", "event_type", F.col("rank").cast("long").alias("rank"), "id", "name", "vendor",
        F.coalesce(F.col("min_price"), F.lit(0.0)).cast("double").alias("price_min"),
        F.coalesce(F.col("max_price"), F.lit(0.0)).cast("double").alias("price_max"),
        "event_count")
