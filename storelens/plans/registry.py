"""Named queries over the driver tables, each with a DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` reads the whole driver tables
(through ``adapters``) and runs one operator or pipeline.  ``ORACLE[name]`` is
the same computation in DuckDB SQL over the same parquet files.  Output
columns are aliased identically on both sides; doubles are rounded to 6
digits (cost-like values to 10) so the engines agree bit for bit.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from storelens import adapters as A
from storelens.operators import dashboard as D
from storelens.operators.common import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = A.AS_OF
ASOF = A.AS_OF_SQL
DAYS = 7           # the trailing windows cut the event log on both sides
LAST_N = 3         # shorter than the longest session
RATE, RATE_SECONDS = 2, 86_400
HISTORY = 2


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _t(spark, sf, name):
    return A.load(spark, sf, name)


def _messages(spark, sf):
    return A.messages(_t(spark, sf, "events"))


def _products(spark, sf, with_embeddings=True):
    emb = _t(spark, sf, "embeddings") if with_embeddings else None
    return A.products(_t(spark, sf, "part"), _t(spark, sf, "lineitem"), emb)


# ---------------------------------------------------------------------------
# A10 top_products (flagship)
# ---------------------------------------------------------------------------

@register("top_products", A.with_views("product_events", "products") + f"""
, counts AS (
  SELECT tenant_id, event_type, product_id, count(*) AS event_count
  FROM product_events
  WHERE created_at > {ASOF} - INTERVAL {DAYS} DAY AND created_at <= {ASOF}
  GROUP BY ALL
), ranked AS (
  SELECT c.tenant_id, c.event_type, p.id, p.title AS name, p.vendor,
         coalesce(p.min_price, 0.0) AS price_min, coalesce(p.max_price, 0.0) AS price_max,
         c.event_count,
         row_number() OVER (PARTITION BY c.tenant_id, c.event_type ORDER BY c.event_count DESC, p.id) AS rank
  FROM counts c JOIN products p ON c.product_id = p.id AND c.tenant_id = p.tenant_id
)
SELECT tenant_id, event_type, CAST(rank AS BIGINT) AS rank, id, name, vendor,
       price_min, price_max, event_count
FROM ranked WHERE rank <= 10
""")
def q_top_products(spark, sf):
    out = D.top_products(A.product_events(_t(spark, sf, "events")), _products(spark, sf, False),
                         AS_OF, event_type=None, limit=10, days=DAYS)
    return out


def _window(col: str, days: int = DAYS, inclusive: bool = False) -> str:
    op = ">=" if inclusive else ">"
    return f"{col} {op} {ASOF} - INTERVAL {days} DAY AND {col} <= {ASOF}"


def _sessions(spark, sf):
    from storelens.operators.sessions import session_rollup
    return session_rollup(_messages(spark, sf))


# ---------------------------------------------------------------------------
# Dashboard A1-A9
# ---------------------------------------------------------------------------

@register("overview", A.with_views("sessions") + f"""
, s AS (
  SELECT tenant_id, count(*) AS total_sessions, count(DISTINCT CAST(started_at AS DATE)) AS days_active,
         coalesce(sum(CASE WHEN CAST(started_at AS DATE) = CAST({ASOF} AS DATE) THEN estimated_cost END), 0.0) AS cost_today
  FROM sessions GROUP BY tenant_id
), m AS (
  SELECT tenant_id,
         count(CASE WHEN CAST(created_at AS DATE) = CAST({ASOF} AS DATE) THEN 1 END) AS messages_today,
         count(DISTINCT CASE WHEN created_at > {ASOF} - INTERVAL 1 HOUR AND created_at <= {ASOF} THEN session_id END) AS active_sessions
  FROM messages GROUP BY tenant_id
)
SELECT coalesce(s.tenant_id, m.tenant_id) AS tenant_id,
       coalesce(total_sessions, 0) AS total_sessions, coalesce(days_active, 0) AS days_active,
       coalesce(messages_today, 0) AS messages_today, round(coalesce(cost_today, 0.0), 10) AS cost_today,
       coalesce(active_sessions, 0) AS active_sessions
FROM s FULL JOIN m ON s.tenant_id = m.tenant_id
""")
def q_overview(spark, sf):
    m = _messages(spark, sf)
    from storelens.operators.sessions import session_rollup
    return round_doubles(D.overview(session_rollup(m), m, AS_OF), cost_today=10)


@register("sessions_over_time", A.with_views("sessions") + f"""
, agg AS (
  SELECT tenant_id, CAST(started_at AS DATE) AS date, count(*) AS session_count,
         count(DISTINCT session_id) AS unique_sessions,
         CAST(coalesce(sum(message_count), 0) AS BIGINT) AS total_messages,
         coalesce(sum(estimated_cost), 0.0) AS daily_cost
  FROM sessions WHERE {_window('started_at')} GROUP BY ALL
), spine AS (
  SELECT t.tenant_id, CAST(g.d AS DATE) AS date
  FROM (SELECT DISTINCT tenant_id FROM agg) t,
       (SELECT unnest(generate_series(CAST({ASOF} AS DATE) - INTERVAL {DAYS - 1} DAY,
                                      CAST(CAST({ASOF} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d) g
)
SELECT s.tenant_id, s.date, coalesce(a.session_count, 0) AS session_count,
       coalesce(a.unique_sessions, 0) AS unique_sessions, coalesce(a.total_messages, 0) AS total_messages,
       round(coalesce(a.daily_cost, 0.0), 10) AS daily_cost
FROM spine s LEFT JOIN agg a ON a.tenant_id = s.tenant_id AND a.date = s.date
""")
def q_sessions_over_time(spark, sf):
    return round_doubles(D.sessions_over_time(_sessions(spark, sf), AS_OF, DAYS), daily_cost=10)


@register("message_volume", A.with_views("messages") + f"""
SELECT tenant_id, CAST(created_at AS DATE) AS date,
       count(CASE WHEN role = 'user' THEN 1 END) AS user_messages,
       count(CASE WHEN role = 'assistant' THEN 1 END) AS assistant_messages,
       count(*) AS total_messages
FROM messages WHERE {_window('created_at')} GROUP BY ALL
""")
def q_message_volume(spark, sf):
    return D.message_volume(_messages(spark, sf), AS_OF, DAYS)


@register("cost_breakdown", A.with_views("messages") + f"""
SELECT tenant_id, model_used AS model, count(*) AS call_count,
       CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
       round(coalesce(sum(cost), 0.0), 10) AS cost,
       grouping(model_used) = 1 AS is_total
FROM messages WHERE model_used IS NOT NULL AND {_window('created_at')}
GROUP BY GROUPING SETS ((tenant_id, model_used), (tenant_id))
""")
def q_cost_breakdown(spark, sf):
    return round_doubles(D.cost_breakdown(_messages(spark, sf), AS_OF, DAYS), cost=10)


@register("intent_distribution", A.with_views("messages") + f"""
SELECT tenant_id, intent, count(*) AS count
FROM messages WHERE role = 'user' AND intent IS NOT NULL AND {_window('created_at')}
GROUP BY ALL
""")
def q_intent_distribution(spark, sf):
    return D.intent_distribution(_messages(spark, sf), AS_OF, DAYS)


@register("hourly_activity", A.with_views("messages", "tenants") + f"""
, agg AS (
  SELECT tenant_id, CAST(hour(created_at) AS BIGINT) AS hour, count(*) AS message_count
  FROM messages WHERE {_window('created_at')} GROUP BY ALL
)
SELECT t.tenant_id, h.hour, coalesce(a.message_count, 0) AS message_count
FROM tenants t
CROSS JOIN (SELECT range AS hour FROM range(24)) h
LEFT JOIN agg a ON a.tenant_id = t.tenant_id AND a.hour = h.hour
""")
def q_hourly_activity(spark, sf):
    return D.hourly_activity(_messages(spark, sf), AS_OF, DAYS, tenants=A.tenants(_t(spark, sf, "nation")))


# ---------------------------------------------------------------------------
# Latency A11-A14
# ---------------------------------------------------------------------------

_LAT = A.with_views("messages") + f"""
, lat AS (SELECT * FROM messages WHERE role = 'assistant' AND latency_ms IS NOT NULL
          AND {_window('created_at', inclusive=True)})
"""


def _lat(spark, sf):
    from storelens.operators.latency import assistant_latencies
    return assistant_latencies(_messages(spark, sf), AS_OF, DAYS)


@register("latency_summary", _LAT + """
SELECT tenant_id, round(coalesce(avg(latency_ms), 0.0), 6) AS avg_latency_ms,
       min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms, count(*) AS message_count
FROM lat GROUP BY tenant_id
""")
def q_latency_summary(spark, sf):
    from storelens.operators.latency import latency_summary
    return round_doubles(latency_summary(_lat(spark, sf)))


@register("latency_percentiles", _LAT + """
SELECT tenant_id,
       round(quantile_cont(latency_ms, 0.50), 6) AS p50, round(quantile_cont(latency_ms, 0.75), 6) AS p75,
       round(quantile_cont(latency_ms, 0.90), 6) AS p90, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99
FROM lat GROUP BY tenant_id
""")
def q_latency_percentiles(spark, sf):
    from storelens.operators.latency import latency_percentiles
    return round_doubles(latency_percentiles(_lat(spark, sf)))


@register("latency_by_hour", _LAT + """
SELECT tenant_id, date_trunc('hour', created_at) AS hour, round(avg(latency_ms), 6) AS avg_latency_ms,
       round(quantile_cont(latency_ms, 0.50), 6) AS p50, round(quantile_cont(latency_ms, 0.90), 6) AS p90,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99, count(*) AS message_count
FROM lat GROUP BY ALL
""")
def q_latency_by_hour(spark, sf):
    from storelens.operators.latency import latency_by_hour
    return round_doubles(latency_by_hour(_lat(spark, sf)))


@register("worst_sessions", _LAT + """
, per AS (
  SELECT tenant_id, session_id, max(latency_ms) AS max_latency_ms, avg(latency_ms) AS avg_latency_ms,
         count(*) AS message_count
  FROM lat GROUP BY ALL
)
SELECT tenant_id, session_id, max_latency_ms, round(avg_latency_ms, 6) AS avg_latency_ms, message_count,
       CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY max_latency_ms DESC, session_id) AS rank FROM per)
WHERE rank <= 10
""")
def q_worst_sessions(spark, sf):
    from storelens.operators.latency import worst_sessions
    return round_doubles(worst_sessions(_lat(spark, sf)))


# ---------------------------------------------------------------------------
# Sessions and messages
# ---------------------------------------------------------------------------

@register("session_rollup", A.with_views("sessions") + """
SELECT tenant_id, session_id, started_at, ended_at, message_count, llm_call_count, total_tokens_used,
       round(estimated_cost, 10) AS estimated_cost, input_tokens, output_tokens,
       round(avg_latency_ms, 6) AS avg_latency_ms, max_latency_ms, min_latency_ms, latency_count
FROM sessions
""")
def q_session_rollup(spark, sf):
    return round_doubles(_sessions(spark, sf), estimated_cost=10)


@register("active_session_count", A.with_views("sessions") + f"""
, open_ AS (SELECT tenant_id, session_id, CASE WHEN message_count <> 2 THEN ended_at END AS ended_at FROM sessions)
SELECT tenant_id,
       count(DISTINCT CASE WHEN ended_at IS NULL OR (ended_at > {ASOF} - INTERVAL 60 MINUTE AND ended_at <= {ASOF})
                      THEN session_id END) AS active_sessions
FROM open_ GROUP BY tenant_id
""")
def q_active_session_count(spark, sf):
    """Sessions of two messages count as not ended."""
    from storelens.operators.sessions import active_session_count
    open_ = _sessions(spark, sf).withColumn("ended_at", F.when(F.col("message_count") != 2, F.col("ended_at")))
    return active_session_count(open_, AS_OF, 60)


@register("recent_sessions", A.with_views("sessions") + """
SELECT tenant_id, session_id, started_at, ended_at,
       round((epoch_us(ended_at) - epoch_us(started_at)) / 60000000.0, 6) AS duration_minutes,
       message_count, llm_call_count, total_tokens_used, input_tokens, output_tokens,
       round(estimated_cost, 10) AS estimated_cost, CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY started_at DESC, session_id) AS rank FROM sessions)
WHERE rank <= 10
""")
def q_recent_sessions(spark, sf):
    from storelens.plans.reports import recent_sessions
    return round_doubles(recent_sessions(_sessions(spark, sf), limit=10), estimated_cost=10)


@register("price_usage", A.with_views("messages") + """
SELECT message_id, tenant_id, model_used, prompt_tokens, completion_tokens, round(cost, 10) AS cost
FROM messages WHERE role = 'assistant'
""")
def q_price_usage(spark, sf):
    m = _messages(spark, sf).where(F.col("role") == "assistant")
    return round_doubles(m.select("message_id", "tenant_id", "model_used", "prompt_tokens",
                                  "completion_tokens", "cost"), cost=10)


@register("derive_latency", A.with_views("messages") + """
, w AS (
  SELECT *, last_value(CASE WHEN role = 'user' THEN created_at END IGNORE NULLS) OVER (
      PARTITION BY tenant_id, session_id ORDER BY created_at, message_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user
  FROM messages
)
SELECT tenant_id, session_id, message_id,
       coalesce(latency_ms, CASE WHEN last_user IS NOT NULL
                THEN CAST(trunc((epoch_us(created_at) - epoch_us(last_user)) / 1000) AS BIGINT) END) AS latency_ms
FROM w WHERE role = 'assistant'
""")
def q_derive_latency(spark, sf):
    from storelens.operators.sessions import derive_latency
    out = derive_latency(_messages(spark, sf)).where(F.col("role") == "assistant")
    return out.select("tenant_id", "session_id", "message_id", "latency_ms")


@register("backfill_session_tokens", A.with_views("sessions") + """
SELECT s.tenant_id, s.session_id,
       CAST(coalesce((SELECT sum(prompt_tokens) FROM messages m WHERE m.tenant_id = s.tenant_id
                AND m.session_id = s.session_id AND m.role = 'assistant'), 0) AS BIGINT) AS input_tokens,
       CAST(coalesce((SELECT sum(completion_tokens) FROM messages m WHERE m.tenant_id = s.tenant_id
                AND m.session_id = s.session_id AND m.role = 'assistant'), 0) AS BIGINT) AS output_tokens
FROM sessions s
""")
def q_backfill_session_tokens(spark, sf):
    from storelens.operators.sessions import backfill_session_tokens
    m = _messages(spark, sf)
    from storelens.operators.sessions import session_rollup
    out = backfill_session_tokens(session_rollup(m), m)
    return out.select("tenant_id", "session_id", "input_tokens", "output_tokens")


@register("usage_running", A.with_views("messages") + """
, calls AS (
  SELECT *, coalesce(total_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS tok
  FROM messages WHERE model_used IS NOT NULL OR prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL
)
SELECT tenant_id, session_id, message_id, created_at, CAST(tok AS BIGINT) AS call_tokens,
       round(coalesce(cost, 0.0), 10) AS call_cost,
       CAST(sum(tok) OVER w AS BIGINT) AS cum_tokens,
       round(sum(coalesce(cost, 0.0)) OVER w, 10) AS cum_cost,
       count(*) OVER w AS cum_calls
FROM calls
WINDOW w AS (PARTITION BY tenant_id, session_id ORDER BY created_at, message_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def q_usage_running(spark, sf):
    from storelens.operators.sessions import usage_running
    return round_doubles(usage_running(_messages(spark, sf)), call_cost=10, cum_cost=10)


@register("last_n_messages", A.with_views("messages") + """
, r AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY created_at DESC, message_id DESC) AS rn,
         least(count(*) OVER (PARTITION BY tenant_id, session_id), 3) AS m
  FROM messages
)
SELECT tenant_id, session_id, message_id, role, created_at, CAST(m - rn + 1 AS BIGINT) AS position
FROM r WHERE rn <= 3
""")
def q_last_n_messages(spark, sf):
    from storelens.operators.sessions import last_n_messages
    return last_n_messages(_messages(spark, sf), LAST_N).select(
        "tenant_id", "session_id", "message_id", "role", "created_at", "position")


@register("rate_window", f"""
SELECT event_id, user_id,
       count(*) OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP)
                      RANGE BETWEEN INTERVAL {RATE_SECONDS * 1_000_000 - 1} MICROSECOND PRECEDING AND CURRENT ROW) AS requests_in_window,
       count(*) OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP)
                      RANGE BETWEEN INTERVAL {RATE_SECONDS * 1_000_000 - 1} MICROSECOND PRECEDING AND CURRENT ROW) > {RATE} AS over_limit
FROM events
""")
def q_rate_window(spark, sf):
    from storelens.operators.sessions import rate_window
    ev = _t(spark, sf, "events").select("event_id", "user_id", "ts")
    return rate_window(ev, "user_id", "ts", window_seconds=RATE_SECONDS, limit=RATE).select("event_id", "user_id", "requests_in_window", "over_limit")


@register("sessionise", """
WITH g AS (
  SELECT user_id, CAST(ts AS TIMESTAMP) AS ts,
         CASE WHEN lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                OR CAST(ts AS TIMESTAMP) - lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts)
                   >= INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS new_session
  FROM events
), s AS (SELECT *, sum(new_session) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 3600 SECOND AS session_end,
       count(*) AS event_count, min(ts) AS first_ts, max(ts) AS last_ts
FROM s GROUP BY user_id, sid
""")
def q_sessionise(spark, sf):
    from storelens.operators.sessions import sessionise
    return sessionise(_t(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", 3600)


@register("expire_messages", A.with_views("messages") + f"""
SELECT tenant_id, session_id, message_id, created_at FROM messages
WHERE coalesce(created_at >= {ASOF} - INTERVAL 15 DAY, true)
""")
def q_expire_messages(spark, sf):
    from storelens.operators.sessions import expire_messages
    kept, _ = expire_messages(_messages(spark, sf), AS_OF, 15)
    return kept.select("tenant_id", "session_id", "message_id", "created_at")


@register("expired_counts", A.with_views("messages") + f"""
SELECT tenant_id, count(CASE WHEN NOT coalesce(created_at >= {ASOF} - INTERVAL 15 DAY, true) THEN 1 END) AS deleted
FROM messages GROUP BY tenant_id
""")
def q_expired_counts(spark, sf):
    from storelens.operators.sessions import expire_messages
    _, deleted = expire_messages(_messages(spark, sf), AS_OF, 15)
    return deleted


_SPLIT = "TIMESTAMP '2024-01-16 12:00:00'"


@register("upsert_sessions", A.with_views("messages") + f"""
, sessions AS (
  SELECT tenant_id, session_id, min(created_at) AS started_at, max(created_at) AS ended_at,
    count(*) AS message_count,
    count(CASE WHEN model_used IS NOT NULL OR prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL THEN 1 END) AS llm_call_count,
    CAST(coalesce(sum(CASE WHEN model_used IS NOT NULL OR prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL
         THEN coalesce(total_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) END), 0) AS BIGINT) AS total_tokens_used,
    coalesce(sum(cost), 0.0) AS estimated_cost,
    CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS input_tokens,
    CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS output_tokens,
    avg(CASE WHEN role = 'assistant' THEN latency_ms END) AS avg_latency_ms,
    max(CASE WHEN role = 'assistant' THEN latency_ms END) AS max_latency_ms,
    min(CASE WHEN role = 'assistant' THEN latency_ms END) AS min_latency_ms,
    count(CASE WHEN role = 'assistant' THEN latency_ms END) AS latency_count
  FROM messages GROUP BY tenant_id, session_id
)
SELECT tenant_id, session_id, started_at, ended_at, message_count, llm_call_count, total_tokens_used,
       round(estimated_cost, 10) AS estimated_cost, input_tokens, output_tokens,
       round(avg_latency_ms, 6) AS avg_latency_ms, max_latency_ms, min_latency_ms, latency_count
FROM sessions
""")
def q_upsert_sessions(spark, sf):
    """Sessions stored from messages before a cut, then the rest upserted.

    The result must equal the rollup of the whole log (checked by the twin).
    """
    from storelens.operators.sessions import session_rollup, upsert_sessions
    m = _messages(spark, sf)
    cut = F.lit("2024-01-16 12:00:00").cast("timestamp")
    existing = session_rollup(m.where(F.col("created_at") < cut))
    out = upsert_sessions(existing, m.where(~(F.col("created_at") < cut)))
    return round_doubles(out, estimated_cost=10)


@register("running_latency_compat", A.with_views("messages") + """
, n AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY created_at, message_id) - 1 AS nb
  FROM messages
), steps AS (
  SELECT tenant_id, session_id, list(struct_pack(x := latency_ms, n := nb) ORDER BY created_at, message_id) AS st
  FROM n WHERE role = 'assistant' AND latency_ms IS NOT NULL GROUP BY ALL
)
SELECT tenant_id, session_id,
       list_reduce(list_prepend(NULL::STRUCT(x BIGINT, n BIGINT), st),
         lambda acc, e: CASE WHEN acc IS NULL THEN e
                          WHEN e.n = 0 THEN acc
                          ELSE struct_pack(x := CAST(trunc((acc.x * (e.n - 1) + e.x) / e.n) AS BIGINT), n := e.n) END).x
         AS avg_latency_ms_compat,
       list_max([s.x FOR s IN st]) AS max_latency_ms, list_min([s.x FOR s IN st]) AS min_latency_ms
FROM steps
""")
def q_running_latency_compat(spark, sf):
    from storelens.operators.sessions import running_latency_compat
    return running_latency_compat(_messages(spark, sf))


# ---------------------------------------------------------------------------
# Search F3-F9, J2-J4, O3, P1, P2, P7, A22
# ---------------------------------------------------------------------------

_PROD_COLS = "id, tenant_id, title, vendor, product_type, tags, min_price, max_price, has_discount"


def _prod_out(df):
    return df.select("id", "tenant_id", "title", "vendor", "product_type", "tags",
                     "min_price", "max_price", "has_discount")


def _filter_query(name, where_sql, **kw):
    from storelens.operators.search import filter_products

    @register(name, A.with_views("products") + f"SELECT {_PROD_COLS} FROM products WHERE {where_sql}")
    def q(spark, sf):
        return _prod_out(filter_products(_products(spark, sf, False), **kw))
    return q


_filter_query("filter_products",
              "product_type = 'ECONOMY' AND coalesce(max_price >= 1000.0, false) "
              "AND coalesce(min_price <= 5000.0, false) AND coalesce(has_discount = true, false)",
              product_type="ECONOMY", min_price=1000.0, max_price=5000.0, has_discount=True)
_filter_query("filter_price_range", "coalesce(max_price >= 0.0, false) AND coalesce(min_price <= 500.0, false)",
              min_price=0.0, max_price=500.0)
_filter_query("filter_type", "product_type = 'PROMO'", product_type="PROMO")
_filter_query("filter_discount", "coalesce(has_discount = false, false)", has_discount=False)


@register("filter_vendor", A.with_views("products") + f"SELECT {_PROD_COLS} FROM products WHERE vendor = 'Brand#4'")
def q_filter_vendor(spark, sf):
    from storelens.operators.search import vendor_equals
    return _prod_out(vendor_equals(_products(spark, sf, False), "Brand#4"))


@register("filter_tag", A.with_views("products") + f"SELECT {_PROD_COLS} FROM products WHERE contains(tags, 'LARGE')")
def q_filter_tag(spark, sf):
    from storelens.operators.search import tag_contains
    return _prod_out(tag_contains(_products(spark, sf, False), "LARGE"))


@register("filter_option", A.with_views("products") + f"SELECT {_PROD_COLS} FROM products WHERE color = 'red'")
def q_filter_option(spark, sf):
    from storelens.operators.search import option_has
    return _prod_out(option_has(_products(spark, sf, False), "Color", "red"))


@register("primary_image", A.with_views("products", "images") + """
SELECT p.id, p.tenant_id, i.src AS image_url
FROM products p LEFT JOIN images i ON p.id = i.product_id AND i.position = 1
""")
def q_primary_image(spark, sf):
    from storelens.operators.search import with_primary_image
    li = _t(spark, sf, "lineitem")
    return with_primary_image(_products(spark, sf, False), A.images(li)).select("id", "tenant_id", "image_url")


@register("first_image", A.with_views("products", "images") + """
SELECT p.id, p.tenant_id, fi.src AS image_url
FROM products p LEFT JOIN LATERAL (
  SELECT src FROM images i WHERE i.product_id = p.id AND i.tenant_id = p.tenant_id
  ORDER BY coalesce(i.position, 2147483647), i.id, i.src LIMIT 1) fi ON true
""")
def q_first_image(spark, sf):
    from storelens.operators.search import with_first_image
    li = _t(spark, sf, "lineitem")
    return with_first_image(_products(spark, sf, False), A.images(li)).select("id", "tenant_id", "image_url")


@register("lookup_ordered", A.with_views("messages", "products") + """
, ids AS (
  SELECT message_id, unnest(range(len(l))) AS pos, unnest(l) AS id
  FROM (SELECT message_id, CAST(json_extract(structured_data, '$.product_ids') AS BIGINT[]) AS l
        FROM messages WHERE structured_data IS NOT NULL)
), firsts AS (SELECT message_id, id, min(pos) AS pos FROM ids GROUP BY ALL)
SELECT f.message_id, CAST(f.pos AS BIGINT) AS pos, p.id, p.title, p.tenant_id
FROM firsts f JOIN products p ON p.id = f.id
""")
def q_lookup_ordered(spark, sf):
    from storelens.operators.search import ids_from_array, lookup_ordered
    m = _messages(spark, sf).where(F.col("structured_data").isNotNull())
    arr = m.select("message_id", F.from_json("structured_data", "struct<product_ids:array<bigint>>")
                   ["product_ids"].alias("ids"))
    ids = ids_from_array(arr, "ids", ["message_id"])
    out = lookup_ordered(_products(spark, sf, False), ids, key=["message_id"])
    return out.select("message_id", F.col("pos").cast("long").alias("pos"), "id", "title", "tenant_id")


@register("distinct_types", A.with_views("products") + """
SELECT DISTINCT tenant_id, product_type FROM products WHERE product_type IS NOT NULL
""")
def q_distinct_types(spark, sf):
    from storelens.operators.catalog import distinct_types
    return distinct_types(_products(spark, sf, False))


@register("catalogue_listing", A.with_views("products", "images") + """
, fi AS (
  SELECT product_id, tenant_id, min({'p': coalesce(position, 2147483647), 'i': id, 's': src}).s AS image_url
  FROM images GROUP BY ALL
), r AS (
  SELECT p.*, fi.image_url,
         row_number() OVER (PARTITION BY p.tenant_id ORDER BY p.updated_at DESC NULLS FIRST, p.id) AS pos
  FROM products p LEFT JOIN fi ON fi.product_id = p.id AND fi.tenant_id = p.tenant_id
)
SELECT tenant_id, CAST(pos AS BIGINT) AS position, id, title AS name, vendor, product_type,
       coalesce(CASE WHEN min_price <> 0 THEN min_price END, 0.0) AS price_min,
       coalesce(CASE WHEN max_price <> 0 THEN max_price END, 0.0) AS price_max,
       has_discount, image_url, handle
FROM r WHERE pos <= 100
""")
def q_catalogue_listing(spark, sf):
    from storelens.plans.search import catalogue_listing
    li = _t(spark, sf, "lineitem")
    return catalogue_listing(_products(spark, sf, False), A.images(li), limit=100)


# Search queries are derived from the data: one per embedding label, whose
# vector is the label's centroid and whose filters depend on the label.

def _label_queries(spark, sf, with_vec=True, with_filters=True, mixed=False, k_rule="5"):
    e = _t(spark, sf, "embeddings")
    cent = (e.select("label", F.posexplode("embedding").alias("pos", "x"))
            .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
            .select("label", F.transform("c", lambda s: s["x"]).alias("vec")))
    L = F.col("label")
    none_s, none_d, none_b = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("boolean")
    vec = F.col("vec") if with_vec else F.lit(None).cast("array<double>")
    if mixed:
        vec = F.when(L % 3 != 1, F.col("vec"))
    return cent.select(
        L.cast("long").alias("query_id"),
        F.concat(F.lit("tenant-"), (L % 3).cast("string")).alias("tenant_id"),
        (F.when(L % 5 == 0, "ECONOMY").when(L % 5 == 1, "PROMO").when(L % 5 == 2, "NO-SUCH-TYPE")
         if with_filters else none_s).alias("product_type"),
        (F.when(L % 2 == 0, F.lit(1000.0)) if with_filters else none_d).alias("min_price"),
        (F.when(L % 3 == 0, F.lit(5000.0)) if with_filters else none_d).alias("max_price"),
        (F.when(L % 4 == 0, F.lit(True)).when(L % 4 == 1, F.lit(False)) if with_filters else none_b)
        .alias("has_discount"),
        vec.cast("array<double>").alias("query_vec"),
        F.expr(k_rule).cast("int").alias("k"))


def _label_queries_sql(with_vec=True, with_filters=True, mixed=False, k_rule="5"):
    vec = "vec" if with_vec else "NULL::DOUBLE[]"
    if mixed:
        vec = "CASE WHEN label % 3 <> 1 THEN vec END"
    f = with_filters
    return f"""
, cent AS (
  SELECT label, list(x ORDER BY pos) AS vec FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (
      SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)
    GROUP BY ALL) GROUP BY label
), queries AS (
  SELECT CAST(label AS BIGINT) AS query_id, 'tenant-' || CAST(label % 3 AS VARCHAR) AS tenant_id,
    {"CASE label % 5 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' WHEN 2 THEN 'NO-SUCH-TYPE' END" if f else "NULL::VARCHAR"} AS product_type,
    {"CASE WHEN label % 2 = 0 THEN 1000.0::DOUBLE END" if f else "NULL::DOUBLE"} AS min_price,
    {"CASE WHEN label % 3 = 0 THEN 5000.0::DOUBLE END" if f else "NULL::DOUBLE"} AS max_price,
    {"CASE label % 4 WHEN 0 THEN true WHEN 1 THEN false END" if f else "NULL::BOOLEAN"} AS has_discount,
    {vec} AS query_vec, CAST({k_rule} AS INTEGER) AS k
  FROM cent
)"""


def _search_sql(cap: int | None) -> str:
    cap_where = f"WHERE cand_rank <= {cap}" if cap is not None else ""
    cols = "id, tenant_id, title, product_type, body_html, min_price, max_price, tags, has_discount, updated_at, embedding"
    return f"""
, filtered AS (
  SELECT q.query_id, q.k, q.query_vec, {', '.join('p.' + c.strip() for c in cols.split(','))}
  FROM products p JOIN queries q ON p.tenant_id = q.tenant_id
   AND (q.product_type IS NULL OR q.product_type = '' OR p.product_type = q.product_type)
   AND (q.min_price IS NULL OR coalesce(p.max_price >= q.min_price, false))
   AND (q.max_price IS NULL OR coalesce(p.min_price <= q.max_price, false))
   AND (q.has_discount IS NULL OR coalesce(p.has_discount = q.has_discount, false))
), cands AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC NULLS FIRST, id) AS cand_rank
                 FROM filtered) {cap_where}
), fb AS (
  SELECT q.query_id, q.k, q.query_vec, {', '.join('p.' + c.strip() for c in cols.split(','))}, NULL::BIGINT AS cand_rank
  FROM products p JOIN queries q ON p.tenant_id = q.tenant_id
  WHERE q.query_vec IS NOT NULL AND q.query_id NOT IN (SELECT query_id FROM cands)
), allc AS (SELECT * FROM cands UNION ALL SELECT * FROM fb),
sem AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
      SELECT *, list_cosine_similarity(embedding, query_vec) AS similarity FROM allc
      WHERE query_vec IS NOT NULL AND embedding IS NOT NULL))
  WHERE rank <= k
), res AS (
  SELECT query_id, rank, id, title, product_type, body_html, min_price, max_price, tags, similarity FROM sem
  UNION ALL
  SELECT query_id, cand_rank AS rank, id, title, product_type, body_html, min_price, max_price, tags,
         NULL::DOUBLE AS similarity FROM allc WHERE query_vec IS NULL AND cand_rank <= k
)
SELECT query_id, CAST(rank AS BIGINT) AS rank, id, title, product_type, body_html,
       CASE WHEN min_price <> 0 THEN min_price END AS min_price,
       CASE WHEN max_price <> 0 THEN max_price END AS max_price,
       tags, round(similarity, 6) AS similarity
FROM res
"""


def _search_out(df):
    return round_doubles(df.drop("options"), keep=("min_price", "max_price"))


@register("semantic_topk", A.with_views("products") + _label_queries_sql(True, False) + _search_sql(None))
def q_semantic_topk(spark, sf):
    from storelens.plans.search import search_batch
    return _search_out(search_batch(_products(spark, sf), _label_queries(spark, sf, True, False)))


@register("search_filters_only", A.with_views("products") + _label_queries_sql(False, True) + _search_sql(None))
def q_search_filters_only(spark, sf):
    from storelens.plans.search import search_batch
    return _search_out(search_batch(_products(spark, sf), _label_queries(spark, sf, False, True)))


@register("search_combined", A.with_views("products") + _label_queries_sql(True, True) + _search_sql(None))
def q_search_combined(spark, sf):
    from storelens.plans.search import search_batch
    return _search_out(search_batch(_products(spark, sf), _label_queries(spark, sf, True, True)))


@register("search_batch", A.with_views("products")
          + _label_queries_sql(True, True, mixed=True, k_rule="1 + (label * 7) % 25") + _search_sql(None))
def q_search_batch(spark, sf):
    from storelens.plans.search import search_batch
    q = _label_queries(spark, sf, True, True, mixed=True, k_rule="1 + (label * 7) % 25")
    return _search_out(search_batch(_products(spark, sf), q))


# ---------------------------------------------------------------------------
# Text and catalogue X1, X3, X8, X14, X15, X20, A16, A20, A21, S9
# ---------------------------------------------------------------------------

_WS_SQL = (r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}"
           r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def _clean_sql(expr: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({expr}, ''), '<[^>]+>', ' ', 'g'), "
            f"'{_WS_SQL}', ' ', 'g'))")


@register("clean_html", f"SELECT page_id, {_clean_sql('html')} AS text FROM pages")
def q_clean_html(spark, sf):
    from storelens.functions.text import clean_html
    return _t(spark, sf, "pages").select("page_id", clean_html("html").alias("text"))


@register("extract_links", """
SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS link FROM pages
""")
def q_extract_links(spark, sf):
    from storelens.functions.text import extract_links
    return _t(spark, sf, "pages").select("page_id", F.explode(extract_links("html")).alias("link"))


_MONEY = "printf('%.2f', {})"


@register("format_price", A.with_views("products") + f"""
SELECT id, CASE WHEN min_price IS NULL THEN NULL
                WHEN max_price IS NULL OR max_price = min_price THEN '$' || {_MONEY.format('min_price')}
                ELSE '$' || {_MONEY.format('min_price')} || ' - $' || {_MONEY.format('max_price')} END AS price_label
FROM products
""")
def q_format_price(spark, sf):
    from storelens.functions.text import format_price
    return _products(spark, sf, False).select("id", format_price("min_price", "max_price").alias("price_label"))


@register("fact_sheet", A.with_views("products") + f"""
SELECT id, 'Name: ' || coalesce(title, 'Not specified') || chr(10)
        || 'Brand: ' || coalesce(vendor, 'Not specified') || chr(10)
        || 'Price Range: ' || coalesce(CASE WHEN min_price IS NULL THEN NULL
                WHEN max_price IS NULL OR max_price = min_price THEN '$' || {_MONEY.format('min_price')}
                ELSE '$' || {_MONEY.format('min_price')} || ' - $' || {_MONEY.format('max_price')} END, 'Not available') || chr(10)
        || 'On Sale: ' || CASE WHEN coalesce(has_discount, false) THEN 'Yes' ELSE 'No' END || chr(10)
        || 'Tags: ' || CASE WHEN length(trim(coalesce(tags, ''))) = 0 THEN 'Not specified'
                            ELSE array_to_string(regexp_split_to_array(coalesce(tags, ''), ',\\s*'), ', ') END AS sheet
FROM products
""")
def q_fact_sheet(spark, sf):
    from storelens.functions.text import fact_sheet
    p = _products(spark, sf, False)
    return p.select("id", fact_sheet("title", "vendor", "min_price", "max_price", "has_discount", "tags").alias("sheet"))


@register("embedding_json", A.with_views("products") + f"""
SELECT id, CAST(to_json(struct_pack(title := title, product_type := product_type, tags := tags, vendor := vendor,
                                    options := MAP {{'Color': [color], 'Size': [size]}},
                                    description := {_clean_sql('body_html')})) AS VARCHAR) AS embedding_json
FROM products
""")
def q_embedding_json(spark, sf):
    return _products(spark, sf, False).select("id", "embedding_json")


@register("variant_rollup", A.with_views("products") + """
SELECT product_id, min_price, max_price, has_discount FROM vroll
""")
def q_variant_rollup(spark, sf):
    from storelens.operators.catalog import variant_rollup_flat
    v = A.variants(_t(spark, sf, "lineitem"))
    return variant_rollup_flat(v)


@register("variant_listing", A.with_views("products") + """
SELECT v.id AS variant_id, p.id AS product_id, p.title, p.vendor, p.product_type, v.title AS variant_title,
       v.price, v.compare_at_price, v.sku, v.option1, v.option2
FROM products p JOIN variants v ON v.product_id = p.id
""")
def q_variant_listing(spark, sf):
    v = A.variants(_t(spark, sf, "lineitem"))
    p = _products(spark, sf, False).select(F.col("id").alias("product_id"), "title", "vendor", "product_type")
    out = p.join(v.select(F.col("id").alias("variant_id"), "product_id", F.col("title").alias("variant_title"),
                          "price", "compare_at_price", "sku", "option1", "option2"), "product_id")
    return out


@register("variants_per_product", A.with_views("products") + """
SELECT count(*) AS variant_rows, count(DISTINCT v.product_id) AS products,
       round(count(*) / count(DISTINCT v.product_id), 1) AS avg_variants_per_product
FROM products p JOIN variants v ON v.product_id = p.id
""")
def q_variants_per_product(spark, sf):
    from storelens.operators.catalog import variants_per_product
    v = A.variants(_t(spark, sf, "lineitem")).select("product_id")
    p = _products(spark, sf, False).select(F.col("id").alias("product_id"))
    return variants_per_product(p.join(v, "product_id"))


@register("ingest_summary", A.with_views("products", "images") + """
SELECT 'products' AS table_name, count(*) AS rows FROM products
UNION ALL SELECT 'variants', count(*) FROM variants
UNION ALL SELECT 'images', count(*) FROM images
""")
def q_ingest_summary(spark, sf):
    li = _t(spark, sf, "lineitem")
    parts = [("products", _products(spark, sf, False)), ("variants", A.variants(li)), ("images", A.images(li))]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@register("expand_recommendations", A.with_views("messages") + """
SELECT tenant_id, unnest(CAST(json_extract(structured_data, '$.product_ids') AS BIGINT[])) AS product_id,
       'recommended' AS event_type, session_id, created_at
FROM messages WHERE structured_data IS NOT NULL
""")
def q_expand_recommendations(spark, sf):
    from storelens.sources.tables import expand_recommendations
    m = _messages(spark, sf).where(F.col("structured_data").isNotNull()) \
        .withColumn("product_ids", F.from_json("structured_data", "struct<product_ids:array<bigint>>")["product_ids"])
    return expand_recommendations(m)


# ---------------------------------------------------------------------------
# Conversations P6, routing F19, session messages F18
# ---------------------------------------------------------------------------

@register("transcripts", """
WITH t AS (SELECT conv_id AS session_id, turn, role, text AS content FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn,
             least(count(*) OVER (PARTITION BY session_id), 5) AS m FROM t),
kept AS (SELECT *, m - rn + 1 AS position FROM r WHERE rn <= 5 AND role IN ('user', 'assistant'))
SELECT session_id,
       string_agg(CASE role WHEN 'user' THEN 'USER: ' ELSE 'CHATBOT: ' END || coalesce(content, '') || chr(10), ''
                  ORDER BY position) AS transcript,
       count(*) AS lines, arg_max(role, position) = 'user' AS ends_with_user
FROM kept GROUP BY session_id
""")
def q_transcripts(spark, sf):
    from storelens.plans.reports import transcripts
    t = A.turns(_t(spark, sf, "conversations"))
    return transcripts(t, 5, key=["session_id"], order=["turn"], text_col="content")


@register("message_transcripts", A.with_views("messages") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY created_at DESC, message_id DESC) AS rn,
               least(count(*) OVER (PARTITION BY tenant_id, session_id), 5) AS m FROM messages),
kept AS (SELECT *, m - rn + 1 AS position FROM r WHERE rn <= 5 AND role IN ('user', 'assistant'))
SELECT tenant_id, session_id,
       string_agg(CASE role WHEN 'user' THEN 'USER: ' ELSE 'CHATBOT: ' END
                  || coalesce(CASE WHEN role = 'assistant' AND structured_data IS NOT NULL THEN structured_data ELSE content END, '')
                  || chr(10), '' ORDER BY position) AS transcript,
       count(*) AS lines, arg_max(role, position) = 'user' AS ends_with_user
FROM kept GROUP BY tenant_id, session_id
""")
def q_message_transcripts(spark, sf):
    from storelens.plans.reports import transcripts
    return transcripts(_messages(spark, sf), 5)


@register("route", A.with_views("messages") + """
SELECT message_id, intent,
       CASE intent WHEN 'product_recommendation' THEN 'product_recommendation_graph'
                   WHEN 'product_inquiry' THEN 'product_inquiry_graph'
                   WHEN 'store_brand_question' THEN 'store_brand_graph'
                   WHEN 'unrelated' THEN 'unrelated_graph' ELSE 'error' END AS route
FROM messages WHERE role = 'user'
""")
def q_route(spark, sf):
    from storelens.operators.sessions import messages_by_role, route
    return route(messages_by_role(_messages(spark, sf), role="user")).select("message_id", "intent", "route")


@register("session_messages", A.with_views("messages") + """
SELECT tenant_id, session_id, message_id, role, content, structured_data, model_used,
       round(coalesce(cost, 0.0), 10) AS cost, created_at, latency_ms
FROM messages WHERE role <> 'system'
""")
def q_session_messages(spark, sf):
    from storelens.operators.sessions import messages_by_role, session_messages
    return round_doubles(session_messages(messages_by_role(_messages(spark, sf))), cost=10)


# ---------------------------------------------------------------------------
# Tenancy, quality and maintenance J10-J12, F17, M2, M3, M6, M10
# ---------------------------------------------------------------------------

@register("tenant_info", A.with_views("tenants") + """
SELECT tenant_id, name, coalesce(description, 'E-commerce store') AS description FROM tenants
""")
def q_tenant_info(spark, sf):
    from storelens.operators.tenancy import tenant_info
    return tenant_info(A.tenants(_t(spark, sf, "nation")), for_agent=True).select("tenant_id", "name", "description")


@register("missing_tenants", A.with_views("messages", "products", "tenants") + """
SELECT DISTINCT tenant_id FROM (SELECT tenant_id FROM messages UNION ALL SELECT tenant_id FROM products)
WHERE tenant_id NOT IN (SELECT tenant_id FROM tenants WHERE description IS NOT NULL)
""")
def q_missing_tenants(spark, sf):
    """Tenants in use among those that have a description: the others miss."""
    from storelens.operators.tenancy import missing_tenants
    used = _messages(spark, sf).select("tenant_id").unionByName(_products(spark, sf, False).select("tenant_id"))
    return missing_tenants(used, _described(spark, sf))


def _described(spark, sf):
    return A.tenants(_t(spark, sf, "nation")).where("description IS NOT NULL")


@register("require_tenant", A.with_views("messages", "tenants") + """
SELECT message_id, tenant_id FROM messages
WHERE tenant_id IN (SELECT tenant_id FROM tenants WHERE description IS NOT NULL)
""")
def q_require_tenant(spark, sf):
    """J10 as a guard."""
    from storelens.operators.tenancy import require_tenant
    return require_tenant(_messages(spark, sf), _described(spark, sf)).select("message_id", "tenant_id")


@register("orphans", A.with_views("products", "images", "product_events") + """
SELECT 'variants->products' AS relation, count(*) AS orphans FROM variants WHERE product_id NOT IN (SELECT id FROM products)
UNION ALL SELECT 'images->products', count(*) FROM images WHERE product_id NOT IN (SELECT id FROM products)
UNION ALL SELECT 'product_events->products', count(*) FROM product_events WHERE product_id NOT IN (SELECT id FROM products)
UNION ALL SELECT 'embeddings->products', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM products)
UNION ALL SELECT 'variants->images', count(*) FROM variants WHERE image_id NOT IN (SELECT id FROM images)
UNION ALL SELECT 'products->embeddings', count(*) FROM products WHERE id NOT IN (SELECT vec_id FROM embeddings)
""")
def q_orphans(spark, sf):
    from storelens.operators.tenancy import orphan_report
    li = _t(spark, sf, "lineitem")
    p = _products(spark, sf, False).select("id")
    return orphan_report([
        ("variants->products", A.variants(li), p, "product_id", "id"),
        ("images->products", A.images(li), p, "product_id", "id"),
        ("product_events->products", A.product_events(_t(spark, sf, "events")), p, "product_id", "id"),
        ("embeddings->products", _t(spark, sf, "embeddings"), p, "vec_id", "id"),
        ("variants->images", A.variants(li), A.images(li), "image_id", "id"),
        ("products->embeddings", p, _t(spark, sf, "embeddings"), "id", "vec_id"),
    ])


@register("uniqueness_report", A.with_views("sessions", "products") + """
, k AS (
  SELECT 'sessions' AS relation, count(*) AS n FROM sessions GROUP BY tenant_id, session_id
  UNION ALL SELECT 'products', count(*) FROM products GROUP BY tenant_id, source_id
  UNION ALL SELECT 'variants', count(*) FROM variants GROUP BY id
  UNION ALL SELECT 'messages', count(*) FROM messages GROUP BY message_id
)
SELECT relation, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys,
       count(CASE WHEN n > 1 THEN 1 END) AS duplicate_keys
FROM k GROUP BY relation
""")
def q_uniqueness_report(spark, sf):
    from storelens.operators.sessions import session_rollup
    from storelens.operators.tenancy import uniqueness_report
    m = _messages(spark, sf)
    return uniqueness_report([
        ("sessions", session_rollup(m), ["tenant_id", "session_id"]),
        ("products", _products(spark, sf, False), ["tenant_id", "source_id"]),
        ("variants", A.variants(_t(spark, sf, "lineitem")), ["id"]),
        ("messages", m, ["message_id"]),
    ])


@register("embedding_coverage", A.with_views("products", "tenants") + """
, per AS (SELECT tenant_id, count(*) AS products, count(embedding) AS with_embedding FROM products GROUP BY tenant_id)
SELECT t.tenant_id, coalesce(per.products, 0) AS products, coalesce(per.with_embedding, 0) AS with_embedding,
       round(CASE WHEN coalesce(per.products, 0) = 0 THEN NULL ELSE per.with_embedding / per.products END, 6) AS coverage
FROM tenants t LEFT JOIN per ON per.tenant_id = t.tenant_id
""")
def q_embedding_coverage(spark, sf):
    from storelens.operators.embed import embedding_coverage
    return round_doubles(embedding_coverage(_products(spark, sf), A.tenants(_t(spark, sf, "nation"))))


@register("pending_embeddings", A.with_views("products") + """
SELECT id, tenant_id FROM products WHERE embedding IS NULL
""")
def q_pending_embeddings(spark, sf):
    from storelens.operators.embed import pending_embeddings
    return pending_embeddings(_products(spark, sf)).select("id", "tenant_id")


@register("backfill_embeddings")
def q_backfill_embeddings(spark, sf):
    """E1 with the default hashed bag-of-words function (no SQL twin: the
    vectors come from a Python function).  Every product ends with a vector."""
    from storelens.operators.embed import backfill_embeddings
    out = backfill_embeddings(_products(spark, sf))
    return out.select("id", "tenant_id", F.size("embedding").cast("long").alias("dims"))


def _changes(nation):
    """Two partial-update rows per tenant (all nations); which fields a row
    sets depends on the nation's region, NULL fields leave values as they are."""
    r = F.col("n_regionkey")
    t = F.concat(F.lit("tenant-"), F.col("n_nationkey").cast("string"))
    first = nation.select(
        t.alias("tenant_id"), F.lit(1).alias("seq"),
        F.lit(None).cast("string").alias("name"),
        F.when(r == 0, F.concat(F.lit("Updated "), F.col("n_name"))).alias("description"),
        F.when(r <= 1, F.create_map(F.lit("theme"), F.lit("dark"))).alias("settings"))
    second = nation.select(
        t.alias("tenant_id"), F.lit(2).alias("seq"),
        F.when(r >= 3, F.lower(F.col("n_name"))).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.when(r == 1, F.create_map(F.lit("theme"), F.lit("blue"), F.lit("currency"), F.lit("USD")))
        .alias("settings"))
    return first.unionByName(second)


@register("settings_merge", A.with_views("tenants") + """
, ch AS (
  SELECT 'tenant-' || CAST(n_nationkey AS VARCHAR) AS tenant_id, 1 AS seq, NULL::VARCHAR AS name,
         CASE WHEN n_regionkey = 0 THEN 'Updated ' || n_name END AS description,
         CASE WHEN n_regionkey <= 1 THEN MAP {'theme': 'dark'} END AS settings FROM nation
  UNION ALL
  SELECT 'tenant-' || CAST(n_nationkey AS VARCHAR), 2, CASE WHEN n_regionkey >= 3 THEN lower(n_name) END, NULL,
         CASE WHEN n_regionkey = 1 THEN MAP {'theme': 'blue', 'currency': 'USD'} END FROM nation
), ch_kv AS (
  SELECT tenant_id, seq, unnest(map_keys(settings)) AS k, unnest(map_values(settings)) AS v
  FROM ch WHERE settings IS NOT NULL
), kv AS (
  SELECT tenant_id, 'region' AS k, region_setting AS v, 0 AS seq FROM tenants
  UNION ALL SELECT tenant_id, 'theme', theme_setting, 0 FROM tenants
  UNION ALL SELECT tenant_id, k, v, seq FROM ch_kv
), merged AS (SELECT tenant_id, k, arg_max(v, seq) AS v FROM kv GROUP BY ALL),
names AS (
  SELECT t.tenant_id,
         coalesce((SELECT arg_max(name, seq) FROM ch WHERE ch.tenant_id = t.tenant_id AND name IS NOT NULL), t.name) AS name,
         coalesce((SELECT arg_max(description, seq) FROM ch WHERE ch.tenant_id = t.tenant_id AND description IS NOT NULL),
                  t.description) AS description
  FROM tenants t
)
SELECT n.tenant_id, n.name, n.description, m.k AS setting_key, m.v AS setting_value
FROM names n JOIN merged m ON m.tenant_id = n.tenant_id
""")
def q_settings_merge(spark, sf):
    from storelens.operators.tenancy import apply_settings_changes
    nation = _t(spark, sf, "nation")
    out = apply_settings_changes(A.tenants(nation), _changes(nation))
    return out.select("tenant_id", "name", "description",
                      F.explode("settings").alias("setting_key", "setting_value"))


@register("replace_products", A.with_views("products") + f"""
, incoming AS (SELECT id, tenant_id, source_id, upper(title) AS title FROM products WHERE product_type = 'PROMO')
SELECT id, tenant_id, source_id, title FROM products
WHERE (tenant_id, source_id) NOT IN (SELECT (tenant_id, source_id) FROM incoming)
UNION ALL SELECT id, tenant_id, source_id, title FROM incoming
""")
def q_replace_products(spark, sf):
    from storelens.operators.catalog import replace_products
    p = _products(spark, sf, False).select("id", "tenant_id", "source_id", "title", "product_type")
    incoming = p.where(F.col("product_type") == "PROMO").withColumn("title", F.upper("title"))
    return replace_products(p, incoming).select("id", "tenant_id", "source_id", "title")


@register("delete_tenant", A.with_views("messages") + """
SELECT tenant_id, count(*) AS messages FROM messages WHERE tenant_id <> 'tenant-0' GROUP BY tenant_id
""")
def q_delete_tenant(spark, sf):
    from storelens.operators.tenancy import delete_tenant
    kept = delete_tenant({"messages": _messages(spark, sf)}, "tenant-0")["messages"]
    return kept.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("messages"))


# ---------------------------------------------------------------------------
# Streaming T1-T7: each runs the stream over the events file to completion
# (availableNow) through the idempotent upsert sink, then reads the result.
# ---------------------------------------------------------------------------

STATE_PARTITIONS = 16      # of these one-off drains; a stream's state keeps it for good


def _drain(spark, sf, build, name, key, mode="update", whole_key_group=False, flush=False):
    """Run a stream over the whole events table, landed in two parts by time,
    into the upsert sink, and read the result back.

    Each part is a run of its own that goes on from the checkpoint, so state
    is carried over.  ``flush`` lands a heartbeat event days after the last
    one: the watermark then closes every real window and session, and append
    mode emits them all.  The stream has a session of its own; the caller's
    settings stay as they are.
    """
    from storelens.session import scratch_path
    from storelens.streaming.sources import file_stream, run_to_table, sink_checkpoint
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(STATE_PARTITIONS))
    events = own.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    landing, path = scratch_path(own, f"{name}-landing"), scratch_path(own, f"{name}-table")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low + (high - low) / 2 if low is not None else None).cast("timestamp_ntz")
    later = F.coalesce(F.col("ts") >= middle, F.lit(False))
    parts = [events.where(~later), events.where(later)]
    if flush and high is not None:
        beat = own.range(1).select(*[
            (F.lit(high) + F.expr("INTERVAL 3 DAYS")).cast("timestamp_ntz").alias(f.name) if f.name == "ts"
            else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
        parts[1] = parts[1].unionByName(beat)
    for part in parts:
        part.write.mode("append").parquet(landing)
        stream = A.with_parts(file_stream(own, landing, events.schema), own, sf)
        run_to_table(build(stream), path, mode=mode, name=name)
    _drop(own, landing)
    _drop(own, sink_checkpoint(path))
    from storelens.streaming.sources import read_upserted
    return read_upserted(spark, path, key, whole_key_group)


def _kept(df, path):
    """``df``, read from ``path``, as a stored table; the files at ``path`` go."""
    from storelens.session import materialize
    out = materialize(df, "read-back")
    _drop(df.sparkSession, path)
    return out, path


def _drop(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@register("stream_session_metrics", ORACLE["session_rollup"])
def q_stream_session_metrics(spark, sf):
    from storelens.streaming.metrics import stream_session_metrics
    # a session of this log lies within a day: finished days leave the state
    out = _drain(spark, sf, lambda e: stream_session_metrics(A.messages(e), window="1 day"),
                 "t1", ["tenant_id", "session_id", "window_start"])
    return round_doubles(out.drop("window_start", "window_end"), estimated_cost=10)


@register("stream_event_counts", A.with_views("product_events") + """
SELECT tenant_id, event_type, product_id, date_trunc('day', created_at) AS window_start,
       date_trunc('day', created_at) + INTERVAL 1 DAY AS window_end, count(*) AS event_count
FROM product_events GROUP BY ALL
""")
def q_stream_event_counts(spark, sf):
    from storelens.streaming.metrics import stream_event_counts
    return _drain(spark, sf, lambda e: stream_event_counts(A.product_events(e), "1 day"),
                  "t2", ["tenant_id", "event_type", "product_id", "window_start"])


@register("stream_active_sessions", A.with_views("messages") + """
, w AS (
  SELECT tenant_id, session_id, (epoch_us(created_at) // 30000000 - i) * 30000000 AS ws
  FROM messages, range(0, 120) r(i)
)
SELECT tenant_id, make_timestamp(ws) AS window_start, make_timestamp(ws + 3600000000) AS window_end,
       count(DISTINCT session_id) AS active_sessions
FROM w GROUP BY ALL
""")
def q_stream_active_sessions(spark, sf):
    """T3 exact: sessions active per 1 h window sliding every 30 s, windows
    emitted once closed by the watermark."""
    from storelens.streaming.metrics import stream_active_sessions
    return _drain(spark, sf, lambda e: stream_active_sessions(A.messages(e), "1 hour", "30 seconds", exact=True),
                  "t3", ["tenant_id", "window_start"], mode="append", flush=True)


@register("stream_sessionise", ORACLE["sessionise"])
def q_stream_sessionise(spark, sf):
    """T4: append mode emits a session once the watermark (max event time - 1 h)
    passes its end; the heartbeat closes those open at the end of the input."""
    from storelens.streaming.metrics import stream_sessionise
    return _drain(spark, sf, lambda e: stream_sessionise(e, "user_id", "ts", 3600),
                  "t4", ["user_id", "session_start"], mode="append", flush=True)


@register("stream_hourly_latency", A.with_views("messages") + """
SELECT tenant_id, date_trunc('hour', created_at) AS hour, round(avg(latency_ms), 6) AS avg_latency_ms,
       round(quantile_cont(latency_ms, 0.50), 6) AS p50, round(quantile_cont(latency_ms, 0.90), 6) AS p90,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99, count(*) AS message_count
FROM messages WHERE role = 'assistant' AND latency_ms IS NOT NULL GROUP BY ALL
""")
def q_stream_hourly_latency(spark, sf):
    from storelens.streaming.metrics import stream_hourly_latency
    return round_doubles(_drain(spark, sf, lambda e: stream_hourly_latency(A.messages(e)), "t7", ["tenant_id", "hour"]))


@register("stream_recent_history", A.with_views("messages") + """
, g AS (
  SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY tenant_id, session_id ORDER BY created_at, message_id)
                      >= INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS brk
  FROM messages
), seg AS (
  SELECT *, sum(brk) OVER (PARTITION BY tenant_id, session_id ORDER BY created_at, message_id ROWS UNBOUNDED PRECEDING) AS sg
  FROM g
), lastseg AS (
  SELECT * FROM seg QUALIFY sg = max(sg) OVER (PARTITION BY tenant_id, session_id)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY created_at DESC, message_id DESC) AS rn,
         least(count(*) OVER (PARTITION BY tenant_id, session_id), 2) AS m
  FROM lastseg
)
SELECT tenant_id, session_id, CAST(m - rn + 1 AS BIGINT) AS position, message_id, role, content, created_at
FROM r WHERE rn <= 2
""")
def q_stream_recent_history(spark, sf):
    from storelens.streaming.keyed import stream_recent_history
    return _drain(spark, sf, lambda e: stream_recent_history(A.messages(e), HISTORY, 3600),
                  "t5", ["tenant_id", "session_id"], whole_key_group=True)


@register("stream_rate_limit")
def q_stream_rate_limit(spark, sf):
    """T6 exact admission in event order: a request is decided once the watermark
    has passed its pane; the heartbeat closes the last ones."""
    from storelens.streaming.keyed import stream_rate_limit
    return _drain(spark, sf, lambda e: stream_rate_limit(e, "user_id", "event_id", "ts", RATE, RATE_SECONDS, ordered=True),
                  "t6", ["request_id"], mode="append", flush=True)


# ---------------------------------------------------------------------------
# Serialisation and projections: S10, F15, J14, J5/M4
# ---------------------------------------------------------------------------

@register("products_json", A.with_views("products") + _label_queries_sql(True, True) + _search_sql(None).replace(
    "\nSELECT query_id, CAST(rank AS BIGINT) AS rank, id, title, product_type, body_html,",
    "\n, ranked AS (SELECT query_id, CAST(rank AS BIGINT) AS rank, id, title, product_type, body_html,", 1)
    .rstrip() + """)
SELECT query_id, CAST(to_json(list(struct_pack(rank := rank, id := id, title := title) ORDER BY rank)) AS VARCHAR) AS json
FROM ranked GROUP BY query_id
""")
def q_products_json(spark, sf):
    from storelens.operators.search import products_to_json
    from storelens.plans.search import search_batch
    res = search_batch(_products(spark, sf), _label_queries(spark, sf, True, True))
    return products_to_json(res.select("query_id", "rank", "id", "title"))


@register("product_cards", A.with_views("products", "images") + """
, fi AS (
  SELECT product_id, tenant_id, min({'p': coalesce(position, 2147483647), 'i': id, 's': src}).s AS image_url
  FROM images GROUP BY ALL
)
SELECT p.id, CAST(p.source_id AS VARCHAR) AS source_id, p.title AS name, coalesce(p.vendor, '') AS vendor,
       fi.image_url, coalesce(p.min_price, 0.0) AS price_min, coalesce(p.max_price, 0.0) AS price_max,
       coalesce(p.has_discount, false) AS has_discount
FROM products p LEFT JOIN fi ON fi.product_id = p.id AND fi.tenant_id = p.tenant_id
""")
def q_product_cards(spark, sf):
    from storelens.operators.search import product_cards, with_first_image
    li = _t(spark, sf, "lineitem")
    return product_cards(with_first_image(_products(spark, sf, False), A.images(li)))


@register("semantic_within", A.with_views("messages", "products") + """
SELECT 'listed' AS restriction, id, tenant_id FROM products
WHERE id IN (SELECT unnest(CAST(json_extract(structured_data, '$.product_ids') AS BIGINT[]))
             FROM messages WHERE structured_data IS NOT NULL)
UNION ALL SELECT 'empty list', id, tenant_id FROM products
""")
def q_semantic_within(spark, sf):
    from storelens.operators.search import ids_from_array, semantic_within
    m = _messages(spark, sf).where(F.col("structured_data").isNotNull())
    arr = m.select("message_id", F.from_json("structured_data", "struct<product_ids:array<bigint>>")
                   ["product_ids"].alias("ids"))
    ids, p = ids_from_array(arr, "ids", ["message_id"]), _products(spark, sf, False)
    within = lambda name, ids: semantic_within(p, ids).select(F.lit(name).alias("restriction"), "id", "tenant_id")
    return within("listed", ids).unionByName(within("empty list", ids.where("id IS NULL")))


@register("variant_images", A.with_views("variants", "images") + """
SELECT v.id, v.product_id, i.id AS image_id
FROM variants v LEFT JOIN (SELECT DISTINCT id FROM images) i ON i.id = v.image_id
""")
def q_variant_images(spark, sf):
    from storelens.operators.catalog import set_null_on_missing_image
    li = _t(spark, sf, "lineitem")
    return set_null_on_missing_image(A.variants(li), A.images(li)).select("id", "product_id", "image_id")


# Twins added after the fact for queries defined above.

# Exact admission as a recursive walk over each user's requests in
# (ts, id) order, carrying the admitted timestamps of the trailing window.
ORACLE["stream_rate_limit"] = """
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, epoch_us(CAST(ts AS TIMESTAMP)) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events
), r AS (
  SELECT user_id, rn, event_id, ts, [us]::BIGINT[] AS adm, true AS admitted FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.ts,
         CASE WHEN len(list_filter(r.adm, lambda a: a > e.us - 86400000000)) >= 2
              THEN list_filter(r.adm, lambda a: a > e.us - 86400000000)
              ELSE list_append(list_filter(r.adm, lambda a: a > e.us - 86400000000), e.us) END,
         len(list_filter(r.adm, lambda a: a > e.us - 86400000000)) < 2
  FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1
)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS request_id, ts, admitted,
       CAST(len(adm) AS BIGINT) AS in_window
FROM r
"""


@register("rate_limit_audit", ORACLE["stream_rate_limit"])
def q_rate_limit_audit(spark, sf):
    """Exact admission over the whole log, in quiet pieces."""
    from storelens.operators.sessions import rate_limit_audit
    out = rate_limit_audit(_t(spark, sf, "events"), "user_id", "event_id", "ts", limit=RATE, window_seconds=RATE_SECONDS)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Every product ends with a 64-dimensional vector (stored or backfilled).
ORACLE["backfill_embeddings"] = A.with_views("products") + """
SELECT id, tenant_id, CAST(64 AS BIGINT) AS dims FROM products
"""


@register("embedding_dimensions", A.with_views("products") + """
SELECT tenant_id, count(embedding) AS with_embedding,
       count(CASE WHEN embedding IS NOT NULL AND len(embedding) <> 64 THEN 1 END) AS wrong_dimension
FROM products GROUP BY tenant_id
""")
def q_embedding_dimensions(spark, sf):
    from storelens.operators.embed import embedding_dimension_report
    return embedding_dimension_report(_products(spark, sf), 64)


# ---------------------------------------------------------------------------
# Catalogue round trip: S2/S3 pages -> P3 ingest (X2, X4, X5, A16 nested)
# ---------------------------------------------------------------------------

def _line_documents(li, bad=None):
    """One catalogue document per line item: a product with one variant, one
    image and one option; prices travel as text, timestamps as ISO text."""
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    compare = F.try_divide(price, F.lit(1.0) - F.col("l_discount"))
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    iso = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    updated = iso if bad is None else F.when(F.col(bad), F.lit("not a time")).otherwise(iso)
    doc_id = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                        "l_extendedprice", "l_discount", "l_shipdate")
    return li.select(
        doc_id.alias("id"),
        F.concat(F.lit("Line "), key).alias("title"),
        F.concat(F.lit("<p>Flag "), F.col("l_returnflag"), F.lit("</p>")).alias("body_html"),
        F.concat(F.lit("Vendor "), F.col("l_returnflag")).alias("vendor"),
        F.col("l_linestatus").alias("product_type"),
        iso.alias("created_at"), updated.alias("updated_at"), iso.alias("published_at"),
        F.array(F.struct(F.lit("Flag").alias("name"), F.array(F.col("l_returnflag")).alias("values"))).alias("options"),
        F.array(F.struct(doc_id.alias("id"), F.lit(1).alias("position"),
                         F.concat(F.lit("https://cdn.example.com/l/"), key, F.lit(".jpg")).alias("src"))).alias("images"),
        F.array(F.struct(doc_id.alias("id"), price.cast("string").alias("price"),
                         compare.cast("string").alias("compare_at_price"), doc_id.alias("image_id"))).alias("variants"))


@register("catalog_roundtrip", """
WITH l AS (
  SELECT *, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price FROM lineitem
)
SELECT 'tenant-rt' AS tenant_id, 'Line ' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS title,
       l_linestatus AS product_type, 'Vendor ' || l_returnflag AS vendor,
       CAST(CAST(CAST(price AS VARCHAR) AS DECIMAL(10,2)) AS DOUBLE) AS min_price, CAST(CAST(CAST(price AS VARCHAR) AS DECIMAL(10,2)) AS DOUBLE) AS max_price,
       coalesce(CASE WHEN l_discount <> 1 THEN price / (1.0 - l_discount) END > price, false) AS has_discount,
       CAST(l_shipdate AS TIMESTAMP) AS created_at, CAST(l_shipdate AS TIMESTAMP) AS published_at,
       l_returnflag AS flag, 'Flag ' || l_returnflag AS description, CAST(1 AS BIGINT) AS variants_resolved
FROM l
""")
def q_catalog_roundtrip(spark, sf):
    """Documents written as pages, read back and ingested; one product per line item."""
    from storelens.plans.ingest import ingest_catalog
    from storelens.sources.catalog import read_catalog_pages, write_catalog_pages
    from storelens.streaming.sources import new_checkpoint
    path = new_checkpoint(spark, "catalog-pages")
    write_catalog_pages(_line_documents(_t(spark, sf, "lineitem")), path)
    raw = read_catalog_pages(spark, path, multiline=False)
    out = ingest_catalog(raw, "tenant-rt", materialize_docs=True)
    _drop(spark, path)
    resolved = out["variants"].groupBy("product_id").agg(F.count("image_id").alias("variants_resolved"))
    p = out["products"]
    return p.join(resolved, p["id"] == resolved["product_id"], "left").select(
        "tenant_id", "title", "product_type", "vendor", F.col("min_price").cast("double").alias("min_price"),
        F.col("max_price").cast("double").alias("max_price"), "has_discount", "created_at",
        "published_at", F.col("options")["Flag"][0].alias("flag"),
        F.get_json_object("embedding_json", "$.description").alias("description"),
        F.coalesce("variants_resolved", F.lit(0)).alias("variants_resolved"))


_LINE_FLAT_SQL = """
WITH l AS (
  SELECT *, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price FROM lineitem
)
SELECT 'Line ' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS title,
       'Vendor ' || l_returnflag AS vendor, l_linestatus AS product_type,
       price, CASE WHEN l_discount <> 1 THEN price / (1.0 - l_discount) END AS compare_at_price,
       CAST(1 AS BIGINT) AS image_count
FROM l
"""


def _as_catalog(docs):
    """Conform documents to the declared catalogue schema (absent fields NULL),
    as reading them from JSON with that schema would."""
    from pyspark.sql import types as T
    from storelens.schemas import CATALOG

    def conform(value, has, want):
        if isinstance(want, T.ArrayType):
            return F.transform(value, lambda x: conform(x, has.elementType, want.elementType))
        if not isinstance(want, T.StructType):
            return value.cast(want)
        out = F.struct(*[field(value[f.name] if f.name in has.names else None, has, f) for f in want])
        return F.when(value.isNotNull(), out)

    def field(value, has, f):
        known = F.lit(None).cast(f.dataType) if value is None else conform(value, has[f.name].dataType, f.dataType)
        return known.alias(f.name)

    return docs.select(*[field(F.col(f.name) if f.name in docs.columns else None, docs.schema, f) for f in CATALOG])


@register("flatten_variants", _LINE_FLAT_SQL)
def q_flatten_variants(spark, sf):
    """X8 on nested documents: one row per variant with the product's columns."""
    from storelens.operators.catalog import flatten_variants
    flat = flatten_variants(_as_catalog(_line_documents(_t(spark, sf, "lineitem"))))
    return flat.select("title", "vendor", "product_type",
                       F.col("price").try_cast("double").alias("price"),
                       F.col("compare_at_price").try_cast("double").alias("compare_at_price"),
                       F.size("image_srcs").cast("long").alias("image_count"))


@register("variants_csv", _LINE_FLAT_SQL)
def q_variants_csv(spark, sf):
    """Flattened variants written as CSV (sorted header, lists as JSON
    text) and read back."""
    from storelens.operators.catalog import flatten_variants
    from storelens.sources.catalog import write_variants_csv
    from storelens.streaming.sources import new_checkpoint
    path = new_checkpoint(spark, "variants-csv")
    write_variants_csv([flatten_variants(_as_catalog(_line_documents(_t(spark, sf, "lineitem"))))], path)
    back, _ = _kept(spark.read.option("header", True).csv(path), path)
    return back.select("title", "vendor", "product_type",
                       F.col("price").try_cast("double").alias("price"),
                       F.col("compare_at_price").try_cast("double").alias("compare_at_price"),
                       F.size(F.from_json("image_srcs", "array<string>")).cast("long").alias("image_count"))


@register("export_daily_csv", ORACLE["sessions_over_time"])
def q_export_daily_csv(spark, sf):
    """The daily sessions report written as CSV (fixed column order) and
    read back with its header."""
    from storelens.sources.catalog import export_daily_csv
    from storelens.streaming.sources import new_checkpoint
    path = new_checkpoint(spark, "export-csv")
    export_daily_csv(_sessions(spark, sf), AS_OF, path, days=DAYS)
    back, _ = _kept(spark.read.option("header", True).csv(path), path)
    return back.select("tenant_id", F.col("date").cast("date").alias("date"),
                       F.col("session_count").cast("long").alias("session_count"),
                       F.col("unique_sessions").cast("long").alias("unique_sessions"),
                       F.col("total_messages").cast("long").alias("total_messages"),
                       F.round(F.col("daily_cost").cast("double"), 10).alias("daily_cost"))


# ---------------------------------------------------------------------------
# Queries of operators that had none: tenants, appends, listing, columns, ingest
# ---------------------------------------------------------------------------

@register("search_capped", A.with_views("products") + _label_queries_sql(True, True) + _search_sql(50))
def q_search_capped(spark, sf):
    """P2 with a cap that the caller sets: the newest 50 matches are ranked."""
    from storelens.plans.search import search_batch
    return _search_out(search_batch(_products(spark, sf), _label_queries(spark, sf, True, True), candidate_cap=50))


@register("listing_page", A.with_views("products", "images") + """
, fi AS (
  SELECT product_id, tenant_id, min({'p': coalesce(position, 2147483647), 'i': id, 's': src}).s AS image_url
  FROM images GROUP BY ALL
), r AS (
  SELECT p.*, fi.image_url,
         row_number() OVER (PARTITION BY p.tenant_id ORDER BY p.updated_at DESC NULLS FIRST, p.id) AS pos
  FROM products p LEFT JOIN fi ON fi.product_id = p.id AND fi.tenant_id = p.tenant_id
)
SELECT tenant_id, CAST(pos AS BIGINT) AS position, id, title AS name, image_url
FROM r WHERE pos > 40 AND pos <= 100 AND product_type = 'PROMO'
""")
def q_listing_page(spark, sf):
    """O1 with an offset, F14 category and O6 sort by name."""
    from storelens.plans.search import catalogue_listing
    page = catalogue_listing(_products(spark, sf, False), A.images(_t(spark, sf, "lineitem")), limit=60, offset=40,
                             category="PROMO", sort="name")
    return page.select("tenant_id", "position", "id", "name", "image_url")


@register("tenant_read", A.with_views("messages") + """
SELECT message_id, '007' AS tenant_id, role, CAST(created_at AS DATE) AS day FROM messages WHERE tenant_id = 'tenant-1'
""")
def q_tenant_read(spark, sf):
    """S7 append, F2 guard, F1 / S6 read of one tenant whose id is digits."""
    from storelens.operators.common import for_tenant
    from storelens.session import scratch_path
    from storelens.sources.tables import append_messages, read_table
    path, m = scratch_path(spark, "tenant-read"), _messages(spark, sf)
    append_messages(m.where("tenant_id <> 'tenant-1'"), path)
    append_messages(for_tenant(m, "tenant-1").withColumn("tenant_id", F.lit("007")), path, tenant_id="007")
    back, _ = _kept(read_table(spark, path, "007").select("message_id", "tenant_id", "role", "day"), path)
    return back


@register("event_append", A.with_views("product_events") + """
SELECT tenant_id, product_id, event_type, session_id, created_at, CAST(created_at AS DATE) AS day FROM product_events
""")
def q_event_append(spark, sf):
    """Product events appended by tenant and day, read back whole."""
    from storelens.session import scratch_path
    from storelens.sources.tables import append_product_events, read_table
    path = scratch_path(spark, "event-append")
    append_product_events(A.product_events(_t(spark, sf, "events")), path)
    back, _ = _kept(read_table(spark, path), path)
    return back.select("tenant_id", "product_id", "event_type", "session_id", "created_at", "day")


@register("column_union", A.with_views("variants", "images") + """
SELECT 'variant' AS kind, id, product_id, sku, NULL::VARCHAR AS src FROM variants
UNION ALL SELECT 'image', id, product_id, NULL, src FROM images
""")
def q_column_union(spark, sf):
    """Frames of different columns written as one CSV and read back."""
    from storelens.session import scratch_path
    from storelens.sources.catalog import write_variants_csv
    li, path = _t(spark, sf, "lineitem"), scratch_path(spark, "column-union")
    write_variants_csv([A.variants(li).select(F.lit("variant").alias("kind"), "id", "product_id", "sku"),
                        A.images(li).select(F.lit("image").alias("kind"), "id", "product_id", "src")], path)
    back, _ = _kept(spark.read.option("header", True).csv(path), path)
    return back.select("kind", F.col("id").cast("long").alias("id"), F.col("product_id").cast("long").alias("product_id"),
                       "sku", "src")


@register("split_tags", A.with_views("products") + """
SELECT id, string_split(tags, ', ') AS tags, len(string_split(tags, ', ')) AS n FROM products
""")
def q_split_tags(spark, sf):
    from storelens.functions.catalog import split_tags
    return _products(spark, sf, False).select("id", split_tags("tags").alias("tags"),
                                              F.size(split_tags("tags")).cast("long").alias("n"))


@register("clean_variant_ids", A.with_views("images") + """
SELECT id, CASE WHEN position > 3 THEN [] ELSE [id, product_id] END AS variant_ids FROM images
""")
def q_clean_variant_ids(spark, sf):
    from storelens.functions.catalog import clean_variant_ids
    i = A.images(_t(spark, sf, "lineitem")).withColumn("raw", F.when(F.col("position") <= 3, F.array(
        "id", F.lit(None).cast("long"), "product_id")))
    return i.select("id", clean_variant_ids("raw").alias("variant_ids"))


@register("is_uuid", """
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents),
u AS (SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
             || CASE WHEN h < '8' THEN substr(h, 21, 12) ELSE substr(h, 21, 11) || 'g' END AS key FROM d)
SELECT doc_id, key, regexp_full_match(key, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') AS valid FROM u
""")
def q_is_uuid(spark, sf):
    from storelens.functions.misc import is_uuid
    h = F.md5(F.coalesce("text", F.lit("")))
    cut = lambda a, n: F.substring(h, a, n)
    key = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), F.when(h < "8", cut(21, 12)).otherwise(
        F.concat(cut(21, 11), F.lit("g"))))
    return _t(spark, sf, "documents").select("doc_id", key.alias("key"), is_uuid(key).alias("valid"))


@register("latest_per_key", A.with_views("messages") + """
SELECT tenant_id, session_id, arg_max(message_id, (created_at, message_id)) AS message_id,
       arg_max(role, (created_at, message_id)) AS role
FROM messages GROUP BY ALL
""")
def q_latest_per_key(spark, sf):
    """The last message of every session."""
    from storelens.operators.sessions import latest_per_key
    m = _messages(spark, sf).select("tenant_id", "session_id", "created_at", "message_id", "role")
    return latest_per_key(m.withColumn("_m", F.col("message_id")), ["tenant_id", "session_id"], ["created_at", "_m"]) \
        .select("tenant_id", "session_id", "message_id", "role")


@register("resolve_variant_images", A.with_views("variants", "images") + """
SELECT v.id, v.product_id, i.id AS image_id
FROM variants v LEFT JOIN images i ON i.id = v.image_id AND i.product_id = v.product_id AND i.tenant_id = v.tenant_id
""")
def q_resolve_variant_images(spark, sf):
    """J5 flat: the image of the variant's own product, if it exists."""
    from storelens.operators.catalog import resolve_variant_images
    li = _t(spark, sf, "lineitem")
    v = A.variants(li).withColumnRenamed("image_id", "source_image_id")
    i = A.images(li).withColumn("source_image_id", F.col("id"))
    return resolve_variant_images(v, i).select("id", "product_id", "image_id")


@register("ingest_counts", """
WITH d AS (SELECT l_shipdate, l_linenumber, l_discount FROM lineitem)
SELECT count(CASE WHEN l_discount < 0.1 THEN 1 END) AS products, count(CASE WHEN l_discount < 0.1 THEN 1 END) AS variants,
       count(CASE WHEN l_discount < 0.1 THEN 1 END) AS images, count(CASE WHEN l_discount < 0.1 THEN 1 END) AS successful,
       count(CASE WHEN l_discount >= 0.1 THEN 1 END) AS failed
FROM d
""")
def q_ingest_counts(spark, sf):
    """Documents whose update time can't be read fail, the rest succeeds."""
    from storelens.plans.ingest import ingest_catalog
    li = _t(spark, sf, "lineitem")
    docs = _line_documents(li.withColumn("bad", F.col("l_discount") >= 0.1), bad="bad")
    return ingest_catalog(_as_catalog(docs), "t")["summary"]


@register("ingest_two_tenants", """
WITH l AS (SELECT *, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price FROM lineitem)
SELECT tenant_id, count(*) AS products, count(*) AS variants, count(*) AS images,
       round(sum(CAST(CAST(CAST(price AS VARCHAR) AS DECIMAL(10,2)) AS DOUBLE)), 2) AS price_sum
FROM l, (VALUES ('007'), ('t2')) t(tenant_id)
WHERE (tenant_id = '007') = (l_linenumber <= 3)
GROUP BY tenant_id
""")
def q_ingest_two_tenants(spark, sf):
    """P3 into one folder, tenant after tenant, the second time over the first
    tenant's own rows: both tenants survive, with every table."""
    from storelens.operators.common import for_tenant
    from storelens.plans.ingest import ingest_catalog, read_catalog_tables, write_catalog_tables
    from storelens.session import materialize, scratch_path
    li, path = _t(spark, sf, "lineitem"), scratch_path(spark, "two-tenants")
    low, high = li.where("l_linenumber <= 3"), li.where("l_linenumber > 3")
    write_catalog_tables(ingest_catalog(_as_catalog(_line_documents(low)), "007"), path)
    write_catalog_tables(ingest_catalog(_as_catalog(_line_documents(high)), "t2"), path)
    # as the ingest command does it: the other tenant's folders stay as they are
    current = {n: for_tenant(t, "007") for n, t in read_catalog_tables(spark, path).items()}
    again = ingest_catalog(_as_catalog(_line_documents(low)), "007", current=current)
    write_catalog_tables(again, path)
    t = read_catalog_tables(spark, path)
    counts = [t[n].groupBy("tenant_id").agg(F.count("*").alias(n)) for n in ("variants", "images")]
    out = t["products"].groupBy("tenant_id").agg(
        F.count("*").alias("products"), F.round(F.sum(F.col("min_price").cast("double")), 2).alias("price_sum"))
    out = materialize(out.join(counts[0], "tenant_id").join(counts[1], "tenant_id"), "two-tenants-counts")
    _drop(spark, path)
    return out.select("tenant_id", "products", "variants", "images", "price_sum")


@register("replace_cascade", A.with_views("products", "images") + """
SELECT 'images' AS relation, count(*) AS kept FROM images
WHERE product_id NOT IN (SELECT id FROM products WHERE product_type = 'PROMO')
UNION ALL SELECT 'variants', count(*) FROM variants
WHERE product_id NOT IN (SELECT id FROM products WHERE product_type = 'PROMO')
""")
def q_replace_cascade(spark, sf):
    """M2: children of replaced products go with them."""
    from storelens.operators.catalog import cascade_children
    li = _t(spark, sf, "lineitem")
    gone = _products(spark, sf, False).where("product_type = 'PROMO'").select("id", "tenant_id")
    parts = [cascade_children(df, gone).agg(F.count("*").alias("kept")).select(F.lit(n).alias("relation"), "kept")
             for n, df in (("images", A.images(li)), ("variants", A.variants(li)))]
    return parts[0].unionByName(parts[1])


@register("delete_tenant_tables", A.with_views("products", "images", "sessions", "product_events", "tenants") + """
SELECT * FROM (
  SELECT 'messages' AS relation, tenant_id, count(*) AS rows FROM messages GROUP BY ALL
  UNION ALL SELECT 'sessions', tenant_id, count(*) FROM sessions GROUP BY ALL
  UNION ALL SELECT 'product_events', tenant_id, count(*) FROM product_events GROUP BY ALL
  UNION ALL SELECT 'products', tenant_id, count(*) FROM products GROUP BY ALL
  UNION ALL SELECT 'images', tenant_id, count(*) FROM images GROUP BY ALL
  UNION ALL SELECT 'variants', tenant_id, count(*) FROM variants GROUP BY ALL
  UNION ALL SELECT 'tenants', tenant_id, count(*) FROM tenants GROUP BY ALL)
WHERE tenant_id <> 'tenant-1'
""")
def q_delete_tenant_tables(spark, sf):
    """M3 over all seven tables."""
    from storelens.operators.tenancy import delete_tenant
    li, ev, m = _t(spark, sf, "lineitem"), _t(spark, sf, "events"), _messages(spark, sf)
    tables = {"messages": m, "sessions": _sessions(spark, sf), "product_events": A.product_events(ev),
              "products": _products(spark, sf, False), "images": A.images(li), "variants": A.variants(li),
              "tenants": A.tenants(_t(spark, sf, "nation"))}
    out = None
    for name, df in delete_tenant(tables, "tenant-1").items():
        one = df.groupBy("tenant_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "tenant_id", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@register("clear_embeddings", A.with_views("products") + """
SELECT id, tenant_id, embedding IS NOT NULL AS had FROM products
""")
def q_clear_embeddings(spark, sf):
    """M7: afterwards every product is pending; ``had`` tells what was there."""
    from storelens.operators.embed import clear_embeddings, pending_embeddings
    p = _products(spark, sf).withColumn("had", F.col("embedding").isNotNull())
    return pending_embeddings(clear_embeddings(p)).select("id", "tenant_id", "had")


@register("evolve_schema", A.with_views("products") + """
SELECT id, CAST(source_id AS VARCHAR) AS source_id, title, 'none' AS barcode FROM products
""")
def q_evolve_schema(spark, sf):
    """M8: a new column with a default, and a wider type."""
    from pyspark.sql import types as T
    from storelens.operators.tenancy import evolve_schema
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("source_id", T.StringType()),
                           T.StructField("title", T.StringType()), T.StructField("barcode", T.StringType())])
    p = _products(spark, sf, False).select("id", "source_id", "title")
    return evolve_schema(p, target, {"barcode": "none"}).select("id", "source_id", "title", "barcode")
