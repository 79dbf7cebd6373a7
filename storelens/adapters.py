"""Driver tables -> this library's tables.

The test data is a TPC-H-like star schema plus an ``events`` log.  These
functions derive the commerce tables from it with plain column expressions,
so every derived table grows with its source:

* messages        <- events (one chat message per event)
* product_events  <- events (view/purchase/click only)
* variants        <- lineitem (one variant per line)
* images          <- lineitem (one image per line)
* products        <- part + variant rollup + embeddings
* tenants         <- nation
* turns           <- conversations

Each derivation has a DuckDB twin in ``SQL`` so oracle queries start from the
same rows.  Keep the two in step.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storelens.functions.catalog import embedding_json
from storelens.schemas import DEFAULT_MODEL_PRICES
from storelens.session import configure

# Fixed evaluation instant inside the events, which cover 2024-01-01 .. 2024-01-30.
AS_OF = dt.datetime(2024, 1, 20, 15, 30, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-20 15:30:00'"
N_TENANTS = 3
# Products that events refer to where the number of parts isn't known.
N_EVENT_PRODUCTS = 200
# Lines with a smaller discount have no compare-at price, images lie beside
# lines up to this number: so products without a discount and variants without
# their image occur.
COMPARE_FROM = 0.10
IMAGE_LINES = 5
SOURCE_ID_BASE = 7_000_000_000

MODEL_BY_MOD5 = ["gpt-4o-mini", "gpt-4.1-nano-2025-04-14", "GPT-4O-MINI", "mystery-model-1", None]
INTENT_BY_MOD5 = ["product_recommendation", "product_inquiry", "store_brand_question", "unrelated", None]
PRODUCT_EVENT_OF = {"view": "recommended", "purchase": "inquired", "click": "clicked"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name == "events":
        df = with_parts(df, spark, sf_dir)
    return df


def with_parts(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number of parts: the products they refer to grow with it."""
    n = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").count()
    return events.withColumn("n_parts", F.lit(n).cast("long"))


def event_product(events: DataFrame, step: int) -> Column:
    """A product of the event's tenant, spread over all parts."""
    n = F.col("n_parts") if "n_parts" in events.columns else F.lit(N_EVENT_PRODUCTS)
    per = F.greatest(F.floor(n / N_TENANTS), F.lit(1))
    return ((F.col("event_id") * step) % per) * N_TENANTS + F.col("user_id") % N_TENANTS


def tenant_of(c: Column) -> Column:
    return F.concat(F.lit("tenant-"), (c % N_TENANTS).cast("string"))


def _case_mod(c: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        if v is None:
            continue
        expr = F.when(c == i, F.lit(v)) if expr is None else expr.when(c == i, F.lit(v))
    return expr


def messages_base(events: DataFrame) -> DataFrame:
    """Chat messages without cost (cost needs the price table, see ``messages``)."""
    et, eid = F.col("event_type"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    is_user = et.isin("view", "click")
    is_asst = et.isin("purchase", "signup")
    prompt = F.when(is_asst, F.get_json_object("props", "$.k").cast("long") * 10)
    completion = F.when(is_asst, eid % 500)
    return events.select(
        tenant_of(F.col("user_id")).alias("tenant_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format(ts, "yyyy-MM-dd")).alias("session_id"),
        eid.alias("message_id"),
        F.when(is_user, "user").when(is_asst, "assistant").otherwise("system").alias("role"),
        F.concat(et, F.lit(" "), F.col("props")).alias("content"),
        F.when(is_user, _case_mod(eid % 5, INTENT_BY_MOD5)).alias("intent"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        F.when(is_asst & (eid % 7 != 0), prompt + completion).alias("total_tokens"),
        F.when(is_asst, _case_mod(eid % 5, MODEL_BY_MOD5)).alias("model_used"),
        ts.alias("created_at"),
        # several ids: one that no product has, and one of them twice
        F.when(et == "purchase", F.concat(
            F.lit('{"product_ids": ['), F.concat_ws(", ", *[x.cast("string") for x in (
                event_product(events, 7), -1 - eid, event_product(events, 11), event_product(events, 7))]),
            F.lit("]}"))).alias("structured_data"),
        F.when(et == "purchase", F.round(F.col("value") * 1000).cast("long")).alias("latency_ms"),
    )


def messages(events: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    from storelens.operators.sessions import price_usage
    return price_usage(messages_base(events), prices)


def product_events(events: DataFrame) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for kv in PRODUCT_EVENT_OF.items() for x in kv])
    ts = F.col("ts").cast("timestamp")
    return (events
            .where(F.col("event_type").isin(*PRODUCT_EVENT_OF))
            .select(tenant_of(F.col("user_id")).alias("tenant_id"),
                    event_product(events, 7).alias("product_id"),
                    mapping[F.col("event_type")].alias("event_type"),
                    F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"),
                             F.date_format(ts, "yyyy-MM-dd")).alias("session_id"),
                    ts.alias("created_at")))


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_shipdate"]


def line_id() -> Column:
    """An id of a line item; order and line number alone repeat in the data."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in LINE_KEY[:4]],
                       F.col("l_quantity").cast("long").cast("string"),
                       *[F.round(F.col(c) * 100).cast("long").cast("string") for c in LINE_KEY[5:8]],
                       F.date_format("l_shipdate", "yyyy-MM-dd"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def variants(lineitem: DataFrame) -> DataFrame:
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    vid = line_id()
    return lineitem.select(
        vid.alias("id"),
        F.col("l_partkey").alias("product_id"),
        tenant_of(F.col("l_partkey")).alias("tenant_id"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("title"),
        price.alias("price"),
        F.when(F.col("l_discount") >= COMPARE_FROM, F.try_divide(price, F.lit(1.0) - F.col("l_discount")))
        .alias("compare_at_price"),
        F.col("l_linenumber").alias("position"),
        F.col("l_returnflag").alias("option1"),
        F.col("l_linestatus").alias("option2"),
        F.concat(F.lit("SKU-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("sku"),
        F.col("l_quantity").cast("int").alias("inventory_quantity"),
        vid.alias("image_id"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def images(lineitem: DataFrame) -> DataFrame:
    iid = line_id()
    return lineitem.where(F.col("l_linenumber") <= IMAGE_LINES).select(
        iid.alias("id"),
        F.col("l_partkey").alias("product_id"),
        tenant_of(F.col("l_partkey")).alias("tenant_id"),
        F.col("l_linenumber").alias("position"),
        F.concat(F.lit("https://cdn.example.com/p/"), F.col("l_partkey").cast("string"), F.lit("/"),
                 F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string"), F.lit(".jpg")).alias("src"),
        F.array(iid).alias("variant_ids"),
    )


def products(part: DataFrame, lineitem: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """One product per part; prices and discount flag roll up from its variants."""
    from storelens.operators.catalog import variant_rollup_flat
    v = variants(lineitem)
    roll = variant_rollup_flat(v, extra=[F.min("created_at").alias("created_at"),
                                         F.max("created_at").alias("updated_at")])
    p = part.select(
        F.col("p_partkey").alias("id"),
        tenant_of(F.col("p_partkey")).alias("tenant_id"),
        (F.col("p_partkey") + F.lit(SOURCE_ID_BASE)).alias("source_id"),
        F.lower(F.regexp_replace("p_name", " ", "-")).alias("handle"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("<p>"), F.col("p_name"), F.lit(" by "), F.col("p_brand"), F.lit("</p>")).alias("body_html"),
        F.col("p_brand").alias("vendor"),
        F.col("p_type").alias("product_type"),
        F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand")).alias("tags"),
        F.lit("active").alias("status"),
        F.create_map(F.lit("Color"), F.array(F.split("p_name", " ")[0]),
                     F.lit("Size"), F.array(F.col("p_size").cast("string"))).alias("options"),
    )
    out = (p.join(roll, p["id"] == roll["product_id"], "left").drop("product_id")
            .withColumn("has_discount", F.coalesce("has_discount", F.lit(False))))
    out = out.withColumn("embedding_json", embedding_json(
        "title", "product_type", "tags", "vendor",
        F.transform(F.map_entries("options"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("values"))),
        "body_html"))
    if embeddings is not None:
        e = embeddings.select(F.col("vec_id").alias("product_id"), "embedding")
        out = out.join(e, out["id"] == e["product_id"], "left").drop("product_id")
    else:
        out = out.withColumn("embedding", F.lit(None).cast("array<float>"))
    return out


def tenants(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.concat(F.lit("tenant-"), F.col("n_nationkey").cast("string")).alias("tenant_id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Store of "), F.col("n_name"))).alias("description"),
        F.lit(None).cast("string").alias("brand_voice"),
        F.concat(F.lit("https://"), F.lower(F.col("n_name")), F.lit(".example.com")).alias("store_url"),
        F.lit(None).cast("string").alias("logo_url"),
        F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"),
                     F.lit("theme"), F.lit("light")).alias("settings"),
        F.lit(AS_OF).cast("timestamp").alias("created_at"),
        F.lit(AS_OF).cast("timestamp").alias("updated_at"),
    )


def turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn"), "role",
                                F.col("text").alias("content"))


# ---------------------------------------------------------------------------
# DuckDB twins (used only by oracle queries).
# ---------------------------------------------------------------------------

def _sql_case_mod(expr: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} {arms} END"


def _event_product_sql(step: int) -> str:
    per = f"greatest((SELECT count(*) FROM part) // {N_TENANTS}, 1)"
    return f"((event_id * {step}) % {per}) * {N_TENANTS} + user_id % {N_TENANTS}"


_LINE_ID = """CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
  CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
  strftime(l_shipdate, '%Y-%m-%d'))), 1, 15) AS BIGINT)"""

_MSG_BASE = f"""
msg_base AS (
  SELECT
    'tenant-' || CAST(user_id % {N_TENANTS} AS VARCHAR) AS tenant_id,
    's' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
    event_id AS message_id,
    CASE WHEN event_type IN ('view','click') THEN 'user'
         WHEN event_type IN ('purchase','signup') THEN 'assistant' ELSE 'system' END AS role,
    event_type || ' ' || props AS content,
    CASE WHEN event_type IN ('view','click') THEN {_sql_case_mod('event_id % 5', INTENT_BY_MOD5)} END AS intent,
    CASE WHEN event_type IN ('purchase','signup') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 END AS prompt_tokens,
    CASE WHEN event_type IN ('purchase','signup') THEN event_id % 500 END AS completion_tokens,
    CASE WHEN event_type IN ('purchase','signup') AND event_id % 7 <> 0
         THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + event_id % 500 END AS total_tokens,
    CASE WHEN event_type IN ('purchase','signup') THEN {_sql_case_mod('event_id % 5', MODEL_BY_MOD5)} END AS model_used,
    CAST(ts AS TIMESTAMP) AS created_at,
    CASE WHEN event_type = 'purchase' THEN '{{"product_ids": [' || concat_ws(', ', {_event_product_sql(7)}, -1 - event_id,
         {_event_product_sql(11)}, {_event_product_sql(7)}) || ']}}' END AS structured_data,
    CASE WHEN event_type = 'purchase' THEN CAST(round(value * 1000) AS BIGINT) END AS latency_ms
  FROM events
)"""

# Theta join on prefix, longest prefix wins; no match -> 0; NULL model -> NULL.
_PRICES = "prices(prefix, input, output) AS (VALUES " + ", ".join(
    f"('{p}', CAST({i!r} AS DOUBLE), CAST({o!r} AS DOUBLE))" for p, i, o in DEFAULT_MODEL_PRICES) + ")"

_MESSAGES = """
model_price AS (
  SELECT m.model_key, arg_max(p.input, length(p.prefix)) AS input, arg_max(p.output, length(p.prefix)) AS output
  FROM (SELECT DISTINCT lower(model_used) AS model_key FROM msg_base WHERE model_used IS NOT NULL) m
  JOIN prices p ON starts_with(m.model_key, p.prefix)
  GROUP BY m.model_key
),
messages AS (
  SELECT b.*,
    CASE WHEN b.model_used IS NULL THEN NULL
         ELSE CAST(coalesce(b.prompt_tokens, 0) AS DOUBLE) / 1e6 * coalesce(mp.input, 0.0)
            + CAST(coalesce(b.completion_tokens, 0) AS DOUBLE) / 1e6 * coalesce(mp.output, 0.0) END AS cost
  FROM msg_base b LEFT JOIN model_price mp ON lower(b.model_used) = mp.model_key
)"""

_PRODUCT_EVENTS = f"""
product_events AS (
  SELECT 'tenant-' || CAST(user_id % {N_TENANTS} AS VARCHAR) AS tenant_id,
         {_event_product_sql(7)} AS product_id,
         CASE event_type WHEN 'view' THEN 'recommended' WHEN 'purchase' THEN 'inquired' WHEN 'click' THEN 'clicked' END AS event_type,
         's' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
         CAST(ts AS TIMESTAMP) AS created_at
  FROM events WHERE event_type IN ('view','purchase','click')
)"""

_VARIANTS = f"""
variants AS (
  SELECT {_LINE_ID} AS id, l_partkey AS product_id,
         'tenant-' || CAST(l_partkey % {N_TENANTS} AS VARCHAR) AS tenant_id,
         'Line ' || CAST(l_linenumber AS VARCHAR) AS title,
         CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price,
         CASE WHEN l_quantity <> 0 AND l_discount <> 1 AND l_discount >= {COMPARE_FROM} THEN (l_extendedprice / l_quantity) / (1.0 - l_discount) END AS compare_at_price,
         l_linenumber AS position, l_returnflag AS option1, l_linestatus AS option2,
         'SKU-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS sku,
         CAST(l_quantity AS INTEGER) AS inventory_quantity,
         {_LINE_ID} AS image_id,
         CAST(l_shipdate AS TIMESTAMP) AS created_at
  FROM lineitem
)"""

_IMAGES = f"""
images AS (
  SELECT {_LINE_ID} AS id, l_partkey AS product_id,
         'tenant-' || CAST(l_partkey % {N_TENANTS} AS VARCHAR) AS tenant_id,
         l_linenumber AS position,
         'https://cdn.example.com/p/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_orderkey AS VARCHAR)
           || '-' || CAST(l_linenumber AS VARCHAR) || '.jpg' AS src
  FROM lineitem WHERE l_linenumber <= {IMAGE_LINES}
)"""

_PRODUCTS = f"""
vroll AS (
  SELECT product_id,
         min(price) AS min_price, max(price) AS max_price,
         bool_or(coalesce(compare_at_price > price, false)) AS has_discount,
         min(created_at) AS created_at, max(created_at) AS updated_at
  FROM variants GROUP BY product_id
),
products AS (
  SELECT p_partkey AS id, 'tenant-' || CAST(p_partkey % {N_TENANTS} AS VARCHAR) AS tenant_id,
         p_partkey + {SOURCE_ID_BASE} AS source_id,
         lower(replace(p_name, ' ', '-')) AS handle,
         p_name AS title, '<p>' || p_name || ' by ' || p_brand || '</p>' AS body_html,
         p_brand AS vendor, p_type AS product_type, p_type || ', ' || p_brand AS tags,
         'active' AS status,
         split_part(p_name, ' ', 1) AS color, CAST(p_size AS VARCHAR) AS size,
         r.min_price, r.max_price, coalesce(r.has_discount, false) AS has_discount,
         r.created_at, r.updated_at,
         CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM part LEFT JOIN vroll r ON r.product_id = p_partkey
            LEFT JOIN embeddings e ON e.vec_id = p_partkey
)"""

_SESSIONS = """
sessions AS (
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
)"""

_TENANTS = """
tenants AS (
  SELECT 'tenant-' || CAST(n_nationkey AS VARCHAR) AS tenant_id, n_name AS name,
         CASE WHEN n_nationkey % 2 = 0 THEN 'Store of ' || n_name END AS description,
         CAST(n_regionkey AS VARCHAR) AS region_setting, 'light' AS theme_setting
  FROM nation
)"""

# name -> (sql, dependencies)
SQL = {
    "msg_base": (_MSG_BASE, []),
    "prices": (_PRICES, []),
    "messages": (_MESSAGES, ["msg_base", "prices"]),
    "product_events": (_PRODUCT_EVENTS, []),
    "variants": (_VARIANTS, []),
    "images": (_IMAGES, []),
    "products": (_PRODUCTS, ["variants"]),
    "sessions": (_SESSIONS, ["messages"]),
    "tenants": (_TENANTS, []),
}


def with_views(*names: str) -> str:
    """'WITH a AS (...), b AS (...)' for the named derived views and their deps."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in SQL[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(SQL[n][0].strip() for n in order) + "\n"
