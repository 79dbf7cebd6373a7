"""Declared schemas, fixed reference values and argument bounds."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Model price table, USD per one million tokens: (prefix, input, output).
DEFAULT_MODEL_PRICES = [
    ("gpt-4.1-nano", 0.10, 0.40),
    ("gpt-4o-mini", 0.15, 0.60),
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
    ("text-embedding-ada-002", 0.10, 0.0),
]

# Intent labels produced by the classifier.
INTENTS = ["product_recommendation", "product_inquiry", "store_brand_question", "unrelated"]

# Intent -> workflow name; anything else (or an error) routes to "error".
INTENT_ROUTES = {
    "product_recommendation": "product_recommendation_graph",
    "product_inquiry": "product_inquiry_graph",
    "store_brand_question": "store_brand_graph",
    "unrelated": "unrelated_graph",
}

# Product analytics event types.
PRODUCT_EVENT_TYPES = ["recommended", "inquired", "clicked"]

# Transcript line prefixes per role.
TRANSCRIPT_PREFIX = {"user": "USER: ", "assistant": "CHATBOT: "}

# Fact-sheet defaults.
NOT_SPECIFIED = "Not specified"
NOT_AVAILABLE = "Not available"

# Default description when a tenant has none (agent context).
DEFAULT_TENANT_DESCRIPTION = "E-commerce store"

# Canonical UUID text form (8-4-4-4-12 hex digits).
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# Argument bounds.
K_DEFAULT, K_MIN, K_MAX = 5, 1, 25
DASHBOARD_DAYS = (1, 90)
EXPORT_DAYS = (1, 365)
TOP_LIMIT = (1, 100)
HISTORY_DEFAULT = 10
HISTORY_CAP = 20
SESSION_TTL_SECONDS = 3600
RATE_LIMIT, RATE_WINDOW_SECONDS = 20, 60
EMBED_BATCH = 100
PAGE_SIZE = 250
PERCENTILES = [0.50, 0.75, 0.90, 0.95, 0.99]


def check_range(name: str, value: int, lo: int, hi: int) -> int:
    if value is None or not (lo <= int(value) <= hi):
        raise ValueError(f"{name} must be in [{lo}, {hi}], got {value!r}")
    return int(value)


# ---------------------------------------------------------------------------
# Nested catalogue document (one product with variants, images, options).
# ---------------------------------------------------------------------------

OPTION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("values", T.ArrayType(T.StringType())),
])

IMAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("alt", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("src", T.StringType()),
    T.StructField("admin_graphql_api_id", T.StringType()),
    T.StructField("variant_ids", T.ArrayType(T.LongType())),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

VARIANT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("compare_at_price", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("inventory_policy", T.StringType()),
    T.StructField("option1", T.StringType()),
    T.StructField("option2", T.StringType()),
    T.StructField("option3", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("grams", T.IntegerType()),
    T.StructField("weight", T.StringType()),
    T.StructField("weight_unit", T.StringType()),
    T.StructField("inventory_item_id", T.LongType()),
    T.StructField("inventory_quantity", T.IntegerType()),
    T.StructField("old_inventory_quantity", T.IntegerType()),
    T.StructField("inventory_management", T.StringType()),
    T.StructField("fulfillment_service", T.StringType()),
    T.StructField("taxable", T.BooleanType()),
    T.StructField("requires_shipping", T.BooleanType()),
    T.StructField("admin_graphql_api_id", T.StringType()),
    T.StructField("image_id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

CATALOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("handle", T.StringType()),
    T.StructField("body_html", T.StringType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("product_type", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("template_suffix", T.StringType()),
    T.StructField("published_scope", T.StringType()),
    T.StructField("admin_graphql_api_id", T.StringType()),
    T.StructField("options", T.ArrayType(OPTION)),
    T.StructField("images", T.ArrayType(IMAGE)),
    T.StructField("variants", T.ArrayType(VARIANT)),
])

# The fields a catalogue page request asks for, in request order.
PAGE_FIELDS = ["id", "title", "handle", "body_html", "vendor", "product_type", "tags",
               "status", "created_at", "updated_at", "published_at", "options",
               "images", "variants"]

# ---------------------------------------------------------------------------
# Relational tables (flat).
# ---------------------------------------------------------------------------

MESSAGES = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("structured_data", T.StringType()),
    T.StructField("latency_ms", T.LongType()),
])

SESSIONS = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("message_count", T.LongType()),
    T.StructField("llm_call_count", T.LongType()),
    T.StructField("total_tokens_used", T.LongType()),
    T.StructField("estimated_cost", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("avg_latency_ms", T.DoubleType()),
    T.StructField("max_latency_ms", T.LongType()),
    T.StructField("min_latency_ms", T.LongType()),
    T.StructField("latency_count", T.LongType()),
])

PRODUCT_EVENTS = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

MODEL_PRICES = T.StructType([
    T.StructField("prefix", T.StringType(), False),
    T.StructField("input", T.DoubleType(), False),
    T.StructField("output", T.DoubleType(), False),
])


MONEY, MONEY_3, MONEY_4, MONEY_6 = (T.DecimalType(10, d) for d in (2, 3, 4, 6))


def _fields(**types) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in types.items()])


_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

TENANTS = _fields(
    tenant_id=_S, name=_S, description=_S, brand_voice=_S, store_url=_S, logo_url=_S,
    settings=T.MapType(_S, _S), created_at=_TS, updated_at=_TS)

PRODUCTS = _fields(
    id=_L, tenant_id=_S, source_id=_L, handle=_S, title=_S, body_html=_S, vendor=_S, product_type=_S, tags=_S,
    status=_S, template_suffix=_S, published_scope=_S, source_api_id=_S, published_at=_TS, min_price=MONEY,
    max_price=MONEY, has_discount=_B, options=T.MapType(_S, T.ArrayType(_S)), embedding_json=_S,
    embedding=T.ArrayType(T.FloatType()), created_at=_TS, updated_at=_TS)

IMAGES = _fields(
    id=_L, product_id=_L, tenant_id=_S, source_image_id=_L, source_product_id=_L, alt=_S, position=_I, width=_I,
    height=_I, src=_S, source_api_id=_S, variant_ids=T.ArrayType(_L), created_at=_TS, updated_at=_TS)

VARIANTS = _fields(
    id=_L, product_id=_L, tenant_id=_S, source_variant_id=_L, source_product_id=_L, title=_S, price=MONEY,
    compare_at_price=MONEY, position=_I, inventory_policy=_S, option1=_S, option2=_S, option3=_S, sku=_S, barcode=_S,
    grams=_I, weight=MONEY_3, weight_unit=_S, inventory_item_id=_L, inventory_quantity=_I, old_inventory_quantity=_I,
    inventory_management=_S, fulfillment_service=_S, taxable=_B, requires_shipping=_B, source_api_id=_S, image_id=_L,
    source_image_id=_L, created_at=_TS, updated_at=_TS)

# Stored tables by name.
TABLES = {"tenants": TENANTS, "products": PRODUCTS, "images": IMAGES, "variants": VARIANTS,
          "messages": MESSAGES, "sessions": SESSIONS, "product_events": PRODUCT_EVENTS}
