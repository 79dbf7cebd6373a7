"""Product filters, image joins, ordered lookup and vector ranking.

Filters are plain Column predicates so Catalyst pushes them to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storelens.functions.vector import cosine_similarity
from storelens.operators.common import for_tenant, top_k_per_group
from storelens.schemas import K_DEFAULT, K_MAX, K_MIN, check_range

INT_MAX = 2_147_483_647


# ---------------------------------------------------------------------------
# F3-F9, F14 predicates
# ---------------------------------------------------------------------------

def product_filter(product_type: str | None = None, min_price: float | None = None,
                   max_price: float | None = None, has_discount: bool | None = None) -> Column:
    """AND of the optional predicates; absent parts are TRUE.

    F4 price-range overlap (inclusive; 0 is a real bound; NULL prices fail a
    given bound), F5 exact type ('' = no filter), F6 discount flag.  The result is
    for ``where``: plain comparisons, NULL for false, so that scans take them.
    """
    cond = F.lit(True)
    if product_type:
        cond = cond & (F.col("product_type") == F.lit(product_type))
    if min_price is not None:
        cond = cond & (F.col("max_price") >= F.lit(float(min_price)))
    if max_price is not None:
        cond = cond & (F.col("min_price") <= F.lit(float(max_price)))
    if has_discount is not None:
        cond = cond & (F.col("has_discount") == F.lit(bool(has_discount)))
    return cond


def filter_products(products: DataFrame, tenant_id: str | None = None, **filters) -> DataFrame:
    """F3 over a products table (F1 tenant scope first)."""
    return for_tenant(products, tenant_id).where(product_filter(**filters))


def vendor_equals(products: DataFrame, vendor: str) -> DataFrame:
    """F7."""
    return products.where(F.col("vendor") == F.lit(vendor))


def tag_contains(products: DataFrame, text: str) -> DataFrame:
    """F8: substring match on the tag text."""
    return products.where(F.coalesce(F.col("tags").contains(F.lit(text)), F.lit(False)))


def option_has(products: DataFrame, name: str, value: str) -> DataFrame:
    """the options map lists ``value`` under ``name``."""
    vals = F.try_element_at(F.col("options"), F.lit(name))
    return products.where(F.coalesce(F.array_contains(vals, F.lit(value)), F.lit(False)))


def by_category(products: DataFrame, category: str | None) -> DataFrame:
    """storefront category filter; blank means all."""
    return products if not category else products.where(F.col("product_type") == F.lit(category))


# ---------------------------------------------------------------------------
# J2 / J3 image joins
# ---------------------------------------------------------------------------

def with_primary_image(products: DataFrame, images: DataFrame) -> DataFrame:
    """LEFT JOIN images ON product AND position = 1.

    Several position-1 images duplicate the product (as in the reference).
    """
    img = images.where(F.col("position") == 1).select(F.col("product_id").alias("_pid"),
                                                      F.col("src").alias("image_url"))
    return products.join(img, products["id"] == img["_pid"], "left").drop("_pid")


def first_image(images: DataFrame) -> DataFrame:
    """Lowest-position image per (tenant, product); NULL position last, ties on
    id, then on src (fully deterministic).

    ``min`` over a (position, id, src) struct is a mergeable aggregate: a
    product with many images costs one partial row per task, never a
    collected list.  The long product key leads the grouping so the
    sort-based aggregate rarely compares the tenant string.
    """
    best = F.min(F.struct(F.coalesce(F.col("position"), F.lit(INT_MAX)).alias("p"),
                          F.col("id").alias("i"), F.col("src").alias("s")))
    return (images.groupBy("product_id", "tenant_id").agg(best["s"].alias("image_url"))
            .select("tenant_id", "product_id", "image_url"))


def with_first_image(products: DataFrame, images: DataFrame) -> DataFrame:
    """LEFT JOIN LATERAL (... ORDER BY position LIMIT 1), tenant matched too."""
    fi = first_image(images).withColumnRenamed("tenant_id", "_t").withColumnRenamed("product_id", "_pid")
    cond = (products["id"] == fi["_pid"]) & (products["tenant_id"] == fi["_t"])
    return products.join(fi, cond, "left").drop("_t", "_pid")


# ---------------------------------------------------------------------------
# J4 ordered lookup, J13 / J14
# ---------------------------------------------------------------------------

def lookup_ordered(products: DataFrame, ids: DataFrame, tenant_id: str | None = None,
                   key: list | None = None) -> DataFrame:
    """Products whose id is in the list, in list order, each once.

    ``ids`` has columns (``key``..., pos, id) - one list per key (e.g. per
    request).  Missing ids vanish; duplicates keep their first position.
    The lists are pre-reduced to one row per (key, id) before the join; the
    planner (AQE) broadcasts them when they are small at runtime.
    Sort by (key..., pos) for the reference's order.
    """
    key = key or []
    first = ids.groupBy(*key, "id").agg(F.min("pos").alias("pos"))
    p = for_tenant(products, tenant_id)
    return p.join(first, "id", "inner")


def ids_from_array(df: DataFrame, array_col: str, key: list) -> DataFrame:
    """(key..., array<id>) -> (key..., pos, id), positions from 0."""
    return df.select(*key, F.posexplode(array_col).alias("pos", "id"))


def semantic_within(products: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Restrict to candidate ids; an absent or empty list means no restriction."""
    if ids is None or ids.isEmpty():
        return products
    return products.join(ids.select("id").distinct(), "id", "left_semi")


# ---------------------------------------------------------------------------
# X9 / O3 vector ranking
# ---------------------------------------------------------------------------

def score(products: DataFrame, query_vec: Column, out_col: str = "similarity") -> DataFrame:
    """Cosine similarity of each product embedding to ``query_vec``."""
    return products.where(F.col("embedding").isNotNull()) \
                   .withColumn(out_col, cosine_similarity(F.col("embedding"), query_vec))


def semantic_topk(products: DataFrame, query_vec, k: int = K_DEFAULT, tenant_id: str | None = None) -> DataFrame:
    """O3: top-k by similarity (ties on id), per tenant when ``tenant_id`` is None.

    ``query_vec`` is a column or a Python list (an embedded query).
    """
    k = check_range("k", k, K_MIN, K_MAX)
    if not isinstance(query_vec, Column):
        query_vec = F.array(*[F.lit(float(x)) for x in query_vec])
    scored = score(for_tenant(products, tenant_id), query_vec)
    return top_k_per_group(scored, ["tenant_id"], [F.col("similarity").desc(), F.col("id").asc()], k)


# ---------------------------------------------------------------------------
# F15 / F16 projections, S10 serialisation
# ---------------------------------------------------------------------------

def product_cards(products_with_image: DataFrame) -> DataFrame:
    """display card; vendor '' if NULL, prices 0 if NULL/0, discount false if NULL."""
    p = products_with_image
    return p.select(
        "id", F.col("source_id").cast("string").alias("source_id"),
        F.col("title").alias("name"), F.coalesce("vendor", F.lit("")).alias("vendor"),
        F.col("image_url") if "image_url" in p.columns else F.lit(None).cast("string").alias("image_url"),
        F.coalesce(F.col("min_price").cast("double"), F.lit(0.0)).alias("price_min"),
        F.coalesce(F.col("max_price").cast("double"), F.lit(0.0)).alias("price_max"),
        F.coalesce("has_discount", F.lit(False)).alias("has_discount"))


def product_details(products: DataFrame) -> DataFrame:
    """F16: detail projection; a price of 0 or NULL becomes NULL."""
    return products.select(
        "id", "title", "product_type", "body_html",
        F.when(F.col("min_price") != 0, F.col("min_price").cast("double")).alias("min_price"),
        F.when(F.col("max_price") != 0, F.col("max_price").cast("double")).alias("max_price"),
        "options", "tags")


def products_to_json(results: DataFrame, key: str = "query_id", order: str = "rank") -> DataFrame:
    """One JSON array per query, elements in rank order.

    Groups are bounded by k (<= 25), so the ordered collect is small.
    """
    cols = [c for c in results.columns if c != key]
    packed = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"),
                                                                            F.struct(*cols).alias("r")))).alias("_a"))
    return packed.select(key, F.to_json(F.transform("_a", lambda e: e["r"])).alias("json"))
