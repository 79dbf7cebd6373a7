"""Catalogue normalisation: nested product documents -> product/variant/image tables.

Nested operators work on one document's arrays with higher-order functions
(no explode, no shuffle); flat operators work on already-normalised tables
with grouped aggregates (map-side partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storelens.functions.catalog import (clean_variant_ids, embedding_json, options_map, parse_ts,
                                         safe_numbers, split_tags)


def _num(c: Column) -> Column:
    return F.when(F.length(c) > 0, c).try_cast("double")


def _money(c: Column, scale: int = 2) -> Column:
    """A price as stored: DECIMAL(10, scale), NULL beyond its range."""
    return c.try_cast(f"decimal(10,{scale})")


def _given(raw: DataFrame, name: str) -> Column:
    """A document field that a source may leave out."""
    return (F.col(name) if name in raw.columns else F.lit(None).cast("string")).alias(name)


def surrogate_id(tenant: Column, natural: Column) -> Column:
    """Deterministic surrogate key: a rerun never renumbers rows."""
    return F.xxhash64(tenant, natural)


# ---------------------------------------------------------------------------
# A16 variant rollup
# ---------------------------------------------------------------------------

def variant_rollup(variants: str | Column = "variants") -> Column:
    """A16 (nested): struct(min_price, max_price, has_discount) from a variants array.

    Empty/NULL price skipped, unparsable price skipped; a variant is on
    discount when its compare-at price parses and is strictly higher.
    """
    v = F.coalesce(F.col(variants) if isinstance(variants, str) else variants, F.array())
    prices = F.filter(F.transform(v, lambda x: _num(x["price"])), lambda p: p.isNotNull())
    disc = F.exists(v, lambda x: F.coalesce(_num(x["compare_at_price"]) > _num(x["price"]), F.lit(False)))
    return F.struct(F.array_min(prices).alias("min_price"), F.array_max(prices).alias("max_price"),
                    disc.alias("has_discount"))


def variant_rollup_flat(variants: DataFrame, key: str = "product_id", price: str = "price",
                        compare_at: str = "compare_at_price", extra: list | None = None) -> DataFrame:
    """A16 (flat): the same rollup over a variants table, one row per product.

    String prices are parsed with the same rules; numeric ones are used as is.
    ``extra`` aggregate columns ride along in the same aggregation (one
    shuffle of the variants, with map-side partial aggregation).
    """
    def num(c: str) -> Column:
        t = dict(variants.dtypes)[c]
        return _num(F.col(c)) if t == "string" else F.col(c).cast("double")
    p, c = num(price), num(compare_at)
    return variants.groupBy(key).agg(
        F.min(p).alias("min_price"), F.max(p).alias("max_price"),
        F.coalesce(F.bool_or(F.coalesce(c > p, F.lit(False))), F.lit(False)).alias("has_discount"),
        *(extra or []))


# ---------------------------------------------------------------------------
# P3 pieces: nested documents -> three tables
# ---------------------------------------------------------------------------

def normalise_products(raw: DataFrame, tenant_id: str) -> DataFrame:
    """Product rows from catalogue documents.

    Rows whose created_at/updated_at do not parse are kept here with NULLs;
    ``split_rejects`` separates them (the reference halts the ingest).
    """
    t = F.lit(tenant_id)
    roll = variant_rollup("variants")
    return raw.select(
        surrogate_id(t, F.col("id")).alias("id"),
        t.alias("tenant_id"),
        F.col("id").alias("source_id"),
        "handle", "title", "body_html", "vendor", "product_type", "tags", "status",
        _given(raw, "template_suffix"), _given(raw, "published_scope"),
        _given(raw, "admin_graphql_api_id").alias("source_api_id"),
        parse_ts("published_at").alias("published_at"),
        _money(roll["min_price"]).alias("min_price"), _money(roll["max_price"]).alias("max_price"),
        roll["has_discount"].alias("has_discount"),
        options_map("options").alias("options"),
        embedding_json().alias("embedding_json"),
        F.lit(None).cast("array<float>").alias("embedding"),
        parse_ts("created_at").alias("created_at"),
        parse_ts("updated_at").alias("updated_at"),
    )


def split_rejects(products: DataFrame):
    """(good, rejects): the id, created_at and updated_at are required."""
    ok = F.col("source_id").isNotNull() & F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()
    return products.where(ok), products.where(~ok)


def normalise_images(raw: DataFrame, tenant_id: str) -> DataFrame:
    """One row per image of each document (X6 variant ids cleaned)."""
    t = F.lit(tenant_id)
    img = raw.select(F.col("id").alias("_pid"), F.explode("images").alias("i"))
    return img.select(
        surrogate_id(t, F.col("i.id")).alias("id"),
        surrogate_id(t, F.col("_pid")).alias("product_id"),
        t.alias("tenant_id"),
        F.col("i.id").alias("source_image_id"), F.col("_pid").alias("source_product_id"),
        F.col("i.alt").alias("alt"), F.col("i.position").alias("position"),
        F.col("i.width").alias("width"), F.col("i.height").alias("height"),
        F.col("i.src").alias("src"), F.col("i.admin_graphql_api_id").alias("source_api_id"),
        clean_variant_ids(F.col("i.variant_ids")).alias("variant_ids"),
        parse_ts(F.col("i.created_at")).alias("created_at"),
        parse_ts(F.col("i.updated_at")).alias("updated_at"),
    )


def normalise_variants(raw: DataFrame, tenant_id: str) -> DataFrame:
    """One row per variant (X5 joint numeric parse, J5 image resolved in-document).

    The variant's image id resolves only against images of the *same*
    document, evaluated on the document's own array - no join.
    """
    t = F.lit(tenant_id)
    v = raw.select(F.col("id").alias("_pid"), F.col("images").alias("_imgs"), F.explode("variants").alias("v"))
    nums = safe_numbers(F.col("v.price"), F.col("v.compare_at_price"), F.col("v.weight"))
    own_image = F.exists(F.coalesce("_imgs", F.array()), lambda i: i["id"] == F.col("v.image_id"))
    return v.select(
        surrogate_id(t, F.col("v.id")).alias("id"),
        surrogate_id(t, F.col("_pid")).alias("product_id"),
        t.alias("tenant_id"),
        F.col("v.id").alias("source_variant_id"), F.col("_pid").alias("source_product_id"),
        F.col("v.title").alias("title"),
        _money(nums["price"]).alias("price"), _money(nums["compare_at_price"]).alias("compare_at_price"),
        F.col("v.position").alias("position"), F.col("v.inventory_policy").alias("inventory_policy"),
        F.col("v.option1").alias("option1"), F.col("v.option2").alias("option2"),
        F.col("v.option3").alias("option3"), F.col("v.sku").alias("sku"),
        F.col("v.barcode").alias("barcode"), F.col("v.grams").alias("grams"),
        _money(nums["weight"], 3).alias("weight"), F.col("v.weight_unit").alias("weight_unit"),
        F.col("v.inventory_item_id").alias("inventory_item_id"),
        F.col("v.inventory_quantity").alias("inventory_quantity"),
        F.col("v.old_inventory_quantity").alias("old_inventory_quantity"),
        F.col("v.inventory_management").alias("inventory_management"),
        F.col("v.fulfillment_service").alias("fulfillment_service"), F.col("v.taxable").alias("taxable"),
        F.col("v.requires_shipping").alias("requires_shipping"),
        F.col("v.admin_graphql_api_id").alias("source_api_id"),
        F.when(own_image, surrogate_id(t, F.col("v.image_id"))).alias("image_id"),
        F.col("v.image_id").alias("source_image_id"),
        parse_ts(F.col("v.created_at")).alias("created_at"),
        parse_ts(F.col("v.updated_at")).alias("updated_at"),
    )


def resolve_variant_images(variants: DataFrame, images: DataFrame) -> DataFrame:
    """J5 (flat): variant.source_image_id -> image.id within the same product.

    A left join on (tenant, product, source image id); an image of another
    product never matches.
    """
    # one image per (tenant, product, source id) even if the source repeats an
    # id, so the left join never multiplies variants
    img = (images.groupBy(F.col("tenant_id").alias("_t"), F.col("product_id").alias("_p"),
                          F.col("source_image_id").alias("_s"))
           .agg(F.min("id").alias("_img")))
    cond = ((variants["tenant_id"] == img["_t"]) & (variants["product_id"] == img["_p"])
            & (variants["source_image_id"] == img["_s"]))
    return (variants.join(img, cond, "left")
            .withColumn("image_id", F.col("_img")).drop("_t", "_p", "_s", "_img"))


def set_null_on_missing_image(variants: DataFrame, images: DataFrame) -> DataFrame:
    """M4: image_id of a variant whose image row is gone becomes NULL (FK SET NULL)."""
    alive = images.select(F.col("id").alias("_img")).distinct()     # never multiplies variants
    return (variants.join(alive, variants["image_id"] == alive["_img"], "left")
            .withColumn("image_id", F.col("_img")).drop("_img"))


# ---------------------------------------------------------------------------
# X8 flatten, A20-A22
# ---------------------------------------------------------------------------

def flatten_variants(raw: DataFrame) -> DataFrame:
    """One row per variant with the product's base columns.

    Products without variants vanish (inner explode).  Tags become an array
    and images a list of their sources.
    """
    base = raw.select(
        F.col("id").alias("product_id"), "title", "handle", "vendor", "product_type",
        split_tags("tags").alias("tags"),
        F.transform(F.coalesce("images", F.array()), lambda i: i["src"]).alias("image_srcs"),
        F.explode("variants").alias("v"))
    return base.select("product_id", "title", "handle", "vendor", "product_type", "tags", "image_srcs",
                       F.col("v.id").alias("variant_id"), F.col("v.title").alias("variant_title"),
                       F.col("v.price").alias("price"), F.col("v.compare_at_price").alias("compare_at_price"),
                       F.col("v.sku").alias("sku"), F.col("v.option1").alias("option1"),
                       F.col("v.option2").alias("option2"), F.col("v.option3").alias("option3"),
                       F.col("v.inventory_quantity").alias("inventory_quantity"))


def ingest_summary(raw: DataFrame, good: Column | None = None) -> DataFrame:
    """Products, variants and images in a batch of documents, and how many
    documents succeeded and failed (``good``: those that can be stored)."""
    good = F.lit(True) if good is None else F.coalesce(good, F.lit(False))
    size = lambda c: F.coalesce(F.sum(F.when(good, F.size(F.coalesce(c, F.array())))), F.lit(0)).cast("long")
    return raw.agg(F.count(F.when(good, F.lit(1))).alias("products"), size("variants").alias("variants"),
                   size("images").alias("images"), F.count(F.when(good, F.lit(1))).alias("successful"),
                   F.count(F.when(~good, F.lit(1))).alias("failed"))


def variants_per_product(flat: DataFrame, key: str = "product_id") -> DataFrame:
    """Variant rows, distinct products, average variants per product (1 decimal)."""
    return flat.agg(F.count(F.lit(1)).alias("variant_rows"),
                    F.count_distinct(key).alias("products")) \
               .withColumn("avg_variants_per_product",
                           F.round(F.try_divide(F.col("variant_rows").cast("double"), F.col("products")), 1))


def distinct_types(products: DataFrame, key: str | None = "tenant_id") -> DataFrame:
    """Distinct non-NULL product types (per tenant), sorted."""
    cols = ([key] if key else []) + ["product_type"]
    return (products.where(F.col("product_type").isNotNull()).select(*cols).distinct()
            .orderBy(*cols))


# ---------------------------------------------------------------------------
# M2 replace_products (U2) with cascade
# ---------------------------------------------------------------------------

def replace_products(current: DataFrame, incoming: DataFrame, key: list | None = None) -> DataFrame:
    """Rows of ``current`` not re-sent, plus every ``incoming`` row.

    Replace-by-key = left_anti + unionByName.  ``incoming`` should hold one row
    per key (see ``latest_per_key``).
    """
    key = key or ["tenant_id", "source_id"]
    kept = current.join(incoming.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def cascade_children(children: DataFrame, parents_removed: DataFrame, fk: str = "product_id") -> DataFrame:
    """Children whose parent was deleted or replaced disappear (ON DELETE CASCADE).

    Ids are compared within a tenant where both sides name one."""
    keys = ["tenant_id"] if "tenant_id" in children.columns and "tenant_id" in parents_removed.columns else []
    gone = parents_removed.select(*keys, F.col("id").alias(fk)).distinct()
    return children.join(gone, [*keys, fk], "left_anti")
