"""S1-S4, A16, A20-A22, J5, X8, M2, P3 on the JSON fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES, ts
from storelens.operators.catalog import (flatten_variants, ingest_summary, replace_products,
                                         resolve_variant_images, variant_rollup, variant_rollup_flat,
                                         variants_per_product)
from storelens.plans.ingest import ingest_catalog, write_catalog_tables
from storelens.sources.catalog import (read_catalog_json, read_catalog_pages, to_csv_frame,
                                       write_catalog, write_variants_csv)

T = "00000000-0000-0000-0000-000000000001"


@pytest.fixture(scope="module")
def raw(spark):
    return read_catalog_json(spark, os.path.join(FIXTURES, "catalog_array.json")).cache()


def test_read_both_shapes(spark, raw):
    wrapped = read_catalog_json(spark, os.path.join(FIXTURES, "catalog_wrapped.json"))
    assert raw.count() == 5
    assert sorted(r.id for r in wrapped.collect()) == [101, 102]


def test_read_bad_shape_raises(spark):
    with pytest.raises(Exception):
        read_catalog_json(spark, os.path.join(FIXTURES, "catalog_bad.json")).collect()


def test_variant_rollup_nested(raw):
    rows = {r.id: r.v for r in raw.select("id", variant_rollup("variants").alias("v")).collect()}
    # 101: prices 20.00, 0.00 (kept), '' skipped, 'abc' skipped, 35.50 -> min 0, max 35.5;
    # discount: 25 > 20 yes
    assert rows[101].min_price == 0.0 and rows[101].max_price == 35.5 and rows[101].has_discount is True
    # 102: empty variants -> NULL prices, no discount; 103: NULL variants
    assert rows[102].min_price is None and rows[102].has_discount is False
    assert rows[103].max_price is None and rows[103].has_discount is False


def test_variant_rollup_flat_matches_nested(raw):
    flat = raw.select(F.col("id").alias("product_id"), F.explode("variants").alias("v")) \
              .select("product_id", "v.price", "v.compare_at_price")
    got = {r.product_id: (r.min_price, r.max_price, r.has_discount) for r in variant_rollup_flat(flat).collect()}
    assert got[101] == (0.0, 35.5, True)


def test_ingest_catalog_end_to_end(spark, raw):
    out = ingest_catalog(raw, T)
    products = {r.source_id: r for r in out["products"].collect()}
    rejects = [r.source_id for r in out["rejects"].collect()]
    assert rejects == [103]
    assert sorted(products) == [101, 102, 104]
    # same id twice: the newer document wins
    assert products[104].title == "Hat v2" and products[104].has_discount is False
    assert products[101].options == {"Color": ["Green"], "Size": ["S", "M"]}
    assert products[101].published_at == ts("2024-01-03 10:00:00")
    assert products[101].created_at == ts("2024-01-02 15:00:00")
    assert products[102].published_at is None
    ej = products[101].embedding_json
    assert '"description":"Warm&nbsp;jacket var x = 1; Green edition"' in ej
    # surrogate ids are deterministic
    again = {r.source_id: r.id for r in ingest_catalog(raw, T)["products"].collect()}
    assert again[101] == products[101].id

    variants = {r.source_variant_id: r for r in out["variants"].collect()}
    assert variants[5001].image_id is not None          # own image resolves
    assert variants[5002].image_id is None              # unknown image id does not
    assert variants[5004].price is None and variants[5004].weight is None
    assert variants[5002].price == 0.0
    images = {r.source_image_id: r for r in out["images"].collect()}
    assert images[9001].variant_ids == [5001] and images[9002].variant_ids == []
    s = out["summary"].first()
    assert (s.products, s.variants, s.images) == (3, 6, 5)


def test_replace_products_with_cascade(spark, raw):
    first = ingest_catalog(raw, T)
    current = {k: first[k] for k in ("products", "images", "variants")}
    update = raw.where(F.col("id") == 101).withColumn("title", F.lit("Trail Jacket II")) \
                .withColumn("updated_at", F.lit("2024-02-01T00:00:00Z")) \
                .withColumn("variants", F.slice("variants", 1, 1))
    second = ingest_catalog(update, T, current=current)
    titles = {r.source_id: r.title for r in second["products"].collect()}
    assert titles == {101: "Trail Jacket II", 102: "Plain Mug", 104: "Hat v2"}
    v = [r.source_variant_id for r in second["variants"].collect()]
    assert sorted(v) == [5001, 5101]


def test_resolve_variant_images_flat(spark):
    variants = spark.createDataFrame([(1, 10, "t", 900), (2, 10, "t", 901), (3, 11, "t", 900)],
                                     "id long, product_id long, tenant_id string, source_image_id long")
    images = spark.createDataFrame([(77, 10, "t", 900), (78, 12, "t", 901)],
                                   "id long, product_id long, tenant_id string, source_image_id long")
    got = {r.id: r.image_id for r in resolve_variant_images(variants, images).collect()}
    assert got == {1: 77, 2: None, 3: None}


def test_flatten_and_counts(raw):
    flat = flatten_variants(raw)
    assert flat.where("product_id = 102").count() == 0   # no variants -> vanishes
    r = variants_per_product(flat).first()
    assert r.variant_rows == 7 and r.products == 2 and r.avg_variants_per_product == 3.5
    s = ingest_summary(raw).first()
    assert (s.products, s.variants, s.images) == (5, 7, 5)


def test_replace_products_keyed(spark):
    cur = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b")], "tenant_id string, source_id long, title string")
    new = spark.createDataFrame([("t", 2, "B"), ("t", 3, "C")], "tenant_id string, source_id long, title string")
    got = sorted((r.source_id, r.title) for r in replace_products(cur, new).collect())
    assert got == [(1, "a"), (2, "B"), (3, "C")]


def test_writers_and_pages(spark, raw, tmp_path):
    write_catalog(raw, str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 5
    from storelens.sources.catalog import read_catalog_ndjson, write_catalog_pages
    back = read_catalog_ndjson(spark, str(tmp_path / "nd"))
    assert sorted(r.id for r in back.collect()) == sorted(r.id for r in raw.collect())
    write_catalog_pages(raw, str(tmp_path / "pages"), page_size=2)
    paged = read_catalog_pages(spark, str(tmp_path / "pages"), multiline=False)
    assert paged.count() == 5
    lines = spark.read.text(str(tmp_path / "pages")).collect()
    assert all(r.value.count('"handle"') <= 2 for r in lines) and len(lines) >= 3
    flat = flatten_variants(raw)
    other = flat.select("variant_id", F.lit("x").alias("extra"))
    write_variants_csv([flat, other], str(tmp_path / "csv"))
    header = spark.read.option("header", True).csv(str(tmp_path / "csv")).columns
    assert header == sorted(header) and "extra" in header and "tags" in header
    csv_frame = to_csv_frame(flat)
    assert dict(csv_frame.dtypes)["tags"] == "string"
    pages = read_catalog_pages(spark, os.path.join(FIXTURES, "catalog_wrapped.json"))
    assert pages.count() == 2


def test_write_catalog_tables(spark, raw, tmp_path):
    out = ingest_catalog(raw, T)
    write_catalog_tables(out, str(tmp_path / "db"))
    back = spark.read.parquet(str(tmp_path / "db" / "products")).where(F.col("tenant_id") == T)
    assert back.count() == 3


def test_set_null_on_missing_image(spark):
    from storelens.operators.catalog import set_null_on_missing_image
    variants = spark.createDataFrame([(1, 77), (2, 78), (3, None)], "id long, image_id long")
    images = spark.createDataFrame([(77,), (77,)], "id long")        # duplicate ids must not multiply rows
    got = {r.id: r.image_id for r in set_null_on_missing_image(variants, images).collect()}
    assert got == {1: 77, 2: None, 3: None}
