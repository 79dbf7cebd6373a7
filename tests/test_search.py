"""F3-F9, J2-J4, J13/J14, O3, P1, P2, P7 - mirrors the reference's search tests."""

import pytest
from pyspark.sql import functions as F

from conftest import ts
from storelens.operators.search import (filter_products, first_image, ids_from_array, lookup_ordered,
                                        option_has, product_cards, products_to_json, semantic_topk,
                                        tag_contains, vendor_equals, with_first_image, with_primary_image)
from storelens.plans.search import catalogue_listing, search_batch, search_products

T = "t1"
SCHEMA = ("id long, tenant_id string, source_id long, title string, vendor string, product_type string, "
          "tags string, min_price double, max_price double, has_discount boolean, options map<string,array<string>>, "
          "body_html string, updated_at timestamp, embedding array<float>, handle string")


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        (1, T, 11, "Green Hat", "United By Blue", "Accessories", "hat, green", 10.0, 20.0, True,
         {"Color": ["Green", "Blue"]}, "<p>hat</p>", ts("2024-01-05 00:00:00"), [1.0, 0.0], "green-hat"),
        (2, T, 12, "Blue Scarf", "Acme", "Accessories", "scarf", 30.0, 30.0, False,
         {"Color": ["Blue"]}, None, ts("2024-01-04 00:00:00"), [0.0, 1.0], "blue-scarf"),
        (3, T, 13, "Mug", "Acme", "Kitchen", "mug, sale", 0.0, 0.0, False,
         {}, "", ts("2024-01-06 00:00:00"), None, "mug"),
        (4, T, 14, "Boot", None, "Shoes", "boot", None, None, None,
         None, None, None, [0.7, 0.7], "boot"),
        (5, "t2", 15, "Other tenant", "Acme", "Accessories", "x", 5.0, 6.0, True,
         {}, None, ts("2024-01-07 00:00:00"), [1.0, 0.0], "other"),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_type_vendor_tag_option_filters(products):
    assert ids(filter_products(products, T, product_type="Accessories")) == [1, 2]
    assert ids(filter_products(products, T, product_type="")) == [1, 2, 3, 4]   # '' = no filter
    assert ids(vendor_equals(products, "United By Blue")) == [1]
    assert ids(tag_contains(products, "sal")) == [3]
    assert ids(option_has(products, "Color", "Green")) == [1]
    assert ids(option_has(products, "Size", "S")) == []


def test_price_range_overlap_and_discount(products):
    assert ids(filter_products(products, T, min_price=15.0, max_price=25.0)) == [1]
    assert ids(filter_products(products, T, min_price=0.0)) == [1, 2, 3]       # 0 is a bound; NULL drops out
    assert ids(filter_products(products, T, max_price=0.0)) == [3]
    assert ids(filter_products(products, T, has_discount=True)) == [1]
    assert ids(filter_products(products, T, product_type="Accessories", max_price=25.0, has_discount=True)) == [1]


def test_search_filters_only_newest_first(products):
    r = search_products(products, T, product_type="Accessories", k=5).orderBy("rank").collect()
    assert [x.id for x in r] == [1, 2] and all(x.similarity is None for x in r)


def test_search_semantic_only_scores_in_range(products):
    r = search_products(products, T, query_vec=[1.0, 0.1], k=5).orderBy("rank").collect()
    assert [x.id for x in r] == [1, 4, 2]          # product 3 has no embedding
    assert all(-1.0 <= x.similarity <= 1.0 for x in r)
    assert r[0].similarity >= r[1].similarity >= r[2].similarity


def test_search_combined_and_k(products):
    r = search_products(products, T, product_type="Accessories", query_vec=[0.0, 1.0], k=1).collect()
    assert [x.id for x in r] == [2]
    assert len(search_products(products, T, query_vec=[1.0, 0.0], k=2).collect()) == 2


def test_search_empty_result_and_fallback(products):
    assert search_products(products, T, product_type="Nope", k=5).count() == 0
    fb = search_products(products, T, product_type="Nope", query_vec=[1.0, 0.0], k=5)
    assert ids(fb) == [1, 2, 4]                     # whole tenant, products with embeddings
    assert search_products(products, T, product_type="Nope", query_vec=[1.0, 0.0], k=5,
                           fallback_unfiltered=False).count() == 0


def test_search_detail_projection(products):
    r = search_products(products, T, product_type="Kitchen", k=5).first()
    assert r.min_price is None and r.max_price is None     # 0 -> NULL in the detail view
    with pytest.raises(ValueError):
        search_products(products, T, k=26)


def test_search_batch_matches_single(spark, products):
    q = spark.createDataFrame(
        [(1, T, "Accessories", None, None, None, [0.0, 1.0], 1), (2, T, None, 15.0, None, None, None, 5),
         (3, "t2", None, None, None, True, [1.0, 0.0], 3)],
        "query_id long, tenant_id string, product_type string, min_price double, max_price double, "
        "has_discount boolean, query_vec array<double>, k int")
    got = {}
    for r in search_batch(products, q).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    assert sorted(got[1]) == [(1, 2)]
    assert sorted(got[2]) == [(1, 1), (2, 2)]
    assert sorted(got[3]) == [(1, 5)]


def test_semantic_topk_per_tenant(products):
    r = semantic_topk(products, [1.0, 0.0], k=1).collect()
    assert sorted((x.tenant_id, x.id) for x in r) == [(T, 1), ("t2", 5)]


def test_images_primary_and_first(spark, products):
    images = spark.createDataFrame(
        [(100, 1, T, 1, "a.jpg"), (101, 1, T, 1, "b.jpg"), (102, 2, T, 2, "c.jpg"), (103, 2, T, None, "d.jpg"),
         (104, 3, T, None, "e.jpg"), (105, 1, "t2", 0, "wrong-tenant.jpg")],
        "id long, product_id long, tenant_id string, position int, src string")
    prim = with_primary_image(products.where("tenant_id = 't1'"), images)
    assert prim.where("id = 1").count() == 2          # two position-1 images duplicate the product
    assert prim.where("id = 2").first().image_url is None
    fi = {r.id: r.image_url for r in with_first_image(products, images).collect()}
    assert fi[1] == "a.jpg" and fi[2] == "c.jpg" and fi[3] == "e.jpg" and fi[4] is None
    cards = {r.id: r for r in product_cards(with_first_image(products, images)).collect()}
    assert cards[4].vendor == "" and cards[4].price_min == 0.0 and cards[4].has_discount is False
    assert cards[1].source_id == "11"
    assert first_image(images).count() == 4


def test_lookup_ordered_keeps_list_order(spark, products):
    lists = spark.createDataFrame([(1, [3, 1, 99, 3]), (2, [])], "req long, ids array<bigint>")
    out = lookup_ordered(products, ids_from_array(lists, "ids", ["req"]), tenant_id=T, key=["req"])
    assert [r.id for r in out.orderBy("req", "pos").collect()] == [3, 1]


def test_products_to_json(spark, products):
    res = search_products(products, T, product_type="Accessories", k=5).select("query_id", "rank", "id", "title")
    j = products_to_json(res).first().json
    assert j.startswith('[{"rank":1,"id":1,') and '"title":"Blue Scarf"' in j


def test_catalogue_listing_pagination_and_sorts(spark, products):
    images = spark.createDataFrame([(100, 1, T, 2, "a2.jpg"), (101, 1, T, 1, "a1.jpg")],
                                   "id long, product_id long, tenant_id string, position int, src string")
    page = catalogue_listing(products, images, tenant_id=T, limit=2, offset=1).orderBy("position").collect()
    # updated_at DESC with NULLs first: 4 (NULL), 3, 1, 2  -> offset 1, limit 2 -> 3, 1
    assert [r.id for r in page] == [3, 1] and page[1].image_url == "a1.jpg"
    low = catalogue_listing(products, images, tenant_id=T, sort="price-low").collect()
    assert [r.price_min for r in low] == sorted(r.price_min for r in low)
    acc = catalogue_listing(products, images, tenant_id=T, category="Accessories").collect()
    assert sorted(r.id for r in acc) == [1, 2]


def test_batch_search_plan_moves_no_vector_and_no_pair(spark, products):
    q = spark.createDataFrame([(1, T, None, None, None, None, [1.0, 0.0], 3)],
                              "query_id long, tenant_id string, product_type string, min_price double, "
                              "max_price double, has_discount boolean, query_vec array<double>, k int")
    plan = search_batch(products, q)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line or "Sort [" in line]
    assert moved and not any("embedding" in line or "query_vec" in line for line in moved)
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_batch_k_is_the_rows_own(spark, products):
    many = spark.range(1, 101).select(
        F.col("id"), F.lit(T).alias("tenant_id"), F.concat(F.lit("P"), "id").alias("title"), F.lit("A").alias("product_type"),
        F.lit("").alias("body_html"), F.lit("").alias("tags"), F.lit(1.0).alias("min_price"), F.lit(2.0).alias("max_price"),
        F.lit(True).alias("has_discount"), F.expr("map('c', array('x'))").alias("options"),
        F.timestamp_seconds(F.col("id")).alias("updated_at"),
        F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("embedding"))
    schema = ("query_id long, tenant_id string, product_type string, min_price double, max_price double, "
              "has_discount boolean, query_vec array<double>, k int")
    q = spark.createDataFrame([(1, T, None, None, None, None, [1.0, 0.0], 50), (2, T, None, None, None, None, [1.0, 0.0], None),
                               (3, T, None, None, None, None, None, 60), (4, None, None, None, None, None, None, 2),
                               (5, T, "A", None, None, None, [1.0, 0.0, 0.0], 3), (6, T, None, None, None, None, [0.0, 0.0], 2)], schema)
    got = {}
    for r in search_batch(many.repartition(3), q).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.similarity))
    assert sorted((a, b) for a, b, _ in got[1]) == [(i, i) for i in range(1, 51)]
    assert len(got[2]) == 5 and 4 not in got
    assert sorted((a, b) for a, b, _ in got[3]) == [(i, 101 - i) for i in range(1, 61)]
    # vectors of another length or of norm zero have no similarity: ties on id
    assert sorted(got[5]) == [(1, 1, None), (2, 2, None), (3, 3, None)] and sorted(got[6]) == [(1, 1, None), (2, 2, None)]
    with pytest.raises(ValueError):
        search_batch(many, q.withColumn("k", F.lit(0)))


def test_batch_in_small_blocks_equals_one_block(spark, products, monkeypatch):
    from storelens.plans import search
    schema = ("query_id long, tenant_id string, product_type string, min_price double, max_price double, "
              "has_discount boolean, query_vec array<double>, k int")
    q = spark.createDataFrame([(i, [T, "t2"][i % 2], [None, "Nope", "Accessories"][i % 3], None, None, None,
                                [float(i), 1.0] if i % 4 else None, 3) for i in range(12)], schema)
    key = lambda df: sorted((r.query_id, r.rank, r.id) for r in df.collect())
    whole = key(search_batch(products, q))
    monkeypatch.setattr(search, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(search, "SLICE_ROWS", 1)
    assert whole and key(search_batch(products, q)) == whole


def test_vector_stage_sees_only_newest_capped_candidates(products):
    # filters always run: with a cap of 2 only the two newest products
    # (4 has NULL updated_at -> first, then 3) reach the vector stage
    r = search_products(products, T, query_vec=[1.0, 0.0], k=5, candidate_cap=2).collect()
    assert sorted(x.id for x in r) == [4]                # 3 has no embedding
    r = search_products(products, T, query_vec=[1.0, 0.0], k=5, candidate_cap=3).collect()
    assert sorted(x.id for x in r) == [1, 4]


def test_listing_page_bounds(spark, products):
    images = spark.createDataFrame([], "id long, product_id long, tenant_id string, position int, src string")
    with pytest.raises(ValueError):
        catalogue_listing(products, images, tenant_id=T, limit=0)
    with pytest.raises(ValueError):
        catalogue_listing(products, images, tenant_id=T, offset=-1)
    with pytest.raises(ValueError):
        catalogue_listing(products, images, tenant_id=T, sort="random")


def test_deep_pages_equal_the_sorted_list(spark):
    from storelens.operators.common import page_of_group
    rows = spark.range(5000).select(
        "id", F.concat(F.lit("t"), F.col("id") % 2).alias("tenant_id"),
        F.when(F.col("id") % 11 > 0, F.timestamp_seconds((F.col("id") * 7919) % 700_000)).alias("updated_at"))
    order = lambda r: (r.updated_at is not None, -(r.updated_at.timestamp() if r.updated_at else 0), r.id)
    all_ = {t: sorted((r for r in rows.collect() if r.tenant_id == t), key=order) for t in ("t0", "t1")}
    for limit, offset in ((100, 0), (100, 990), (100, 2000), (7, 2495), (3000, 100)):
        got = page_of_group(rows, "tenant_id", [F.col("updated_at").desc_nulls_first(), F.col("id").asc()],
                            F.coalesce(F.unix_seconds("updated_at"), F.lit(2 ** 62)), limit, offset, "pos")
        want = [(t, offset + i + 1, r.id) for t in all_ for i, r in enumerate(all_[t][offset:offset + limit])]
        assert sorted((r.tenant_id, r.pos, r.id) for r in got.collect()) == sorted(want)
    deep = page_of_group(rows, "tenant_id", [F.col("updated_at").desc_nulls_first(), F.col("id").asc()],
                         F.coalesce(F.unix_seconds("updated_at"), F.lit(2 ** 62)), 100, 800)
    assert "WindowGroupLimit" in deep._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_null_query_ids(spark):
    from storelens.plans.search import search_batch
    df = products_of(spark)
    q = "query_id long, tenant_id string, product_type string, min_price double, max_price double, has_discount boolean, query_vec array<double>, k int"
    queries = spark.createDataFrame([(1, "t", "A", None, None, None, None, 5), (1, "t", "B", None, None, None, None, 5),
                                     (None, "t", "B", None, None, None, [1.0, 0.0], 1),
                                     (None, "t", "A", None, None, None, None, 5)], q)
    got = sorted((r.query_id is None, r.product_type, r["rank"], r.id) for r in search_batch(df, queries).collect())
    assert got == [(False, "A", 1, 0), (False, "A", 2, 1), (False, "B", 1, 2), (False, "B", 2, 3),
                   (True, "A", 1, 0), (True, "A", 2, 1), (True, "B", 1, 2)]


def products_of(spark):
    rows = [(i, "t", t, f"p{i}", None, p, p, False, None, None, None, v)
            for i, (t, p, v) in enumerate([("A", 1.0, [0.0, 1.0]), ("A", 9.0, None), ("B", 5.0, [1.0, 0.0]), ("B", 2.0, [0.5, 0.5])])]
    return spark.createDataFrame(rows, "id long, tenant_id string, product_type string, title string, body_html string, "
                                 "min_price double, max_price double, has_discount boolean, options map<string,array<string>>, "
                                 "tags string, updated_at timestamp, embedding array<double>")


def scans(df):
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [node for node in plan.split("\n\n") if "Scan parquet" in node and "PushedFilters" in node]


def test_a_request_pushes_its_filter_and_reads_no_vector_without_need(spark, tmp_path):
    from storelens.plans.search import search_products
    products_of(spark).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    out = search_products(df, "t", product_type="A", min_price=1.5)
    assert [r.id for r in out.collect()] == [1]
    ranking = next(line for line in scans(out) if "has_discount" in line or "updated_at" in line)
    assert "EqualTo(product_type,A)" in ranking and "GreaterThanOrEqual(max_price,1.5)" in ranking
    assert "embedding" not in ranking
    ranked = search_products(df, "t", product_type="B", query_vec=[1.0, 0.0])
    assert [r.id for r in ranked.orderBy("rank").collect()] == [2, 3]
    assert any("embedding" in line and "EqualTo(product_type,B)" in line for line in scans(ranked))
    # nothing matches: the whole tenant is searched
    assert [r.id for r in search_products(df, "t", product_type="none", query_vec=[0.0, 1.0]).orderBy("rank").collect()] == [0, 3, 2]
    assert search_products(df, "t", product_type="none").count() == 0
