"""F2, F17, J10-J12, M3, M6, M8-M10, E1, E2, M7, F13."""

import pytest
from pyspark.sql import functions as F, types as T

from storelens.operators.embed import (backfill_embeddings, clear_embeddings, embed_query, embedding_coverage,
                                       embedding_dimension_report,
                                       hashed_bow, pending_embeddings)
from storelens.operators.tenancy import (apply_settings_changes, check_tenant_writes, delete_tenant,
                                         duplicate_keys, evolve_schema, missing_tenants, orphans, require_tenant,
                                         tenant_info, uniqueness_report, verify_schema)

TEN = ("tenant_id string, name string, description string, brand_voice string, store_url string, "
       "logo_url string, settings map<string,string>, created_at timestamp, updated_at timestamp")


@pytest.fixture(scope="module")
def tenants(spark):
    return spark.createDataFrame([("a", "A", None, None, None, None, {"theme": "light", "lang": "en"}, None, None),
                                  ("b", "B", "Shop B", None, None, None, None, None, None)], TEN)


def test_check_tenant_writes_fails_on_foreign_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x long")
    assert check_tenant_writes(df.where("tenant_id = 'a'"), "a").count() == 1
    with pytest.raises(Exception):
        check_tenant_writes(df, "a").write.parquet(str(tmp_path / "x"))


def test_tenant_info_defaults(tenants):
    r = {x.tenant_id: x for x in tenant_info(tenants, for_agent=True).collect()}
    assert r["a"].description == "E-commerce store" and r["b"].settings == {}
    assert tenant_info(tenants).where("tenant_id = 'a'").first().description is None


def test_missing_and_required_tenants(spark, tenants):
    df = spark.createDataFrame([("a", 1), ("z", 2)], "tenant_id string, x long")
    assert [r.tenant_id for r in missing_tenants(df, tenants).collect()] == ["z"]
    assert [r.x for r in require_tenant(df, tenants).collect()] == [1]


def test_orphans_and_delete(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1, "a"), (11, 3, "a"), (12, None, "b")], "cid long, product_id long, tenant_id string")
    assert [r.cid for r in orphans(child, parent, "product_id").collect()] == [11]
    left = delete_tenant({"child": child}, "a")["child"]
    assert [r.cid for r in left.collect()] == [12]


def test_apply_settings_changes(spark, tenants):
    changes = spark.createDataFrame(
        [("a", 1, None, "first", {"theme": "dark"}), ("a", 2, "A2", None, {"theme": "blue", "x": "1"}),
         ("b", 1, None, None, None)],
        "tenant_id string, seq int, name string, description string, settings map<string,string>")
    r = {x.tenant_id: x for x in apply_settings_changes(tenants, changes).collect()}
    assert r["a"].name == "A2" and r["a"].description == "first"
    assert r["a"].settings == {"theme": "blue", "lang": "en", "x": "1"}
    assert r["b"].name == "B" and r["b"].description == "Shop B" and r["b"].settings is None
    assert r["a"].updated_at is not None


def test_schema_evolution_and_verification(spark):
    target = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType()),
                           T.StructField("c", T.StringType())])
    df = spark.createDataFrame([(1, "x")], "a long, c string")
    out = evolve_schema(df, target, {"b": 0})
    assert out.columns == ["a", "b", "c"] and out.first().b == 0
    rep = {r.column: r.status for r in verify_schema(df, target).collect()}
    assert rep == {"a": "ok", "b": "missing", "c": "ok"}


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert [(r.k, r.n) for r in duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    r = uniqueness_report([("t", df, ["k"])]).first()
    assert (r.rows, r.distinct_keys, r.duplicate_keys) == (3, 2, 1)


def test_embedding_lifecycle(spark):
    prods = spark.createDataFrame([(1, "a", '{"title":"x"}', None), (2, "a", '{"title":"y"}', [0.1, 0.2]),
                                   (3, "b", None, None)],
                                  "id long, tenant_id string, embedding_json string, embedding array<float>")
    assert [r.id for r in pending_embeddings(prods).collect()] == [1]
    filled = {r.id: r.embedding for r in backfill_embeddings(prods).collect()}
    assert len(filled[1]) == 64 and filled[2] == pytest.approx([0.1, 0.2]) and filled[3] is None
    regen = {r.id: r.embedding for r in backfill_embeddings(prods, regenerate=True).collect()}
    assert len(regen[2]) == 64

    def broken(texts):
        raise RuntimeError("service down")
    failed = {r.id: r.embedding for r in backfill_embeddings(prods, broken).collect()}
    assert failed[1] is None                               # stays pending
    assert clear_embeddings(prods, "a").where("embedding IS NOT NULL").count() == 0
    cov = {r.tenant_id: (r.products, r.with_embedding) for r in embedding_coverage(prods).collect()}
    assert cov == {"a": (2, 1), "b": (1, 0)}
    assert embed_query("green hat") == hashed_bow(["green hat"])[0]


def test_dimension_report_and_rejection(spark):
    prods = spark.createDataFrame([(1, "a", "x", [0.1] * 64), (2, "a", "y", [0.1, 0.2]), (3, "a", "z", None)],
                                  "id long, tenant_id string, embedding_json string, embedding array<float>")
    r = embedding_dimension_report(prods, 64).first()
    assert r.with_embedding == 2 and r.wrong_dimension == 1
    short = backfill_embeddings(prods, lambda texts: [[1.0, 2.0] for _ in texts])
    assert short.where("id = 3").first().embedding is None          # wrong size -> stays pending
