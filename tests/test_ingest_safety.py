"""Nothing is lost: tables of other tenants, equal paths, corrupt input, repeated documents, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from storelens.plans.ingest import ingest_catalog, newest_documents, read_catalog_tables, write_catalog_tables
from storelens.schemas import CATALOG, IMAGES, PRODUCTS, VARIANTS


def doc(i, updated="2024-01-01T00:00:00Z", **kw):
    return {"id": i, "title": f"P{i}", "created_at": "2024-01-01T00:00:00Z", "updated_at": updated,
            "variants": [{"id": (i or 0) * 10, "price": "1.005", "compare_at_price": "2", "weight": "1.2345", "taxable": True,
                          "inventory_policy": "deny"}],
            "images": [{"id": (i or 0) * 100, "src": "a.jpg"}], **kw}


@pytest.fixture()
def land(spark, tmp_path):
    def write(docs, name="docs"):
        from storelens.sources.catalog import read_catalog_json
        path = tmp_path / f"{name}.json"
        path.write_text("﻿\n\t " + json.dumps(docs) if name == "docs" else json.dumps(docs))
        return read_catalog_json(spark, str(path))
    return write


def ids(df):
    return sorted((r.tenant_id, r.source_id) for r in df.collect())


def test_two_tenants_and_the_same_path_twice(spark, land, tmp_path):
    out = str(tmp_path / "out")
    write_catalog_tables(ingest_catalog(land([doc(1), doc(2)]), "007"), out)
    write_catalog_tables(ingest_catalog(land([doc(3, images=[], variants=[])], "b"), "b"), out)
    t = read_catalog_tables(spark, out)
    assert ids(t["products"]) == [("007", 1), ("007", 2), ("b", 3)] and t["images"].count() == 2
    again = ingest_catalog(land([doc(2, title="new"), doc(4)], "c"), "007", current=read_catalog_tables(spark, out))
    write_catalog_tables(again, out)
    t = read_catalog_tables(spark, out)
    assert ids(t["products"]) == [("007", 1), ("007", 2), ("007", 4), ("b", 3)]
    assert t["products"].where("title = 'new'").count() == 1 and t["variants"].count() == 3


def test_rows_that_went_leave_no_old_folder(spark, land, tmp_path):
    out = str(tmp_path / "out")
    write_catalog_tables(ingest_catalog(land([doc(1)]), "t"), out)
    write_catalog_tables(ingest_catalog(land([doc(1, images=[])], "x"), "t", current=read_catalog_tables(spark, out)), out)
    t = read_catalog_tables(spark, out)
    assert t["images"].count() == 0 and t["products"].count() == 1


def test_declared_schemas_and_money(spark, land):
    out = ingest_catalog(land([doc(1)]), "t")
    for name, schema in (("products", PRODUCTS), ("images", IMAGES), ("variants", VARIANTS)):
        assert {f.name: f.dataType.simpleString() for f in out[name].schema} == {
            f.name: f.dataType.simpleString() for f in schema}, name
    v = out["variants"].first()
    assert (str(v.price), str(v.weight), v.taxable, v.inventory_policy, v.source_product_id) == ("1.01", "1.235", True, "deny", 1)


def test_newest_document_by_instant_then_file_order(land):
    rows = [doc(1, "2024-01-01T10:00:00+09:00", title="old"), doc(1, "2024-01-01T05:00:00Z", title="new"),
            doc(2, title="first"), doc(2, title="last"), doc(None, title="a"), doc(None, title="b"), doc(3, "bad"), doc(3, title="good")]
    got = sorted((r.id or 0, r.title) for r in newest_documents(land(rows)).collect())
    assert got == [(0, "a"), (0, "b"), (1, "new"), (2, "last"), (3, "good")]
    out = ingest_catalog(land(rows), "t")
    assert out["rejects"].count() == 2
    assert out["summary"].first().asDict() == {"products": 3, "variants": 3, "images": 3, "successful": 3, "failed": 2}


def test_each_text_is_embedded_once(spark, land, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def embed(texts):
        import uuid
        (log / uuid.uuid4().hex).write_text(str(len(texts)))
        return [[0.0] * 1536 for _ in texts]

    current = ingest_catalog(land([doc(1)], "x"), "t")
    out = ingest_catalog(land([doc(i) for i in range(1, 21)]), "t", current=current, embed=True, embed_fn=embed)
    for name in ("products", "images", "variants"):
        out[name].collect()
    out["products"].collect()
    assert sum(int(f.read_text()) for f in log.iterdir()) == 20


def test_corrupt_input_is_never_dropped(spark, tmp_path):
    from storelens.sources.catalog import corrupt_pages, read_catalog_ndjson, read_catalog_pages
    for i, text in enumerate(['{"products": [{"id": 1}]}', '{"products": [{"id": 2', '{"products": [{"id": 3}]}']):
        (tmp_path / f"p{i}.json").write_text(text)
    with pytest.raises(Exception, match="p1.json"):
        read_catalog_pages(spark, str(tmp_path)).collect()
    assert [r.file.rsplit("/", 1)[1] for r in corrupt_pages(spark, str(tmp_path)).collect()] == ["p1.json"]
    lines = tmp_path / "l"
    lines.mkdir()
    (lines / "x.json").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="x.json"):
        read_catalog_ndjson(spark, str(lines)).collect()


def test_second_run_into_a_sink_goes_on(spark, tmp_path):
    from storelens.streaming.sources import file_stream, read_upserted, run_to_table
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for lo in (0, 10):
        part = spark.range(lo, lo + 10)
        part.write.mode("append").parquet(src)
        run_to_table(file_stream(spark, src, part.schema), out, mode="append")
    assert read_upserted(spark, out, ["id"]).count() == 20


def test_gap_sessions_keep_every_piece(spark, tmp_path):
    from storelens import adapters as A
    from storelens.streaming.metrics import session_metrics_key, stream_session_metrics
    from storelens.streaming.sources import file_stream, read_upserted, run_to_table
    path = "/root/testdata/sf0.001/events.parquet"
    events = file_stream(spark, path, spark.read.parquet(path).schema)
    out = str(tmp_path / "out")
    run_to_table(stream_session_metrics(A.messages(events), gap_seconds=600), out, mode="append")
    raw = spark.read.parquet(out)
    assert read_upserted(spark, out, session_metrics_key(gap_seconds=600)).count() == raw.count() > 0


def test_prices_of_a_given_table_are_joined(spark):
    from storelens.operators.sessions import price_usage
    usage = spark.createDataFrame([(1, "GPT-x-mini", 10 ** 6, 0), (2, "gpt", 0, 10 ** 6), (3, None, 5, 5), (4, "other", 1, 1)],
                                  "id long, model_used string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("gpt", 1.0, 2.0), ("gpt-x", 3.0, 4.0)] + [(f"p{i}", 9.0, 9.0) for i in range(2000)],
                                   "prefix string, input double, output double")
    got = {r.id: r.cost for r in price_usage(usage, prices).collect()}
    assert got == {1: 3.0, 2: 2.0, 3: None, 4: 0.0}


def test_empty_id_list_means_no_restriction(spark):
    from storelens.operators.search import semantic_within
    p, none = spark.range(5), spark.createDataFrame([], "id long")
    assert semantic_within(p, none).count() == semantic_within(p, None).count() == 5
    assert semantic_within(p, spark.range(2)).count() == 2


def test_ingest_command_keeps_what_isnt_sent_again(spark, tmp_path):
    from storelens import cli
    out = str(tmp_path / "out")

    def ingest(docs, tenant, *more):
        path = tmp_path / "landed.json"
        path.write_text(json.dumps(docs))
        cli.main(["ingest", "--input", str(path), "--tenant", tenant, "--out", out, *more])
        spark.catalog.clearCache()
        return read_catalog_tables(spark, out)

    assert ids(ingest([doc(1), doc(2)], "a")["products"]) == [("a", 1), ("a", 2)]
    assert ids(ingest([doc(3)], "a")["products"]) == [("a", 1), ("a", 2), ("a", 3)]
    assert ids(ingest([doc(1)], "b")["products"]) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    t = ingest([doc(2, title="new", images=[]), doc(4)], "a")
    assert ids(t["products"]) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1)]
    assert t["products"].where("title = 'new'").count() == 1
    assert (t["images"].count(), t["variants"].count()) == (4, 5)
    assert ids(ingest([doc(9)], "a", "--replace-all")["products"]) == [("a", 9), ("b", 1)]


def test_products_are_swapped_in_after_their_children(spark, land, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    out = str(tmp_path / "out")
    write_catalog_tables(ingest_catalog(land([doc(1)]), "t"), out)
    again = ingest_catalog(land([doc(2)], "x"), "t", current=read_catalog_tables(spark, out))
    write = DataFrameWriter.parquet

    def failing(self, path, *a, **kw):
        if path == f"{out}/products":
            raise OSError("lost the store")
        return write(self, path, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError, match="lost"):
        write_catalog_tables(again, out)
    monkeypatch.undo()
    t = read_catalog_tables(spark, out)
    assert ids(t["products"]) == [("t", 1)]
    assert t["images"].count() == 2 and t["variants"].count() == 2


def test_repeated_documents_after_a_shuffle(spark, land):
    rows = [doc(k % 40, f"2024-01-{1 + k % 28:02d}T00:00:00Z", title=f"{k}") for k in range(400)]
    raw = land(rows).repartition(13)
    got = newest_documents(raw)
    assert sorted(r.id for r in got.collect()) == list(range(40))
    assert got.count() == 40


def written_rows(spark, make):
    """What ``make`` writes below the checkpoint folder: {name: rows}."""
    import os
    from storelens.session import checkpoint_dir
    base = checkpoint_dir(spark)
    before = set(os.listdir(base))
    make()
    return {name.rsplit("-", 1)[0]: spark.read.parquet(f"{base}/{name}").count()
            for name in set(os.listdir(base)) - before if name.startswith("catalog-")}


def test_documents_are_stored_once(spark, land):
    """without repeated ids nothing is written or joined after the first table."""
    kept = {}
    raw = land([doc(i) for i in range(1, 9)], "once")
    assert written_rows(spark, lambda: kept.update(df=newest_documents(raw, store=True))) == {
        "catalog-numbered": 8, "catalog-repeated": 0}
    assert "Join" not in kept["df"]._jdf.queryExecution().toString() and kept["df"].count() == 8
    twice = land([doc(1), doc(1, title="new"), doc(2)], "twice")
    assert written_rows(spark, lambda: kept.update(df=newest_documents(twice, store=True))) == {
        "catalog-numbered": 3, "catalog-repeated": 1, "catalog-last": 1, "catalog-docs": 2}
    assert sorted((r.id, r.title) for r in kept["df"].collect()) == [(1, "new"), (2, "P2")]


def test_pages_are_cut_without_a_shuffle(spark, tmp_path, monkeypatch):
    """small compressed files, each document once, pages of the given size."""
    from storelens.sources import catalog
    docs = spark.range(0, 23, 1, 2).select("id", F.lit("p").alias("title"), F.lit(None).cast("string").alias("vendor"))
    path = str(tmp_path / "pages")
    seen = {}
    write = docs.write.__class__.text

    def noted(self, *a, **kw):
        seen["plan"] = self._df._jdf.queryExecution().toString()
        return write(self, *a, **kw)

    monkeypatch.setattr(docs.write.__class__, "text", noted)
    catalog.write_catalog_pages(docs, path, page_size=5)
    assert "Exchange" not in seen["plan"]
    pages = [json.loads(r.value)["products"] for r in spark.read.text(path).collect()]
    assert sorted(d["id"] for p in pages for d in p) == list(range(23)) and max(map(len, pages)) == 5
    assert all(set(d) == {"id", "title"} for p in pages for d in p)
    assert all(f.suffix == ".gz" for f in (tmp_path / "pages").glob("part-*"))


def test_children_are_moved_not_written_twice(spark, land, tmp_path, monkeypatch):
    """each row of images and variants is written once; the hidden folder goes."""
    from pyspark.sql import DataFrameWriter
    out, paths = tmp_path / "out", []
    write = DataFrameWriter.parquet

    def noted(self, path, *a, **kw):
        paths.append(path)
        return write(self, path, *a, **kw)

    tables = ingest_catalog(land([doc(1), doc(2)]), "007")
    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    write_catalog_tables(tables, str(out))
    monkeypatch.undo()
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["images", "products", "products", "rejects", "variants"]
    assert not [f for f in out.iterdir() if f.name.startswith("_")]
    t = read_catalog_tables(spark, str(out))
    assert {r.tenant_id for n in t for r in t[n].collect()} == {"007"} and t["images"].count() == 2


def test_documents_without_repeats_are_not_written(spark, land):
    """unless they shall be stored, documents are read where they lie."""
    raw = land([doc(1), doc(2), doc(None)], "once")
    assert written_rows(spark, lambda: newest_documents(raw)) == {}
    assert newest_documents(raw).count() == 3
    twice = land([doc(1), doc(1, title="new"), doc(2)], "twice")
    assert written_rows(spark, lambda: newest_documents(twice)) == {
        "catalog-numbered": 3, "catalog-repeated": 1, "catalog-last": 1}


def test_products_are_written_once(spark, land, tmp_path, monkeypatch):
    """their folders are moved in, and no write sorts rows by tenant."""
    from pyspark.sql import DataFrameWriter
    out, rows, key = tmp_path / "out", [], "spark.sql.maxConcurrentOutputFileWriters"
    write = DataFrameWriter.parquet

    def noted(self, path, *a, **kw):
        if path.endswith("/products"):
            rows.append((self._df.count(), path == f"{out}/products", spark.conf.get(key)))
        return write(self, path, *a, **kw)

    before = spark.conf.get(key)
    write_catalog_tables(ingest_catalog(land([doc(1), doc(2)]), "007"), str(out))
    again = ingest_catalog(land([doc(2), doc(3)], "x"), "b", current=read_catalog_tables(spark, str(out)))
    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    write_catalog_tables(again, str(out))
    monkeypatch.undo()
    assert rows == [(4, False, "8"), (0, True, before)] and spark.conf.get(key) == before
    assert ids(read_catalog_tables(spark, str(out))["products"]) == [("007", 1), ("007", 2), ("b", 2), ("b", 3)]
    assert not [f for f in out.iterdir() if f.name.startswith("_")]


@pytest.mark.parametrize("sent", [1, 2, 5, 6])
def test_replaced_rows_go_whether_few_or_most(spark, land, sent):
    """settled on ids first where most go; children without a product, and null keys, stay."""
    old = ingest_catalog(land([doc(i) for i in range(1, 7)], "old"), "t")
    current = {n: old[n] for n in ("products", "images", "variants")}
    nobody = lambda df: df.withColumn("product_id", F.when(F.col("source_product_id") == 1, F.lit(-1)))
    for n in ("images", "variants"):
        current[n] = current[n].unionByName(nobody(current[n].where("source_product_id <= 2")))
    stray = current["products"].where("source_id = 1")
    current["products"] = current["products"].unionByName(stray.withColumn("tenant_id", F.lit("u"))) \
        .unionByName(stray.withColumn("source_id", F.lit(None).cast("long")).withColumn("id", F.lit(-2).cast("long")))
    got = {}
    new = land([doc(i, title="new") for i in range(1, sent + 1)] + [doc(9)], "new")
    written = written_rows(spark, lambda: got.update(ingest_catalog(new, "t", current=current)))
    assert written["catalog-replaced"] == 8 and ("catalog-staying" in written) == (sent > 4)
    assert sorted((r.tenant_id, r.source_id or 0, r.title) for r in got["products"].collect()) == sorted(
        [("t", 0, "P1"), ("u", 1, "P1"), ("t", 9, "P9")] + [("t", i, "new" if i <= sent else f"P{i}") for i in range(1, 7)])
    for n in ("images", "variants"):
        assert sorted(r.product_id or 0 for r in got[n].where("source_product_id <= 2").collect()) == sorted(
            [-1, 0] + [r.id for r in old["products"].where("source_id <= 2").collect()])
        assert got[n].count() == 9 and set(got[n].columns) == set(old[n].columns)


def test_documents_conform_as_if_read_from_json(spark):
    from storelens.plans.registry import _as_catalog, _line_documents
    li = spark.createDataFrame(
        [(1, 2, 3, 1, 4.0, 10.0, 0.1, "A", "O", "2024-01-02"), (1, 2, 3, 2, 0.0, 10.0, 1.0, None, None, None),
         (None, None, None, 3, None, None, None, 'q"\\', "é", "2024-02-29"), (7, 2, 3, None, 3.0, 1.0, 0.0, "", "", "1999-12-31")],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_returnflag string, l_linestatus string, d string").withColumn("l_shipdate", F.col("d").cast("timestamp"))
    docs = _line_documents(li)
    got, json_way = _as_catalog(docs), docs.select(
        F.from_json(F.to_json(F.struct(*docs.columns)), CATALOG).alias("d")).select("d.*")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(f.name, f.dataType.simpleString()) for f in CATALOG]
    assert sorted(map(str, got.collect())) == sorted(map(str, json_way.collect())) and got.count() == 4
