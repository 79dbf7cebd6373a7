"""S5-S8 writers/readers and plan checks: partition pruning and pushed filters."""

import os

from pyspark.sql import functions as F

from conftest import FIXTURES, SMOKE, ts
from storelens import adapters as A
from storelens.operators.common import trailing
from storelens.operators.sessions import session_rollup
from storelens.plans.ingest import ingest_catalog
from storelens.sources.catalog import EXPORT_COLUMNS, export_daily_csv, read_catalog_json
from storelens.sources.tables import append_messages, append_product_events, read_table


def test_append_and_read_with_pruning(spark, tmp_path):
    msgs = A.messages(A.load(spark, SMOKE, "events"))
    path = str(tmp_path / "messages")
    append_messages(msgs, path)
    back = read_table(spark, path, "tenant-1")
    assert back.count() == msgs.where("tenant_id = 'tenant-1'").count()
    q = trailing(back, "created_at", A.AS_OF, days=5)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tenant-1" in plan
    assert "PushedFilters" in plan and "created_at" in plan.split("PushedFilters")[1][:400]
    pe = str(tmp_path / "pe")
    append_product_events(A.product_events(A.load(spark, SMOKE, "events")), pe)
    assert any(d.startswith("tenant_id=") for d in os.listdir(pe))


def test_tenant_guard_on_write(spark, tmp_path):
    import pytest
    msgs = A.messages(A.load(spark, SMOKE, "events"))
    with pytest.raises(Exception):
        append_messages(msgs, str(tmp_path / "bad"), tenant_id="tenant-0")
    append_messages(msgs.where("tenant_id = 'tenant-0'"), str(tmp_path / "ok"), tenant_id="tenant-0")


def test_export_daily_csv(spark, tmp_path):
    sessions = session_rollup(A.messages(A.load(spark, SMOKE, "events")))
    out = export_daily_csv(sessions, A.AS_OF, str(tmp_path / "csv"), days=31)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["tenant_id"] + EXPORT_COLUMNS
    assert back.count() == out.count() == 3 * 31


def test_ingest_materialized_docs(spark):
    raw = read_catalog_json(spark, os.path.join(FIXTURES, "catalog_array.json"))
    out = ingest_catalog(raw, "t", materialize_docs=True)
    assert out["products"].count() == 3 and out["variants"].count() == 6
    plan = out["variants"]._jdf.queryExecution().executedPlan().toString()
    assert "JsonFileFormat" not in plan and "Text" not in plan.split("FileScan")[1][:30]


def test_cli_ingest_and_export(spark, tmp_path):
    from storelens import cli
    out = str(tmp_path / "catalog")
    cli.main(["ingest", "--input", os.path.join(FIXTURES, "catalog_array.json"), "--tenant", "t", "--out", out])
    assert spark.read.parquet(f"{out}/products").count() == 3
    tables = str(tmp_path / "tables")
    from storelens.plans.serving import build_tables
    build_tables(spark, SMOKE, tables)
    cli.main(["export-daily", "--tables", tables, "--as-of", "2024-01-31 00:00:00", "--out",
              str(tmp_path / "csv"), "--tenant", "tenant-2", "--days", "31"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 31


def test_expand_and_inquiry_events(spark):
    from storelens.sources.tables import expand_recommendations, inquiry_event
    df = spark.createDataFrame([("t", "s", ts("2024-01-01 00:00:00"), [3, 1], 7)],
                               "tenant_id string, session_id string, created_at timestamp, product_ids array<bigint>, "
                               "product_id long")
    rec = expand_recommendations(df).collect()
    assert sorted(r.product_id for r in rec) == [1, 3] and {r.event_type for r in rec} == {"recommended"}
    inq = inquiry_event(df).first()
    assert inq.event_type == "inquired" and inq.product_id == 7


def test_cli_stream_sessions_once_and_resume(spark, tmp_path):
    from storelens import cli
    from storelens.streaming.sources import read_upserted
    msgs = A.messages(A.load(spark, SMOKE, "events"))
    land, out, ck = str(tmp_path / "land"), str(tmp_path / "sessions"), str(tmp_path / "ck")
    cut = F.lit("2024-01-16 12:00:00").cast("timestamp")
    msgs.where(F.col("created_at") < cut).write.parquet(f"{land}/part1")
    args = ["stream-sessions", "--landing", f"{land}/*", "--out", out, "--checkpoint", ck, "--once"]
    cli.main(args)
    msgs.where(F.col("created_at") >= cut).write.parquet(f"{land}/part2")
    cli.main(args)                                   # resumes from the checkpoint
    got = read_upserted(spark, out, ["tenant_id", "session_id"])
    want = session_rollup(msgs)
    cols = ["tenant_id", "session_id", "message_count", "llm_call_count", "input_tokens"]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == \
        sorted(tuple(r[c] for c in cols) for r in want.collect())
