"""Stored-table request path: tenant partitions prune, results equal the batch form."""

from storelens import adapters as A
from storelens.operators import dashboard as D
from storelens.plans.serving import TenantStore, build_tables

from conftest import SMOKE


def test_served_requests_match_batch(spark, tmp_path):
    base = str(tmp_path / "tables")
    build_tables(spark, SMOKE, base)
    store = TenantStore(spark, base)
    got = store.message_volume("tenant-1", A.AS_OF, 31)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tenant-1" in plan
    m = A.messages(A.load(spark, SMOKE, "events"))
    want = D.message_volume(m, A.AS_OF, 31).where("tenant_id = 'tenant-1'")
    cols = ["date", "user_messages", "assistant_messages", "total_messages"]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == \
        sorted(tuple(r[c] for c in cols) for r in want.collect())
    assert store.overview("tenant-1", A.AS_OF).count() == 1
    assert store.search("tenant-1", product_type="ECONOMY", k=3).count() <= 3
    assert store.listing("tenant-1", 10, 0).count() == 10
    assert store.latency("tenant-1", A.AS_OF, 31)["summary"].count() == 1
    info = store.tenant_info("tenant-1").first()
    assert info.name == "NATION_1" and info.settings["theme"] == "light"
    sid = got.sparkSession.read.parquet(f"{base}/messages").where("tenant_id = 'tenant-1'").first().session_id
    msgs = store.session_messages("tenant-1", sid).collect()
    times = [(r.created_at, r.message_id) for r in msgs]
    assert msgs and times == sorted(times) and all(r.session_id == sid for r in msgs)
    hist = store.history("tenant-1", sid, 3).collect()
    assert 1 <= len(hist) <= 3 and sorted(r.position for r in hist) == list(range(1, len(hist) + 1))
    out = store.export_daily("tenant-1", A.AS_OF, str(tmp_path / "csv"), 31)
    assert out.count() == 31
