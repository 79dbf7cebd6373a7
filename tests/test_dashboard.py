"""A1-A14, J1, J9, O4, P4, P5 on small frames."""

import datetime as dt

import numpy as np
import pytest

from conftest import ts
from storelens.operators import dashboard as D
from storelens.operators import latency as L
from storelens.operators.tenancy import evolve_schema
from storelens.plans.reports import recent_sessions, transcripts
from storelens.schemas import SESSIONS

AS_OF = "2024-01-10 00:00:00"


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [("t", "a", ts("2024-01-09 10:00:00"), ts("2024-01-09 10:30:00"), 4, 0.5),
            ("t", "b", ts("2024-01-09 12:00:00"), None, 2, None),
            ("t", "c", ts("2024-01-07 01:00:00"), ts("2024-01-07 02:00:00"), None, 0.25),
            ("t", "old", ts("2024-01-02 00:00:00"), ts("2024-01-02 00:00:00"), 1, 1.0),
            ("u", "x", ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00"), 1, 1.0)]
    df = spark.createDataFrame(rows, "tenant_id string, session_id string, started_at timestamp, "
                                     "ended_at timestamp, message_count long, estimated_cost double")
    return evolve_schema(df, SESSIONS)


@pytest.fixture(scope="module")
def messages(spark):
    rows = []
    for i in range(40):
        role = ["user", "assistant", "system"][i % 3]
        rows.append(("t", f"s{i % 4}", i, role, ts("2024-01-09 00:00:00") + dt.timedelta(hours=i % 30),
                     ["product_inquiry", None][i % 2] if role == "user" else None,
                     [None, "gpt-4o-mini", "text-embedding-3-small"][(i // 3) % 3] if role == "assistant" else None,
                     10 * i, i, 0.001 * i if role == "assistant" else None,
                     100 + 7 * i if role == "assistant" else None))
    return spark.createDataFrame(rows, "tenant_id string, session_id string, message_id long, role string, "
                                       "created_at timestamp, intent string, model_used string, prompt_tokens long, "
                                       "completion_tokens long, cost double, latency_ms long").cache()


def test_sessions_over_time_gap_fill(sessions):
    out = D.sessions_over_time(sessions, AS_OF, days=7).orderBy("tenant_id", "date").collect()
    assert len(out) == 7 and {r.tenant_id for r in out} == {"t"}      # tenant u has no rows in window
    by_day = {str(r.date): r for r in out}
    assert by_day["2024-01-09"].session_count == 2 and by_day["2024-01-09"].total_messages == 6
    assert by_day["2024-01-09"].daily_cost == 0.5
    assert by_day["2024-01-08"].session_count == 0 and by_day["2024-01-08"].daily_cost == 0.0
    assert "2024-01-03" not in by_day


def test_overview(sessions, messages):
    r = {x.tenant_id: x for x in D.overview(sessions, messages, "2024-01-09 12:30:00").collect()}
    assert r["t"].total_sessions == 4 and r["t"].days_active == 3
    assert r["t"].cost_today == 0.5
    assert r["u"].messages_today == 0


def test_volume_cost_intents_hours(messages):
    vol = D.message_volume(messages, "2024-01-11 00:00:00", 7).collect()
    assert sum(r.total_messages for r in vol) == 40
    assert sum(r.user_messages for r in vol) == 14 and sum(r.assistant_messages for r in vol) == 13
    cb = D.cost_breakdown(messages, "2024-01-11 00:00:00", 7).collect()
    total = [r for r in cb if r.is_total][0]
    models = [r for r in cb if not r.is_total]
    assert {r.model for r in models} == {"gpt-4o-mini", "text-embedding-3-small"}
    assert total.call_count == sum(r.call_count for r in models)
    assert total.cost == pytest.approx(sum(r.cost for r in models))
    intents = D.intent_distribution(messages, "2024-01-11 00:00:00", 7).collect()
    assert [(r["intent"], r["count"]) for r in intents] == [("product_inquiry", 7)]
    hours = D.hourly_activity(messages, "2024-01-11 00:00:00", 7).collect()
    assert len(hours) == 24 and sum(r.message_count for r in hours) == 40


def test_top_products_ties_and_nulls(spark):
    ev = spark.createDataFrame([("t", p, "recommended", "s", ts("2024-01-09 00:00:00")) for p in [1, 1, 2, 2, 3, 9]],
                               "tenant_id string, product_id long, event_type string, session_id string, created_at timestamp")
    prod = spark.createDataFrame([(1, "A", "v", None, None), (2, "B", "v", 1.0, 2.0), (3, "C", None, 3.0, 3.0)],
                                 "id long, title string, vendor string, min_price double, max_price double")
    out = D.top_products(ev, prod, AS_OF, "recommended", limit=2, days=7).orderBy("rank").collect()
    assert [(r.id, r.event_count) for r in out] == [(1, 2), (2, 2)]     # tie broken by id; 9 has no product
    assert out[0].price_min == 0.0


def test_latency_report_matches_numpy(messages):
    rep = L.latency_report(messages, "2024-01-11 00:00:00", 7)
    lat = [r.latency_ms for r in messages.where("role = 'assistant'").collect()]
    p = rep["percentiles"].first()
    for q, got in zip([50, 75, 90, 95, 99], [p.p50, p.p75, p.p90, p.p95, p.p99]):
        assert got == pytest.approx(np.percentile(lat, q))
    s = rep["summary"].first()
    assert s.message_count == len(lat) and s.avg_latency_ms == pytest.approx(np.mean(lat))
    worst = rep["worst_sessions"].orderBy("rank").collect()
    assert worst[0].max_latency_ms == max(lat)
    assert sum(r.message_count for r in rep["by_hour"].collect()) == len(lat)


def test_recent_sessions_duration(sessions):
    r = {x.session_id: x for x in recent_sessions(sessions, 10).collect()}
    assert r["a"].duration_minutes == 30.0 and r["b"].duration_minutes is None
    assert r["b"].rank == 1 and r["c"].estimated_cost == 0.25


def test_transcripts_system_consumes_limit(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "system", "sys"), (1, 3, "user", "q"),
            (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    t = spark.createDataFrame(rows, "session_id long, turn long, role string, content string")
    out = {r.session_id: r for r in transcripts(t, 3, key=["session_id"], order=["turn"]).collect()}
    assert out[1].transcript == "CHATBOT: hello\nUSER: q\n" and out[1].ends_with_user is True
    assert out[2].ends_with_user is False and out[2].lines == 2


def test_scoped_scalars_answer_for_empty_tenant(sessions, messages):
    r = D.overview(sessions, messages, AS_OF, tenant_id="nobody").collect()
    assert len(r) == 1 and r[0].total_sessions == 0 and r[0].cost_today == 0.0
    rep = L.latency_report(messages, AS_OF, 7, tenant_id="nobody")
    s = rep["summary"].first()
    assert s.avg_latency_ms == 0.0 and s.message_count == 0 and s.min_latency_ms is None
    assert rep["percentiles"].first().p99 == 0.0


def test_hourly_activity_spine_sources(spark, messages):
    one = D.hourly_activity(messages, "2024-01-11 00:00:00", 7, tenant_id="nobody").collect()
    assert len(one) == 24 and sum(r.message_count for r in one) == 0
    ten = spark.createDataFrame([("t",), ("u",)], "tenant_id string")
    both = D.hourly_activity(messages, "2024-01-11 00:00:00", 7, tenants=ten).collect()
    assert len(both) == 48 and sum(r.message_count for r in both if r.tenant_id == "t") == 40


def test_approximate_percentiles_close_to_exact(messages):
    lat = L.assistant_latencies(messages, "2024-01-11 00:00:00", 7)
    ex = L.latency_percentiles(lat).first()
    ap = L.latency_percentiles(lat, exact=False).first()
    vals = sorted(r.latency_ms for r in lat.collect())
    for name in ("p50", "p90", "p99"):
        assert ap[name] in vals                                  # sketch answers are sample values
        assert abs(vals.index(ap[name]) - vals.index(min(vals, key=lambda v: abs(v - ex[name])))) <= 1
    assert L.latency_by_hour(lat, exact=False).count() == L.latency_by_hour(lat).count()


def test_overview_approx_distinct(sessions, messages):
    ex = {r.tenant_id: r.active_sessions for r in D.overview(sessions, messages, "2024-01-10 06:00:00").collect()}
    ap = {r.tenant_id: r.active_sessions for r in
          D.overview(sessions, messages, "2024-01-10 06:00:00", approx_distinct=True).collect()}
    assert ex == ap          # small cardinalities are exact in HyperLogLog++


def test_argument_bounds_are_checked(sessions, messages):
    with pytest.raises(ValueError):
        D.message_volume(messages, AS_OF, days=0)
    with pytest.raises(ValueError):
        D.cost_breakdown(messages, AS_OF, days=91)
    with pytest.raises(ValueError):
        D.top_products(messages, messages, AS_OF, limit=101)
    with pytest.raises(ValueError):
        D.sessions_over_time(sessions, AS_OF, days=366)
