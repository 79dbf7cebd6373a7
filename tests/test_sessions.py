"""J6, J7, J8, A15, A17-A19, W1, W4, W5, M1, M5, F11, F18, F19, T4 batch."""

import pytest
from pyspark.sql import functions as F

from conftest import MSG_COLS, msg, ts
from storelens.operators.sessions import (active_session_count, backfill_session_tokens, derive_latency,
                                          expire_messages, last_n_messages, latest_per_key, merge_session_rollups,
                                          messages_by_role, model_prices, price_usage, rate_window, route,
                                          running_latency_compat, session_messages, session_rollup, sessionise,
                                          upsert_sessions, usage_running)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        msg("t", "s1", 1, "system", "2024-01-01 10:00:00"),
        msg("t", "s1", 2, "user", "2024-01-01 10:00:00", intent="product_inquiry"),
        msg("t", "s1", 3, "assistant", "2024-01-01 10:00:01.5", p=1000, c=500, model="gpt-4o-mini-2024-07-18"),
        msg("t", "s1", 4, "user", "2024-01-01 10:01:00"),
        msg("t", "s1", 5, "assistant", "2024-01-01 10:01:02", p=100, c=0, tot=150, model="GPT-4.1-NANO", lat=777),
        msg("t", "s1", 6, "assistant", "2024-01-01 10:02:00", p=10, c=10, model="unknown-model"),
        msg("t", "s2", 7, "assistant", "2024-01-01 11:00:00", model=None),
        msg("t", "s2", 8, "user", "2024-01-01 11:00:05"),
    ]
    return price_usage(spark.createDataFrame(rows, MSG_COLS)).cache()


def by_id(df, col):
    return {r.message_id: r[col] for r in df.collect()}


def test_price_usage_prefix_rules(spark, log):
    cost = by_id(log, "cost")
    assert cost[3] == pytest.approx(1000 / 1e6 * 0.15 + 500 / 1e6 * 0.60)   # suffix still matches
    assert cost[5] == pytest.approx(100 / 1e6 * 0.10)                        # upper case lowered
    assert cost[6] == 0.0                                                    # unknown -> 0
    assert cost[7] is None and cost[2] is None                               # no model -> NULL
    # longest prefix wins
    prices = model_prices(spark, [("gpt", 1.0, 1.0), ("gpt-4o", 2.0, 2.0)])
    df = spark.createDataFrame([("gpt-4o-mini", 1_000_000, 0), ("gpt-3", 1_000_000, 0)],
                               "model_used string, prompt_tokens long, completion_tokens long")
    got = {r.model_used: r.cost for r in price_usage(df, prices).collect()}
    assert got == {"gpt-4o-mini": 2.0, "gpt-3": 1.0}


def test_derive_latency_as_of(log):
    lat = by_id(derive_latency(log), "latency_ms")
    assert lat[3] == 1500            # 1.5 s after the user message
    assert lat[5] == 777             # explicit value wins
    assert lat[6] == 60000           # latest earlier user message is #4
    assert lat[7] is None            # no earlier user message in s2
    assert lat[2] is None            # user rows untouched


def test_session_rollup_and_upsert(spark, log):
    r = {x.session_id: x for x in session_rollup(derive_latency(log)).collect()}
    s1 = r["s1"]
    assert s1.message_count == 6 and s1.llm_call_count == 3
    assert s1.total_tokens_used == 1500 + 150 + 20
    assert s1.input_tokens == 1110 and s1.output_tokens == 510
    assert s1.max_latency_ms == 60000 and s1.min_latency_ms == 777
    assert s1.avg_latency_ms == pytest.approx((1500 + 777 + 60000) / 3)
    assert s1.started_at == ts("2024-01-01 10:00:00") and s1.ended_at == ts("2024-01-01 10:02:00")
    # upsert of a later batch equals the rollup of everything
    m = derive_latency(log)
    first = session_rollup(m.where(F.col("message_id") <= 4))
    merged = {x.session_id: x for x in upsert_sessions(first, m.where(F.col("message_id") > 4)).collect()}
    for k in ("message_count", "llm_call_count", "total_tokens_used", "max_latency_ms", "min_latency_ms",
              "started_at", "ended_at"):
        assert merged["s1"][k] == s1[k], k
    assert merged["s1"].avg_latency_ms == pytest.approx(s1.avg_latency_ms)
    assert merged["s1"].estimated_cost == pytest.approx(s1.estimated_cost)
    assert merge_session_rollups(first, first).count() == first.count()


def test_running_latency_compat_integer_recurrence(spark):
    from conftest import MSG_COLS as C
    rows = [msg("t", "s", 1, "user", "2024-01-01 00:00:00"),
            msg("t", "s", 2, "assistant", "2024-01-01 00:00:01", lat=100),
            msg("t", "s", 3, "user", "2024-01-01 00:00:02"),
            msg("t", "s", 4, "assistant", "2024-01-01 00:00:03", lat=201)]
    r = running_latency_compat(spark.createDataFrame(rows, C)).first()
    # first: 100; second: n = 3 earlier messages -> (100 * 2 + 201) div 3 = 133
    assert r.avg_latency_ms_compat == 133 and r.max_latency_ms == 201 and r.min_latency_ms == 100


def test_backfill_tokens_and_running_usage(spark, log):
    sessions = session_rollup(log).withColumn("input_tokens", F.lit(None)).withColumn("output_tokens", F.lit(None))
    got = {r.session_id: (r.input_tokens, r.output_tokens) for r in backfill_session_tokens(sessions, log).collect()}
    assert got == {"s1": (1110, 510), "s2": (0, 0)}
    run = {r.message_id: r for r in usage_running(log).collect()}
    assert run[6].cum_tokens == 1670 and run[6].cum_calls == 3
    assert run[6].cum_cost == pytest.approx(run[3].call_cost + run[5].call_cost + run[6].call_cost)


def test_last_n_and_projections(log):
    last = {r.message_id: r.position for r in last_n_messages(log, 3).collect()}
    assert last == {4: 1, 5: 2, 6: 3, 7: 1, 8: 2}
    assert messages_by_role(log).where("role = 'system'").count() == 0
    assert messages_by_role(log, include_system=True).count() == 8
    dash = by_id(session_messages(log, "t", "s2"), "cost")
    hist = by_id(session_messages(log, "t", "s2", zero_cost=False), "cost")
    assert dash[7] == 0.0 and hist[7] is None
    routed = by_id(route(log), "route")
    assert routed[2] == "product_inquiry_graph" and routed[4] == "error"


def test_active_sessions_and_expiry(spark):
    s = spark.createDataFrame([("t", "a", ts("2024-01-31 00:30:00")), ("t", "b", None),
                               ("t", "c", ts("2024-01-30 22:00:00"))],
                              "tenant_id string, session_id string, ended_at timestamp")
    assert active_session_count(s, "2024-01-31 01:00:00", 60).first().active_sessions == 2
    m = spark.createDataFrame([("t", 1, ts("2023-12-31 23:59:59")), ("t", 2, ts("2024-01-01 00:00:00")),
                               ("t", 3, None)], "tenant_id string, message_id long, created_at timestamp")
    kept, deleted = expire_messages(m, "2024-01-31 00:00:00", 30)
    assert sorted(r.message_id for r in kept.collect()) == [2, 3]
    assert deleted.first().deleted == 1


def test_rate_window_strict_and_bucketed(spark):
    base = ts("2024-01-01 00:00:00")
    import datetime as dt
    rows = [(i, "k", base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 59, 60, 61, 119.5, 125])]
    got = {r.event_id: r.requests_in_window for r in rate_window(
        spark.createDataFrame(rows, "event_id long, key string, ts timestamp"), "key", "ts", limit=2).collect()}
    # (t-60, t]: at 60 s the request at 0 s has left the window
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 4, 5: 3, 6: 2}


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 5), (2, "c", 3)], "k long, v string, u long")
    assert sorted((r.k, r.v) for r in latest_per_key(df, ["k"], ["u"]).collect()) == [(1, "b"), (2, "c")]


def test_sessionise_gap(spark):
    import datetime as dt
    base = ts("2024-01-01 00:00:00")
    rows = [(1, base), (1, base + dt.timedelta(minutes=59)), (1, base + dt.timedelta(minutes=119)),
            (1, base + dt.timedelta(minutes=179, seconds=1)), (2, base)]
    out = sessionise(spark.createDataFrame(rows, "user_id long, ts timestamp"), "user_id", "ts", 3600)
    got = sorted((r.user_id, r.event_count) for r in out.collect())
    assert got == [(1, 1), (1, 3), (2, 1)]


def test_segmented_scans_cross_segments(spark):
    """Sessions spanning several days: carry-ins and cross-day merges are exact."""
    from conftest import MSG_COLS as C
    rows = [msg("t", "s", 1, "user", "2024-01-01 23:59:00"),
            msg("t", "s", 2, "assistant", "2024-01-02 00:00:30", p=10, c=1, model="gpt-4o-mini"),
            msg("t", "s", 3, "assistant", "2024-01-03 00:00:00", p=5, c=5, model="gpt-4o-mini")]
    m = price_usage(spark.createDataFrame(rows, C))
    lat = by_id(derive_latency(m), "latency_ms")
    assert lat[2] == 90_000 and lat[3] == 24 * 3600_000 + 60_000
    run = {r.message_id: r for r in usage_running(m).collect()}
    assert run[3].cum_tokens == 21 and run[3].cum_calls == 2


def test_sessionise_chains_across_midnights(spark):
    import datetime as dt
    base = ts("2024-01-01 22:30:00")
    step = [0, 50, 100, 150, 200, 250, 300]          # minutes; every gap 50 min -> one session over 3 days
    rows = [(1, base + dt.timedelta(minutes=m)) for m in step]
    rows += [(1, base + dt.timedelta(minutes=300 + 61)), (1, base + dt.timedelta(hours=30))]
    rows += [(2, base + dt.timedelta(hours=h)) for h in (0, 2, 4)]
    out = sessionise(spark.createDataFrame(rows, "user_id long, ts timestamp"), "user_id", "ts", 3600)
    got = sorted((r.user_id, r.event_count, r.first_ts) for r in out.collect())
    assert [(u, n) for u, n, _ in got] == [(1, 1), (1, 1), (1, 7), (2, 1), (2, 1), (2, 1)]
    one = [r for r in out.collect() if r.event_count == 7][0]
    assert one.session_end == base + dt.timedelta(minutes=300 + 60)


def test_route_with_error_column(spark):
    df = spark.createDataFrame([("store_brand_question", None), ("unrelated", "boom"), (None, None)],
                               "intent string, error string")
    got = [r.route for r in route(df, error_col="error").collect()]
    assert got == ["store_brand_graph", "error", "error"]
