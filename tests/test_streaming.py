"""Streams over files equal their batch twins; keyed-state semantics."""

import datetime as dt
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE, ts
from storelens import adapters as A
from storelens.operators.sessions import session_rollup
from storelens.streaming.keyed import stream_rate_limit, stream_recent_history
from storelens.streaming.metrics import (stream_event_counts, stream_hourly_latency, stream_session_metrics,
                                         stream_sessionise)
from storelens.streaming.sources import file_stream, new_checkpoint, read_upserted, run_to_table, stream_path


def events_stream(spark):
    schema = spark.read.parquet(f"{SMOKE}/events.parquet").schema
    return file_stream(spark, f"{SMOKE}/events.parquet", schema)


def drain(df, key, mode="update", group=False):
    spark = df.sparkSession
    path = new_checkpoint(spark, "test-table")
    run_to_table(df, path, mode=mode)
    return read_upserted(spark, path, key, group)


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_path():
    assert stream_path("/a/events.parquet") == "/a/events.parque[t]"
    assert stream_path("/a/landing") == "/a/landing"


def test_session_metrics_equals_batch(spark):
    batch = session_rollup(A.messages(A.load(spark, SMOKE, "events")))
    stream = drain(stream_session_metrics(A.messages(events_stream(spark))), ["tenant_id", "session_id"])
    cols = ["tenant_id", "session_id", "started_at", "ended_at", "message_count", "llm_call_count",
            "total_tokens_used", "input_tokens", "output_tokens", "max_latency_ms", "min_latency_ms"]
    assert rows(stream, cols) == rows(batch, cols)


def test_event_counts_equal_batch(spark):
    pe = A.product_events(A.load(spark, SMOKE, "events"))
    batch = pe.groupBy("tenant_id", "event_type", "product_id", F.date_trunc("day", "created_at").alias("window_start")) \
              .agg(F.count(F.lit(1)).alias("event_count"))
    stream = drain(stream_event_counts(A.product_events(events_stream(spark))),
                   ["tenant_id", "event_type", "product_id", "window_start"])
    cols = ["tenant_id", "event_type", "product_id", "window_start", "event_count"]
    assert rows(stream, cols) == rows(batch, cols)


def test_hourly_latency_counts(spark):
    stream = drain(stream_hourly_latency(A.messages(events_stream(spark))), ["tenant_id", "hour"])
    m = A.messages(A.load(spark, SMOKE, "events")).where("role = 'assistant' AND latency_ms IS NOT NULL")
    assert stream.agg(F.sum("message_count")).first()[0] == m.count()


def test_sessionise_closed_sessions(spark):
    out = drain(stream_sessionise(events_stream(spark), "user_id", "ts", 3600), ["user_id", "session_start"],
                mode="append")
    ev = A.load(spark, SMOKE, "events")
    max_ts = ev.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    assert out.count() > 0
    assert out.agg(F.max("session_end")).first()[0] <= max_ts - dt.timedelta(hours=1)


def test_recent_history_cap_and_ttl(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    base = ts("2024-01-01 00:00:00")
    recs = [("t", "s", i, "user", f"m{i}", base + dt.timedelta(minutes=i)) for i in range(25)]
    recs += [("t", "s", 100, "user", "late", base + dt.timedelta(minutes=24 + 61))]     # gap > TTL
    recs += [("t", "q", 200 + i, "user", f"q{i}", base + dt.timedelta(minutes=i)) for i in range(3)]
    pd.DataFrame(recs, columns=["tenant_id", "session_id", "message_id", "role", "content", "created_at"]) \
      .to_parquet(land / "part-0.parquet", coerce_timestamps="us")
    schema = "tenant_id string, session_id string, message_id long, role string, content string, created_at timestamp"
    from pyspark.sql.types import _parse_datatype_string
    src = file_stream(spark, str(land), _parse_datatype_string(schema))
    out = drain(stream_recent_history(src, n=20, ttl_seconds=3600), ["tenant_id", "session_id"], group=True)
    got = {}
    for r in out.collect():
        got.setdefault(r.session_id, []).append((r.position, r.message_id))
    assert sorted(got["s"]) == [(1, 100)]             # history expired before the late message
    assert sorted(got["q"]) == [(1, 200), (2, 201), (3, 202)]


def test_rate_limit_admits_exactly(spark, tmp_path):
    land = tmp_path / "req"
    land.mkdir()
    base = ts("2024-01-01 00:00:00")
    secs = [0, 1, 2, 3, 30, 60, 61, 62]
    pd.DataFrame({"user_id": [7] * len(secs), "event_id": range(len(secs)),
                  "ts": [base + dt.timedelta(seconds=s) for s in secs]}).to_parquet(land / "p.parquet", coerce_timestamps="us")
    from pyspark.sql.types import _parse_datatype_string
    src = file_stream(spark, str(land), _parse_datatype_string("user_id long, event_id long, ts timestamp"))
    out = drain(stream_rate_limit(src, "user_id", "event_id", "ts", limit=3, window_seconds=60), ["request_id"],
                mode="append")
    adm = {r.request_id: r.admitted for r in out.collect()}
    # 0,1,2 admitted; 3 and 30 rejected (3 admitted in window); at 60 the one at 0 left -> admitted;
    # 61: window (1,61] holds 2,60 -> admitted; 62: (2,62] holds 60,61 -> admitted
    assert [adm[i] for i in range(len(secs))] == [True, True, True, False, False, True, True, True]


def test_session_metrics_with_inactivity_gap(spark):
    out = drain(stream_session_metrics(A.messages(events_stream(spark)), gap_seconds=3600),
                ["tenant_id", "session_id", "started_at"], mode="append")
    assert out.count() > 0
    ev = A.load(spark, SMOKE, "events")
    max_ts = ev.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    # only sessions closed by the final watermark are emitted
    assert out.agg(F.max("ended_at")).first()[0] <= max_ts - dt.timedelta(hours=2)


def test_active_sessions_sketch_matches_exact_on_small_counts(spark):
    from storelens.streaming.metrics import stream_active_sessions
    key = ["tenant_id", "window_start"]
    exact = drain(stream_active_sessions(A.messages(events_stream(spark)), "1 hour", "30 minutes", exact=True),
                  key, mode="append")
    approx = drain(stream_active_sessions(A.messages(events_stream(spark)), "1 hour", "30 minutes"), key)
    e = {(r.tenant_id, r.window_start): r.active_sessions for r in exact.collect()}
    a = {(r.tenant_id, r.window_start): r.active_sessions for r in approx.collect()}
    assert e and all(a[k] == v for k, v in e.items())   # HLL++ is exact at these cardinalities


def test_compact_upserted(spark, tmp_path):
    from storelens.streaming.sources import compact_upserted
    path = new_checkpoint(spark, "compact-src")
    run_to_table(stream_event_counts(A.product_events(events_stream(spark))), path)
    out = str(tmp_path / "snapshot")
    key = ["tenant_id", "event_type", "product_id", "window_start"]
    compact_upserted(spark, path, key, out)
    snap = spark.read.parquet(out)
    assert snap.count() == read_upserted(spark, path, key).count() and "_batch" not in snap.columns


class Batches:
    """A landing folder whose files are micro-batches, drained one by one from
    one checkpoint."""

    def __init__(self, spark, folder, schema):
        folder.mkdir()
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        self.table = new_checkpoint(spark, "batches")

    def land(self, build, rows, mode):
        from pyspark.sql.types import _parse_datatype_string
        names = [f.split()[0] for f in self.schema.split(", ")]
        pq.write_table(pa.table({name: pa.array(column) for name, column in zip(names, zip(*rows))}),
                       self.folder / f"p{self.n}.parquet", coerce_timestamps="us")
        self.n += 1
        return run_to_table(build(file_stream(self.spark, str(self.folder), _parse_datatype_string(self.schema))),
                            self.table, mode=mode)


HISTORY = "tenant_id string, session_id string, message_id long, role string, content string, created_at timestamp"


def test_recent_history_state_expires_over_three_batches(spark, tmp_path):
    base = ts("2024-01-01 00:00:00")
    at = lambda s, i, minutes: ("t", s, i, "user", f"{s}{i}", base + dt.timedelta(minutes=minutes))
    b = Batches(spark, tmp_path / "land", HISTORY)
    build = lambda m: stream_recent_history(m, n=3, ttl_seconds=3600, watermark="10 minutes")
    b.land(build, [at("a", i, i) for i in range(5)] + [at("b", 50, 3)], "update")
    b.land(build, [at("a", 5, 30), at("c", 60, 500)], "update")          # appended; the watermark passes a and b
    last = b.land(build, [at("c", 61, 501)], "update")
    got = {}
    for r in read_upserted(spark, b.table, ["tenant_id", "session_id"], True).collect():
        got.setdefault(r.session_id, []).append((r.position, r.message_id))
    assert {k: sorted(v) for k, v in got.items()} == {
        "a": [(1, 3), (2, 4), (3, 5)], "b": [(1, 50)], "c": [(1, 60), (2, 61)]}
    assert last.exception() is None
    after = b.land(build, [at("a", 7, 502)], "update")                   # a's list went: a new history
    rows = {(r.session_id, r.position): r.message_id
            for r in read_upserted(spark, b.table, ["tenant_id", "session_id"], True).collect()}
    assert rows[("a", 1)] == 7 and ("a", 2) not in rows
    assert after.exception() is None


def test_recent_history_with_the_clocks_time_to_live(spark, tmp_path):
    import time
    from storelens.streaming.sources import sink_checkpoint, upsert_batch_writer
    from pyspark.sql.types import _parse_datatype_string
    base = ts("2024-01-01 00:00:00")

    def last_history(name, ttl, n, pause):
        land, table = tmp_path / name, new_checkpoint(spark, name)
        land.mkdir()
        for i in range(n):
            row = ("t", "s", i, "user", "x", base + dt.timedelta(hours=2 * i))
            pd.DataFrame([row], columns=[f.split()[0] for f in HISTORY.split(", ")]) \
              .to_parquet(land / f"p{i}.parquet", coerce_timestamps="us")
            src = file_stream(spark, str(land), _parse_datatype_string(HISTORY))
            # such a stream never runs out of batches: one each
            q = (stream_recent_history(src, n=20, ttl_seconds=ttl, processing_ttl=True).writeStream
                 .outputMode("update").foreachBatch(upsert_batch_writer(table))
                 .option("checkpointLocation", sink_checkpoint(table)).trigger(once=True).start())
            assert q.awaitTermination(60)
            time.sleep(pause)
        return sorted(r.message_id for r in read_upserted(spark, table, ["tenant_id", "session_id"], True).collect())

    assert last_history("long", 600, 3, 0) == [0, 1, 2]        # hours of event time, seconds of the clock
    assert last_history("short", 1, 2, 1.5) == [1]


REQUESTS = "user_id long, event_id long, ts timestamp"


def walk(requests, limit, window):
    """Request by request, in (ts, id) order of each user."""
    out, admitted = {}, {}
    for user, rid, at in sorted(requests, key=lambda r: (r[0], r[2], r[1] is not None, r[1] or 0)):
        own = admitted[user] = [a for a in admitted.get(user, []) if a > at - dt.timedelta(seconds=window)]
        if len(own) < limit:
            own.append(at)
            out[rid] = (True, len(own))
        else:
            out[rid] = (False, len(own))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_rate_limit_whatever_the_arrival(spark, tmp_path, seed):
    import random
    rng, base = random.Random(seed), ts("2024-01-01 00:00:00")
    log = [(rng.choice([1, 1, 1, 2]), i, base + dt.timedelta(seconds=rng.randrange(900))) for i in range(600)]
    rng.shuffle(log)                        # both batches hold all times
    b = Batches(spark, tmp_path / "land", REQUESTS)
    build = lambda r: stream_rate_limit(r, "user_id", "event_id", "ts", 3, 60, "1 hour", ordered=True)
    b.land(build, log[:300], "append")
    b.land(build, log[300:], "append")
    # one without an id among ids that a float can't hold
    log += [(3, None, base), (3, 2 ** 60 + 1, base)]
    b.land(build, [(3, None, base), (3, 2 ** 60 + 1, base)], "append")
    end = b.land(build, [(9, 10_000, base + dt.timedelta(days=1))], "append")
    got = {r.request_id: (r.admitted, r.in_window) for r in spark.read.parquet(b.table).collect()}
    want = walk(log, 3, 60)
    assert {k: (got.get(k), want.get(k)) for k in {*got, *want} if got.get(k) != want.get(k)} == {}
    assert end.exception() is None


def test_ordered_rate_limit_holds_a_pane_not_a_batch():
    """One key with many requests: what is decided at once is a pane's."""
    from storelens.streaming.keyed import _OrderedLimiter
    import numpy as np

    class Store(dict):
        getValue, removeKey = dict.get, dict.pop

        def updateValue(self, k, v):
            self[k] = v

        def exists(self):
            return bool(self)

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

        def clear(self):
            self.kept = None

    class Handle:
        def __init__(self):
            self.timers, self.stores = set(), {}

        def getValueState(self, name, schema, ttl=None):
            return self.stores.setdefault(name, Value())

        def getMapState(self, name, k, v, ttl=None):
            return self.stores.setdefault(name, Store())

        def registerTimer(self, ms):
            self.timers.add(ms)

    class Expired:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

    limiter, handle, decided = _OrderedLimiter(5, 60, True), Handle(), []
    limiter.init(handle)
    whole = limiter._decide

    def counted(key, us, ids, named):
        decided.append(len(us))
        return whole(key, us, ids, named)
    limiter._decide = counted
    n, chunk = 50_000, 1000
    seconds = np.random.default_rng(1).permutation(n) // 10
    chunks = (pd.DataFrame({"at": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds[lo:lo + chunk], unit="s"),
                            "request": np.arange(lo, lo + chunk), "named": True}) for lo in range(0, n, chunk))
    assert list(limiter.handleInputRows(("k",), chunks, None)) == [] and not decided
    rows = 0
    while handle.timers:
        ms = min(handle.timers)
        handle.timers.remove(ms)
        rows += sum(len(f) for f in limiter.handleExpiredTimer(("k",), None, Expired(ms)))
    assert rows == n and max(decided) <= 600
    assert not handle.stores["waiting"] and not handle.stores["pieces"] and handle.stores["admitted"].kept is None


def test_active_sessions_by_blocks_over_batches(spark, tmp_path):
    """exact counts whatever the slide, from few state rows."""
    import random
    from storelens.streaming.metrics import stream_active_sessions
    rng, base = random.Random(5), ts("2024-01-01 00:00:00")
    log = sorted((rng.randrange(6 * 3600), rng.choice("abc")) for _ in range(60)) + [(9 * 3600, "a")]
    for window, slide in ((3600, 30), (3600, 7 * 60)):
        b = Batches(spark, tmp_path / f"land{slide}", "tenant_id string, session_id string, created_at timestamp")
        build = lambda m: stream_active_sessions(m, f"{window} seconds", f"{slide} seconds", exact=True)  # noqa: E731,B023
        updated = 0
        for part in (log[:20], log[20:40], log[40:], [(86_400, "z")]):
            q = b.land(build, [("t", s, base + dt.timedelta(seconds=at)) for at, s in part], "append")
            updated += sum(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"])
        want = {}
        t0 = int(base.replace(tzinfo=dt.timezone.utc).timestamp())
        for at, s in log:
            first = (t0 + at - window) // slide * slide + slide
            for w in range(first, t0 + at + 1, slide):
                want.setdefault(w, set()).add(s)
        got = {int(r.window_start.replace(tzinfo=dt.timezone.utc).timestamp()): r.active_sessions
               for r in spark.read.parquet(b.table).selectExpr(
                   "CAST(window_start AS timestamp_ntz) AS window_start", "active_sessions").collect()}
        assert got == {w: len(s) for w, s in want.items()}
        if slide == 30:
            assert updated < 61 * 120 / 2       # a row for each message and window before


class Calls:
    """A state store that counts what it is asked."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, schema, ttl=None):
        calls, held = self, self.values.setdefault(name, {})

        class Value:
            def get(self):
                calls.calls += 1
                return held.get(0)

            def update(self, value):
                calls.calls += 1
                held[0] = value

            def clear(self):
                calls.calls += 1
                held.clear()
        return Value()

    def getMapState(self, name, key, value, ttl=None):
        calls, held = self, self.values.setdefault(name, {})

        class Map:
            def getValue(self, k):
                calls.calls += 1
                return held.get(k)

            def updateValue(self, k, value):
                calls.calls += 1
                held[k] = value

            def removeKey(self, k):
                calls.calls += 1
                held.pop(k)

            def exists(self):
                calls.calls += 1
                return bool(held)
        return Map()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_shards_histories_go_together():
    """as many calls to the store for 300 sessions as for one."""
    import random
    from storelens.streaming.keyed import _Histories
    rng, base, handle, got, seen = random.Random(3), pd.Timestamp("2024-01-01"), Calls(), {}, {}
    shard = _Histories(3, 3600)
    shard.init(handle)
    for batch in range(3):
        rows = [("t" if i % 7 else None, f"s{rng.randrange(300)}", rng.random() < 0.9, batch * 1000 + i, "user", f"{batch}-{i}",
                 base + pd.Timedelta(seconds=batch * 5000 + rng.randrange(5000))) for i in range(1000)]
        for tenant, session, named, mid, _, content, at in rows:
            seen.setdefault((tenant, session), []).append((at, named, mid if named else 0, content))
        frame = pd.DataFrame([(t, s, n, m if n else 0, r, c, a) for t, s, n, m, r, c, a in rows],
                             columns=["tenant_id", "session_id", "named", "message_id", "role", "content", "created_at"])
        frame["created_at"] = frame["created_at"].astype("datetime64[us]")
        before = handle.calls
        for out in shard.handleInputRows((1,), iter([frame[:400], frame[400:]]), At(0)):
            for key, one in out.groupby(["tenant_id", "session_id"], dropna=False):
                key = (None if pd.isna(key[0]) else key[0], key[1])
                got[key] = one.sort_values("position")["content"].tolist()
        assert handle.calls - before <= 3
        want = {}
        for key, held in seen.items():
            held = sorted(held, key=lambda r: r[:3])[-3:]
            cut = [i for i in range(1, len(held)) if held[i][0] - held[i - 1][0] >= pd.Timedelta(seconds=3600)]
            want[key] = [r[3] for r in held[cut[-1] if cut else 0:]]
        assert got == want
    end = max(handle.timers) + 10 ** 9
    assert list(shard.handleExpiredTimer((1,), At(end), At(end))) == [] and not handle.values["messages"]


def test_a_shards_requests_are_decided_together():
    """as many calls to the store for 200 keys as for one."""
    import random
    from storelens.streaming.keyed import _ShardLimiter
    rng, base, handle = random.Random(4), pd.Timestamp("2024-01-01"), Calls()
    log = [(rng.choice([None, *(f"u{k}" for k in range(200))]), i, base + pd.Timedelta(seconds=rng.randrange(300)))
           for i in range(3000)]
    shard = _ShardLimiter(3, 60, True)
    shard.init(handle)
    frame = pd.DataFrame(log, columns=["k", "request", "at"]).assign(named=True)
    assert list(shard.handleInputRows((1,), iter([frame[:1000], frame[1000:]]), At(0))) == []
    got = {}
    while handle.timers:
        ms = min(handle.timers)
        handle.timers.remove(ms)
        for out in shard.handleExpiredTimer((1,), At(ms), At(ms)):
            got.update({int(r.request_id): (r.admitted, r.in_window) for r in out.itertuples()})
    assert handle.calls < 100 and not any(handle.values.values())
    assert got == walk([(u or "", i, at) for u, i, at in log], 3, 60)
