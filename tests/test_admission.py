"""Exact admission over a log equals a request by request walk."""
import random
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storelens.functions.admission import admit
from storelens.operators.sessions import quiet_pieces, rate_limit_audit


def walk(times, limit, window):
    held, out = deque(), []
    for t in times:
        while held and held[0] <= t - window:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append((ok, len(held)))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=80), st.integers(1, 6), st.integers(1, 25), st.integers(0, 80))
def test_admit_equals_a_walk(times, limit, window, cut):
    times = np.array(sorted(times), dtype=np.int64)
    got, prior = [], np.empty(0, dtype=np.int64)
    for part in (times[:cut], times[cut:]):
        ok, inside, prior = admit(part, prior, limit, window)
        got += zip(ok.tolist(), inside.tolist(), strict=True)
        assert len(prior) <= limit
    assert got == walk(times.tolist(), limit, window)


@pytest.fixture(scope="module")
def requests(spark):
    r = random.Random(2)
    rows, t = [], {}
    for i in range(3000):
        k = r.choice(["hot"] * 6 + ["a", "b", None])
        t[k] = t.get(k, 0) + r.choice([0, 0, 1, 2, 5, 10, 40])
        rows.append((k, i, t[k]))
    r.shuffle(rows)
    df = spark.createDataFrame(rows + [("a", 9999, None)], "who string, n long, sec long")
    return rows, df.withColumn("at", F.timestamp_seconds("sec"))


@pytest.mark.parametrize("limit, window, batch", [(3, 10, 10_000), (1, 7, 17), (20, 60, 5)])
def test_audit_equals_a_walk(spark, requests, limit, window, batch):
    rows, df = requests
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((t, i) for who, i, t in rows if who == k)
        for (_, i), got in zip(own, walk([t for t, _ in own], limit, window), strict=True):
            want[i] = (k, *got)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = rate_limit_audit(df, "who", "n", "at", limit=limit, window_seconds=window).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["request_id"]: (r["key"], r["admitted"], r["in_window"]) for r in out} == want
    assert len(out) == len(rows)


def test_a_hot_key_is_cut_where_it_is_quiet(requests):
    rows, df = requests
    pieces = quiet_pieces(df, "who", "at", 10).where("who = 'hot'")
    held = {}
    for r in pieces.collect():
        held.setdefault(r["_piece"], []).append(r["sec"])
    times = sorted(t for who, _, t in rows if who == "hot")
    gaps = sum(b - a >= 10 for a, b in zip(times, times[1:], strict=False))
    assert len(held) == gaps + 1
    spans = sorted((min(v), max(v)) for v in held.values())
    assert all(b[0] - a[1] >= 10 for a, b in zip(spans, spans[1:], strict=False))


def test_bounds(requests):
    with pytest.raises(ValueError, match="limit"):
        rate_limit_audit(requests[1], "who", "n", "at", limit=0)
