"""Chat sessions and messages: pricing, rollups, as-of latency, history, rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from storelens.functions.admission import admit
from storelens.functions.misc import total_tokens, usage_cost
from storelens.operators.common import as_ts, top_k_per_group
from storelens.schemas import (DEFAULT_MODEL_PRICES, HISTORY_DEFAULT, INTENT_ROUTES, MODEL_PRICES,
                               RATE_LIMIT, RATE_WINDOW_SECONDS, SESSION_TTL_SECONDS)

SESSION_KEY = ["tenant_id", "session_id"]


# ---------------------------------------------------------------------------
# J7 price_usage
# ---------------------------------------------------------------------------

def model_prices(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or DEFAULT_MODEL_PRICES, MODEL_PRICES)


def _price_expr(model: Column, rules: list, field: int) -> Column:
    """CASE over prefixes, longest first; unknown model -> NULL price."""
    key = F.lower(model)
    expr = None
    for rule in rules:
        cond = key.startswith(F.lit(rule[0]))
        val = F.lit(float(rule[field]))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr if expr is not None else F.lit(None).cast("double")


def price_usage(usage: DataFrame, prices: DataFrame | None = None, *, model_col: str = "model_used",
                prompt_col: str = "prompt_tokens", completion_col: str = "completion_tokens",
                out_col: str = "cost") -> DataFrame:
    """Cost of each usage row from a prefix-keyed price table.

    Lower-cased model name must *start with* a price key; the longest key
    wins; no match costs 0; NULL model gives NULL cost.  The default table is
    a CASE expression: no join, no shuffle.  A given ``prices`` table of any
    size is joined: each different model name is matched by hash on its
    prefixes, and the few names go back to the usage rows.
    """
    model = F.col(model_col)
    if prices is None:
        rules = sorted(DEFAULT_MODEL_PRICES, key=lambda r: (-len(r[0]), r[0]))
        cost = usage_cost(prompt_col, completion_col, _price_expr(model, rules, 1), _price_expr(model, rules, 2))
        return usage.withColumn(out_col, F.when(model.isNotNull(), cost))
    names = usage.select(F.lower(model).alias("_model")).where(F.col("_model").isNotNull()).distinct()
    prefixes = names.select("_model", F.explode(F.sequence(F.lit(0), F.length("_model"))).alias("_len")) \
                    .withColumn("_prefix", F.substring("_model", F.lit(1), F.col("_len")))
    p = prices.groupBy(F.col("prefix").alias("_prefix")).agg(
        F.max(F.struct("input", "output")).alias("_price"))       # a repeated key: its dearest row
    best = prefixes.join(p, "_prefix").groupBy("_model").agg(F.max_by("_price", "_len").alias("_price"))
    out = usage.withColumn("_key", F.lower(model)).join(best, F.col("_key") == F.col("_model"), "left")
    cost = usage_cost(prompt_col, completion_col, F.col("_price.input"), F.col("_price.output"))
    return out.withColumn(out_col, F.when(model.isNotNull(), cost)).drop("_key", "_model", "_price")


# ---------------------------------------------------------------------------
# F11 / F18 / F19 projections
# ---------------------------------------------------------------------------

def messages_by_role(messages: DataFrame, include_system: bool = False, role: str | None = None) -> DataFrame:
    """drop system rows unless asked; optionally keep one role only."""
    out = messages if include_system else messages.where(F.col("role") != "system")
    return out if role is None else out.where(F.col("role") == role)


def session_messages(messages: DataFrame, tenant_id: str | None = None, session_id: str | None = None,
                     zero_cost: bool = True) -> DataFrame:
    """message projection; for one session, in chronological order.

    ``zero_cost`` selects the dashboard reader (NULL/0 cost -> 0); otherwise the
    history reader (NULL/0 cost -> NULL).
    """
    out = messages
    if tenant_id is not None:
        out = out.where(F.col("tenant_id") == tenant_id)
    if session_id is not None:
        out = out.where(F.col("session_id") == session_id)
    cost = F.col("cost")
    cost = F.coalesce(cost, F.lit(0.0)) if zero_cost else F.when(cost != 0, cost)
    out = out.select("tenant_id", "session_id", "message_id", "role", "content", "structured_data",
                     "model_used", cost.alias("cost"), "created_at", "latency_ms")
    # one session is a bounded set: return it in chronological order
    return out.orderBy("created_at", "message_id") if session_id is not None else out


def route(df: DataFrame, intent_col: str = "intent", error_col: str | None = None,
          out_col: str = "route") -> DataFrame:
    """error -> 'error'; else intent -> workflow name; unknown -> 'error'."""
    expr = None
    for intent, target in INTENT_ROUTES.items():
        c = F.col(intent_col) == intent
        expr = F.when(c, F.lit(target)) if expr is None else expr.when(c, F.lit(target))
    expr = expr.otherwise(F.lit("error"))
    if error_col is not None:
        expr = F.when(F.col(error_col).isNotNull(), F.lit("error")).otherwise(expr)
    return df.withColumn(out_col, expr)


# ---------------------------------------------------------------------------
# J6 derive_latency (as-of join as a window frame)
# ---------------------------------------------------------------------------

SEGMENT = "1 day"     # time slice that bounds one task's share of a hot session


def _segment(ts: Column, segment: str) -> Column:
    return F.date_trunc("day", ts) if segment == "1 day" else F.window(ts, segment)["start"]


def derive_latency(messages: DataFrame, segment: str = SEGMENT) -> DataFrame:
    """Assistant latency = ms since the latest earlier user message.

    An explicit latency wins; none earlier -> NULL; ms truncated.

    As-of lookup as a segmented scan, so one hot session never lands in a
    single task: rows are cut into (session, time-segment) slices; inside a
    slice a running ``last(ignorenulls)`` frame finds the latest earlier user
    message; a slice with none takes the last user message of the nearest
    earlier slice, found from one summary row per slice (a small window).
    """
    key = SESSION_KEY + ["_seg"]
    m = messages.withColumn("_seg", _segment(F.col("created_at"), segment))
    user_ts = F.when(F.col("role") == "user", F.col("created_at"))
    w_in = (Window.partitionBy(*key).orderBy("created_at", "message_id")
            .rowsBetween(Window.unboundedPreceding, -1))
    within = m.withColumn("_last_user", F.last(user_ts, ignorenulls=True).over(w_in))
    # carry-in: last user message of all earlier segments of the session
    summary = m.groupBy(*key).agg(F.max(user_ts).alias("_seg_last_user"))
    w_prev = (Window.partitionBy(*SESSION_KEY).orderBy("_seg")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.withColumn("_carry", F.last("_seg_last_user", ignorenulls=True).over(w_prev)) \
                   .select(*key, "_carry")
    joined = within.join(carry, key, "left")
    last_user = F.coalesce(F.col("_last_user"), F.col("_carry"))
    gap_ms = ((F.unix_micros("created_at") - F.unix_micros(last_user)) / F.lit(1000)).cast("long")
    derived = F.when((F.col("role") == "assistant") & last_user.isNotNull(), gap_ms)
    out = joined.withColumn(
        "latency_ms",
        F.when(F.col("role") == "assistant", F.coalesce(F.col("latency_ms"), derived)).otherwise(F.col("latency_ms")))
    return out.select(*messages.columns)


# ---------------------------------------------------------------------------
# A17 session_rollup, A18 compat fold, M1 upsert
# ---------------------------------------------------------------------------

def _is_llm_call() -> Column:
    return (F.col("model_used").isNotNull() | F.col("prompt_tokens").isNotNull()
            | F.col("completion_tokens").isNotNull())


def session_rollup(messages: DataFrame) -> DataFrame:
    """One row per (tenant, session) from the message log.

    Exact sums (the reference rounds cost at each increment); latency stats
    over assistant rows with a latency.  One hash aggregate with map-side
    partial aggregation, so a hot session costs one partial row per task.
    """
    llm = _is_llm_call()
    asst_lat = F.when(F.col("role") == "assistant", F.col("latency_ms"))
    return messages.groupBy(*SESSION_KEY).agg(
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("ended_at"),
        F.count(F.lit(1)).alias("message_count"),
        F.count(F.when(llm, F.lit(1))).alias("llm_call_count"),
        F.coalesce(F.sum(F.when(llm, total_tokens("total_tokens", "prompt_tokens", "completion_tokens"))),
                   F.lit(0)).cast("long").alias("total_tokens_used"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("estimated_cost"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.avg(asst_lat).alias("avg_latency_ms"),
        F.max(asst_lat).alias("max_latency_ms"),
        F.min(asst_lat).alias("min_latency_ms"),
        F.count(asst_lat).alias("latency_count"),
    )


def merge_session_rollups(*parts: DataFrame) -> DataFrame:
    """Combine partial rollups of the same sessions (associative)."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    lat_sum = F.sum(F.col("avg_latency_ms") * F.col("latency_count"))
    lat_n = F.sum("latency_count")
    return df.groupBy(*SESSION_KEY).agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.sum("message_count").alias("message_count"),
        F.sum("llm_call_count").alias("llm_call_count"),
        F.sum("total_tokens_used").alias("total_tokens_used"),
        F.sum("estimated_cost").alias("estimated_cost"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.try_divide(lat_sum, lat_n).alias("avg_latency_ms"),
        F.max("max_latency_ms").alias("max_latency_ms"),
        F.min("min_latency_ms").alias("min_latency_ms"),
        lat_n.alias("latency_count"),
    )


def upsert_sessions(existing: DataFrame, new_messages: DataFrame) -> DataFrame:
    """M1: fold a batch of new messages into the stored session rows.

    Insert unseen sessions, update the rest (ended_at moves forward, counters
    add up).  Union + re-aggregate instead of a full outer join: one shuffle
    with partial aggregation, and duplicate keys in either input are merged.
    """
    return merge_session_rollups(existing, session_rollup(new_messages))


COMPAT_OUT = ("tenant_id string, session_id string, avg_latency_ms_compat long, "
              "max_latency_ms long, min_latency_ms long")


def _compat_fold(batches):
    """Fold sorted (tenant, session, created_at, message_id) rows; state carries
    across Arrow batches, so memory is one batch whatever the session size."""
    import pandas as pd

    cur, n, avg, hi, lo = None, 0, None, None, None
    out = []

    def flush():
        if cur is not None and avg is not None:
            out.append((cur[0], cur[1], int(avg), int(hi), int(lo)))

    for pdf in batches:
        keys = zip(pdf["tenant_id"].tolist(), pdf["session_id"].tolist())
        for k, role, lat in zip(keys, pdf["role"].tolist(), pdf["latency_ms"].tolist()):
            if k != cur:
                flush()
                cur, n, avg, hi, lo = k, 0, None, None, None
            if role == "assistant" and lat is not None and lat == lat:
                x = int(lat)
                if avg is None:
                    avg = x
                elif n != 0:
                    num = avg * (n - 1) + x
                    q = abs(num) // n           # exact integer division truncating toward zero
                    avg = q if num >= 0 else -q
                hi = x if hi is None else max(hi, x)
                lo = x if lo is None else min(lo, x)
            n += 1
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=["tenant_id", "session_id", "avg_latency_ms_compat",
                                             "max_latency_ms", "min_latency_ms"])
            out = []
    flush()
    if out:
        yield pd.DataFrame(out, columns=["tenant_id", "session_id", "avg_latency_ms_compat",
                                         "max_latency_ms", "min_latency_ms"])


def running_latency_compat(messages: DataFrame) -> DataFrame:
    """The reference's incremental average, reproduced exactly.

    avg <- x when unset, else (avg * (n - 1) + x) div n where n is the
    session's message count *before* this message (all roles), integer
    arithmetic.  The recurrence is order-dependent and not associative, so
    it is a sequential fold: rows are hash-partitioned by session, sorted
    within partitions, and folded by ``mapInPandas`` which streams Arrow
    batches - a session is never collected, however large.  Use A17's exact
    average for analytics; this exists for parity with stored values.
    """
    rows = (messages.select(*SESSION_KEY, "created_at", "message_id", "role", "latency_ms")
            .repartition(*SESSION_KEY)
            .sortWithinPartitions(*SESSION_KEY, "created_at", "message_id"))
    return rows.mapInPandas(_compat_fold, COMPAT_OUT)


# ---------------------------------------------------------------------------
# J8 backfill, A19 running usage, A15 active sessions, M5 expiry
# ---------------------------------------------------------------------------

def backfill_session_tokens(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """input/output tokens per session = sums over its assistant rows, else 0.

    The reference's two correlated subqueries become one grouped aggregate
    and one left join on the session key.
    """
    sums = (messages.where(F.col("role") == "assistant").groupBy(*SESSION_KEY)
            .agg(F.sum("prompt_tokens").alias("_in"), F.sum("completion_tokens").alias("_out")))
    s = sessions.drop("input_tokens", "output_tokens")
    return (s.join(sums, SESSION_KEY, "left")
             .withColumn("input_tokens", F.coalesce("_in", F.lit(0)).cast("long"))
             .withColumn("output_tokens", F.coalesce("_out", F.lit(0)).cast("long"))
             .drop("_in", "_out"))


def usage_running(messages: DataFrame, segment: str = SEGMENT) -> DataFrame:
    """Cumulative tokens, cost and call count per session, per LLM call.

    Segmented prefix sums: running sums inside (session, time-segment)
    slices plus the totals of all earlier slices (a window over one summary
    row per slice), so a hot session is spread over many tasks.
    """
    calls = messages.where(_is_llm_call()) \
        .withColumn("_seg", _segment(F.col("created_at"), segment)) \
        .withColumn("_tok", total_tokens("total_tokens", "prompt_tokens", "completion_tokens")) \
        .withColumn("_cost", F.coalesce("cost", F.lit(0.0)))
    key = SESSION_KEY + ["_seg"]
    w_in = (Window.partitionBy(*key).orderBy("created_at", "message_id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = calls.withColumn("_t", F.sum("_tok").over(w_in)) \
                  .withColumn("_c", F.sum("_cost").over(w_in)) \
                  .withColumn("_n", F.count(F.lit(1)).over(w_in))
    seg = calls.groupBy(*key).agg(F.sum("_tok").alias("_st"), F.sum("_cost").alias("_sc"),
                                  F.count(F.lit(1)).alias("_sn"))
    w_prev = Window.partitionBy(*SESSION_KEY).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = seg.select(*key, F.coalesce(F.sum("_st").over(w_prev), F.lit(0)).alias("_ot"),
                         F.coalesce(F.sum("_sc").over(w_prev), F.lit(0.0)).alias("_oc"),
                         F.coalesce(F.sum("_sn").over(w_prev), F.lit(0)).alias("_on"))
    out = within.join(offsets, key, "left")
    return out.select(
        *SESSION_KEY, "message_id", "created_at",
        F.col("_tok").cast("long").alias("call_tokens"),
        F.col("_cost").alias("call_cost"),
        (F.col("_t") + F.col("_ot")).cast("long").alias("cum_tokens"),
        (F.col("_oc") + F.col("_c")).alias("cum_cost"),
        (F.col("_n") + F.col("_on")).cast("long").alias("cum_calls"),
    )


def active_session_count(sessions: DataFrame, as_of, minutes: int = 60) -> DataFrame:
    """Sessions with ended_at in the last ``minutes`` *or* NULL, per tenant."""
    cutoff = as_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))
    active = F.col("ended_at").isNull() | ((F.col("ended_at") > cutoff) & (F.col("ended_at") <= as_ts(as_of)))
    return (sessions.groupBy("tenant_id")
            .agg(F.count_distinct(F.when(active, F.col("session_id"))).alias("active_sessions")))


def expire_messages(messages: DataFrame, as_of, days: int = 30):
    """M5: (kept rows, deleted count per tenant).  NULL timestamps are kept."""
    cutoff = as_ts(as_of) - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(0))
    keep = F.coalesce(F.col("created_at") >= cutoff, F.lit(True))
    kept = messages.where(keep)
    deleted = messages.groupBy("tenant_id").agg(F.count(F.when(~keep, F.lit(1))).alias("deleted"))
    return kept, deleted


# ---------------------------------------------------------------------------
# W1 last_n_messages, W5 latest_per_key
# ---------------------------------------------------------------------------

def last_n_messages(messages: DataFrame, n: int = HISTORY_DEFAULT, key: list | None = None,
                    order: list | None = None) -> DataFrame:
    """The newest ``n`` messages of every session, numbered oldest first.

    ``position`` runs 1..m (m <= n) in chronological order.
    """
    key = key or SESSION_KEY
    order = order or ["created_at", "message_id"]
    newest = top_k_per_group(messages, key, [F.col(c).desc() for c in order], n, "_recency")
    w = Window.partitionBy(*key)
    return (newest.withColumn("position", (F.count(F.lit(1)).over(w) - F.col("_recency") + 1).cast("long"))
                  .drop("_recency"))


def latest_per_key(df: DataFrame, key: list, order_cols: list) -> DataFrame:
    """Keep the newest row per key (replace-by-key), ties broken by later order columns.

    ``max_by`` over a struct is a mergeable aggregate, so duplicates are
    reduced map-side before the shuffle.
    """
    payload = F.struct(*[F.col(c) for c in df.columns if c not in key])
    ordering = F.struct(*[F.col(c) for c in order_cols])
    return (df.groupBy(*key).agg(F.max_by(payload, ordering).alias("_row"))
              .select(*key, "_row.*"))


# ---------------------------------------------------------------------------
# W4 rate_window (trailing count per key) and T4 batch sessionisation
# ---------------------------------------------------------------------------

def rate_window(requests: DataFrame, key: str, ts_col: str = "ts", *, window_seconds: int = RATE_WINDOW_SECONDS,
                limit: int = RATE_LIMIT) -> DataFrame:
    """Requests by the same key in (ts - window, ts], and whether over ``limit``.

    The lower bound is strict, as in the reference's limiter (a request
    exactly ``window`` seconds old has left the window).

    A plain per-key RANGE frame puts a hot key's whole history in one task.
    Instead each row is bucketed by ``window_seconds`` of time and also copied
    into the next bucket as look-back context; the frame then runs per
    (key, bucket), so a task holds at most two buckets of one key.
    """
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    size = window_seconds * 1_000_000
    b = F.floor(micros / F.lit(size)).cast("long")
    tagged = (requests.withColumn("_us", micros)
              .withColumn("_b", b)
              .withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
              .withColumn("_bucket", F.col("_b") + F.col("_copy")))
    w = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-size + 1, 0)
    counted = tagged.withColumn("requests_in_window", F.count(F.lit(1)).over(w))
    return (counted.where(F.col("_copy") == 0)
                   .withColumn("over_limit", F.col("requests_in_window") > F.lit(limit))
                   .drop("_us", "_b", "_copy", "_bucket"))


def quiet_pieces(requests: DataFrame, key: str, ts_col: str, window_seconds: int) -> DataFrame:
    """``requests`` that have a time, with ``_us`` and ``_piece``: a number that
    changes, within a key, only where no request came for a whole window.

    Time is cut into buckets of one window; a bucket begins a piece if its first
    request is a window or more after the last one of the bucket before.  Only one
    row a key and bucket is put in order, whatever the number of requests.
    """
    size = window_seconds * 1_000_000
    rows = (requests.withColumn("_us", F.unix_micros(F.col(ts_col).cast("timestamp"))).where("_us IS NOT NULL")
            .withColumn("_bucket", F.floor(F.col("_us") / F.lit(size)).cast("long")))
    order = Window.partitionBy("_k").orderBy("_b")
    quiet = F.col("_low") - F.lag("_high").over(order) >= size
    pieces = (rows.groupBy(F.col(key).alias("_k"), F.col("_bucket").alias("_b"))
              .agg(F.min("_us").alias("_low"), F.max("_us").alias("_high"))
              .withColumn("_cut", F.when(F.coalesce(quiet, F.lit(True)), F.col("_b")))
              .select("_k", "_b", F.max("_cut").over(order).alias("_piece")))
    return rows.join(pieces, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b"))) \
               .drop("_k", "_b", "_bucket")


def rate_limit_audit(requests: DataFrame, key: str, id_col: str, ts_col: str = "ts", *, limit: int = RATE_LIMIT,
                     window_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """W4, exact: which requests of a log the limiter admits (batch form of T6).

    A request is admitted when fewer than ``limit`` admitted requests of its key
    lie in (ts - window, ts]; requests are decided in (ts, id) order.  Returns key
    (as text), request_id, ts, admitted and in_window, the admitted requests of
    the window after the decision.  Requests without a time are left out; those
    without a key share one.

    After a quiet window the limiter holds nothing, so the pieces of
    ``quiet_pieces`` are decided in parallel, each in one pass over sorted Arrow
    batches that carries ``limit`` times.  A task puts its pieces on one time line,
    a window apart, and decides a batch at once.
    """
    if limit < 1 or window_seconds < 1:
        raise ValueError("limit and window must be at least 1")
    size = window_seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, line, last = np.empty(0, dtype=np.int64), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            us = batch.column("_us").to_numpy()
            piece = np.append(False, batch.column("_start").to_numpy(zero_copy_only=False)[1:])
            step = np.diff(us, prepend=us[0])
            # a batch may go on with the piece of the one before
            first = (batch.column("key")[0].as_py(), batch.column("_piece")[0].as_py())
            step[0] = us[0] - last[1] if last is not None and last[0] == first else size
            times = line + np.cumsum(np.where(piece, size, step))
            ok, inside, prior = admit(times, prior, limit, size)
            line = int(times[-1])
            last = (batch.column("key")[n - 1].as_py(), batch.column("_piece")[n - 1].as_py()), int(us[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("request_id"), batch.column("_us"), pa.array(ok), pa.array(inside)],
                names=["key", "request_id", "us", "admitted", "in_window"])

    rows = quiet_pieces(requests, key, ts_col, window_seconds).select(
        F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("request_id"), "_us", "_piece")
    dealt = rows.repartition("key", "_piece").sortWithinPartitions("key", "_piece", "_us", "request_id")
    return dealt.mapInArrow(_marked_starts(fold), "key string, request_id long, us long, admitted boolean, in_window long") \
                .withColumn("ts", F.timestamp_micros("us")) \
                .select("key", "request_id", "ts", "admitted", "in_window")


def _marked_starts(fold):
    """``fold`` on batches with a column that marks each row whose key or piece
    isn't that of the row before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked():
            for batch in batches:
                n = batch.num_rows
                start = np.zeros(n, dtype=bool)
                for c in ("key", "_piece"):
                    codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                    start[1:] |= codes[1:] != codes[:-1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "_start"])
        return fold(marked())
    return run


def sessionise(events: DataFrame, key: str, ts_col: str = "ts", gap_seconds: int = SESSION_TTL_SECONDS,
               segment: str = SEGMENT) -> DataFrame:
    """T4 (batch): activity sessions that expire ``gap_seconds`` after the last event.

    A session is [first event, last event + gap); a new one starts when the
    gap to the previous event is >= ``gap_seconds``.

    Skew-safe two-level form: sessions are first built inside (key,
    time-segment) slices with ``session_window``, so a task holds at most one
    key's slice.  Only the first and last session of a slice can continue
    across a slice boundary, so just those (<= 2 per key and segment) are
    merged across slices by an interval merge; the slice-interior sessions
    are final as they are.
    """
    gap = f"{gap_seconds} seconds"
    e = events.select(F.col(key), F.col(ts_col).cast("timestamp").alias("_ts")) \
              .withColumn("_seg", _segment(F.col("_ts"), segment))
    local = (e.groupBy(key, "_seg", F.session_window("_ts", gap).alias("s"))
              .agg(F.count(F.lit(1)).alias("event_count"), F.min("_ts").alias("first_ts"),
                   F.max("_ts").alias("last_ts"))
              .select(key, "_seg", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                      "event_count", "first_ts", "last_ts"))
    w_seg = Window.partitionBy(key, "_seg")
    marked = (local.withColumn("_is_first", F.col("session_start") == F.min("session_start").over(w_seg))
                   .withColumn("_is_last", F.col("session_start") == F.max("session_start").over(w_seg)))
    cols = [key, "session_start", "session_end", "event_count", "first_ts", "last_ts"]
    interior = marked.where(~F.col("_is_first") & ~F.col("_is_last")).select(*cols)
    edge = marked.where(F.col("_is_first") | F.col("_is_last")).select(*cols)
    # interval merge of edge sessions per key: a new group starts when the
    # session begins at or after the furthest end seen so far
    w = Window.partitionBy(key).orderBy("session_start", "session_end")
    reach = F.max("session_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = edge.withColumn("_new", F.when(reach.isNull() | (F.col("session_start") >= reach), 1).otherwise(0)) \
                  .withColumn("_grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy(key, "_grp").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("event_count").alias("event_count"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts")).select(*cols)
    return interior.unionByName(merged)
