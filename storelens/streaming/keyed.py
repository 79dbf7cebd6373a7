"""T5 recent history and T6 rate limiting: keyed state on transformWithState.

State lies in a RocksDB store, so a task's memory doesn't grow with the number
of keys.  Every call to the store and every frame costs the same whether it
holds one key or a thousand, so keys share state by ``SHARDS`` hashes: a shard's
keys are read, decided and written together.  A shard has one event-time timer
at a time (or one a pane); the timer that finds newer rows moves on, the one
that finds none deletes the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from storelens.functions.admission import admit
from storelens.schemas import HISTORY_CAP, RATE_LIMIT, RATE_WINDOW_SECONDS, SESSION_TTL_SECONDS
from storelens.streaming.metrics import WATERMARK, event_time

SHARDS = 256      # a running stream keeps it for good, as its state lies by shards
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _on_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _named(col: str, alias: str | None = None) -> list:
    """An id as a column without nulls and a flag: pandas would turn all ids of
    a batch with a null into floats, which the state stores as nulls."""
    return [F.coalesce(F.col(col).cast("long"), F.lit(0)).alias(alias or col), F.col(col).isNotNull().alias("named")]


def _ids(ids, named) -> pd.api.extensions.ExtensionArray:
    return pd.arrays.IntegerArray(np.array(ids, dtype=np.int64), ~np.array(named, dtype=bool))


def _plain(column: pd.Series) -> list:
    """Python values with None for nulls, as the state stores them."""
    return column.astype(object).where(column.notna(), None).tolist()


def _shard(shards: int, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(shards)).alias("shard")


def _micros(times: pd.Series) -> np.ndarray:
    return pd.to_datetime(times).to_numpy().astype("datetime64[us]").astype("int64")


# ---------------------------------------------------------------------------
# T5
# ---------------------------------------------------------------------------

HISTORY_OUT = ("tenant_id string, session_id string, position long, message_id long, role string, "
               "content string, created_at timestamp")
_COLUMNS = ["named", "message_id", "role", "content"]
_ORDER = itemgetter(0, 1, 2)        # time, rows without an id first, id


class _History(StatefulProcessor):
    def __init__(self, n: int, ttl_seconds: int, timers: bool, processing_ttl: bool):
        self.n, self.ttl, self.timers, self.processing_ttl = n, ttl_seconds, timers, processing_ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "us long, named boolean, message_id long, role string, content string",
                                            self.ttl * 1000 if self.processing_ttl else None)

    def _tail(self, messages: list[tuple]) -> list[tuple]:
        """The newest n in order, after the last gap of the time to live."""
        messages = sorted(messages, key=_ORDER)[-self.n:]
        if not self.processing_ttl:
            for i in range(len(messages) - 1, 0, -1):
                if messages[i][0] - messages[i - 1][0] >= self.ttl * 1_000_000:
                    return messages[i:]
        return messages

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(row) for row in self.messages.get()]
        # The answer depends on the newest n alone, so chunks are folded into
        # n messages one after the other, whatever the key's volume.
        last = self._tail(held)
        before = len(last)
        old = last
        for chunk in rows:
            new = zip(_micros(chunk["created_at"]).tolist(), *(chunk[c].tolist() for c in _COLUMNS))
            last = self._tail(last + list(new))
        # messages that follow those in the state are appended to it; the list is
        # written anew when it would be twice as long as wanted, or is out of order
        stays = sum(m in old for m in last) if before else 0
        fresh = last[stays:]
        if stays and not self.processing_ttl and last[:stays] == old[before - stays:] \
                and (len(last) == self.n or stays == before) and len(held) + len(fresh) <= 2 * self.n:
            if fresh:
                self.messages.appendList(fresh)
        else:
            self.messages.put(last)
        if self.timers and not held:
            self.handle.registerTimer(last[-1][0] // 1000 + self.ttl * 1000)
        us, named, ids, roles, contents = zip(*last)
        yield pd.DataFrame({"tenant_id": key[0], "session_id": key[1], "position": range(1, len(last) + 1),
                            "message_id": _ids(ids, named), "role": roles, "content": contents,
                            "created_at": np.array(us, dtype="datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = max((row[0] for row in self.messages.get()), default=None)
        if newest is not None:
            end = newest // 1000 + self.ttl * 1000
            if end > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(end)
            else:
                self.messages.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Histories(StatefulProcessor):
    """The histories of a shard's sessions, by event time."""

    SESSION = ["tenant_id", "session_id"]
    HELD = [*SESSION, "us", *_COLUMNS]

    def __init__(self, n: int, ttl_seconds: int):
        self.n, self.ttl = n, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getValueState(
            "messages", "tenant_id array<string>, session_id array<string>, us array<long>, named array<boolean>, "
                        "message_id array<long>, role array<string>, content array<string>")

    def _held(self) -> pd.DataFrame | None:
        state = self.messages.get()
        return pd.DataFrame(dict(zip(self.HELD, state))) if state else None

    def _live(self, held: pd.DataFrame, watermark_ms: int) -> pd.DataFrame:
        """The sessions that don't end before the watermark."""
        newest = held.groupby(self.SESSION, dropna=False)["us"].transform("max")
        return held[(newest + self.ttl) // 1000 > watermark_ms]

    def _tail(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The newest n of each session, in order (rows without an id first, then by id)."""
        rows = rows.sort_values(["us", "named", "message_id"], kind="stable")
        return rows.groupby(self.SESSION, dropna=False, sort=False).tail(self.n)

    def _after_gap(self, rows: pd.DataFrame) -> pd.DataFrame:
        """What follows each session's last gap of the time to live."""
        session = rows.groupby(self.SESSION, dropna=False, sort=False).ngroup()
        gap = rows.groupby(session)["us"].diff() >= self.ttl
        part = gap.groupby(session).cumsum()
        return rows[part == part.groupby(session).transform("max")]

    def _keep(self, rows: pd.DataFrame) -> None:
        self.messages.update(tuple(_plain(rows[c]) for c in self.HELD))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        last = [] if held is None else [self._live(held, timerValues.getCurrentWatermarkInMs()).assign(fresh=False)]
        # folded chunk after chunk, so a task holds n messages a session and a chunk
        for chunk in rows:
            chunk = chunk.assign(us=_micros(chunk["created_at"]), fresh=True)[[*self.HELD, "fresh"]]
            last = [self._tail(pd.concat([*(x for x in last if len(x)), chunk], ignore_index=True))]
        out = self._after_gap(last[0])
        self._keep(out)
        if held is None:
            self.handle.registerTimer((int(out["us"].max()) + self.ttl) // 1000)
        by = out.groupby(self.SESSION, dropna=False, sort=False)
        out = out.assign(position=by.cumcount() + 1, changed=by["fresh"].transform("any"))
        out = out[out["changed"]]
        yield pd.DataFrame({"tenant_id": out["tenant_id"], "session_id": out["session_id"], "position": out["position"],
                            "message_id": _ids(out["message_id"], out["named"]), "role": out["role"],
                            "content": out["content"], "created_at": out["us"].to_numpy().astype("datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        live = held if held is None else self._live(held, timerValues.getCurrentWatermarkInMs())
        if live is not None and len(live):
            if len(live) < len(held):
                self._keep(live)
            self.handle.registerTimer((int(live["us"].max()) + self.ttl) // 1000)
        else:
            self.messages.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_recent_history(messages: DataFrame, n: int = HISTORY_CAP, ttl_seconds: int = SESSION_TTL_SECONDS,
                          watermark: str | None = WATERMARK, processing_ttl: bool = False,
                          shards: int | None = SHARDS) -> DataFrame:
    """T5: the last ``n`` messages per session, expiring ``ttl_seconds`` after
    the last message.

    Sessions share state by ``shards`` hashes, each a table of at most ``n``
    messages a session; sessions that have ended leave it.  Without shards, or
    without a watermark, a session has its own list of at most 2 ``n`` messages,
    to which new ones are appended.  Messages expire by event time: a gap of the time to live or more
    begins a new history, and a timer deletes the state once the watermark has
    passed its end.  With ``processing_ttl`` the store itself expires the list
    by the cluster's clock, ``ttl_seconds`` after it was last written; Spark
    runs such a stream without end, so give it a trigger other than availableNow.

    Emits a key's whole history (positions 1..m, oldest first) whenever it
    changes; the upsert sink keeps the newest history per key.
    """
    m = event_time(messages, "created_at", None if processing_ttl else watermark) \
        .select("tenant_id", "session_id", *_named("message_id"), "role", "content", "created_at")
    _on_rocksdb(m)
    timers = bool(watermark) and not processing_ttl
    if shards and timers:
        return m.withColumn("shard", _shard(shards, "tenant_id", "session_id")).groupBy("shard") \
            .transformWithStateInPandas(_Histories(n, ttl_seconds), HISTORY_OUT, "Update", "EventTime")
    return m.groupBy("tenant_id", "session_id").transformWithStateInPandas(
        _History(n, ttl_seconds, timers, processing_ttl), HISTORY_OUT, "Update",
        "ProcessingTime" if processing_ttl else "EventTime" if timers else "None")


# ---------------------------------------------------------------------------
# T6
# ---------------------------------------------------------------------------

RATE_OUT = "key string, request_id long, ts timestamp, admitted boolean, in_window long"
_EMIT_ROWS = 100_000


class _Limiter(StatefulProcessor):
    """Admitted times of the trailing window, at most ``limit``."""

    def __init__(self, limit: int, window_seconds: int, timers: bool):
        self.limit, self.window, self.timers = limit, window_seconds * 1_000_000, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getValueState("admitted", "times array<long>")

    def _decide(self, key, us: np.ndarray, ids: np.ndarray, named: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.lexsort((ids, named, us))
        us, ids, named = us[order], ids[order], named[order]
        # one call to the store: no state and state without times are the same
        state = self.admitted.get()
        prior = np.array(state[0] if state else [], dtype=np.int64)
        ok, inside, prior = admit(us, prior[prior > us[0] - self.window], self.limit, self.window)
        self.admitted.update((prior[prior > us[-1] - self.window].tolist(),))
        for lo in range(0, len(us), _EMIT_ROWS):
            part = slice(lo, lo + _EMIT_ROWS)
            yield pd.DataFrame({"key": key[0], "request_id": _ids(ids[part], named[part]), "ts": us[part].astype("datetime64[us]"),
                                "admitted": ok[part], "in_window": inside[part]})

    def _end(self) -> int | None:
        state = self.admitted.get()
        return (max(state[0]) + self.window) // 1000 if state and len(state[0]) else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.timers and not self.admitted.exists()
        chunks = [(_micros(p["at"]), p["request"].to_numpy(), p["named"].to_numpy(dtype=bool)) for p in rows]
        yield from self._decide(key, *(np.concatenate(column) for column in zip(*chunks)))
        if first:
            self.handle.registerTimer(self._end() or timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = self._end()
        if end is not None and end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
        else:
            self.admitted.clear()
        return iter(())

    def close(self) -> None:
        pass


class _OrderedLimiter(_Limiter):
    """Requests wait in panes of event time until the watermark has passed
    them, so they are decided in order however they arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # a pane's pieces, one for each chunk of rows that brought some of it
        self.pieces = handle.getMapState("pieces", "pane long", "pieces int")
        self.waiting = handle.getMapState("waiting", "pane long, piece int", "times array<long>, ids array<long>, named array<boolean>")

    def _more(self, p: pd.DataFrame, own: np.ndarray) -> tuple:
        return ()

    def _pane(self, key, held: list[tuple], end: int) -> Iterator[pd.DataFrame]:
        yield from self._decide(key, *(np.concatenate([np.array(h[i], dtype=kind) for h in held])
                                       for i, kind in enumerate((np.int64, np.int64, bool))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for p in rows:
            us, ids, named = _micros(p["at"]), p["request"].to_numpy(), p["named"].to_numpy(dtype=bool)
            panes = us // self.window
            for pane in np.unique(panes).tolist():
                own = panes == pane
                found = self.pieces.getValue((pane,))
                piece = found[0] if found else 0
                self.waiting.updateValue((pane, piece), (us[own].tolist(), ids[own].tolist(), named[own].tolist(),
                                                         *self._more(p, own)))
                self.pieces.updateValue((pane,), (piece + 1,))
                if not piece:
                    self.handle.registerTimer((pane + 1) * self.window // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        pane = now * 1000 // self.window - 1
        found = self.pieces.getValue((pane,))
        if found:
            held = [self.waiting.getValue((pane, i)) for i in range(found[0])]
            yield from self._pane(key, held, now * 1000)
            for i in range(found[0]):
                self.waiting.removeKey((pane, i))
            self.pieces.removeKey((pane,))
            # admitted ones matter until the next pane is over
            self.handle.registerTimer(now + self.window // 1000)
        elif not self.pieces.exists():
            self.admitted.clear()


class _ShardLimiter(_OrderedLimiter):
    """The panes of a shard's keys: one pane of all of them is decided at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getValueState("admitted", "keys array<string>, times array<array<long>>")
        self.pieces = handle.getMapState("pieces", "pane long", "pieces int")
        self.waiting = handle.getMapState(
            "waiting", "pane long, piece int",
            "times array<long>, ids array<long>, named array<boolean>, keys array<string>")

    def _more(self, p: pd.DataFrame, own: np.ndarray) -> tuple:
        return (_plain(p["k"][own]),)

    def _pane(self, key, held: list[tuple], end: int) -> Iterator[pd.DataFrame]:
        us, ids, named = (np.concatenate([np.array(h[i], dtype=kind) for h in held])
                          for i, kind in enumerate((np.int64, np.int64, bool)))
        codes, keys = pd.factorize(np.array([k for h in held for k in h[3]], dtype=object), use_na_sentinel=False)
        order = np.lexsort((ids, named, us, codes))
        us, ids, named, codes = us[order], ids[order], named[order], codes[order]
        state = self.admitted.get()
        before = {k: np.array(t, dtype=np.int64) for k, t in zip(*state)} if state else {}
        none, after = np.empty(0, dtype=np.int64), {}
        ok, inside = np.empty(len(us), dtype=bool), np.empty(len(us), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(codes, prepend=-1, append=-1)).tolist()
        names = [None if pd.isna(k) else k for k in keys]
        for lo, hi in zip(cuts, cuts[1:]):
            k, prior = names[codes[lo]], before.get(names[codes[lo]], none)
            ok[lo:hi], inside[lo:hi], prior = admit(us[lo:hi], prior[prior > us[lo] - self.window], self.limit, self.window)
            # what the pane's end leaves behind matters to no later request
            prior = prior[prior > end - self.window]
            if len(prior):
                after[k] = prior.tolist()
        self.admitted.update((list(after), list(after.values())))
        for lo in range(0, len(us), _EMIT_ROWS):
            part = slice(lo, lo + _EMIT_ROWS)
            yield pd.DataFrame({"key": np.array(names, dtype=object)[codes[part]], "request_id": _ids(ids[part], named[part]),
                                "ts": us[part].astype("datetime64[us]"), "admitted": ok[part], "in_window": inside[part]})


def stream_rate_limit(requests: DataFrame, key: str, id_col: str, ts_col: str = "ts", limit: int = RATE_LIMIT,
                      window_seconds: int = RATE_WINDOW_SECONDS, watermark: str | None = WATERMARK,
                      ordered: bool = False, shards: int | None = SHARDS) -> DataFrame:
    """Exact admission - a request is admitted when fewer than ``limit``
    *admitted* requests of its key lie in (ts - window, ts].

    State per key is the admitted times still inside the window (at most
    ``limit``), deleted by a timer once the watermark has passed the window.
    By default requests are decided at once, in (ts, id) order within a
    micro-batch, so a task holds the times and ids of one key's requests in it
    (16 bytes each).

    ``ordered`` (needs a watermark) decides a request once the watermark has
    passed its pane, a window's length of event time: the answer is that of
    the whole log in (ts, id) order however rows arrive within the watermark.
    Requests without a time are no requests.  Waiting ones lie in the state store, by ``shards``
    hashes of their keys (None: by keys); a task holds one Arrow chunk, then one shard's requests
    of one pane, never its micro-batch.
    """
    if ordered and not watermark:
        raise ValueError("ordered decisions need a watermark")
    r = event_time(requests, ts_col, watermark) \
        .select(F.col(key).cast("string").alias("k"), *_named(id_col, "request"),
                F.col(ts_col).alias("at")).where("at IS NOT NULL")
    _on_rocksdb(r)
    if ordered and shards:
        return r.withColumn("shard", _shard(shards, "k")).groupBy("shard").transformWithStateInPandas(
            _ShardLimiter(limit, window_seconds, True), RATE_OUT, "Append", "EventTime")
    form = _OrderedLimiter if ordered else _Limiter
    return r.groupBy("k").transformWithStateInPandas(
        form(limit, window_seconds, bool(watermark)), RATE_OUT, "Append", "EventTime" if watermark else "None")
