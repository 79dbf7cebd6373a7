"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

All queries run once to warm up the JVM, then each runs ``BENCH_RUNS`` times
(default 3); the median wall time is reported.  ``value`` sums the end-to-end queries (each
derives its tables from the raw driver tables).  The ``served_*`` entries are
per-tenant requests over tables stored once, partitioned by tenant (and day),
i.e. the reference's request path; the reference's read timeout is 1 s.  Execution is forced with the ``noop`` sink,
so the whole plan runs on the executors and nothing is collected to the
driver.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storelens.plans.registry import QUERIES  # noqa: E402
from storelens.session import get_spark  # noqa: E402

HEADLINE = [
    "top_products", "overview", "sessions_over_time", "message_volume", "cost_breakdown",
    "intent_distribution", "hourly_activity", "latency_summary", "latency_percentiles", "latency_by_hour",
    "worst_sessions", "session_rollup", "derive_latency", "price_usage", "usage_running", "last_n_messages",
    "rate_window", "sessionise", "upsert_sessions", "filter_products", "first_image", "lookup_ordered",
    "catalogue_listing", "semantic_topk", "search_combined", "search_batch", "variant_rollup",
    "clean_html", "extract_links", "embedding_json", "transcripts", "settings_merge", "embedding_coverage",
    "stream_session_metrics", "stream_event_counts",
]


def run_once(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def served_suite(spark, sf: str, runs: int) -> dict:
    """Per-tenant requests over stored, tenant-partitioned tables (setup not timed)."""

    from pyspark.sql import functions as F

    from storelens import adapters as A
    from storelens.plans.serving import TenantStore, build_tables
    from storelens.session import checkpoint_dir

    base = f"{checkpoint_dir(spark)}/bench-tables-{os.getpid()}"
    build_tables(spark, sf, base)
    store = TenantStore(spark, base)
    t, as_of = "tenant-1", A.AS_OF
    vec = [1.0] + [0.0] * 63
    # a busy session of the tenant (picked once, outside the timed requests)
    session = (store.table("messages", t).groupBy("session_id").count()
               .orderBy(F.desc("count"), "session_id").first()["session_id"])
    requests = {
        "overview": lambda: store.overview(t, as_of),
        "sessions_over_time": lambda: store.sessions_over_time(t, as_of, 7),
        "message_volume": lambda: store.message_volume(t, as_of, 7),
        "cost_breakdown": lambda: store.cost_breakdown(t, as_of, 7),
        "intent_distribution": lambda: store.intent_distribution(t, as_of, 7),
        "hourly_activity": lambda: store.hourly_activity(t, as_of, 7),
        "top_products": lambda: store.top_products(t, as_of),
        "latency_percentiles": lambda: store.latency(t, as_of)["percentiles"],
        "latency_by_hour": lambda: store.latency(t, as_of)["by_hour"],
        "recent_sessions": lambda: store.recent_sessions(t),
        "tenant_info": lambda: store.tenant_info(t),
        "session_messages": lambda: store.session_messages(t, session),
        "history": lambda: store.history(t, session, 10),
        "search": lambda: store.search(t, product_type="ECONOMY", min_price=1000.0, query_vec=vec, k=5),
        "listing": lambda: store.listing(t, 100, 0),
    }
    out = {}
    for name, make in requests.items():
        def once():
            t0 = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        once()
        out[f"served_{name}"] = round(statistics.median(once() for _ in range(runs)), 3)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus * 2)))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=shuffle, driver_memory="16g",
                      extra={"spark.ui.enabled": "false"})
    for name in names:                                             # one warm-up pass (JIT, file metadata)
        run_once(spark, name, sf)
    times = {}
    for name in names:
        times[name] = round(statistics.median(run_once(spark, name, sf) for _ in range(runs)), 3)
    total = round(sum(times.values()), 3)
    served = served_suite(spark, sf, runs) if not sys.argv[1:] else {}
    label = os.path.basename(sf)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": {**times, **served},
                      "served_max_sec": max(served.values()) if served else None, "sf": label.replace("sf", "") if label.startswith("sf") else label,
                      "cpus": cpus, "runs": runs, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
