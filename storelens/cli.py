"""spark-submit entry points (the reference's ingest / export commands).

    spark-submit -m storelens.cli ingest --input 'landing/*.json' --tenant T --out <catalog>
    spark-submit -m storelens.cli export-daily --tables <tables> --as-of 2024-01-31 --out <csv>
    spark-submit -m storelens.cli stream-sessions --landing <messages> --out <sessions>

Each command is one Spark application; the cluster supplies master,
resources and ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from storelens.schemas import MESSAGES
from storelens.session import configure


def _spark(app: str) -> SparkSession:
    spark = SparkSession.builder.appName(app).getOrCreate()
    return configure(spark)


def cmd_ingest(a) -> None:
    from storelens.operators.common import for_tenant
    from storelens.plans.ingest import ingest_catalog, read_catalog_tables, write_catalog_tables
    from storelens.sources.catalog import read_catalog_json, read_catalog_ndjson
    spark = _spark("storelens-ingest")
    raw = read_catalog_ndjson(spark, a.input) if a.ndjson else read_catalog_json(spark, a.input)
    # products that aren't sent again stay, unless the whole catalogue is replaced
    current = None
    if a.current:
        current = read_catalog_tables(spark, a.current)
    elif not a.replace_all:
        current = {n: for_tenant(t, a.tenant) for n, t in read_catalog_tables(spark, a.out).items()}
    out = ingest_catalog(raw, a.tenant, current=current, embed=a.embed, materialize_docs=True)
    write_catalog_tables(out, a.out)
    out["summary"].show(truncate=False)


def cmd_export_daily(a) -> None:
    from storelens.sources.catalog import export_daily_csv
    from storelens.sources.tables import read_table
    spark = _spark("storelens-export")
    sessions = read_table(spark, f"{a.tables}/sessions", a.tenant)
    export_daily_csv(sessions, a.as_of, a.out, a.days, a.tenant)


def cmd_stream_sessions(a) -> None:
    from storelens.streaming.metrics import stream_session_metrics
    from storelens.streaming.sources import file_stream, sink_checkpoint, upsert_batch_writer
    spark = _spark("storelens-stream-sessions")
    src = file_stream(spark, a.landing, MESSAGES, max_files_per_trigger=a.max_files)
    # session windows support append only: a session is written once closed
    mode = "append" if a.gap else "update"
    window = None if a.gap or a.window == "none" else a.window
    w = (stream_session_metrics(src, gap_seconds=a.gap or None, window=window).writeStream.outputMode(mode)
         .foreachBatch(upsert_batch_writer(a.out))
         .option("checkpointLocation", a.checkpoint or sink_checkpoint(a.out)))
    # --once drains what has landed and stops (a scheduled batch run); the
    # checkpoint makes the next run continue where this one ended
    w = w.trigger(availableNow=True) if a.once else w.trigger(processingTime=a.trigger)
    w.start().awaitTermination()


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="storelens")
    sub = p.add_subparsers(dest="cmd", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--input", required=True)
    i.add_argument("--tenant", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--current", help="stored tables to go on from (default: the tenant's at --out, if any)")
    i.add_argument("--replace-all", action="store_true", help="the tenant keeps only the products of this input")
    i.add_argument("--ndjson", action="store_true")
    i.add_argument("--embed", action="store_true")
    i.set_defaults(fn=cmd_ingest)
    e = sub.add_parser("export-daily")
    e.add_argument("--tables", required=True)
    e.add_argument("--as-of", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--tenant")
    e.add_argument("--days", type=int, default=30)
    e.set_defaults(fn=cmd_export_daily)
    s = sub.add_parser("stream-sessions")
    s.add_argument("--landing", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--checkpoint")
    s.add_argument("--gap", type=int, default=0)
    s.add_argument("--window", default="1 day",
                   help="count a session by windows, whose state the watermark ends; 'none' keeps all sessions for ever")
    s.add_argument("--max-files", type=int, default=1000)
    s.add_argument("--trigger", default="30 seconds")
    s.add_argument("--once", action="store_true")
    s.set_defaults(fn=cmd_stream_sessions)
    a = p.parse_args(argv)
    a.fn(a)


if __name__ == "__main__":
    main()
