"""Per-tenant requests over stored tables (the reference's request path).

``build_tables`` writes the commerce tables once, partitioned by tenant (logs
also by day); ``TenantStore`` reads them with the tenant as a partition
filter, so a request only lists and scans that tenant's folders, and the
time window of a dashboard query prunes day folders and row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from storelens import adapters as A
from storelens.operators import dashboard as D
from storelens.operators import latency as L
from storelens.operators.sessions import session_rollup
from storelens.plans.reports import recent_sessions
from storelens.plans.search import catalogue_listing, search_products
from storelens.operators.sessions import last_n_messages, session_messages
from storelens.operators.tenancy import tenant_info
from storelens.schemas import HISTORY_DEFAULT
from storelens.sources.catalog import export_daily_csv
from storelens.sources.tables import read_table, write_table

LOGS = ("messages", "product_events")


def build_tables(spark: SparkSession, sf_dir: str, base: str) -> dict:
    """Derive the commerce tables from the driver tables and store them."""
    ev = A.load(spark, sf_dir, "events")
    li = A.load(spark, sf_dir, "lineitem")
    messages = A.messages(ev)
    tables = {
        "messages": messages.withColumn("day", F.to_date("created_at")),
        "product_events": A.product_events(ev).withColumn("day", F.to_date("created_at")),
        "sessions": session_rollup(messages),
        "products": A.products(A.load(spark, sf_dir, "part"), li, A.load(spark, sf_dir, "embeddings")),
        "images": A.images(li),
        "tenants": A.tenants(A.load(spark, sf_dir, "nation")),
    }
    for name, df in tables.items():
        write_table(df, f"{base}/{name}", ["tenant_id", "day"] if name in LOGS else ["tenant_id"], "overwrite")
    return {name: f"{base}/{name}" for name in tables}


class TenantStore:
    """Tenant-scoped readers over the stored tables."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.schemas: dict = {}        # of the stored tables, read from a file's footer once

    def table(self, name: str, tenant_id: str) -> DataFrame:
        path = f"{self.base}/{name}"
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(path).schema
        return read_table(self.spark, path, tenant_id, self.schemas[name])

    # dashboard routes -----------------------------------------------------
    def overview(self, tenant_id, as_of):
        return D.overview(self.table("sessions", tenant_id), self.table("messages", tenant_id), as_of, tenant_id)

    def sessions_over_time(self, tenant_id, as_of, days=7):
        return D.sessions_over_time(self.table("sessions", tenant_id), as_of, days)

    def message_volume(self, tenant_id, as_of, days=7):
        return D.message_volume(self.table("messages", tenant_id), as_of, days)

    def cost_breakdown(self, tenant_id, as_of, days=7):
        return D.cost_breakdown(self.table("messages", tenant_id), as_of, days)

    def intent_distribution(self, tenant_id, as_of, days=7):
        return D.intent_distribution(self.table("messages", tenant_id), as_of, days)

    def hourly_activity(self, tenant_id, as_of, days=7):
        return D.hourly_activity(self.table("messages", tenant_id), as_of, days, tenant_id)

    def top_products(self, tenant_id, as_of, event_type="recommended", limit=10, days=7):
        return D.top_products(self.table("product_events", tenant_id), self.table("products", tenant_id),
                              as_of, event_type, limit, days, tenant_id)

    def latency(self, tenant_id, as_of, days=7):
        return L.latency_report(self.table("messages", tenant_id), as_of, days, tenant_id)

    def recent_sessions(self, tenant_id, limit=10):
        return recent_sessions(self.table("sessions", tenant_id), limit)

    def tenant_info(self, tenant_id):
        return tenant_info(self.table("tenants", tenant_id))

    def session_messages(self, tenant_id, session_id):
        return session_messages(self.table("messages", tenant_id), tenant_id, session_id)

    def history(self, tenant_id, session_id, n=HISTORY_DEFAULT):
        m = self.table("messages", tenant_id).where(F.col("session_id") == session_id)
        return last_n_messages(m, n)

    def export_daily(self, tenant_id, as_of, path, days=30):
        return export_daily_csv(self.table("sessions", tenant_id), as_of, path, days, tenant_id)

    # catalogue / search routes -------------------------------------------
    def search(self, tenant_id, **request):
        return search_products(self.table("products", tenant_id), tenant_id, **request)

    def listing(self, tenant_id, limit=100, offset=0, **kw):
        return catalogue_listing(self.table("products", tenant_id), self.table("images", tenant_id),
                                 tenant_id, limit, offset, **kw)
