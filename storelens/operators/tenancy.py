"""Tenancy, data-quality and table-maintenance operators.

F2, F17, J10, J12, M3, M6, M8, M9, M10.  The reference enforces these with
row-level security, foreign keys, unique indexes and DDL; here they are
joins and aggregates that produce reports or fail a write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from storelens.functions.misc import merge_settings
from storelens.operators.common import as_ts
from storelens.schemas import DEFAULT_TENANT_DESCRIPTION


def check_tenant_writes(df: DataFrame, tenant_id: str, col: str = "tenant_id") -> DataFrame:
    """the frame, failing at execution if any row belongs to another tenant.

    ``assert_true`` is evaluated inside the write job itself - no extra pass.
    """
    ok = F.coalesce(F.col(col) == F.lit(tenant_id), F.lit(False))
    guard = F.assert_true(ok, F.lit(f"row outside tenant {tenant_id}"))
    return df.where(F.coalesce(guard.isNull(), F.lit(True)))


def tenant_info(tenants: DataFrame, for_agent: bool = False) -> DataFrame:
    """tenant fields with defaults (settings {}; agent view fills description)."""
    empty = F.create_map().cast("map<string,string>")
    desc = F.col("description")
    if for_agent:
        desc = F.coalesce(desc, F.lit(DEFAULT_TENANT_DESCRIPTION))
    return tenants.select("tenant_id", "name", desc.alias("description"), "brand_voice", "store_url",
                          "logo_url", F.coalesce("settings", empty).alias("settings"),
                          "created_at", "updated_at")


def missing_tenants(df: DataFrame, tenants: DataFrame, col: str = "tenant_id") -> DataFrame:
    """Tenant ids used by ``df`` that do not exist (should be empty)."""
    used = df.select(F.col(col).alias("tenant_id")).distinct()
    return used.join(tenants.select("tenant_id"), "tenant_id", "left_anti")


def require_tenant(df: DataFrame, tenants: DataFrame, col: str = "tenant_id") -> DataFrame:
    """J10 as a guard: rows of ``df`` whose tenant exists (left semi join)."""
    t = tenants.select(F.col("tenant_id").alias(col))
    return df.join(t, col, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose foreign key has no parent (NULL keys are not orphans)."""
    p = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(p, fk, "left_anti")


def orphan_report(checks: list) -> DataFrame:
    """J12 summary: one row (relation, orphans) per (name, child, parent, fk, pk)."""
    parts = [orphans(c, p, fk, pk).agg(F.count(F.lit(1)).alias("orphans"))
             .select(F.lit(name).alias("relation"), "orphans") for name, c, p, fk, pk in checks]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def delete_tenant(tables: dict, tenant_id: str, col: str = "tenant_id") -> dict:
    """M3: every table without the tenant's rows (cascade by tenant key)."""
    return {name: df.where(~F.coalesce(F.col(col) == F.lit(tenant_id), F.lit(False)))
            for name, df in tables.items()}


def apply_settings_changes(tenants: DataFrame, changes: DataFrame, seq_col: str = "seq",
                           as_of=None) -> DataFrame:
    """M6: apply a batch of partial tenant updates; only given fields change.

    ``changes`` has tenant_id, ``seq`` (application order) and any of name,
    description, brand_voice, store_url, logo_url, settings (a map merged
    shallowly, right side wins).  Per field the last non-NULL change wins
    (``max_by`` - mergeable, no collected lists); settings are reduced per
    (tenant, key) the same way.
    """
    fields = [c for c in ("name", "description", "brand_voice", "store_url", "logo_url") if c in changes.columns]
    agg = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq_col))).alias(f"_new_{c}") for c in fields]
    reduced = changes.groupBy("tenant_id").agg(*agg, F.max(seq_col).alias("_seq"))
    out = tenants.join(reduced, "tenant_id", "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
    if "settings" in changes.columns:
        kv = (changes.select("tenant_id", seq_col, F.explode("settings").alias("k", "v"))
              .groupBy("tenant_id", "k").agg(F.max_by("v", F.col(seq_col)).alias("v"))
              .groupBy("tenant_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_new_settings")))
        out = out.join(kv, "tenant_id", "left") \
                 .withColumn("settings", F.when(F.col("_new_settings").isNull(), F.col("settings"))
                             .otherwise(merge_settings(F.col("settings"), F.col("_new_settings")))) \
                 .drop("_new_settings")
    touched = F.col("_seq").isNotNull()
    as_of = F.current_timestamp() if as_of is None else as_of
    if "updated_at" in out.columns:
        out = out.withColumn("updated_at", F.when(touched, as_ts(as_of)).otherwise(F.col("updated_at")))
    return out.drop("_seq")


def evolve_schema(df: DataFrame, target: T.StructType, defaults: dict | None = None) -> DataFrame:
    """M8: add the target's missing columns (with defaults), cast, and order like it."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = []
    for f in target.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in target.fields}]
    return df.select(*cols, *extra)


def verify_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """M9: column-by-column comparison with an expected schema (metadata only)."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for f in expected.fields:
        got = actual.get(f.name)
        want = f.dataType.simpleString()
        rows.append((f.name, want, got, "ok" if got == want else ("missing" if got is None else "type")))
    for name, got in actual.items():
        if name not in {f.name for f in expected.fields}:
            rows.append((name, None, got, "extra"))
    return df.sparkSession.createDataFrame(
        rows, "column string, expected string, actual string, status string")


def duplicate_keys(df: DataFrame, key: list) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def uniqueness_report(checks: list) -> DataFrame:
    """M10 summary: (relation, rows, distinct_keys, duplicate_keys) per (name, df, key)."""
    parts = []
    for name, df, key in checks:
        per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per.agg(F.sum("n").cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
                             F.count(F.when(F.col("n") > 1, F.lit(1))).alias("duplicate_keys"))
                     .select(F.lit(name).alias("relation"), "rows", "distinct_keys", "duplicate_keys"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
