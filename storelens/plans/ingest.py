"""Catalogue ingest - documents -> products, images, variants (+ rejects).

One lineage from the raw documents: product columns are expressions on the
nested frame, images and variants are generators (explode) on the same
frame, and replacement of previously stored products is an anti-join - on
ids alone, ahead of the rows, where most of them are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from storelens.functions.catalog import parse_ts
from storelens.operators.catalog import (cascade_children, ingest_summary, normalise_images,
                                         normalise_products, normalise_variants, replace_products,
                                         split_rejects)
from storelens.operators.embed import backfill_embeddings
from storelens.schemas import TABLES
from storelens.session import materialize, set_for

# children before the products that they belong to
WRITE_ORDER = ("rejects", "images", "variants", "products")

# folders that a task writes side by side; rows of further tenants are sorted
OPEN_TENANTS = 8


def _repeated_ids(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id")


def newest_documents(raw: DataFrame, store: bool = False) -> DataFrame:
    """Of documents with the same id the one with the latest ``updated_at``
    (as an instant, whatever its offset), then the last in file order.

    Rows are numbered once, in a stored table, so both sides of the join below see
    the same numbers even where a shuffle or a retry deals rows anew.  Repeated
    ids are found on narrow rows and stored first: without any the documents are
    neither moved nor written again, and a few are sent to the documents.
    ``store`` writes the outcome too, where it isn't the stored table itself.
    Without it documents that have no repeated ids are not written at all: they
    are ``raw``, which should then give the same rows whenever it is read.
    Documents without an id all stay.
    """
    if not store and _repeated_ids(raw).count() == 0:
        return raw
    docs = materialize(raw.withColumn("_pos", F.monotonically_increasing_id()), "catalog-numbered", compression="zstd")
    named = docs.where(F.col("id").isNotNull())
    twice = materialize(_repeated_ids(docs), "catalog-repeated")
    if twice.isEmpty():
        return docs.drop("_pos")
    place = F.struct(parse_ts("updated_at").alias("at"), F.col("_pos").alias("pos"))
    repeated = materialize(named.select("id", "updated_at", "_pos").join(twice, "id", "left_semi")
                           .groupBy(F.col("id").alias("_id")).agg(F.max(place)["pos"].alias("_last")), "catalog-last")
    newest = (docs.join(repeated, F.col("id") == F.col("_id"), "left")
              .where(F.col("_last").isNull() | (F.col("_pos") == F.col("_last"))).drop("_id", "_last", "_pos"))
    return materialize(newest, "catalog-docs", compression="zstd") if store else newest


def _listed(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose values in the columns of ``keys`` are listed there, NULL like any other."""
    other = keys.select(*[F.col(c).alias(f"_{c}") for c in keys.columns])
    cond = F.lit(True)
    for c in keys.columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(other, cond, "left_semi")


def _cascade_ids_first(children: DataFrame, replaced: DataFrame, fk: str = "product_id") -> DataFrame:
    """``cascade_children`` where most parents go: the keys that stay are found
    and stored first, so whole rows are moved only if many of them stay."""
    keys = [c for c in ("tenant_id", fk) if c in children.columns]
    return _listed(children, materialize(cascade_children(children.select(*keys).distinct(), replaced, fk), "catalog-staying"))


def ingest_catalog(raw: DataFrame, tenant_id: str, current: dict | None = None,
                   embed_fn=None, embed: bool = False, materialize_docs: bool = False) -> dict:
    """Normalise a batch of catalogue documents for one tenant.

    * the same source id twice in a batch: ``newest_documents`` (W5)
    * documents without an id, or whose created/updated timestamps do not
      parse, go to ``rejects`` (the reference halts the whole ingest on them)
    * with ``current`` (products, images, variants), re-sent products replace
      their stored rows and their children (M2 with cascade); if that is more
      than half of the stored products, what stays is settled on ids first
    * ``embed`` backfills vectors with ``embed_fn`` (E1); the embedded products
      are written once, so each text is embedded once however often the
      result is read
    * ``materialize_docs`` writes the de-duplicated documents once under
      ``spark.checkpoint.dir`` so the three tables (and a retry after a lost
      executor) read stored Parquet instead of joining again
    """
    dedup = newest_documents(raw, store=materialize_docs)
    good, rejects = split_rejects(normalise_products(dedup, tenant_id))
    storable = (F.col("id").isNotNull() & parse_ts("created_at").isNotNull() & parse_ts("updated_at").isNotNull())
    docs = dedup.where(storable)
    images = normalise_images(docs, tenant_id)
    variants = normalise_variants(docs, tenant_id)
    out = {"products": good, "images": images, "variants": variants, "rejects": rejects,
           "summary": ingest_summary(dedup, storable)}
    key = ["tenant_id", "source_id"]
    most = False
    if current:
        # ids only, found once for all three tables; good has one row a key
        sent = current["products"].select(*key, "id").join(good.select(*key, F.lit(True).alias("_sent")), key, "left")
        marked = materialize(sent.select("tenant_id", "id", "_sent", F.when(F.col("_sent").isNull(), F.col("source_id"))
                                         .alias("source_id")), "catalog-replaced")
        n = marked.agg(F.count(F.lit(1)).alias("stored"), F.count("_sent").alias("replaced")).first()
        most = 2 * n["replaced"] > n["stored"]
        replaced, cascade = marked.where("_sent").select("tenant_id", "id"), _cascade_ids_first if most else cascade_children
        out["images"] = cascade(current["images"], replaced).unionByName(images, allowMissingColumns=True)
        out["variants"] = cascade(current["variants"], replaced).unionByName(variants, allowMissingColumns=True)
    if embed:
        good = materialize(backfill_embeddings(good, embed_fn), "catalog-embedded")
        out["products"] = good
    if most:
        staying = materialize(marked.where("_sent IS NULL").select(*key).distinct(), "catalog-staying")
        out["products"] = _listed(current["products"], staying).unionByName(good, allowMissingColumns=True)
    elif current:
        out["products"] = replace_products(current["products"], good)
    return out


def read_catalog_tables(spark: SparkSession, base_path: str) -> dict:
    """Stored products, images and variants, with their declared schemas (an
    empty table has no file to infer one from); a table that isn't there yet is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs

    def read(name: str) -> DataFrame:
        path = hadoop.Path(f"{base_path}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], TABLES[name])
        return spark.read.schema(TABLES[name]).parquet(f"{base_path}/{name}")

    return {n: read(n) for n in ("products", "images", "variants")}


def write_catalog_tables(tables: dict, base_path: str) -> None:
    """Write products/images/variants/rejects partitioned by tenant.

    Only the folders of the tenants in ``tables`` are replaced; other tenants
    stay.  All tables are first written aside, so ``tables`` may be computed
    from ``base_path`` itself, and a failure while computing changes nothing.
    Then the tables are swapped in, children before products (WRITE_ORDER): a
    failure in between may leave new images and variants that no product names
    yet, never a product without its own; a rerun of the same ingest mends it.
    A tenant without rows in one of the tables loses its old rows there.

    Tables lie aside by tenant, in a hidden folder of ``base_path``, and their
    folders are moved, so each row is written once and no task sorts its rows.
    Products, whose folders make an ingest visible, come last, after a job that
    makes their table and its mark and fails where ``base_path`` can't be written.
    """
    names = [n for n in WRITE_ORDER if n in tables]
    if not names:
        return
    spark = tables[names[0]].sparkSession
    aside = f"{base_path}/_aside-{uuid.uuid4().hex[:12]}"
    ready = {}
    with set_for(spark, "spark.sql.maxConcurrentOutputFileWriters", OPEN_TENANTS):
        for n in names:
            (tables[n].write.option("compression", "zstd").mode("overwrite").partitionBy("tenant_id")
             .parquet(f"{aside}/{n}"))
            ready[n] = spark.read.schema(tables[n].schema).parquet(f"{aside}/{n}")
    held = {n: {r["tenant_id"] for r in ready[n].select("tenant_id").distinct().collect()} for n in names}
    tenants = set().union(*held.values())                                   # tenants written, not rows
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(base_path).getFileSystem(spark._jsc.hadoopConfiguration())
    folder_of = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for n in names:
        path = f"{base_path}/{n}"
        if n == "products":
            ready[n].limit(0).write.mode("append").partitionBy("tenant_id").parquet(path)
        fs.mkdirs(hadoop.Path(path))
        for t in held[n]:
            old = hadoop.Path(f"{path}/{folder_of('tenant_id', t)}")
            fs.delete(old, True)
            if not fs.rename(hadoop.Path(f"{aside}/{n}/{folder_of('tenant_id', t)}"), old):
                raise OSError(f"can't move new {n} to {old.toString()}")
        for t in tenants - held[n]:
            fs.delete(hadoop.Path(f"{path}/{folder_of('tenant_id', t)}"), True)
    fs.delete(hadoop.Path(aside), True)
