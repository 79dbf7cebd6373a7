"""Product search pipelines: one query (P1), many at once (P2), storefront."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from storelens.operators.common import for_tenant, page_of_group
from storelens.operators.search import by_category, product_filter, with_first_image
from storelens.schemas import K_DEFAULT, K_MAX, K_MIN, check_range

# Queries of one scan of the products: so many at most, and so many bytes of vectors.
BLOCK_QUERIES = 4096
BLOCK_BYTES = 32 << 20
# Product rows compared with a block at a time, and winners that are broadcast.
SLICE_ROWS = 1024
BROADCAST_WINNERS = 10_000
QUERY_COLUMNS = ["query_id", "tenant_id", "product_type", "min_price", "max_price", "has_discount",
                 "query_vec", "k"]
_BEST = pa.schema([("query", pa.int64()), ("scope", pa.string()), ("n", pa.int64()), ("id", pa.int64()),
                   ("has", pa.bool_()), ("similarity", pa.float64()), ("newest", pa.int64())])
_BEST_DDL = "query long, scope string, n long, id long, has boolean, similarity double, newest long"
_NO_DATE = np.iinfo(np.int64).max          # NULL update times come first


class _Block:
    """A block of queries as arrays, by tenant.

    Queries go by their number; the caller's ``query_id`` is only a name, which
    may repeat or be NULL.
    """

    def __init__(self, queries: list, first: int = 0):
        self.number = np.arange(first, first + len(queries))
        self.name = [q["query_id"] for q in queries]
        self.tenant = np.array([q["tenant_id"] for q in queries], dtype=object)
        self.type = [q["product_type"] or None for q in queries]
        self.bounds = np.array([[np.nan if q[c] is None else q[c] for c in ("min_price", "max_price")]
                                for q in queries], dtype=np.float64)
        self.discount = np.array([-1 if q["has_discount"] is None else int(q["has_discount"]) for q in queries])
        self.k = np.array([K_DEFAULT if q["k"] is None else q["k"] for q in queries], dtype=np.int64)
        if (self.k < 1).any():
            raise ValueError("k must be at least 1")
        vectors = [None if q["query_vec"] is None else np.array(q["query_vec"], dtype=np.float64) for q in queries]
        self.has_vector = np.array([v is not None for v in vectors], dtype=bool)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(v) for v in vectors if v is not None}:
            at = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == size])
            self.by_size[size] = at, np.stack([vectors[i] for i in at])

    def __len__(self) -> int:
        return len(self.number)


def _cosines(block: _Block, own: np.ndarray, vectors: pa.Array) -> np.ndarray:
    """(rows, own queries) cosine similarity; NaN where it is undefined."""
    out = np.full((len(vectors), len(own)), np.nan)
    sizes = np.array(pc.fill_null(pc.list_value_length(vectors), -1))
    for size, (at, q) in block.by_size.items():
        rows, mine = np.flatnonzero(sizes == size), np.flatnonzero(np.isin(own, at))
        if len(rows) and len(mine) and size:
            x = np.array(vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(
                zero_copy_only=False)).reshape(-1, size)
            y = q[np.searchsorted(at, own[mine])]
            norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[np.ix_(rows, mine)] = np.where(norms > 0, x @ y.T / norms, np.nan)
    return out


def _first(keys: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Positions of the k smallest by (keys[0], keys[1])."""
    main = keys[0]
    at = np.arange(len(main))
    if len(main) > 4 * k:      # ties with the k-th stay in
        at = np.flatnonzero(main <= np.partition(main, k - 1)[k - 1])
    return at[np.lexsort((keys[1][at], main[at]))[:k]]


def _best_rows(products: DataFrame, block: _Block, cap: int | None, fallback: bool) -> DataFrame:
    """Each task's best rows of each query: no pair of product and query is a
    row, and no vector leaves the task.

    Scope "f" has rows that match the query's filter, "u" rows of its whole
    tenant (for the fallback), "n" the number of matches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, str], list[np.ndarray]] = {}
        matches = np.zeros(len(block), dtype=np.int64)

        def keep(q: int, scope: str, rows: np.ndarray, ids, has, sims, newest) -> None:
            if not len(rows):
                return
            ranked = block.has_vector[q]
            if ranked and (cap is None or scope == "u"):
                rows = rows[has[rows]]
            new = [x[rows] for x in (ids, has, sims, newest)]
            old = best.get((q, scope))
            new = new if old is None else [np.concatenate(p) for p in zip(old, new, strict=True)]
            by_date = (-new[3], new[0])
            if not ranked:
                at = _first(by_date, int(block.k[q]))
            elif cap is not None and scope == "f":
                at = _first(by_date, cap)
            else:
                at = _first((np.where(np.isnan(new[2]), np.inf, -new[2]), new[0]), int(block.k[q]))
            best[q, scope] = [x[at] for x in new]

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                ids, tenants = np.array(col("id")), col("tenant_id").to_numpy(zero_copy_only=False)
                types = col("product_type").to_numpy(zero_copy_only=False)
                low, high = (np.array(pc.fill_null(col(c).cast(pa.float64()), np.nan)) for c in ("min_price", "max_price"))
                sale = np.array(pc.fill_null(col("has_discount").cast(pa.int8()), -1))
                newest = np.array(pc.fill_null(col("newest"), _NO_DATE))
                vectors = col("embedding")
                has = np.array(vectors.is_valid())
                for tenant in set(tenants):
                    own, rows = np.flatnonzero(block.tenant == tenant), np.flatnonzero(tenants == tenant)
                    if not len(own):
                        continue
                    sims = _cosines(block, own, vectors.take(pa.array(rows)))
                    given = [x[rows] for x in (ids, has)]
                    dates = newest[rows]
                    for j, q in enumerate(own.tolist()):
                        lo_, hi_ = block.bounds[q]
                        ok = np.ones(len(rows), dtype=bool)
                        if block.type[q] is not None:
                            ok &= types[rows] == block.type[q]
                        if not np.isnan(lo_):
                            ok &= high[rows] >= lo_
                        if not np.isnan(hi_):
                            ok &= low[rows] <= hi_
                        if block.discount[q] >= 0:
                            ok &= sale[rows] == block.discount[q]
                        matches[q] += ok.sum()
                        keep(q, "f", np.flatnonzero(ok), *given, sims[:, j], dates)
                        if fallback and block.has_vector[q] and not matches[q]:
                            keep(q, "u", np.flatnonzero(has[rows]), *given, sims[:, j], dates)
        for q in np.flatnonzero(matches).tolist():
            best.pop((q, "u"), None)       # this task has seen a match
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.number[q]]), pa.array(["n"]), pa.array([matches[q]])] + [
                    pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), pa.float64(), pa.int64())], schema=_BEST)
        for (q, scope), (ids, has, sims, dates) in best.items():
            n = len(ids)
            sims = pa.array(sims, mask=np.isnan(sims)) if block.has_vector[q] else pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block.number[q])), pa.array([scope] * n), pa.array(np.zeros(n, dtype=np.int64)),
                 pa.array(ids), pa.array(has), sims, pa.array(dates)], schema=_BEST)

    # vectors are only read for queries that have one
    vector = F.col("embedding") if block.has_vector.any() else F.lit(None).cast(products.schema["embedding"].dataType)
    rows = products.select("id", "tenant_id", "product_type", "min_price", "max_price", "has_discount",
                           F.unix_micros("updated_at").alias("newest"), vector.alias("embedding"))
    return rows.where(F.col("tenant_id").isin(*sorted({t for t in block.tenant if t is not None}))) \
               .mapInArrow(run, _BEST_DDL)


def _block_winners(products: DataFrame, block: _Block, cap: int | None, fallback: bool) -> DataFrame:
    """(query_id, rank, _id, _t, similarity) of a block of queries."""
    rows = _best_rows(products, block, cap, fallback)
    facts = products.sparkSession.createDataFrame(
        [(int(n), i, t, int(k), bool(v)) for n, i, t, k, v in
         zip(block.number, block.name, block.tenant, block.k, block.has_vector, strict=True)],
        "q long, query_id long, _t string, k int, ranked boolean")
    # what meets here are the tasks' best rows: tasks x k for each query
    rows = rows.join(F.broadcast(facts), F.col("query") == F.col("q"))
    rows = rows.withColumn("matched", F.sum("n").over(Window.partitionBy("query"))) \
               .where((F.col("scope") == "f") | ((F.col("scope") == "u") & (F.col("matched") == 0)))
    by_date = Window.partitionBy("query").orderBy(F.col("newest").desc(), "id")
    if cap is not None:
        rows = rows.withColumn("_c", F.row_number().over(by_date)) \
                   .where((F.col("_c") <= cap) | (F.col("scope") == "u")) \
                   .where(~F.col("ranked") | F.col("has"))
    order = Window.partitionBy("query").orderBy(
        F.col("similarity").desc_nulls_last(), F.when(~F.col("ranked"), F.col("newest")).desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("_id"), "_t", "similarity")


def _blocks(queries: DataFrame) -> Iterator[_Block]:
    """The queries in blocks of bounded rows and bytes."""
    held, size, first = [], 0, 0
    for q in queries.select(*QUERY_COLUMNS).toLocalIterator():
        held.append(q)
        size += 8 * len(q["query_vec"] or ())
        if len(held) >= BLOCK_QUERIES or size >= BLOCK_BYTES:
            yield _Block(held, first)
            first += len(held)
            held, size = [], 0
    if held:
        yield _Block(held, first)


def search_batch(products: DataFrame, queries: DataFrame, candidate_cap: int | None = None,
                 fallback_unfiltered: bool = True) -> DataFrame:
    """The reference's search for many queries at once.

    Per query: F3 filter -> if it has a vector, rank the matches that have an
    embedding by cosine similarity (ties on id), else newest first
    (updated_at DESC, NULLs first, ties on id) -> first k (NULL: the default).
    ``candidate_cap`` ranks only the newest so many matches; without it all.
    A query whose filter matches nothing but has a vector searches the whole
    tenant (the reference's empty-id-list fallback).

    Any number of ``queries`` (QUERY_COLUMNS): they go block by block, bounded
    in rows and bytes, to one scan of the products each.  A task scores its
    products against the block in arrays and ships the best k ids per query;
    details are joined to the winners only.  Each row of ``queries`` is answered by
    itself, also where a ``query_id`` repeats or is NULL.
    """
    found, n = None, 0
    for block in _blocks(queries):
        n += int(block.k.sum())
        one = _block_winners(products, block, candidate_cap, fallback_unfiltered)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = products.sparkSession.createDataFrame(
            [], "query_id long, rank long, _id long, _t string, similarity double")
    return _with_details(products, found, n)


def _with_details(products: DataFrame, winners: DataFrame, n: int) -> DataFrame:
    """Join the wide detail columns to the ``n`` ranked winners at most."""
    details = products.select("id", "tenant_id", "title", "product_type", "body_html", "min_price", "max_price",
                              "options", "tags")
    if n <= BROADCAST_WINNERS:
        winners = F.broadcast(winners)
    out = details.join(winners, (details["id"] == winners["_id"]) & (details["tenant_id"] == winners["_t"]))
    return out.select(
        "query_id", "rank", "id", "title", "product_type", "body_html",
        F.when(F.col("min_price") != 0, F.col("min_price").cast("double")).alias("min_price"),
        F.when(F.col("max_price") != 0, F.col("max_price").cast("double")).alias("max_price"),
        "options", "tags", "similarity")


def search_products(products: DataFrame, tenant_id: str, product_type: str | None = None,
                    min_price: float | None = None, max_price: float | None = None,
                    has_discount: bool | None = None, query_vec: list | None = None,
                    k: int = K_DEFAULT, candidate_cap: int | None = None,
                    fallback_unfiltered: bool = True) -> DataFrame:
    """One search request (a block of one query).

    The filter is a predicate of the product scan.  Only a request with a vector
    whose filter matches nothing reads the whole tenant (the fallback); that is
    looked up first, on the filter's columns alone.
    """
    k = check_range("k", k, K_MIN, K_MAX)
    query = {"query_id": 0, "tenant_id": tenant_id, "product_type": product_type, "min_price": min_price,
             "max_price": max_price, "has_discount": has_discount, "query_vec": query_vec, "k": k}
    scoped = for_tenant(products, tenant_id)
    matching = scoped.where(product_filter(product_type, min_price, max_price, has_discount))
    filtered = bool(product_type) or not (min_price is None and max_price is None and has_discount is None)
    if query_vec is not None and fallback_unfiltered and filtered and matching.select("id").isEmpty():
        matching = scoped
    return _with_details(scoped, _block_winners(matching, _Block([query]), candidate_cap, fallback_unfiltered), k)


# ---------------------------------------------------------------------------
# P7 storefront listing
# ---------------------------------------------------------------------------

# Storefront sorts (built lazily: Columns need an active session).
SORTS = {
    "newest": lambda: None,
    "price-low": lambda: [F.col("price_min").asc(), F.col("position").asc()],
    "price-high": lambda: [F.col("price_max").desc(), F.col("position").asc()],
    "name": lambda: [F.col("name").asc(), F.col("position").asc()],
}


def catalogue_listing(products: DataFrame, images: DataFrame, tenant_id: str | None = None,
                      limit: int = 100, offset: int = 0, category: str | None = None,
                      sort: str = "newest") -> DataFrame:
    """Page of products per tenant, newest first, with the first image.

    Page = rows offset+1 .. offset+limit of ``updated_at DESC`` (NULLs first,
    ties on id) per tenant, then the storefront's category filter and sort
    within the page.  ``position`` is the row's place in the page order.
    Any offset is allowed; see ``page_of_group``.
    """
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    # Cut the page first, then resolve images for the page's products only: the
    # image scan is a semi-join against the page, not an aggregation over every
    # image of the tenant.
    ranked = page_of_group(for_tenant(products, tenant_id), "tenant_id",
                           [F.col("updated_at").desc_nulls_first(), F.col("id").asc()],
                           F.coalesce(F.unix_seconds("updated_at"), F.lit(_NO_DATE)), limit, offset, "_pos")
    page_ids = ranked.select(F.col("id").alias("product_id"), "tenant_id")
    if tenant_id is not None and limit <= BROADCAST_WINNERS:
        # one tenant: at most limit ids; for all tenants the page set grows
        # with the tenant count, so AQE decides
        page_ids = F.broadcast(page_ids)
    page_images = for_tenant(images, tenant_id).join(page_ids, ["product_id", "tenant_id"], "left_semi")
    ranked = with_first_image(ranked, page_images)
    page = ranked.select(
        "tenant_id", F.col("_pos").cast("long").alias("position"), "id", F.col("title").alias("name"),
        "vendor", "product_type",
        F.coalesce(F.when(F.col("min_price") != 0, F.col("min_price")), F.lit(0.0)).cast("double").alias("price_min"),
        F.coalesce(F.when(F.col("max_price") != 0, F.col("max_price")), F.lit(0.0)).cast("double").alias("price_max"),
        "has_discount", "image_url", "handle")
    page = by_category(page, category)
    order = SORTS[sort]()
    return page if order is None else page.orderBy(*order)
