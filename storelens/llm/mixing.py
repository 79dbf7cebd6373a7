"""Mixing sources to target weights by a hypergeometric splitting tree.

Targets: the sources in code-point order (null last) get a cycle of weights
and share a multiple of all words; a target stops at ``max_passes`` times its
source's size, and the excess is shared again by weight.

Draws: a source's documents are dealt into blocks by a hash of the id.  A
pass over a source takes its blocks in an order permuted for the pass; as
many passes and blocks are drawn as the target needs, the last block only
in part, as near as its documents allow.  That fixes each source's quota of blocks.
A binary tree over the output shards then splits the quotas: at each node the
left half's number of blocks is fixed and its sources follow a multivariate
hypergeometric distribution, so the shards are as even as they would be after
shuffling all blocks together.  Each shard finds its own way down the tree
from seeds of the nodes, takes the next blocks of each source's permuted list
(no block is taken twice), and is shuffled locally by a hash.

Defined results: a null or empty text has size 0 and is drawn whenever its
place is; a null source is a source of its own; rows of the same id and
source are drawn together; a source of size 0 has target 0 and nothing taken; an empty table gives
an empty result; clashing or extra columns are kept as they are by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, n_words, stored


@dataclass(frozen=True)
class MixParams:
    """``factor``: words of the mix to words of all documents; ``weights``: the
    cycle of source weights; ``block_docs``: mean documents of a block;
    ``shards``: output shards, a power of two isn't needed."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    factor: float = 1.5
    max_passes: int = 2
    block_docs: int = 64
    shards: int = 32
    seed: int = 23


def targets(sizes: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Rows (source, source_size, docs, rank, target) from rows (source, size).

    With caps c and weights w the shares are min(c, x w) for one level x: the
    sources that stop are those with the smallest c / w.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # one row for each source from here on
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("rank", F.row_number().over(in_order) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in p.weights])
    by = by.withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(p.weights))).cast("int"))).withColumn(
        "cap", F.col("source_size").cast("double") * p.max_passes)
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    by = by.withColumn("total", F.sum("source_size").over(whole) * F.lit(p.factor))
    by = by.withColumn("stopped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn(
        "rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # the level if exactly the sources before this one stopped
    by = by.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("rest"))
    open_ = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        F.col("cap") / F.col("weight"), "rank", "level")).otherwise(None)).over(whole)
    return by.withColumn("first_open", open_["level"]).select(
        "source", "source_size", "docs", "rank",
        F.least("cap", F.coalesce(F.col("first_open") * F.col("weight"), F.col("cap"))).alias("target"))


def _split(quotas: list[int], shards: int, p: MixParams, spark) -> DataFrame:
    """(shard, rank, start, n): the n blocks that a shard takes of the source
    of a rank, from place ``start`` of the source's list of draws."""
    schema = pa.schema([("shard", pa.int32()), ("rank", pa.int32()), ("start", pa.int64()), ("n", pa.int64())])

    def down(shard: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.array(quotas, dtype=np.int64)
        start = np.zeros_like(own)
        lo, hi, node = 0, shards, 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            rng = np.random.default_rng([p.seed, node])
            left_total = int(own.sum()) * (mid - lo) // (hi - lo)
            left = np.zeros_like(own)
            rest, to_draw = int(own.sum()), left_total
            for s, n in enumerate(own.tolist()):  # source by source
                rest -= n
                if to_draw and n:
                    left[s] = _hypergeometric(rng, n, rest, to_draw)
                    to_draw -= int(left[s])
            if shard < mid:
                own, hi, node = left, mid, 2 * node
            else:
                start, own, lo, node = start + left, own - left, mid, 2 * node + 1
        return start, own

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                start, own = down(shard)
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), shard, dtype=np.int32)), pa.array(at.astype(np.int32)),
                    pa.array(start[at]), pa.array(own[at])], schema=schema)

    return spark.range(shards).mapInArrow(run, "shard int, rank int, start long, n long")


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of good + bad."""
    if good + bad < 10 ** 9:
        return int(rng.hypergeometric(good, bad, draws))
    # beyond the generator's range: inversion of the probabilities themselves,
    # from the mode outwards by the ratio of neighbours; what lies further out
    # than the reach weighs less than a double's last bit
    good, bad, draws = int(good), int(bad), int(draws)
    total = good + bad
    least, most = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), least), most)
    spread = (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5
    reach = int(9 * spread) + 60
    k = np.arange(mode, min(most, mode + reach), dtype=np.float64)
    up = np.cumprod((good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1)))
    k = np.arange(mode, max(least, mode - reach), -1, dtype=np.float64)
    down = np.cumprod(k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1)))
    sums = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return mode - len(down) + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


DRAW_DDL = "array<struct<pass: int, shard: int, place: long>>"


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           params: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (id, source, size, h) of each document, and the
    decisions (id, source, source_size, target, draws) of each different id
    and source, draws being its places (pass, shard, place) in the mix."""
    p, spark = params, docs.sparkSession
    rows, _ = stored(docs.select(F.col(key).alias("id"), F.col(source).alias("source"),
                                 n_words(text).alias("size"),
                                 F.xxhash64(F.col(key), F.lit(p.seed)).alias("h")), "mix-sizes")
    # one row for each source
    by, _ = stored(targets(rows, p), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.least(
        F.floor(F.col("target") / F.col("source_size")), F.lit(p.max_passes))).otherwise(0).cast("int")
    by = by.withColumn("whole", whole).withColumn(
        "rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).withColumn(
        "blocks", F.greatest(F.ceil(F.col("docs") / p.block_docs), F.lit(1)))

    units = rows.groupBy("source", "id", "h").agg(F.sum("size").alias("size"))
    units = units.join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "source", "h", "size", "source_size", "target", "rank", "whole", "rest",
        F.pmod("h", F.col("blocks")).alias("block"))

    # each source's blocks in permuted order, with the words before; a block has a
    # draw in every whole pass, and one more if the rest reaches it
    permuted = Window.partitionBy("rank").orderBy(F.xxhash64("rank", "block", F.lit(p.seed)), "block")
    blocks = units.groupBy("rank", "block", "whole", "rest").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("place", F.row_number().over(permuted) - 1).withColumn(
        "before", F.sum("words").over(permuted) - F.col("words")).withColumn(
        "n", F.count("*").over(Window.partitionBy("rank"))).withColumn(
        "times", F.col("whole") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0))
    blocks, _ = stored(blocks, "mix-blocks")
    quotas = {r["rank"]: r["q"] for r in blocks.groupBy("rank").agg(F.sum("times").alias("q")).collect()}
    quota = [int(quotas.get(k, 0)) for k in range(max(quotas, default=-1) + 1)]
    shares = _split(quota, p.shards, p, spark).select("rank", "shard", F.explode(
        F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))
    listed = blocks.where("times > 0").select("rank", "block", "n", F.col("place").alias("at"), F.explode(
        F.sequence(F.lit(0), F.col("times") - 1)).alias("pass")).select(
        "rank", "block", "pass", (F.col("pass") * F.col("n") + F.col("at")).alias("place"))
    listed = listed.join(shares, ["rank", "place"]).groupBy("rank", "block").agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard", "place"))).alias("draws"))  # max_passes at most
    taken = blocks.select("rank", "block", "before").join(listed, ["rank", "block"])

    # the last pass takes the documents of its last block that fit in order, then
    # the one whose size comes nearest to what is still missing
    inside = Window.partitionBy("rank", "block")
    upto = inside.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.withColumn("upto", F.sum("size").over(upto)).join(taken, ["rank", "block"], "left")
    units = units.withColumn("fits", F.coalesce(F.col("before") + F.col("upto") <= F.col("rest"), F.lit(False)))
    units = units.withColumn("missing", F.col("rest") - F.col("before") - F.coalesce(
        F.sum(F.when(F.col("fits"), F.col("size"))).over(inside), F.lit(0)))
    off = F.abs(F.col("size") - F.col("missing"))
    units = units.withColumn("choice", F.row_number().over(inside.orderBy("fits", off, "h", "id")))
    last = F.col("fits") | ((F.col("choice") == 1) & (off < F.col("missing")))
    decisions = units.select("id", "source", "source_size", "target", F.coalesce(F.filter(
        "draws", lambda d: (d["pass"] < F.col("whole")) | last), F.expr(f"CAST(array() AS {DRAW_DDL})")
    ).alias("draws"))
    return rows, stored(decisions, "mix-decisions")[0]


def _placed(rows: DataFrame, decisions: DataFrame, key: str, source: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows with their decision, whose columns get the returned names."""
    names = {c: free_name(rows, f"mix_{c}") for c in decisions.columns}
    named = decisions.select(*[F.col(c).alias(n) for c, n in names.items()])
    return rows.join(named, F.col(key).eqNullSafe(F.col(names["id"]))
                     & F.col(source).eqNullSafe(F.col(names["source"]))), names


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           params: MixParams = MixParams()) -> DataFrame:
    """(key, size, source_size, target, taken, draws) of every document."""
    rows, decisions = decide(docs, key, text, source, params)
    rows, names = _placed(rows, decisions, "id", "source")
    return rows.select(
        F.col("id").alias(key), "size", F.col(names["source_size"]).alias("source_size"),
        F.col(names["target"]).alias("target"), (F.col("size") * F.size(names["draws"])).alias("taken"),
        F.col(names["draws"]).alias("draws"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        params: MixParams = MixParams(), shard: str | None = None) -> DataFrame:
    """The mix itself: each document as often as it is drawn, with its columns.

    With ``shard`` the shard's number is added under that name and the rows are
    dealt by shard and shuffled inside it.
    """
    _, decisions = decide(docs, key, text, source, params)
    rows, names = _placed(docs, decisions, key, source)
    draw, order = free_name(rows, "mix_draw"), free_name(rows, "mix_order")
    rows = rows.withColumn(draw, F.explode(names["draws"]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if shard is None:
        return rows.select(*columns)
    place = F.xxhash64(names["id"], f"{draw}.pass", f"{draw}.shard", F.lit(params.seed))
    return (rows.select(*columns, F.col(f"{draw}.shard").alias(shard), place.alias(order))
            .repartition(F.col(shard)).sortWithinPartitions(shard, order).drop(order))
