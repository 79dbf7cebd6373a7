"""Corpus pipeline over ``documents``: each stage calls one operator of
``storelens.llm``, works on all rows that the stage before kept, and is
written as Parquet in the shared folder before the next one reads it.

Defined results: a row with a null id can't be named by a verdict and goes at
the first stage, as does one without a letter; of rows with the same id one
stays after the second stage; the result of a stage on no rows is no rows;
further columns of ``documents`` aren't carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm import decontam, langid, mixing, simhash
from storelens.llm.common import free_name, keep_ids, prepare, stored
from storelens.llm.queries import table, written_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the text models are learned from them."""
    prepare(spark)
    found = langid.identify(langid.of_documents(docs), langid.train(docs))
    return keep_ids(docs, "doc_id", found.where("accepted").select("id")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    prepare(spark)
    groups = simhash.near_duplicates(docs)
    kept = keep_ids(docs, "doc_id", groups.where("doc_id = component_id").select("doc_id"))
    return kept.select(*COLUMNS).dropDuplicates(["doc_id"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    prepare(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, dealt to its shards and shuffled there."""
    prepare(spark)
    return mixing.mix(docs, shard=free_name(docs, "shard")).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, written as Arrow files and read back."""
    prepare(spark)
    return written_tokens(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

# learned models, hashes and a tokenizer: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
