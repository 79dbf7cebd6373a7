"""Registered queries of this subpackage: thin callers of its operators."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (align, chat, decontam, langid, lm, mixing, periods, quality, repeats, simhash, tokens,
               toxicity, warc)
from .common import discard, fold, prepare, shared_folder, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a third of the ids is held out."""
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, one row each with its items."""
    prepare(spark)
    found = decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.lit(True).alias("contaminated"), F.size("leaks").alias("n_items"),
        F.col("leaks.item").alias("item_ids"), F.array_max("leaks.lcs").alias("lcs"),
        F.array_max("leaks.cosine").alias("cosine"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every web page and of every document.

    Documents carry their doc_id; page p has -1 - p as doc_id, and its page_id.
    """
    prepare(spark)
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.train(docs)
    # one fusion: what a declared tag says is learned from both tables
    rows = langid.of_documents(docs).unionByName(
        langid.of_pages(pages).withColumn("id", -1 - F.col("id")))
    return langid.identify(rows, model).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 0, -1 - F.col("id")).alias("page_id"),
        "declared", "host", "suffix", "lang", "probability", "accepted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and divergence verdict of every document."""
    prepare(spark)
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The tokenizers file that op7 and the pipeline encode with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    prepare(spark)
    return mixing.shares(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def written_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digests of the ids of ``docs``, written and read back; the files go."""
    folder = shared_folder(spark, "tokens")
    files = tokens.write(docs, folder, vocabulary())
    rows, _ = stored(tokens.read_digests(files), "token-digests")
    discard(spark, folder)
    return rows


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, read back from the Arrow files."""
    prepare(spark)
    return written_tokens(spark, table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation and of one full of control strings."""
    prepare(spark)
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    pieces, _ = stored(chat.format_conversations(turns.unionByName(extra)), "chat")
    return chat.digests(pieces)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; a seventh of the ids is held out."""
    prepare(spark)
    held_out = fold("doc_id", 7) == 2
    return lm.score(table(spark, sf_dir, "documents"), training=~held_out).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    prepare(spark)
    folder = shared_folder(spark, "warc")
    files = warc.archive(table(spark, sf_dir, "pages"), folder)
    rows, _ = stored(warc.read(files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    discard(spark, folder)
    return rows


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its copies of earlier ones."""
    prepare(spark)
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, with corpus-wide counts."""
    import public_tokenizers

    prepare(spark)
    return align.align(table(spark, sf_dir, "documents"),
                       str(public_tokenizers.path("byte_bpe_50k.json")),
                       str(public_tokenizers.path("piece_bpe_32k.model"))).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def drilled(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document; of every tenth one (by its id's crc32) a tail is
    its first words over and over."""
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    root = words[a:a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (root * ((n - a) // len(root) + 1))[:n - a]


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, with drilled tails."""
    prepare(spark)
    found = periods.find_runs(table(spark, sf_dir, "documents"), edit=drilled)
    best = F.get("runs", F.col("best"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * get(runs, best).length DIV get(runs, best).period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256)
        .alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_langid": op3_langid,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_tokens": op7_tokens,
    "op8_chat": op8_chat,
    "op9_lm": op9_lm,
    "op10_warc": op10_warc,
    "op11_repeats": op11_repeats,
    "op12_alignment": op12_alignment,
    "op13_periods": op13_periods,
}

_COMMON = ", ".join(
    f"('{k}', {quality.COMMON_WORDS[k]!r})" for k in quality.COMMON_WORDS)

# op4: the same counts, histograms and distances in list functions.
_OP4 = rf"""
WITH lists(lang_key, list) AS (VALUES {_COMMON}, ('{quality.OTHER}', {quality.COMMON_WORDS["en"]!r})),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    CASE WHEN lang IN (SELECT lang_key FROM lists) AND lang <> '{quality.OTHER}' THEN lang
         ELSE '{quality.OTHER}' END AS lang_key
  FROM documents),
w AS (
  SELECT rid, doc_id, t, lang_key, list,
    regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d JOIN lists USING (lang_key)),
win AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
rep AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM win),
cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY rid),
m AS (
  SELECT rid, doc_id, lang_key, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(t)::BIGINT AS n_chars,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS c_upper,
    (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::BIGINT AS letters,
    (length(t) - length(regexp_replace(t, '\p{{N}}', '', 'g')))::BIGINT AS c_number,
    list_transform(list, lambda c: len(list_filter(w, lambda x: lower(x) = c))::BIGINT) AS hits
  FROM w),
h AS (
  SELECT rid, doc_id, lang_key, n_words, word_chars, n_symbols, n_chars, n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    [c_upper, letters - c_upper, c_number, n_chars - word_chars, n_symbols,
     word_chars - letters - c_number - n_symbols] AS chars,
    list_append(hits, n_words - list_sum(hits)::BIGINT) AS words
  FROM m LEFT JOIN cov USING (rid)),
cells AS (
  SELECT lang_key, kind, k, sum(v) AS v FROM (
    SELECT lang_key, 0 AS kind, unnest(range(1, len(chars) + 1)) AS k, unnest(chars) AS v FROM h
    UNION ALL
    SELECT lang_key, 1, unnest(range(1, len(words) + 1)), unnest(words) FROM h) GROUP BY ALL),
refs AS (
  SELECT lang_key, kind, list(v ORDER BY k) AS ref FROM (
    SELECT lang_key, kind, k, v FROM cells WHERE lang_key <> '{quality.OTHER}'
    UNION ALL
    SELECT '{quality.OTHER}', kind, k, sum(v) FROM cells GROUP BY kind, k) GROUP BY lang_key, kind),
pairs AS (
  SELECT rid, 0 AS kind, chars AS a, ref AS b FROM h JOIN refs USING (lang_key) WHERE refs.kind = 0
  UNION ALL
  SELECT rid, 1, words, ref FROM h JOIN refs USING (lang_key) WHERE refs.kind = 1),
parts AS (
  SELECT rid, kind, unnest(a) / list_sum(a) AS p, unnest(b) / list_sum(b) AS q
  FROM pairs WHERE list_sum(a) > 0 AND list_sum(b) > 0),
dist AS (
  SELECT rid, kind, sqrt(greatest(sum(
      CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js
  FROM parts GROUP BY rid, kind),
v AS (
  SELECT h.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_chars >= {quality.Limits().min_chars} AND coalesce(dc.js, 0) > {quality.Limits().chars}
    OR n_words >= {quality.Limits().min_words} AND coalesce(dw.js, 0) > {quality.Limits().words} AS far
  FROM h LEFT JOIN dist dc ON dc.rid = h.rid AND dc.kind = 0
  LEFT JOIN dist dw ON dw.rid = h.rid AND dw.kind = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT far AS kept
FROM v
"""

# op8: the template's marks are constants; a backslash or a control string
# costs one more character.
_CONTROLS = "|".join([r"\\"] + [re.escape(c) for c in chat.CONTROLS])
_OP8 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  sum({len(chat.TURN) + len(chat.TURN_END) + 2} + length(role) + length(text)
      + len(regexp_extract_all(text, '{_CONTROLS}')) + len(regexp_extract_all(role, '{_CONTROLS}|\n'))
  )::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

# op10: base32 takes four characters from each five hexadecimal digits.
_OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS responds FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = responds THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> responds THEN responds END AS refers_to
FROM p JOIN r USING (h)
"""

ORACLE = {"op4_quality": _OP4, "op8_chat": _OP8, "op10_warc": _OP10}
