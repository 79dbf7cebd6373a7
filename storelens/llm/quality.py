"""Quality rules: distribution divergence, in DataFrame functions only.

Each text gives a histogram of character classes and one of the common words
of its language.  References are the sums of these histograms over all
documents of a language.  A document is rejected when the Jensen-Shannon
distance (base 2, 0 to 1) of a histogram to its reference is above a limit;
a histogram of too few characters or words isn't compared.  Base rules on
length and repetition come first.

Defined results: a null or empty text has no words and fails the base rules;
a null or unlisted language is compared with the sum over all documents;
repeated rows are judged alike, one result row each; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, stored

# Frequent function words of each language, most frequent first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "it": ["di", "e", "il", "la", "che", "in", "a", "per", "un", "del", "non", "con"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "os"],
    "nl": ["de", "van", "een", "het", "en", "in", "is", "dat", "op", "te", "zijn", "met"],
}
OTHER = "*"
BINS = 12
CLASSES = ["c_upper", "c_letter", "c_number", "c_space", "c_mark", "c_rest"]
MARKS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """``chars`` and ``words``: distances above which a text is rejected;
    ``min_chars`` and ``min_words``: shorter texts aren't compared."""

    chars: float = 0.30
    words: float = 0.30
    min_chars: int = 200
    min_words: int = 100


def _removed(text: str, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One narrow row per document: base counts and both histograms."""
    listed = F.col(lang).isin(list(COMMON_WORDS))
    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"),
        F.when(listed, F.col(lang)).otherwise(OTHER).alias("lang_key"))
    # languages share no list; the words of an unlisted one are compared with English
    lists = F.expr("CASE lang_key " + " ".join(
        f"WHEN '{k}' THEN array({', '.join(repr(w) for w in v)})" for k, v in COMMON_WORDS.items())
        + f" ELSE array({', '.join(repr(w) for w in COMMON_WORDS['en'])}) END")
    trimmed = F.btrim("t", F.lit(SPACE))
    rows = rows.withColumn("w", F.when(F.length(trimmed) == 0, F.array().cast("array<string>"))
                           .otherwise(F.split(trimmed, SPACE_CLASS))).withColumn("list", lists)
    n = F.size("w")
    rows = rows.select(
        "doc_id", "lang_key", n.cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", MARKS, ""))).cast("long").alias("n_symbols"),
        F.length("t").cast("long").alias("n_chars"),
        _removed("t", r"\p{Lu}+").cast("long").alias("c_upper"),
        _removed("t", r"\p{L}+").cast("long").alias("letters"),
        _removed("t", r"\p{N}+").cast("long").alias("c_number"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
            F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("windows"),
        F.filter(F.transform("w", lambda x: F.array_position("list", F.lower(x)).cast("int")),
                 lambda i: i > 0).alias("common"))
    rows = rows.withColumn("dup", F.coalesce(
        F.size("windows") > F.size(F.array_distinct("windows")), F.lit(False)))
    # positions of windows, in the order of their hashes, where some window recurs
    rows = rows.withColumn("s", F.when(F.col("dup"), F.array_sort(F.transform(
        "windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    rows = rows.withColumn("at", F.filter(F.transform("s", lambda e, k: F.when(
        (F.get("s", k + 1)["h"] == e["h"]) | (F.get("s", F.greatest(k - 1, F.lit(0)))["h"] == e["h"])
        & (k > 0), e["p"])), lambda p: p.isNotNull()))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "at", lambda p: F.array(p, p + 1, p + 2)))))
    size = F.size("common")
    hits = [size - F.size(F.array_remove("common", F.lit(b))) for b in range(1, BINS + 1)]
    return rows.select(
        "doc_id", "lang_key", "n_words", "word_chars", "n_symbols", "n_chars",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("dup"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.array(
            F.col("c_upper"), F.col("letters") - F.col("c_upper"), F.col("c_number"),
            F.col("n_chars") - F.col("word_chars"), F.col("n_symbols"),
            F.col("word_chars") - F.col("letters") - F.col("c_number") - F.col("n_symbols"),
        ).alias("chars"),
        F.array(*[h.cast("long") for h in hits], (F.col("n_words") - size).cast("long")).alias("words"))


def references(measures: DataFrame) -> DataFrame:
    """Summed histograms of each language and, under ``OTHER``, of all documents."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(BINS + 1)]
    by = measures.groupBy("lang_key").agg(*sums)
    names = [c for c in by.columns if c != "lang_key"]
    total = by.agg(*[F.sum(c).alias(c) for c in names]).withColumn("lang_key", F.lit(OTHER))
    both = by.where(F.col("lang_key") != OTHER).unionByName(total)
    return both.select(
        "lang_key", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_chars"),
        F.array(*[f"w{i}" for i in range(BINS + 1)]).alias("ref_words"))


def js_distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if either is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    na, nb = total(a), total(b)
    terms = F.zip_with(F.transform(a, lambda x: x / na), F.transform(b, lambda x: x / nb),
                       lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.when((na > 0) & (nb > 0), F.sqrt(F.greatest(total(terms), F.lit(0.0))))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          limits: Limits = Limits()) -> DataFrame:
    """Base counts, distances and verdict of every document."""
    rows, _ = stored(measure(docs, key, text, lang), "quality")
    # one row for each listed language and one for the rest
    rows = rows.join(F.broadcast(references(rows)), "lang_key", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn(
        "char_distance", F.when(F.col("n_chars") >= limits.min_chars, js_distance("chars", "ref_chars"))
    ).withColumn(
        "word_distance", F.when(F.col("n_words") >= limits.min_words, js_distance("words", "ref_words")))
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > limits.chars) | (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) > limits.words)
    return rows.select(
        F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")
