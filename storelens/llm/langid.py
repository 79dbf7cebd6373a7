"""Language ID: Bayesian fusion of text and address evidence.

Evidence of a row: the text's likelihood under models of letter trigrams (bytes) of each
language and of no language (all trigrams alike); the declared language of
its markup; the suffix of its host; the host itself.  What a declaration, a
suffix or a host says is learned from the rows: each row's text posterior is
added up by grouped aggregation, and the counts are smoothed hierarchically,
host to suffix to all rows (a row's own share is left out of its host).  The
sum of the logarithms is the posterior; a row is accepted if its best
language is a language and has at least the limit.

Defined results: a row without a letter has no text evidence and isn't
accepted; a null or unreadable declaration, address or host is no
evidence; ties go to the first language in code order; without any labelled
row the only hypothesis is no language, and nothing is accepted; repeated
rows are judged alike, one result row each; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, utf8

NONE = "und"


@dataclass(frozen=True)
class LangParams:
    """``sample``: texts that a language's model is learned from, about (by the
    smallest hashes of the id); ``temper``: weight of one trigram, as trigrams
    depend on each other; ``kappa``: strength of a parent level in rows."""

    sample: int = 1000
    bits: int = 16
    temper: float = 0.1
    kappa: float = 5.0
    limit: float = 0.5
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """Log probability of each trigram bucket (rows) in each language (columns)."""

    languages: tuple[str, ...]
    logs: np.ndarray


# A-Z in lower case; every other ASCII character but a-z is a space.
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32
                     for c in range(256)], dtype=np.uint32)


def _trigrams(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of each trigram of letters and spaces; a text stands
    between spaces, and what has two spaces side by side is left out."""
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    raw = _LETTERS[np.frombuffer(b"".join(b" %b " % t for t in texts), dtype=np.uint8)]
    codes = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    codes = (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    of = np.repeat(np.arange(len(texts)), sizes)
    space = raw == 32
    use = (of[:-2] == of[2:]) & ~(space[1:-1] & (space[:-2] | space[2:]))
    return of[:-2][use], codes[use]


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          params: LangParams = LangParams()) -> Model:
    """Trigram models of the languages in ``labelled``, from a bounded sample of each."""
    p = params
    rows = labelled.where(F.col(lang).isNotNull() & (F.col(lang) != NONE))
    counts = {r["lang"]: r["n"] for r in
              rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}  # one a language
    if not counts:
        return Model((NONE,), np.full((1 << p.bits, 1), -p.bits * np.log(2.0), dtype=np.float32))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, p.sample / n))])
    place = F.pmod(F.xxhash64(F.col(key), F.lit(p.seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(place < share[F.col(lang)]).select(F.col(lang).alias("l"), utf8(text).alias("t"))
    schema = pa.schema([("l", pa.string()), ("g", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for k, t in zip(langs, texts, strict=True) if k == lang]
                for lo, hi in pieces(own):
                    sums[lang] = sums.get(lang, 0) + np.bincount(
                        _trigrams(own[lo:hi], p.bits)[1], minlength=1 << p.bits)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], schema=schema)

    languages = tuple(sorted(counts))
    n = np.zeros((1 << p.bits, len(languages)))
    for r in (rows.mapInArrow(count, "l string, g int, n long").groupBy("l", "g")
              .agg(F.sum("n").alias("n")).collect()):  # languages x buckets at most
        n[r["g"], languages.index(r["l"])] = r["n"]
    logs = np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * (1 << p.bits)))
    none = np.full((1 << p.bits, 1), -p.bits * np.log(2.0))
    return Model((*languages, NONE), np.hstack([logs, none]).astype(np.float32))


# -- what a page states ------------------------------------------------------------

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>")


def visible_text(page: str) -> str:
    """The text of a page without comments, scripts, styles and tags."""
    page = _DROPPED.sub(" ", page)
    end = page.rfind(">") + 1  # no tag ends behind it: looking for one there takes quadratic time
    return html_.unescape(_TAG.sub(" ", page[:end]) + page[end:])


def declared_language(html: str | Column) -> Column:
    """The primary subtag of the page's lang attribute, null if there is none."""
    html = F.col(html) if isinstance(html, str) else html
    return primary_subtag(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))


def primary_subtag(tag: str | Column) -> Column:
    """en of en-GB; null for what isn't two or three letters, so there are few."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    found = F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(found != "", found)


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


# -- likelihoods and fusion -----------------------------------------------------------

def likelihoods(rows: DataFrame, model: Model, params: LangParams = LangParams()) -> DataFrame:
    """(id, declared, host, n, logs): tempered log likelihood of each row's
    text in each language.  ``rows`` has id, text (bytes), markup (boolean),
    declared and host."""
    p = params
    width = len(model.languages)
    schema = pa.schema([("id", pa.int64()), ("declared", pa.string()), ("host", pa.string()),
                        ("n", pa.int64()), ("logs", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, markup = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n, logs = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), width))
            for lo, hi in pieces(texts):
                shown = [visible_text(t.decode("utf-8", "replace")).encode() if m else t
                         for t, m in zip(texts[lo:hi], markup[lo:hi], strict=True)]
                of, codes = _trigrams(shown, p.bits)
                n[lo:hi] = np.bincount(of, minlength=hi - lo)
                for k in range(width):
                    logs[lo:hi, k] = np.bincount(of, model.logs[codes, k], minlength=hi - lo)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(texts) + 1) * width, pa.int32()), pa.array((logs * p.temper).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(4), pa.array(n), flat], schema=schema)

    return rows.select("id", "text", "markup", "declared", "host").mapInArrow(
        run, "id long, declared string, host string, n long, logs array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _softmax(logs: str | Column) -> Column:
    logs = F.col(logs) if isinstance(logs, str) else logs
    parts = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(parts, lambda x: x / _total(parts))


def _smoothed(counts: Column, parent: Column, kappa: float) -> Column:
    return F.zip_with(counts, parent, lambda c, q: (c + kappa * q) / (_total(counts) + kappa))


def fuse(rows: DataFrame, languages: tuple[str, ...], params: LangParams = LangParams()) -> DataFrame:
    """Posterior of each row of ``likelihoods`` (best read from a stored table)."""
    p, width = params, len(languages)
    zeros = F.array(*[F.lit(0.0)] * width)
    sums = lambda: F.array(*[F.sum(F.get("own", F.lit(k))) for k in range(width)])
    # rows without text say nothing about their host
    rows = rows.withColumn("own", F.when(F.col("n") > 0, _softmax("logs")).otherwise(zeros))
    rows = rows.withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)))

    # host -> suffix -> all, each level summed from the one before
    hosts, _ = stored(rows.groupBy("host", "suffix").agg(sums().alias("own")), "lang-hosts")
    every = hosts.agg(sums().alias("own")).first()["own"]
    total = sum(x or 0.0 for x in every)
    top = F.array(*[F.lit(((x or 0.0) + 1.0) / (total + width)) for x in every])
    suffixes = hosts.where("suffix IS NOT NULL").groupBy("suffix").agg(
        _smoothed(sums(), top, p.kappa).alias("parent"))
    hosts = hosts.join(suffixes, "suffix", "left").select(
        F.col("host").alias("host_"), F.col("own").alias("host_sum"), F.coalesce("parent", top).alias("parent"))

    # P(declared | language): primary subtags only, a few hundred rows at most
    declared = rows.where("declared IS NOT NULL").groupBy("declared").agg(sums().alias("said"))
    said = {r["declared"]: r["said"] for r in declared.collect()}
    n_said = [sum(v[k] for v in said.values()) for k in range(width)]
    kinds = len(said) + 1
    table = [(d, [float(np.log((v[k] + 1.0) / (n_said[k] + kinds))) for k in range(width)])
             for d, v in said.items()]
    declared = rows.sparkSession.createDataFrame(table, "declared_ string, declared_logs array<double>")

    rows = rows.join(F.broadcast(declared), F.col("declared") == F.col("declared_"), "left").join(
        hosts, F.col("host") == F.col("host_"), "left")
    others = F.zip_with("host_sum", "own", lambda s, o: F.greatest(s - o, F.lit(0.0)))
    prior = F.when(F.col("host_").isNull(), top).otherwise(_smoothed(others, F.col("parent"), p.kappa))
    rows = rows.withColumn("prior", prior)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add("logs", F.transform("prior", lambda q: F.ln(F.greatest(q, F.lit(1e-12))))),
               F.coalesce("declared_logs", zeros))
    rows = rows.withColumn("fused", logs).withColumn("posterior", _softmax("fused"))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    rows = rows.withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in languages]), best)).withColumn(
        "probability", F.array_max("posterior"))
    return rows.select("id", "n", "declared", "host", "suffix", "lang", "probability", (
        (F.col("n") > 0) & (F.col("lang") != NONE) & (F.col("probability") >= p.limit)).alias("accepted"))


def of_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                 source: str = "source") -> DataFrame:
    """Evidence rows of plain documents: the declared tag, and the source as host."""
    return docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("text"),
                       F.lit(False).alias("markup"), primary_subtag(lang).alias("declared"),
                       F.lower(F.col(source)).alias("host"))


def of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Evidence rows of web pages: visible text, lang attribute and address."""
    return pages.select(F.col(key).cast("long").alias("id"), utf8(html).alias("text"),
                        F.lit(True).alias("markup"), declared_language(html).alias("declared"),
                        host_of(url).alias("host"))


def identify(rows: DataFrame, model: Model, params: LangParams = LangParams()) -> DataFrame:
    """Language, probability and verdict of every evidence row."""
    found, _ = stored(likelihoods(rows, model, params), "lang-texts")
    return fuse(found, model.languages, params)
