"""Catalogue document helpers: options, embedding text, timestamps, numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from storelens.functions.text import clean_html


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def options_map(options="options") -> Column:
    """array<struct<name, values>> -> map<name, values>.

    Blank names are dropped; a repeated name keeps the last entry (needs
    spark.sql.mapKeyDedupPolicy=LAST_WIN, set by ``session.configure``).
    NULL/empty input gives an empty map.
    """
    opts = F.coalesce(_col(options), F.array())
    kept = F.filter(opts, lambda o: F.coalesce(F.length(o["name"]) > 0, F.lit(False)))
    entries = F.transform(kept, lambda o: F.struct(o["name"].alias("key"),
                                                   F.coalesce(o["values"], F.array().cast("array<string>")).alias("value")))
    return F.map_from_entries(entries)


def embedding_json(title="title", product_type="product_type", tags="tags", vendor="vendor",
                   options="options", body_html="body_html") -> Column:
    """The text that gets embedded: a JSON object in declared key order.

    NULL fields are kept as JSON null; non-ASCII characters are kept as is.
    """
    return F.to_json(F.struct(
        _col(title).alias("title"),
        _col(product_type).alias("product_type"),
        _col(tags).alias("tags"),
        _col(vendor).alias("vendor"),
        options_map(options).alias("options"),
        clean_html(body_html).alias("description"),
    ), {"ignoreNullFields": "false"})


def parse_ts(c) -> Column:
    """Lenient ISO-8601; bad/empty -> NULL.

    Spark's string->timestamp cast accepts date-only, 'T' or space, optional
    fractions (up to micros) and Z / +hh:mm / +hhmm offsets; the compact basic
    form (20240102T100000Z) is tried second.
    """
    s = F.trim(_col(c))
    s = F.when(F.length(s) > 0, s)
    return F.coalesce(s.try_cast("timestamp"),
                      F.try_to_timestamp(s, F.lit("yyyyMMdd'T'HHmmssX")))


def _num(c: Column) -> Column:
    """'' or NULL -> NULL (not parsed); otherwise try_cast to double."""
    return F.when(F.length(c) > 0, c)


def safe_numbers(price="price", compare_at="compare_at_price", weight="weight") -> Column:
    """Parse a variant's price, compare-at price and weight together.

    One value present but unparsable nulls all three of them, as the
    reference parses them in one try-block.
    """
    p, c, w = _num(_col(price)), _num(_col(compare_at)), _num(_col(weight))
    pp, cc, ww = p.try_cast("double"), c.try_cast("double"), w.try_cast("double")
    bad = ((p.isNotNull() & pp.isNull()) | (c.isNotNull() & cc.isNull())
           | (w.isNotNull() & ww.isNull()))
    return F.when(bad, F.struct(F.lit(None).cast("double").alias("price"),
                                F.lit(None).cast("double").alias("compare_at_price"),
                                F.lit(None).cast("double").alias("weight"))) \
            .otherwise(F.struct(pp.alias("price"), cc.alias("compare_at_price"), ww.alias("weight")))


def clean_variant_ids(c="variant_ids") -> Column:
    """NULL -> [], NULL elements dropped."""
    return F.filter(F.coalesce(_col(c), F.array().cast("array<bigint>")), lambda x: x.isNotNull())


def split_tags(c="tags") -> Column:
    """', ' separated tag text -> array; NULL/'' -> []."""
    s = _col(c)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.array().cast("array<string>")) \
            .otherwise(F.split(s, ", "))
