"""Usage, duration, settings and identifier helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from storelens.schemas import UUID_PATTERN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def usage_cost(prompt_tokens, completion_tokens, input_price, output_price) -> Column:
    """tokens / 1e6 * price, input plus output; unknown price -> 0."""
    p = F.coalesce(_col(prompt_tokens), F.lit(0)).cast("double")
    c = F.coalesce(_col(completion_tokens), F.lit(0)).cast("double")
    return (p / F.lit(1e6) * F.coalesce(_col(input_price), F.lit(0.0))
            + c / F.lit(1e6) * F.coalesce(_col(output_price), F.lit(0.0)))


def total_tokens(reported, prompt_tokens, completion_tokens) -> Column:
    """Reported total, else prompt + completion (missing parts count 0)."""
    return F.coalesce(_col(reported),
                      F.coalesce(_col(prompt_tokens), F.lit(0)) + F.coalesce(_col(completion_tokens), F.lit(0)))


def duration_minutes(started, ended) -> Column:
    """(ended - started) in minutes as double; NULL if either side is NULL."""
    return (F.unix_micros(_col(ended)) - F.unix_micros(_col(started))) / F.lit(60_000_000.0)


def merge_settings(old, new) -> Column:
    """Shallow map merge, right side wins; NULL sides count as empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(F.coalesce(_col(old), empty), F.coalesce(_col(new), empty))


def is_uuid(c) -> Column:
    return F.coalesce(_col(c).rlike(UUID_PATTERN), F.lit(False))
