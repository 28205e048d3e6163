"""Row filters that both sides of a comparison share."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions.canonical import identifier
from twinlake.plans.options import DiffOptions

_WINDOW = re.compile(r"(\d+)\s+(day|hour)s?$")


def incremental(column: str, since: str | None, as_of: datetime | None = None) -> Column:
    """``column >= since``: since is ``N day(s)`` or ``N hour(s)`` before as_of (default now), else a literal."""
    since = since or "1 day"
    c = identifier(column)
    if m := _WINDOW.match(since.strip()):
        n, unit = int(m[1]), m[2]
        now = F.lit(as_of) if as_of else F.current_timestamp()
        return c >= now - (F.make_dt_interval(F.lit(n)) if unit == "day" else F.make_dt_interval(F.lit(0), F.lit(n)))
    return c >= F.lit(since)


def apply_filter(df: DataFrame, options: DiffOptions) -> DataFrame:
    """The condition or the incremental window; every strategy and probe goes through here."""
    if options.where:
        return df.filter(F.expr(options.where))
    if options.update_column:
        return df.filter(incremental(options.update_column, options.update_since, options.as_of))
    return df


def key_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """low <= key < high, as a predicate that scans push down."""
    return df.filter((identifier(key) >= low) & (identifier(key) < high))


def in_buckets(df: DataFrame, bucket: Column, buckets: DataFrame) -> DataFrame:
    """Rows whose bucket is among those of a (small) frame with one column ``bkt``."""
    return df.withColumn("bkt", bucket).join(buckets, "bkt", "left_semi")


def after(keys: Sequence[str], last: Sequence) -> Column:
    """Lexicographic (keys) > (last)."""
    return F.struct(*map(identifier, keys)) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, last)))
