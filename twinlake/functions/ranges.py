"""Split points of a key's order, and the range that a key is in."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a sketch for each range asked for: a range then holds its share within about a quarter (two sigma).
PER_RANGE = 64


def key_sample(keys: DataFrame, size: int, by: Column | None = None) -> DataFrame:
    """The ``size`` rows of the smallest hashes: a sample without chance, and a mergeable quantile sketch.

    The sample of a union is the sample of the union of samples, so tasks keep ``size`` rows each and pass only those
    on. by: hash that tells rows apart, where keys repeat (default: hash of the key).
    """
    names = [f"`{n}`" for n in keys.columns]
    place = by if by is not None else F.xxhash64(*names)
    return keys.select(place.alias("_place"), *names).orderBy("_place", *names).limit(size).drop("_place")


def spread(rows: list[tuple], ranges: int) -> list[tuple]:
    """At most ``ranges - 1`` distinct rows of a sorted sample that cut it into parts of about equal size."""
    out: list[tuple] = []
    for k in range(1, ranges):
        i = k * len(rows) // ranges
        if 0 < i < len(rows) and rows[i] != rows[0] and (not out or rows[i] != out[-1]):
            out.append(rows[i])
    return out


def split_points(keys: DataFrame, ranges: int, names: Sequence[str] = (), by: Column | None = None) -> list[tuple]:
    """At most ``ranges - 1`` distinct ascending keys that cut the rows into parts of about equal size, for keys of any order.

    names: the key's columns (default all). Points are given as text, as ``range_of`` takes them. What reaches the
    driver is bounded by PER_RANGE * ranges keys.
    """
    if ranges < 2:
        return []
    names = [f"`{n}`" for n in names or keys.columns]
    # Spark sorts, as its order of strings (by bytes) is not the driver's
    rows = key_sample(keys, PER_RANGE * ranges, by).select(*names).orderBy(*map(F.asc_nulls_first, names))
    return spread([tuple(r) for r in rows.select(*(F.col(n).cast("string") for n in names)).collect()], ranges)


def range_of(keys: Sequence[Column], kinds: Sequence[T.DataType], points: Sequence[tuple]) -> Column:
    """The number of points (ascending, as text) that are at most the key, by binary search in a constant array."""
    if not points:
        return F.lit(0)
    columns = [F.from_json(F.lit(json.dumps([p[i] for p in points])), "array<string>").cast(T.ArrayType(t)) for i, t in enumerate(kinds)]
    keys = [k.cast(t) for k, t in zip(keys, kinds)]

    def reached(i: Column, key: Column) -> Column:
        """Whether point i is at most the key, column by column; NULLs come first."""
        out = None
        for j in reversed(range(len(kinds))):
            p, k = F.get(columns[j], i), key.getField(f"k{j}")
            if out is None:
                out = p.isNull() | F.coalesce(p <= k, F.lit(False))
            else:
                out = (p.isNull() & k.isNotNull()) | F.coalesce(p < k, F.lit(False)) | (p.eqNullSafe(k) & out)
        return out

    n = len(points)
    steps = [1 << b for b in reversed(range(n.bit_length()))]
    # the key is handed on in the state: what only the body of a function refers to is not seen by all rules of the optimizer
    state = lambda at, key: F.struct(at.alias("at"), key.alias("key"))

    def forward(s: Column, step: Column) -> Column:
        at, key = s.getField("at"), s.getField("key")
        return state(F.when((at + step <= n) & reached(at + step - 1, key), at + step).otherwise(at), key)

    start = state(F.lit(0), F.struct(*(k.alias(f"k{j}") for j, k in enumerate(keys))))
    return F.aggregate(F.array(*map(F.lit, steps)), start, forward, lambda s: s.getField("at"))
