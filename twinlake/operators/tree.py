"""A tree of checksums over ranges of the key, from one scan of each side.

The leaves are cut by split points that are quantiles of the keys, whatever their type or number of columns, so a
skewed domain has leaves of about equal size too. Where that many points would be too many (``MAX_RANGES``), a range is
dealt into leaves by the key's hash. Each row is summed once, in its leaf; a node's sums are those of its children, so any
level is rolled up from the leaves without another look at the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions.canonical import identifier
from twinlake.functions.hashing import MODULUS, hash_slice, sum_modulo
from twinlake.functions.ranges import PER_RANGE, key_sample, range_of, spread
from twinlake.plans.tableplan import TablePlan

#: Ranges by split points, and leaves at most; more leaves would only make the last comparison finer.
MAX_RANGES, MAX_LEAVES = 256, 1 << 20
SUMS = ("s1", "s2", "s3", "s4")


@dataclass
class Leaves:
    """How keys are dealt into leaves: by split points, then by hash into ``parts``."""

    kinds: list[T.DataType]
    points: list[tuple]
    parts: int = 1

    @property
    def number(self) -> int:
        return (len(self.points) + 1) * self.parts

    def of(self, keys: list[Column]) -> Column:
        """The leaf of a key, 0 to number - 1, in the order of the ranges."""
        at = range_of(keys, self.kinds, self.points).cast("bigint")
        if self.parts == 1:
            return at
        return at * self.parts + F.pmod(F.xxhash64(*(k.cast(t) for k, t in zip(keys, self.kinds))), F.lit(self.parts))

    def bounds(self, first: int, last: int) -> tuple[tuple | None, tuple | None]:
        """(least key, next key) of leaves first to last; None where there is no bound."""
        a, b = first // self.parts, last // self.parts
        return self.points[a - 1] if a else None, self.points[b] if b < len(self.points) else None


def _keys(df: DataFrame, plan: TablePlan, kinds: list[T.DataType]) -> DataFrame:
    return df.select(*(identifier(k).cast(t).alias(f"k{i}") for i, (k, t) in enumerate(zip(plan.key_names, kinds))))


def common_kinds(left: DataFrame, right: DataFrame, lplan: TablePlan, rplan: TablePlan) -> list[T.DataType]:
    """The types in which keys of both sides are compared."""
    both = [df.limit(0).select(*(identifier(k).alias(f"k{i}") for i, k in enumerate(p.key_names))) for df, p in ((left, lplan), (right, rplan))]
    return [f.dataType for f in both[0].union(both[1]).schema]


def cut(left: DataFrame, right: DataFrame, lplan: TablePlan, rplan: TablePlan, rows_a_leaf: int, least: int = 1) -> Leaves:
    """Leaves of about ``rows_a_leaf`` rows of the two sides' larger one, from one small sketch of both sides' keys.

    The sketch is the keys of the smallest hashes; it gives the quantiles, and by how small those hashes are, the number of rows.
    """
    kinds = common_kinds(left, right, lplan, rplan)
    keys = _keys(left, lplan, kinds).unionByName(_keys(right, rplan, kinds))
    names = keys.columns
    size = PER_RANGE * MAX_RANGES
    place = F.xxhash64(*names)
    sample = key_sample(keys, size).withColumn("place", place).orderBy(*map(F.asc_nulls_first, names))
    rows = [tuple(r) for r in sample.select(*(F.col(n).cast("string") for n in names), "place").collect()]  # at most size keys
    total = len(rows)
    if total == size:
        total = int(size / max(1e-18, (max(r[-1] for r in rows) + 2**63) / 2**64))
    wanted = max(least, min(MAX_LEAVES, -(-total // (2 * rows_a_leaf))))
    # bytes have no text that keeps their order: such keys are dealt by hash alone
    points = [] if any(isinstance(t, T.BinaryType) for t in kinds) else spread([r[:-1] for r in rows], min(MAX_RANGES, wanted))
    parts = 1
    while (len(points) + 1) * parts < wanted:
        parts *= 2
    return Leaves(kinds, points, parts)


def leaf_sums(left: DataFrame, right: DataFrame, lplan: TablePlan, rplan: TablePlan, leaves: Leaves) -> DataFrame:
    """(leaf, left_cnt, left_s1.., right_cnt, right_s1..): one scan of each side, one row a leaf that has rows."""

    def rows(df: DataFrame, plan: TablePlan, side: str) -> DataFrame:
        leaf = leaves.of([identifier(k) for k in plan.key_names])
        h = df.select(leaf.alias("leaf"), plan.identity_hash().alias("h"))
        return h.groupBy("leaf").agg(F.count("*").alias("cnt"), *(sum_modulo(hash_slice(F.col("h"), i)).alias(s) for i, s in enumerate(SUMS))).withColumn("side", F.lit(side))

    both = rows(left, lplan, "left").unionByName(rows(right, rplan, "right"))
    mine = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c)))
    columns = [F.coalesce(mine(side, c), F.lit(0)).cast("bigint" if c == "cnt" else "decimal(20,0)").alias(f"{side}_{c}") for side in ("left", "right") for c in ("cnt", *SUMS)]
    return both.groupBy("leaf").agg(*columns)


def roll_up(leaf_rows: DataFrame, width: int) -> DataFrame:
    """The level of the tree whose nodes have ``width`` leaves each: (node, the same columns)."""
    modulus = F.lit(str(MODULUS)).cast("decimal(20,0)")

    def total(c: str) -> Column:
        if c.endswith("cnt"):
            return F.sum(c).alias(c)
        return (F.sum(F.col(c).cast("decimal(27,0)")) % modulus).cast("decimal(20,0)").alias(c)

    return leaf_rows.groupBy(F.expr(f"leaf div {width}").alias("node")).agg(*(total(c) for c in leaf_rows.columns if c != "leaf"))


def unequal() -> Column:
    """Whether the sums of a node's two sides differ."""
    out = F.lit(False)
    for c in ("cnt", *SUMS):
        out = out | (F.col(f"left_{c}") != F.col(f"right_{c}"))
    return out


def within(df: DataFrame, plan: TablePlan, leaves: Leaves, open_: DataFrame, span: tuple[int, int] | None = None) -> DataFrame:
    """The rows of leaves in ``open_`` (one column, leaf). span: first and last leaf, a range that scans can be pruned by."""
    if span is not None:  # by the first column of the key
        (low, high), k = leaves.bounds(*span), identifier(plan.key_names[0])
        nulls = low is None or low[0] is None
        if not nulls:
            df = df.filter(k >= F.lit(low[0]).cast(leaves.kinds[0]))
        if high is not None and high[0] is None:
            df = df.filter(k.isNull())
        elif high is not None:
            bound = F.lit(high[0]).cast(leaves.kinds[0])
            below = k < bound if len(plan.key_names) == 1 else k <= bound
            df = df.filter(below | k.isNull() if nulls else below)
    leaf = leaves.of([identifier(k) for k in plan.key_names])
    return df.withColumn("_leaf", leaf).join(open_.select(F.col("leaf").alias("_leaf")), "_leaf", "left_semi").drop("_leaf")
