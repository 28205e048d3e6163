"""As-of and interval joins without nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions.canonical import identifier
from twinlake.functions.ranges import range_of, split_points
from twinlake.operators.lineage import settled
from twinlake.plans.tableplan import is_integer

#: Time shards of an as-of join at most: rows of one key in the step that carries matches over shards.
MAX_SHARDS = 256
#: Bins of an interval join are this power of two as wide from one level to the next.
LEVEL_BITS = 3
#: Rows of a side of a bin that meet in one task; a bin with more is dealt out in pieces.
PIECE_ROWS = 8192


def as_of_join(
    left: DataFrame, right: DataFrame, *, on: Sequence[tuple[str, str]] = (), time: tuple[str, str], forward: bool = False, exact: bool = True,
    tolerance: Column | None = None, how: str = "left", shards: int | None = None, suffix: str = "_right",
) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of equal keys whose time is the last one at or before its own.

    on: pairs of key columns (left, right), not null-safe; time: the two time columns, of one ordered type. ``forward``: the
    first one at or after instead. Without ``exact`` equal times do not match. tolerance: an interval; rows farther away do
    not match. Of right rows with equal keys and times the one that is greatest by its columns, in their order, counts. Rows
    of ``left`` without a match stay with NULLs, or go (``how="inner"``); a NULL key or time never matches. Right columns
    whose names clash get the suffix.

    Both tables are united and sorted once, by key and time shard (split points are quantiles of all times), so a key with very many
    rows is dealt over ``shards`` tasks. Within a shard the match is the last right row by time; for rows without one there,
    the last right rows of earlier shards, one a key and shard, are carried over and joined.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    spark = left.sparkSession
    shards = min(MAX_SHARDS, shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [f"k{i}" for i in range(len(on))]
    kind = right.schema[time[1]].dataType

    def keys(df: DataFrame, side: int) -> list[Column]:
        return [identifier(pair[side]).alias(n) for pair, n in zip(on, names)]

    def part(df: DataFrame, side: int) -> DataFrame:
        row = F.struct(*(identifier(c) for c in df.columns))
        t = identifier(time[side]).cast(kind).alias("t")
        return df.select(*keys(df, side), t, row.alias("row"))

    l, r = part(left, 0), part(right, 1).filter("t is not null")
    for n in names:
        r = r.filter(F.col(n).isNotNull())
    told = F.xxhash64(*names, "t", "row").alias("h")
    times = l.select("t", told).unionByName(r.select("t", told)).filter("t is not null")
    points = split_points(times, shards, ["t"], F.col("h"))
    shard = range_of([F.col("t")], [kind], points).alias("shard")
    l, r = (x.select(*names, "t", shard, "row") for x in (l, r))
    direction = (lambda c: F.desc(c)) if forward else (lambda c: F.asc(c))
    # at equal times right rows come first if they count, else after the left ones
    order = F.when(F.col("l").isNull(), 0 if exact else 2).otherwise(1)
    right_row = F.when(F.col("l").isNull(), F.struct(F.col("t").alias("t"), F.col("row").alias("row")))
    none_l, none_r = F.lit(None).cast(l.schema["row"].dataType), F.lit(None).cast(r.schema["row"].dataType)
    both = l.select(*names, "t", "shard", F.col("row").alias("l"), none_r.alias("row")).unionByName(r.select(*names, "t", "shard", none_l.alias("l"), "row"))
    seen = Window.partitionBy(*names, "shard").orderBy(direction("t"), order, "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_seen = F.last(right_row, ignorenulls=True).over(seen)
    met = both.withColumn("m", last_seen).filter("l is not null").drop("row").withColumn("m", F.when(F.col("t").isNotNull(), F.col("m")))

    # the last right row of each key and shard, by the same order, carried to the shards after it
    place = F.struct(F.col("t"), F.col("row"))
    if forward:  # the first time, but of equal ones the greatest row
        firsts = r.groupBy(*names, "shard").agg(F.min("t").alias("t"))
        last = r.join(firsts, [*names, "shard", "t"]).groupBy(*names, "shard").agg(F.max(place).alias("c"))
    else:
        last = r.groupBy(*names, "shard").agg(F.max(place).alias("c"))
    asked = met.filter("m is null and t is not null").select(*names, "shard").distinct()
    shards_of = last.unionByName(asked.withColumn("c", F.lit(None).cast(last.schema["c"].dataType)))
    # in the order of shards, what is asked comes before the shard's own row (which would have matched within the shard, or must not)
    before = Window.partitionBy(*names).orderBy(direction("shard"), F.col("c").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    carried = shards_of.withColumn("carry", F.last("c", ignorenulls=True).over(before)).filter("c is null and carry is not null").select(*names, "shard", "carry")
    out = met.join(carried, [*names, "shard"], "left").withColumn("m", F.coalesce("m", F.when(F.col("t").isNotNull(), F.col("carry"))))
    if tolerance is not None:
        near = F.col("m.t") <= F.col("t") + tolerance if forward else F.col("m.t") >= F.col("t") - tolerance
        out = out.withColumn("m", F.when(near, F.col("m")))
    if how == "inner":
        out = out.filter("m is not null")
    taken = set(left.columns)
    columns = [F.col("m.row").getField(c).alias(c + suffix if c in taken else c) for c in right.columns]
    return out.select(*(F.col("l").getField(c).alias(c) for c in left.columns), *columns)


def _number(c: Column, kind: T.DataType) -> Column:
    """An ordered type as bigint, one to one."""
    if is_integer(kind):
        return c.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    raise ValueError(f"bounds of type {kind.simpleString()} have no bins; cast them to integers, dates or timestamps")


def interval_join(
    left: DataFrame, right: DataFrame, *, left_interval: tuple[str, str], right_interval: tuple[str, str], on: Sequence[tuple[str, str]] = (), closed: bool = True, suffix: str = "_right",
) -> DataFrame:
    """All pairs of rows with equal keys whose intervals overlap (a point is an interval with equal bounds).

    ``closed`` intervals that touch overlap, half-open ones, [start, end), do not, and hold nothing if start = end. NULL bounds and
    intervals that end before they start match nothing. Right columns whose names clash get the suffix.

    Bins are of several widths, each 2 ** LEVEL_BITS times the one below. An interval's own level is the lowest where it is
    less than 2 ** LEVEL_BITS bins long, so most of what meets it there overlaps it; on levels above it is in two bins at most. Two intervals meet on
    the higher of their own levels, in the bin of the later start, so no pair comes twice, and only if that level is the own one of at least one of
    them; very long intervals need no more bins than short ones. What meets in a bin is rechecked exactly. Only levels that occur are used
    (at most 21). Bins with more than PIECE_ROWS rows of a side are counted first and dealt out: pieces of one side by pieces of the other, each
    pair in a place of its own, so neither work nor memory of a task grows with a bin (rows that are copies of each other in all
    columns stay in one piece). The number of pairs is the result's and can be quadratic.
    """
    taken = set(left.columns)

    def part(df: DataFrame, bounds: tuple[str, str], side: str) -> DataFrame:
        start, end = (_number(identifier(c), df.schema[c].dataType) for c in bounds)
        row = F.struct(*(identifier(c) for c in df.columns)).alias(side)
        keys = [identifier(pair[0 if side == "l" else 1]).alias(f"k{i}") for i, pair in enumerate(on)]
        rows = df.select(*keys, start.alias(f"{side}s"), (end if closed else end - 1).alias(f"{side}e"), row).filter(f"{side}s <= {side}e")
        # the number of levels but the first on which an interval of 2 ** LEVEL_BITS bins would not be longer
        length = f"coalesce(try_subtract({side}e, {side}s), {(1 << 63) - 1}L)"
        return rows.withColumn("own", F.expr(" + ".join(f"cast({length} >= {1 << LEVEL_BITS * k}L as int)" for k in range(1, -(-63 // LEVEL_BITS)))))

    l, r = part(left, left_interval, "l"), part(right, right_interval, "r")
    found = l.select("own", F.lit("l").alias("side")).unionByName(r.select("own", F.lit("r").alias("side"))).distinct().collect()  # at most 2 * 21
    levels = {side: sorted(x["own"] for x in found if x["side"] == side) for side in "lr"}
    cell = ["level", "who", "bin", *(f"k{i}" for i in range(len(on)))]

    def dealt(rows: DataFrame, side: str) -> DataFrame:
        """rows once in each bin and role: ``who`` is on its own level there, both sides (b) or one of them."""
        other = "r" if side == "l" else "l"
        own = F.col("own")
        at = lambda level, who: F.struct(level.cast("int").alias("level"), F.lit(who).alias("who"))
        places = [F.when(own == k, F.array(at(own, "b"))) for k in levels[other]]
        places += [F.when(own > k, F.array(at(own, side))) for k in levels[other][:1]]
        places += [F.when(own < k, F.array(at(F.lit(k), other))) for k in levels[other]]
        rows = rows.withColumn("at", F.explode(F.flatten(F.array_compact(F.array(*places))))) if places else rows.limit(0).withColumn("at", at(own, "b"))
        rows = rows.select("*", "at.level", "at.who", (F.col("at.level") * LEVEL_BITS).alias("shift")).drop("at", "own")
        first, last = F.expr(f"shiftright({side}s, shift)"), F.expr(f"shiftright({side}e, shift)")
        return rows.withColumn("bin", F.explode(F.sequence(first, last)))

    a, b = dealt(l, "l"), dealt(r, "r").drop("shift")
    large = [x.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > PIECE_ROWS).select(*cell, F.expr(f"(n + {PIECE_ROWS - 1}) div {PIECE_ROWS}").alias(n)) for x, n in ((a, "ln"), (b, "rn"))]
    pieces = settled(large[0].join(large[1], cell, "full_outer"))  # less than one a PIECE_ROWS rows
    if not pieces.isEmpty():
        pieces = F.broadcast(pieces)

        def piece(rows: DataFrame, mine: str, other: str, row: str) -> DataFrame:
            """rows in one piece of their own side each, before all pieces of the other side."""
            rows = rows.join(pieces, cell, "left")
            own = F.pmod(F.xxhash64(row), F.coalesce(f"{mine}n", F.lit(1)))
            all_ = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"{other}n", F.lit(1)) - 1))
            return rows.withColumn(f"{mine}piece", own).withColumn(f"{other}piece", all_).drop("ln", "rn")

        a, b = piece(a, "l", "r", "l"), piece(b, "r", "l", "r")
        cell = [*cell, "lpiece", "rpiece"]
    # a small side is not broadcast: the other may be in few partitions, which would then make all pairs
    met = a.join(b.hint("merge"), cell).filter("ls <= re and rs <= le and bin = shiftright(greatest(ls, rs), shift)")
    return met.select("l.*", *(F.col("r").getField(c).alias(c + suffix if c in taken else c) for c in right.columns))
