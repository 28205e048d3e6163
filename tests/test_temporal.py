"""As-of and interval joins against plain loops, and their plans."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from twinlake.functions.ranges import range_of, split_points
from twinlake.operators.temporal import as_of_join, interval_join


def plain_as_of(left, right, forward, exact, near):
    out = []
    for k, t, v in left:
        best = None
        for k2, t2, w in right:
            if k is None or t is None or k2 != k or t2 is None:
                continue
            gap = t2 - t if forward else t - t2
            if gap < 0 or (gap == 0 and not exact) or (near is not None and gap > near):
                continue
            row = (-gap, (w is not None, w))
            if best is None or row > best[0]:
                best = (row, (k2, t2, w))
        out.append((k, t, v, *(best[1] if best else (None,) * 3)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_as_of_against_loops(spark, forward, exact):
    rng = random.Random(forward * 2 + exact)
    time = lambda: rng.choice([None, *range(40)])
    key = lambda: rng.choice([None, 1, 1, 1, 2, 3])
    left = [(key(), time(), i) for i in range(200)] + [(9, 3, -1)] * 2
    right = [(key(), time(), rng.choice([None, "a", "b", "c"])) for _ in range(120)]
    right += right[:5]
    l, r = spark.createDataFrame(left, "k int, t long, v int"), spark.createDataFrame(right, "k int, t long, v string")
    for near in (None, 3):
        want = plain_as_of(left, right, forward, exact, near)
        for shards in (1, 7, 64):
            got = as_of_join(l, r, on=[("k", "k")], time=("t", "t"), forward=forward, exact=exact, tolerance=F.lit(near) if near else None, shards=shards)
            assert got.columns == ["k", "t", "v", "k_right", "t_right", "v_right"]
            assert sorted(map(tuple, got.collect()), key=repr) == want
        inner = as_of_join(l, r, on=[("k", "k")], time=("t", "t"), forward=forward, exact=exact, tolerance=F.lit(near) if near else None, how="inner")
        assert inner.count() == sum(w[3] is not None for w in want)


def test_as_of_without_keys_and_empty_sides(spark):
    l, r = spark.createDataFrame([(1,), (5,), (9,)], "t int"), spark.createDataFrame([(2, "a"), (6, "b")], "u int, v string")
    assert sorted(map(tuple, as_of_join(l, r, time=("t", "u"), shards=3).collect())) == [(1, None, None), (5, 2, "a"), (9, 6, "b")]
    assert as_of_join(l.limit(0), r, time=("t", "u")).collect() == []
    assert [x.v for x in as_of_join(l, r.limit(0), time=("t", "u")).collect()] == [None] * 3
    with pytest.raises(ValueError):
        as_of_join(l, r, time=("t", "u"), how="outer")


def test_a_hot_key_is_dealt_over_tasks(spark):
    l = spark.range(20_000).selectExpr("1 as k", "id as t", "id as v")
    r = spark.range(5_000).selectExpr("1 as k", "id * 4 as t", "id as w")
    out = as_of_join(l, r, on=[("k", "k")], time=("t", "t"), shards=32)
    assert out.filter("w = t div 4 and t_right = w * 4").count() == 20_000
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # rows of the one key by shard, as the window deals them out
    points = split_points(l.select("t").unionByName(r.select("t")), 32)
    sizes = [x["count"] for x in l.select(range_of([F.col("t")], [l.schema["t"].dataType], points).alias("s")).groupBy("s").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * 20_000 / 32


def plain_pairs(left, right, closed, keyed):
    ok = lambda a, b: a is not None and b is not None and (a <= b if closed else a < b)
    out = []
    for k, a, b, i in left:
        for m, c, d, j in right:
            if (not keyed or (k is not None and k == m)) and ok(a, b) and ok(c, d) and ok(a, d) and ok(c, b):
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("kind", ["long", "timestamp", "timestamp_ntz", "date"])
def test_intervals_against_loops(spark, closed, kind):
    rng = random.Random(closed)

    def interval():
        a = rng.choice([None, *range(-300, 300)])
        length = rng.choice([0, 0, 1, 2, 5, 8, 64, 65, 500, 10_000, -3])
        return (a, None if a is None or rng.random() < 0.05 else a + length)

    def typed(x):
        if x is None or kind == "long":
            return x
        return date(2000, 1, 1) + timedelta(x) if kind == "date" else datetime(2000, 1, 1) + timedelta(microseconds=x)

    left, right = ([(rng.choice([None, 1, 1, 2]), *interval(), i) for i in range(90)] for _ in range(2))
    make = lambda rows: spark.createDataFrame([(k, typed(a), typed(b), i) for k, a, b, i in rows], f"k int, a {kind}, b {kind}, i int")
    l, r = make(left), make(right)
    for on in ([], [("k", "k")]):
        got = interval_join(l, r, left_interval=("a", "b"), right_interval=("a", "b"), on=on, closed=closed)
        assert sorted((x.i, x.i_right) for x in got.collect()) == plain_pairs(left, right, closed, bool(on))


def test_very_long_intervals_need_few_bins(spark):
    big = 1 << 60
    l = spark.createDataFrame([(-big, big), (0, 0), (big, big), (-(1 << 63), (1 << 63) - 1 - big)], "a long, b long")
    out = interval_join(l.limit(3), l.limit(3), left_interval=("a", "b"), right_interval=("a", "b"))
    assert out.count() == 3 + 4
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_bounds_without_bins_are_refused(spark):
    l = spark.createDataFrame([(1.5, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        interval_join(l, l, left_interval=("a", "b"), right_interval=("a", "b"))


def test_split_points_of_any_key(spark):
    df = spark.range(4000).selectExpr("concat('k', cast(id * id % 1009 as string)) as s", "id % 7 as n", "id")
    for names in (["s"], ["n", "s"], ["id"]):
        points = split_points(df, 16, names, F.xxhash64("id"))
        kinds = [df.schema[n].dataType for n in names]
        sizes = [x["count"] for x in df.groupBy(range_of([F.col(n) for n in names], kinds, points).alias("r")).count().collect()]
        assert len(points) <= 15 and len(sizes) == len(points) + 1 and max(sizes) < 2 * 4000 / 16
        low = df.select(range_of([F.col(n) for n in names], kinds, points).alias("r"), F.struct(*names).alias("k")).groupBy("r").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("r").collect()
        assert all(tuple(x.b) < tuple(y.a) for x, y in zip(low, low[1:]))
    assert split_points(df.limit(0), 16, ["s"]) == [] and split_points(df.selectExpr("1 as c"), 16) == []


def test_full_bins_are_dealt_in_pieces(spark, monkeypatch):
    from twinlake.operators import temporal

    monkeypatch.setattr(temporal, "PIECE_ROWS", 16)
    # points of one instant, many short intervals around it and few long ones
    left = [(None, 5, 5, i) for i in range(100)]
    right = [(None, 5 - i % 3, 5 + i % 4, i) for i in range(60)] + [(None, -1000, 1000 + i, 100 + i) for i in range(5)] + [(None, 6, 7, 200)]
    l, r = (spark.createDataFrame(rows, "k int, a long, b long, i int") for rows in (left, right))
    for x, y, one, two in ((l, r, left, right), (r, l, right, left)):
        got = interval_join(x, y, left_interval=("a", "b"), right_interval=("a", "b"))
        assert sorted((z.i, z.i_right) for z in got.collect()) == plain_pairs(one, two, True, False)
        assert "lpiece" in got._jdf.queryExecution().toString()
