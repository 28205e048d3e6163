"""Comparisons by key where keys repeat give what SQL's full join gives."""

import duckdb
import pytest
from pyspark.sql import functions as F

from twinlake import workload
from twinlake.diff import DiffOptions, diff
from twinlake.operators import strategies

COPIES = 8  # of 150,000 keys each: the right side's added keys, 1,000,000 later, are keys already


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Orders in which added keys meet others, of few rows: (folder, DuckDB on it)."""
    folder = tmp_path_factory.mktemp("repeated")
    duck = duckdb.connect()
    wanted = "o_orderkey % 1499 = 5 or (o_orderkey - 1000000) % 1499 = 5 or o_orderkey % 997 = 3 or o_orderkey % 501 = 7"
    duck.sql(
        f"copy (select * from (select t.* replace (o_orderkey + i * 150000 as o_orderkey) from range({COPIES}) r(i), '/root/testdata/sf0.1/orders.parquet' t) where {wanted})"
        f" to '{folder}/orders.parquet' (format parquet)"
    )
    duck.sql(f"create view orders as select * from '{folder}/orders.parquet'")
    return str(folder), duck


def check(spark, repeated, name):
    folder, duck = repeated
    want = duck.sql(workload.oracle_sql()[name])
    df = workload.queries()[name](spark, folder)
    got = sorted(map(repr, map(tuple, df.select(*want.columns).collect())))
    assert got == sorted(map(repr, want.fetchall())) and got


def around(spark):
    """Both sides, with keys that repeat in all ways."""
    left = [(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "d"), (4, "e"), (4, "e"), (5, "f"), (6, "g"), (6, "h"), (None, "n"), (None, "m"), (8, "i")]
    right = [(1, "b"), (1, "a"), (2, "c"), (3, "d"), (3, "x"), (3, "x"), (4, "y"), (4, "z"), (7, "q"), (7, "q"), (6, "g"), (None, "n"), (8, "i")]
    return tuple(spark.createDataFrame(rows, "id int, v string") for rows in (left, right))


def all_pairs(spark, strategy, fallback=None, **options):
    l, r = around(spark)
    result = diff(l, r, DiffOptions(strategy=strategy, repeats="pairs", fetch_all_threshold=0, bisection_threshold=1, **options), declared_key=["id"])
    assert result.report.strategy == (fallback or strategy)
    rows = result.diffs.collect()
    for x in rows:
        assert x.status == ("MissingLeft" if x.left is None else "MissingRight" if x.right is None else "Modified")
    return sorted((x.key.id is None, x.key.id, x.left and x.left.v or "", x.right and x.right.v or "") for x in rows)


#: (key is NULL, key, left, right): each row with each row of its key and another content
WANT = sorted(
    [(False, 1, "a", "b"), (False, 1, "b", "a"), (False, 3, "d", "x"), (False, 3, "d", "x"), *[(False, 4, "e", y) for y in "yyzz"]]
    + [(False, 5, "f", ""), (False, 6, "h", "g"), (False, 7, "", "q"), (False, 7, "", "q"), (True, None, "m", "n")],
)


def test_joindiff_pairs(spark):
    assert all_pairs(spark, "joindiff") == WANT


def test_filtered_diff(spark, repeated):
    check(spark, repeated, "filtered_diff")


def test_incremental_diff(spark, repeated):
    check(spark, repeated, "incremental_diff")


def test_keyeddiff(spark, repeated):
    assert all_pairs(spark, "keyeddiff") == WANT
    check(spark, repeated, "keyeddiff_rows")


def test_hashdiff(spark, repeated):
    assert all_pairs(spark, "hashdiff") == WANT
    check(spark, repeated, "hashdiff_rows")


def test_checkpoint_resume(spark, repeated):
    check(spark, repeated, "checkpoint_resume")


def test_iblt(spark, repeated):
    assert all_pairs(spark, "iblt", "hashdiff") == WANT  # rows that repeat alike on one side only vanish in a sketch
    check(spark, repeated, "iblt_decode")


def test_difference_estimate(spark, repeated):
    check(spark, repeated, "difference_estimate")


def test_joindiff_contents(spark, repeated):
    check(spark, repeated, "joindiff_contents")


def test_recheck_confirmed(spark, repeated):
    check(spark, repeated, "recheck_confirmed")


def test_one_leaf_tells_that_keys_repeat(spark, monkeypatch):
    def all_keys(*_):
        raise AssertionError("all keys were exchanged first")

    monkeypatch.setattr(strategies, "_differing_keys", all_keys)
    l = spark.range(400).selectExpr("id div 2 % 50 a", "id div 100 b", "id % 7 v")
    result = diff(l, l.filter("v <> 3"), DiffOptions(strategy="hashdiff", any_key=True, bisection_threshold=16), declared_key=["a", "b"])
    assert result.report.strategy == "bucketdiff" and result.report.summary.missing_right == result.diffs.count() > 0
    assert not any("h0" in str(x) for x in spark.sparkContext._jsc.getPersistentRDDs().values())  # hashes are given up
    result.close()


def test_registered_comparisons_are_not_cancelled(spark, monkeypatch):
    limits = []
    monkeypatch.setattr(workload, "diff", lambda l, r, options, **more: limits.append(options.statement_timeout) or diff(l, r, options, **more))
    for name in ("declared_duplicate_diff", "keyed_string_diff"):
        workload.queries()[name](spark, "/root/testdata/sf0.001")
    assert limits == [None, None]


def test_ranges_of_composite_keys_with_nulls(spark):
    l = spark.range(600).selectExpr("if(id % 3 = 0, null, id % 5) a", "id b", "id v")
    r = l.withColumn("v", F.expr("if(b % 97 = 6, -1, v)"))
    result = diff(l, r, DiffOptions(strategy="hashdiff", any_key=True, bisection_threshold=8), declared_key=["a", "b"])
    assert sorted(x.key.b for x in result.diffs.collect()) == [6, 103, 200, 297, 394, 491, 588]
    result.close()
