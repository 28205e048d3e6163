"""Order-independent checksums: the row count and the sums of the four hash slices modulo 2**64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions.canonical import identifier
from twinlake.functions.hashing import bucket, hash_slice, slices_of_halves, sum_modulo
from twinlake.operators.filters import key_range
from twinlake.plans.tableplan import TablePlan

SUMS = ("s1", "s2", "s3", "s4")


def _aggregates() -> list[Column]:
    return [F.count("*").alias("cnt"), *(sum_modulo(hash_slice(F.col("h"), i)).alias(s) for i, s in enumerate(SUMS))]


def checksum(df: DataFrame, plan: TablePlan) -> DataFrame:
    """One row (cnt, s1..s4) of the table's content."""
    return df.select(plan.content_hash().alias("h")).agg(*_aggregates())


def checksum_range(df: DataFrame, plan: TablePlan, low: int, high: int) -> DataFrame:
    return checksum(key_range(df, plan.key_names[0], low, high), plan)


def checksum_bucket(df: DataFrame, plan: TablePlan, n: int, b: int) -> DataFrame:
    """The checksum of the rows whose content hash is in bucket b of n."""
    return df.select(plan.content_hash().alias("h")).filter(bucket(F.col("h"), n) == b).agg(*_aggregates())


def batch_checksum(df: DataFrame, plan: TablePlan, n: int, *, by: str = "content") -> DataFrame:
    """(bkt, cnt, s1..s4) of all buckets from one scan.

    by content: bucket and sums of the content hash; by key: bucket of the key hash, sums of the identity hash.
    """
    if by == "content":
        rows = df.select(plan.content_hash().alias("h")).withColumn("bkt", bucket(F.col("h"), n))
    elif by == "key":
        rows = df.select(plan.identity_hash().alias("h"), plan.key_bucket(n).alias("bkt"))
    else:
        raise ValueError("by is 'content' or 'key'")
    return bucket_sums(rows)


def bucket_sums(rows: DataFrame) -> DataFrame:
    """(bkt, cnt, s1..s4) of rows (h, bkt) that are hashed already."""
    return rows.groupBy("bkt").agg(*_aggregates())


def half_sums(rows: DataFrame) -> DataFrame:
    """bucket_sums of rows (h0, h1, bkt) that hold their hashes as halves."""
    slices = slices_of_halves(F.col("h0"), F.col("h1"))
    return rows.groupBy("bkt").agg(F.count("*").alias("cnt"), *(sum_modulo(x).alias(s) for x, s in zip(slices, SUMS)))


def differing(left: DataFrame, right: DataFrame, on: str = "bkt") -> DataFrame:
    """(on, left_cnt, right_cnt) where the two sides' checksums differ; an absent group counts as zeros."""
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(-1)))
    signed = [F.sum(F.col("side") * F.col(c)).alias(f"d_{c}") for c in ("cnt", *SUMS)]
    counts = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("cnt"))), F.lit(0)).cast("long").alias(n) for s, n in ((1, "left_cnt"), (-1, "right_cnt"))]
    out = both.groupBy(on).agg(*signed, *counts)
    return out.filter(" or ".join(f"d_{c} <> 0" for c in ("cnt", *SUMS))).select(on, "left_cnt", "right_cnt")


def key_domain(df: DataFrame, plan: TablePlan) -> DataFrame:
    """(lo, hi) of the single key as bigint; a key beyond bigint is an error, not a NULL."""
    k = identifier(plan.key_names[0])
    return df.agg(F.min(k).cast("bigint").alias("lo"), F.max(k).cast("bigint").alias("hi"))
