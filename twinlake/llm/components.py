"""Connected components of links between ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import Scratch, written

MAX_ROUNDS = 64


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id in a link; component is the smallest id reachable.

    Each round keeps one row per link and ends its lineage by a table in the shared folder, which the next
    round replaces. A node with very many links is met only in aggregations with partial sums and in joins
    that AQE can split. Links to oneself and null ends are ignored; no links give an empty result.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.written(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u.alias("u"), v.alias("v")).filter("u > v").distinct())
        state = _state(edges)
        for _ in range(MAX_ROUNDS):
            if not state[0]:
                break
            both = edges.union(edges.select("v", "u"))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").selectExpr("inline(if(v > m, array(struct(v as u, m as v), struct(u as u, m as v)), array(struct(u as u, m as v))))")
            edges = scratch.written(small.distinct())
            scratch.keep_last()
            before, state = state, _state(edges)
            if state == before:
                break
        else:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        return written(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (id, component) after further links (a, b) between its components, or ids that are in none.

    Only the components that the links name are joined anew, so the work follows the further links.
    """
    more = components(links)
    old = found.join(more.select(F.col("id").alias("component"), F.col("component").alias("new")), "component", "left")
    old = old.select("id", F.coalesce("new", "component").alias("component"))
    return old.union(more.join(found, "id", "left_anti").select("id", "component"))
