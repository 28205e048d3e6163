"""Temperature mixing with DataFrame functions only.

1. Tokens (runs of non-space) are summed by source; p are the sources' shares.
2. The exponent a of w = p**a / sum(p**a) is bisected: the largest a whose weights have at least
   ``entropy`` of the entropy of equal weights, but not below the smallest a at which no source is
   repeated more than ``repeats`` times as often as the least repeated one.
3. The budget is the one at which the least repeated source is seen once in full (or a given number of
   tokens). A source with budget T is scheduled as epochs laid end to end, each a new permutation of its
   documents, until T is spent; a document begun is taken whole.
4. The schedule has ``blocks`` blocks; a copy that starts at token t of its source's T goes to block
   floor(t * blocks / T), so every block holds the sources in the target weights.

Prefix sums run within shards of a permutation (the leading hex digits of its key) on top of a small
table of shard sums, so a source with any share of the rows is spread over many tasks.

Cases: a null text has no tokens, and a document without tokens that follows the last one goes to the last
block; a null source is a source of its own; sources without tokens keep
their documents once, in block 0; rows that repeat an id add up their copies (with ``by_text``, only if their
texts are equal too); an empty table gives an empty result; only ``id``, ``source`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from twinlake.llm.common import written

ENTROPY = 0.95
REPEATS = 2.0
BLOCKS = 64
STEPS = 40
#: Shards of a permutation: 16 ** SHARD_DIGITS.
SHARD_DIGITS = 3
#: Ratios are kept as integers of this unit, so that budgets are exact.
UNIT = 10_000
#: The table of sources is gathered in one row, so their number is bounded; beyond it the job fails.
MAX_SOURCES = 1_000_000


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def text_marks(text: str = "text") -> dict[str, Column]:
    """Two hashes that stand for a text."""
    return {"mark1": F.xxhash64(text), "mark2": F.xxhash64(text, F.lit(1))}


def _bisect(holds, rising: bool) -> Column:
    """The end of [0, 1] at which ``holds`` (true up to, or from, some point) changes."""

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = holds(mid) if rising else ~holds(mid)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    state = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, step, lambda s: s["lo" if rising else "hi"])


def exponent(shares: Column, entropy: float, repeats: float) -> Column:
    """The exponent for an array of positive shares."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def entropy_at(a: Column) -> Column:
        z = total(F.transform(shares, lambda p: F.pow(p, a)))
        return F.log(z) - a * total(F.transform(shares, lambda p: F.pow(p, a) * F.log(p))) / z

    enough = entropy * F.log(F.size(shares).cast("double"))
    spread = F.array_max(shares) / F.array_min(shares)
    by_entropy = F.when(entropy_at(F.lit(1.0)) >= enough, F.lit(1.0)).otherwise(_bisect(lambda a: entropy_at(a) >= enough, True))
    by_repeats = F.when(spread <= repeats, F.lit(0.0)).otherwise(_bisect(lambda a: F.pow(spread, 1 - a) <= repeats, False))
    return F.round(F.greatest(by_entropy, by_repeats), 6)


def source_weights(tokens: DataFrame, *, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """source, total (tokens), weight_ppm, planned (tokens to schedule) from rows of (source, n_tokens).

    The exponent is found from one row with all sources' shares, at most MAX_SOURCES of them.
    """
    totals = tokens.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    row = totals.agg(F.sort_array(F.collect_list(F.struct("total", "source"))).alias("all"))
    row = row.select(F.when(F.size("all") <= MAX_SOURCES, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {MAX_SOURCES} sources"))).alias("all"))
    row = row.withColumn("whole", F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["total"]))
    some = F.filter("all", lambda x: x["total"] > 0)
    row = row.withColumn("shares", F.transform(some, lambda x: x["total"] / F.nullif(F.col("whole"), F.lit(0))))
    row = row.withColumn("a", F.when(F.size("shares") > 0, exponent(F.col("shares"), entropy, repeats)))
    row = row.withColumn("z", F.aggregate(F.transform("shares", lambda p: F.pow(p, F.col("a"))), F.lit(0.0), lambda s, x: s + x))
    row = row.withColumn("largest", F.array_max("shares"))
    out = row.select("a", "z", "whole", "largest", F.inline("all"))
    share = F.col("total") / F.nullif(F.col("whole"), F.lit(0))
    ratio = F.round(F.pow(F.col("largest") / share, 1 - F.col("a")) * UNIT).cast("long")
    weight = F.pow(share, F.col("a")) / F.col("z")
    planned = F.expr(f"total * ratio div {UNIT}") if budget is None else F.floor(F.col("weight_ppm") * F.lit(budget) / 1e6).cast("long")
    has = F.col("total") > 0
    out = out.withColumn("ratio", F.when(has, ratio).otherwise(UNIT)).withColumn("weight_ppm", F.when(has, F.round(weight * 1e6).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("planned", planned.cast("long")).select("source", "total", "weight_ppm", "planned")


def mix_sources(
    df: DataFrame, *, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, blocks: int = BLOCKS, seed: int = 0, id: str = "doc_id", source: str = "source", text: str = "text", by_text: bool = False
) -> DataFrame:
    """doc_id, source, n_tokens, weight_ppm (of the source), copies and blocks (comma-joined, ascending).

    With the default budget every document has a copy; with a smaller one, copies of 0 have no row. ``by_text``: rows of one
    id and different texts are different documents, told apart by the columns ``text_marks`` that the result then has.
    """
    marks = [c.alias(n) for n, c in text_marks(text).items()] if by_text else []
    row = ["doc_id", "source", *(text_marks(text) if by_text else ())]
    rows = written(df.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), token_count(text).alias("n_tokens"), *marks))
    weights = source_weights(rows, entropy=entropy, repeats=repeats, budget=budget)
    # as many rows as sources; a join that AQE may split or, if it proves small, broadcast
    plan = rows.join(weights, rows.source.eqNullSafe(weights.source)).drop(weights.source)
    epochs = F.when(F.col("total") > 0, F.expr("(planned + total - 1) div total")).otherwise(F.lit(1)).cast("int")
    copies = plan.withColumn("epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0), epochs - 1)).otherwise(F.array().cast("array<int>"))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    copies = copies.withColumn("key", key).withColumn("shard", F.substring("key", 1, SHARD_DIGITS))

    sums = copies.groupBy("source", "epoch", "shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = Window.partitionBy("source", "epoch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "epoch", "shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("shard_at"))
    within = Window.partitionBy("source", "epoch", "shard").orderBy("key", "doc_id", *row[2:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("in_shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = placed.alias("c").join(offsets.alias("o"), F.expr("c.source <=> o.source and c.epoch = o.epoch and c.shard = o.shard"))
    placed = placed.select("c.*", "o.shard_at").withColumn("at", F.expr("epoch * total + shard_at + in_shard"))
    # a document without tokens spends nothing, so one that follows the last token still has its place
    placed = placed.filter("total = 0 or at < planned or (n_tokens = 0 and at = planned)")
    block = F.expr(f"cast(least(floor(cast(at as decimal(38,0)) * {blocks} / planned), {blocks} - 1) as int)")
    placed = placed.withColumn("block", F.when(F.col("total") > 0, block).otherwise(F.lit(0)))
    out = placed.groupBy(*row).agg(F.max("n_tokens").alias("n_tokens"), F.max("weight_ppm").alias("weight_ppm"), F.count("*").alias("copies"), F.sort_array(F.collect_list("block")).alias("blocks"))
    return out.withColumn("blocks", F.array_join(F.transform("blocks", lambda b: b.cast("string")), ","))
