"""The comparison strategies. Each yields its differences as a frame (key, left, right, status) and shards.

All of them read filtered sides, so a condition or window holds for every step. Hashed rows that several steps
of a strategy read are persisted (spilling to disk) until the end; small results in between are checkpointed.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions.canonical import identifier
from twinlake.functions.hashing import half, hash_slice, sum_modulo
from twinlake.operators import checksum, joins, sketch, tree
from twinlake.operators.filters import in_buckets
from twinlake.operators.lineage import settled
from twinlake.plans.checkpoints import Checkpoint, fingerprint
from twinlake.plans.options import DiffOptions
from twinlake.plans.report import Shard
from twinlake.plans.tableplan import TablePlan, is_integer

MAX_BUCKETS = 1024
#: The most buckets of bucketdiff; fewer than the rows call for only prune less.
MOST_CONTENT_BUCKETS = 1 << 20
#: Keys of differences that are broadcast to fetch their rows: at most so many, of so many bytes.
FEW_KEYS, FEW_BYTES = 50_000, 4 << 20
#: The sketch of ibltdiff is sized by an estimate; beyond so many differences the comparison is made by hashdiff.
SKETCH_LIMIT = 1 << 17


class SketchOverflow(RuntimeError):
    """More differences than the sketch's capacity."""


class RepeatedKeys(RuntimeError):
    """Keys that a comparison by key met more than once on a side."""


@dataclass
class Outcome:
    diffs: DataFrame
    shards: list[Shard] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    queries: int = 0
    durations: list[float] = field(default_factory=list)
    totals: tuple[int, int] | None = None
    held: list[DataFrame] = field(default_factory=list)


def _few(keys: DataFrame) -> bool:
    """Whether keys (key, ...) are few enough to be sent to all tasks."""
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json("key"))), F.lit(0))).first()
    return n <= FEW_KEYS and size <= FEW_BYTES


@dataclass
class Sides:
    """Both filtered frames with their plans."""

    left: DataFrame
    right: DataFrame
    lplan: TablePlan
    rplan: TablePlan

    @property
    def spark(self) -> SparkSession:
        return self.left.sparkSession

    def counts(self) -> tuple[int, int]:
        """Both row counts, from one job."""
        rows = self.left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(self.right.select(F.lit(0).alias("l"), F.lit(1).alias("r")))
        got = rows.agg(F.coalesce(F.sum("l"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
        return int(got[0]), int(got[1])

    def contents(self, diffs: DataFrame) -> DataFrame:
        """Rows of differences that are settled: few enough keys are sent to all tasks, others are joined by exchange."""
        return joins.with_contents(diffs, self.left, self.right, self.lplan, self.rplan, few=_few(diffs))

    def all_contents(self, diffs: DataFrame) -> DataFrame:
        """Differences that are settled, each with every row of its key."""
        return joins.with_all_contents(diffs, self.left, self.right, self.lplan, self.rplan, few=_few(diffs))

    def pairs(self, keys: DataFrame) -> DataFrame:
        """The pairs of rows that differ, of keys that are settled."""
        return joins.pairs(keys, self.left, self.right, self.lplan, self.rplan, few=_few(keys))

    def no_diffs(self) -> DataFrame:
        return self.contents(joins.keyed_differences(self.left.limit(0), self.right.limit(0), self.lplan, self.rplan))


def _differing_keys(sides: Sides, options: DiffOptions) -> DataFrame:
    """(key, status), from one exchange of keys and hashes, in which keys are counted too."""
    states = joins.keyed_states(sides.left, sides.right, sides.lplan, sides.rplan)
    if options.trust_keys:
        return settled(states.filter("status is not null").select("key", "status"))
    found = settled(states.filter("status is not null or left_n > 1 or right_n > 1"))
    if not found.filter("left_n > 1 or right_n > 1").isEmpty():
        raise RepeatedKeys("duplicate keys")
    return found.select("key", "status")


def _differences(sides: Sides, options: DiffOptions) -> DataFrame:
    """(key, left, right, status): keys by one exchange, their rows by a second, small join."""
    if options.pairs:
        return sides.pairs(settled(joins.unequal_keys(sides.left, sides.right, sides.lplan, sides.rplan)))
    return sides.contents(_differing_keys(sides, options))


def joindiff(sides: Sides, options: DiffOptions) -> Outcome:
    """One exchange of keys and hashes; rows of differences by a second, small join."""
    return Outcome(_differences(sides, options), queries=2)


def _unlike(sides: Sides, options: DiffOptions) -> DataFrame | None:
    """(key) of keys that the left side holds with several contents, if keys may repeat and there are any.

    Where both sides hold them alike, their sums are equal, yet each content differs from the other side's others. Any other
    key with pairs that differ has unequal sums.
    """
    if not options.pairs:
        return None
    keys = settled(joins.keys_of_several_contents(sides.left, sides.lplan))
    return None if keys.isEmpty() else keys


def bucket_count(rows: int, threshold: int) -> int:
    return max(1, min(MAX_BUCKETS, -(-rows // threshold)))


def bucketdiff(sides: Sides, options: DiffOptions) -> Outcome:
    """Contents as multisets. Each row is hashed once and its hash kept as two halves until the differences are settled; checksums by content bucket, with as many buckets as the rows call for,
    leave only rows of buckets that differ to a count of each content, unless most rows are in such buckets.
    """
    totals = sides.counts()
    started = time.monotonic()
    n = max(1, min(MOST_CONTENT_BUCKETS, -(-max(totals) // options.bisection_threshold)))
    kept = [df.select(p.content_hash().alias("h")).select(*(half(F.col("h"), i).alias(f"h{i}") for i in (0, 1))).persist(StorageLevel.MEMORY_AND_DISK) for df, p in ((sides.left, sides.lplan), (sides.right, sides.rplan))]
    hashed = [rows.withColumn("bkt", F.shiftrightunsigned("h0", 32) % n) for rows in kept]
    differ = settled(checksum.differing(*(checksum.half_sums(rows) for rows in hashed)))
    shards = [Shard(f"bucket-{b}", (b, b + 1), lc, rc, abs(lc - rc), "Diff") for b, lc, rc in differ.orderBy("bkt").limit(MAX_BUCKETS).collect()]
    inside = differ.agg(F.coalesce(F.sum(F.col("left_cnt") + F.col("right_cnt")), F.lit(0))).first()[0]
    if inside * 2 < sum(totals):
        hashed_some = [rows.join(differ.select("bkt"), "bkt", "left_semi") for rows in hashed]  # AQE broadcasts few buckets
    else:
        hashed_some = hashed
    diffs = settled(joins.unequal_halves(*hashed_some))
    for rows in kept:
        rows.unpersist()
    return Outcome(joins.keyless_rows(diffs), shards, queries=4, durations=[1000 * (time.monotonic() - started)], totals=totals)


def keyeddiff(sides: Sides, options: DiffOptions) -> Outcome:
    """Checksums by key-hash bucket, then a full outer join of the buckets that differ.

    Small tables are joined whole; with an empty side every key of the other is a difference.
    """
    totals = sides.counts()
    warnings = []
    if totals[0] != totals[1]:
        warnings.append(f"row counts differ: {totals[0]} and {totals[1]}")
    if totals == (0, 0):
        return Outcome(sides.no_diffs(), warnings=warnings, queries=1, totals=totals)
    if max(totals) <= options.fetch_all_threshold or 0 in totals:
        out = joindiff(sides, options)
        return Outcome(out.diffs, warnings=warnings, queries=3, totals=totals)
    n = bucket_count(max(totals), options.bisection_threshold)
    started = time.monotonic()
    differ = settled(checksum.differing(checksum.batch_checksum(sides.left, sides.lplan, n, by="key"), checksum.batch_checksum(sides.right, sides.rplan, n, by="key")))
    shards = [Shard(f"bucket-{b}", (b, b + 1), lc, rc, abs(lc - rc), "Diff") for b, lc, rc in sorted(differ.collect())]
    ids = differ.select("bkt")
    if (unlike := _unlike(sides, options)) is not None:
        rows = joins.of_keys(sides.left, sides.lplan, unlike, sides.lplan, few=_few(unlike))
        ids = ids.unionByName(rows.select(sides.lplan.key_bucket(n).alias("bkt"))).distinct()
    ids = F.broadcast(settled(ids))  # at most n
    some = [in_buckets(df, p.key_bucket(n), ids).drop("bkt") for df, p in ((sides.left, sides.lplan), (sides.right, sides.rplan))]
    part = Sides(*some, sides.lplan, sides.rplan)
    out = joindiff(part, options)
    return Outcome(out.diffs, shards, warnings, 5, [1000 * (time.monotonic() - started)], totals)


def first_segments(low: int, high: int, n: int) -> tuple[int, int]:
    """(width, number) of equal segments of [low, high)."""
    span = high - low
    width = max(1, -(-span // n))
    return width, -(-span // width)


def segment_checksums(rows: DataFrame, segment) -> DataFrame:
    """(seg, cnt, s1..s4) of hashed rows (k, h) by an expression of k."""
    sums = [sum_modulo(hash_slice(F.col("h"), i)).alias(s) for i, s in enumerate(checksum.SUMS)]
    return rows.groupBy(segment.alias("seg")).agg(F.count("*").alias("cnt"), *sums)


def hashdiff(sides: Sides, options: DiffOptions) -> Outcome:
    """A tree of checksums by key, from one scan a side; rows of leaves that differ are compared by key.

    The leaves hold about ``bisection_threshold`` rows, cut at quantiles of the keys, so skewed keys are no deeper than others.
    Nodes of ``bisection_factor`` children are rolled up from them; the shards of the report are the nodes that
    differ on the lowest level of at most eight nodes a thread. NULL keys are in the first leaves.
    """
    started = time.monotonic()
    leaves = tree.cut(sides.left, sides.right, sides.lplan, sides.rplan, options.bisection_threshold, min(tree.MAX_RANGES, 2 * options.threads))
    sums = settled(tree.leaf_sums(sides.left, sides.right, sides.lplan, sides.rplan, leaves))
    width = 1
    while -(-leaves.number // width) > options.threads * 8:
        width *= options.bisection_factor
    marked = None
    if (unlike := _unlike(sides, options)) is not None:
        keys = [F.col("key").getField(k) for k in sides.lplan.key_names]
        marked = settled(unlike.select(leaves.of(keys).alias("leaf")).distinct())
    also = {r[0] for r in marked.select(F.expr(f"leaf div {width}")).distinct().collect()} if marked is not None else set()  # at most threads * 8
    nodes = sorted(tree.roll_up(sums, width).withColumn("differs", tree.unequal()).collect(), key=lambda r: r["node"])  # at most threads * 8
    durations = [1000 * (time.monotonic() - started)]
    totals = (sum(r["left_cnt"] for r in nodes), sum(r["right_cnt"] for r in nodes))
    shards = []
    for r in nodes:
        if r["differs"] or r["node"] in also:
            a, b = r["node"] * width, min((r["node"] + 1) * width, leaves.number)
            shards.append(Shard(f"leaves-[{a},{b})", (a, b), r["left_cnt"], r["right_cnt"], abs(r["left_cnt"] - r["right_cnt"]), "Diff"))
    if not shards:
        return Outcome(sides.no_diffs(), queries=3, durations=durations, totals=totals)
    open_ = sums.filter(tree.unequal()).select("leaf")
    if marked is not None:
        open_ = settled(open_.unionByName(marked).distinct())

    if not options.pairs and not options.trust_keys:  # where keys repeat often, one leaf tells so before all are compared
        first = sums.filter(tree.unequal()).agg(F.min("leaf")).first()[0]
        parts = [tree.within(df, p, leaves, open_.filter(F.col("leaf") == first), (first, first)) for df, p in ((sides.left, sides.lplan), (sides.right, sides.rplan))]
        if not joins.keyed_states(*parts, sides.lplan, sides.rplan).filter("left_n > 1 or right_n > 1").isEmpty():
            raise RepeatedKeys("duplicate keys")

    def compare(a: int, b: int) -> DataFrame:
        """The differences in leaves a to b - 1."""
        some = open_.filter(f"leaf >= {a} and leaf < {b}")
        parts = [tree.within(df, p, leaves, some, (a, b - 1)) for df, p in ((sides.left, sides.lplan), (sides.right, sides.rplan))]
        return _differences(Sides(*parts, sides.lplan, sides.rplan), options)

    if not options.checkpoint:
        return Outcome(compare(shards[0].key_range[0], shards[-1].key_range[1]), shards, [], 5, durations, totals)
    columns = [c for c in nodes[0].asDict() if c not in ("node", "differs")]
    plan = fingerprint(
        [options.left_source, options.right_source, options.left_name, options.right_name, [[str(r[c]) for c in columns] for r in nodes]],
        [[p.key_names, [(f.name, f.dataType.simpleString()) for f in p.columns], p.scale, p.exact, p.nested_json] for p in (sides.lplan, sides.rplan)],
        [options.where, options.update_column, options.update_since, options.as_of, options.bisection_factor, options.bisection_threshold, width, leaves.points, leaves.parts, options.pairs],
    )
    shared = sides.spark.conf.get("spark.checkpoint.dir", None)
    book = Checkpoint(options.checkpoint, plan, f"{shared}/differences" if shared else None)
    todo = [s for s in shards if not book.completed(s.shard_id)]
    waves = [e["wave"] for s in shards if (e := book.completed(s.shard_id)) and e["wave"]]
    for s in shards:
        s.status = "Diff" if s in todo else "Skipped"
    for at in range(0, len(todo), options.threads):
        some = todo[at : at + options.threads]
        a, b = some[0].key_range[0], some[-1].key_range[1]
        wave = fingerprint(plan, a, b)
        compare(a, b).write.mode("overwrite").parquet(f"{book.diffs_path}/{wave}")
        for s in some:
            book.record(s.shard_id, left=s.left_count, right=s.right_count, wave=wave)
        waves.append(wave)
    book.finish()
    out = sides.no_diffs()
    for wave in dict.fromkeys(waves):
        out = out.unionByName(sides.spark.read.schema(out.schema).parquet(f"{book.diffs_path}/{wave}"))
    return Outcome(out, shards, [], 4 + len(waves), durations, totals)


def _with_null_keys(sides: Sides, diffs: DataFrame, options: DiffOptions) -> DataFrame:
    """diffs and those of the rows with a NULL key; nothing is added where no side can have any."""
    parts = [df.filter(identifier(p.key_names[0]).isNull()) for df, p in ((sides.left, sides.lplan), (sides.right, sides.rplan))]
    if all(p.isEmpty() for p in parts):
        return diffs
    return diffs.unionByName(joindiff(Sides(*parts, sides.lplan, sides.rplan), options).diffs)


def ibltdiff(sides: Sides, options: DiffOptions) -> Outcome:
    """Sketches of a fixed size a side; only their difference reaches the driver.

    The size follows an estimate of the number of differences, from a stack of small sketches, unless
    ``iblt_capacity`` names one. One integer key is read off the cells; other keys are cells of 128-bit hashes, and the join
    that fetches the rows recovers them.
    """
    started = time.monotonic()
    plain = len(sides.lplan.keys) == 1 and all(is_integer(p.keys[0].dataType) for p in (sides.lplan, sides.rplan))
    l, r = sides.left, sides.right
    if plain:  # NULL has no integer
        l, r = (df.filter(identifier(p.key_names[0]).isNotNull()) for df, p in ((l, sides.lplan), (r, sides.rplan)))
    key = sketch.INTEGER if plain else sketch.HASHED
    capacity, decoded, queries = options.iblt_capacity, None, 3
    if capacity is None:  # one scan for a small sketch and the estimate that tells the size of a larger one
        m = sketch.cells_for(sketch.FIRST_CAPACITY)
        cells = sketch.subtract(sketch.strata(l, sides.lplan, key, m), sketch.strata(r, sides.rplan, key, m), key, "stratum").collect()
        decoded = sketch.peel([c for c in cells if c["stratum"] < 0], m, key)
        if not decoded.complete:
            about = sketch.estimated(cells, key)
            if about > SKETCH_LIMIT:
                raise SketchOverflow(f"about {about} differences, more than a sketch may hold ({SKETCH_LIMIT})")
            capacity, queries = 2 * max(about, sketch.FIRST_CAPACITY), 4
    if capacity is not None:
        m = sketch.cells_for(capacity)
        cells = sketch.subtract(sketch.sketch(l, sides.lplan, m, key), sketch.sketch(r, sides.rplan, m, key), key)
        decoded = sketch.peel(cells.collect(), m, key)  # at most 4 * m cells
    if not decoded.complete:
        raise SketchOverflow(f"more differences than a sketch of capacity {capacity} can decode")
    found = sketch.classify(decoded)
    if plain:
        name, kind = sides.lplan.key_names[0], sides.lplan.keys[0].dataType
        rows = sides.spark.createDataFrame(found, T.StructType([T.StructField("k", T.LongType()), T.StructField("status", T.StringType())]))
        rows = rows.select(F.struct(F.col("k").cast(kind).alias(name)).alias("key"), "status")
    else:
        rows = sides.spark.createDataFrame([(*k, status) for k, status in found], "h0 long, h1 long, status string")
        rows = joins.by_key_hash(rows, sides.left, sides.right, sides.lplan, sides.rplan)
    if options.pairs:
        keys = rows.select("key")
        if (unlike := _unlike(Sides(l, r, sides.lplan, sides.rplan), options)) is not None:
            keys = keys.unionByName(unlike)
        diffs = sides.pairs(settled(keys.distinct()))
    else:
        diffs = joins.with_contents(rows, sides.left, sides.right, sides.lplan, sides.rplan, few=len(found) <= FEW_KEYS, counted=True) if plain else rows
        diffs = settled(diffs)
        if not options.trust_keys and not diffs.filter("left_n > 1 or right_n > 1").isEmpty():
            raise RepeatedKeys("duplicate keys")
        diffs = diffs.select("key", "left", "right", "status")
    if plain:
        diffs = _with_null_keys(sides, diffs, options)
    return Outcome(diffs, queries=queries, durations=[1000 * (time.monotonic() - started)], totals=sides.counts())


RUN = {"joindiff": joindiff, "bucketdiff": bucketdiff, "keyeddiff": keyeddiff, "hashdiff": hashdiff, "iblt": ibltdiff}
