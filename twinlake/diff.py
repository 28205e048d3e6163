"""Comparison of two tables: plan, route, strategy, recheck, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.operators import checksum, joins
from twinlake.operators.filters import apply_filter
from twinlake.operators.lineage import delete, stored
from twinlake.operators.snapshots import Manifest, SnapshotChanged, is_pinned
from twinlake.operators.timeouts import limited
from twinlake.operators.strategies import RUN, Outcome, RepeatedKeys, Sides, SketchOverflow
from twinlake.plans import router
from twinlake.plans.options import DiffOptions
from twinlake.plans.report import MISSING_LEFT, MISSING_RIGHT, MODIFIED, Report, TableRef
from twinlake.plans.tableplan import TablePlan, build_plan, pair_warnings

Reader = Callable[[], DataFrame]


@dataclass
class DiffResult:
    """The report, and all differences as a frame (key, left, right, status, confirmed)."""

    report: Report
    diffs: DataFrame
    _held: list[DataFrame]
    _stored: list[str] = field(default_factory=list)

    def close(self) -> None:
        """Give up what the comparison holds; ``diffs`` of a snapshot cannot be read after it."""
        for df in self._held:
            df.unpersist()
        for path in self._stored:
            delete(self.diffs.sparkSession, path)
        self._stored.clear()


def _reader(side: DataFrame | Reader) -> Reader:
    return side if callable(side) else lambda: side


def plan_sides(left: DataFrame, right: DataFrame, options: DiffOptions, declared: Sequence[str] = ()) -> tuple[TablePlan, TablePlan, list[str]]:
    scale = options.decimal_scale
    wanted = dict(key=options.key, columns=options.columns, declared_key=declared, exact=options.exact_hash, nested_json=options.nested_json)
    plans = [build_plan(df, scale=scale, **wanted) for df in (left, right)]
    if scale is None:  # decimals of different scale are compared at the larger one
        kinds = [{f.name.lower(): f.dataType.scale for f in p.columns if isinstance(f.dataType, T.DecimalType)} for p in plans]
        if any(kinds[0][c] != kinds[1][c] for c in kinds[0].keys() & kinds[1].keys()):
            largest = max(s for k in kinds for s in k.values())
            plans = [build_plan(df, scale=largest, **wanted) for df in (left, right)]
    return plans[0], plans[1], [f"left: {w}" for w in plans[0].warnings] + [f"right: {w}" for w in plans[1].warnings] + pair_warnings(*plans)


def recheck(diffs: DataFrame, sides: Sides) -> DataFrame:
    """diffs with ``confirmed``: whether a fresh read of both sides still shows a difference of the key, of any type.

    Rows are told apart as when differences are found; a key that repeats is equal if no row of it differs from one of the other side.
    """
    keys = diffs.select("key").distinct()
    some = (joins.of_keys(df, p, keys, sides.lplan) for df, p in ((sides.left, sides.lplan), (sides.right, sides.rplan)))
    still = joins.unequal_keys(*some, sides.lplan, sides.rplan).select(F.col("key").alias("still"))
    same = F.lit(True)
    for k in sides.lplan.key_names:
        same = same & F.col("key").getField(k).eqNullSafe(F.col("still").getField(k))
    return diffs.join(still, same, "left").withColumn("confirmed", F.col("still").isNotNull()).drop("still")


def diff(left: DataFrame | Reader, right: DataFrame | Reader, options: DiffOptions | None = None, *, declared_key: Sequence[str] = ()) -> DiffResult:
    """Compare two tables, given as frames or as functions that read them (then rechecks read afresh).

    consistency ``snapshot``: both sides are read once, into tables of the shared folder, and every step sees that
    state; differences are then confirmed on a fresh read. Unless ``trust_keys`` says that the source enforces them, keys are
    counted where a strategy looks at them anyhow: all of them by joindiff, those of differing buckets or leaves
    by keyeddiff and hashdiff, those that differ by iblt (rows repeated alike on both sides are no difference). Where one
    repeats, contents are compared as multisets.
    consistency ``pinned``: a side that is read from files keeps the list of them for every step and is not copied; were
    they rewritten or removed meanwhile, SnapshotChanged is raised. A side without such a list is copied.
    ``statement_timeout`` is a limit on each job of the comparison, ``deadline`` on all of them together.
    """
    options = options or DiffOptions()
    spark = SparkSession.active()
    return limited(spark, lambda: _diff(left, right, options, declared_key), options.statement_timeout, "comparison", deadline=options.deadline)


def _diff(left: DataFrame | Reader, right: DataFrame | Reader, options: DiffOptions, declared_key: Sequence[str]) -> DiffResult:
    read_left, read_right = _reader(left), _reader(right)
    started = datetime.now(timezone.utc)
    lraw, rraw = read_left(), read_right()
    lplan, rplan, warnings = plan_sides(lraw, rraw, options, declared_key)
    same = options.left_source is not None and options.left_source == options.right_source or options.left_source is None and options.right_source is None
    route = router.choose(lplan, rplan, same_source=same, wish=options.strategy, any_key=options.any_key)
    sides = Sides(apply_filter(lraw, options), apply_filter(rraw, options), lplan, rplan)
    held: list[DataFrame] = []
    paths: list[str] = []
    if options.consistency == "snapshot":
        (sides.left, a), (sides.right, b) = stored(sides.left), stored(sides.right)
        paths += [a, b]
    manifests: list[Manifest] = []
    if options.consistency == "pinned":
        for name, raw in (("left", lraw), ("right", rraw)):
            if is_pinned(raw):
                manifests.append(Manifest.of(name, raw))
                paths.append(manifests[-1].path)
            else:
                copy, path = stored(getattr(sides, name))
                setattr(sides, name, copy)
                paths.append(path)
    try:
        result = _compare(sides, read_left, read_right, route, options, started, warnings, held, paths)
        for manifest in manifests:
            manifest.check()
        return result
    except Exception as e:
        try:
            if not isinstance(e, SnapshotChanged):  # a step may have failed because a file is no longer what it was
                for manifest in manifests:
                    manifest.check()
            raise
        finally:
            for path in paths:
                delete(sides.spark, path)


def _compare(sides: Sides, read_left: Reader, read_right: Reader, route: router.Route, options: DiffOptions, started: datetime, warnings: list[str], held: list[DataFrame], paths: list[str]) -> DiffResult:
    lplan, rplan = sides.lplan, sides.rplan
    warnings += route.warnings
    strategy = route.strategy
    try:
        try:
            outcome = RUN[strategy](sides, options)
        except SketchOverflow as e:
            if options.strict:
                raise
            warnings.append(f"{e}; falling back to hashdiff")
            strategy = "hashdiff"
            outcome = RUN[strategy](sides, options)
    except RepeatedKeys as e:
        warnings.append(f"{e}; strategy '{strategy}' needs unique keys: falling back to bucketdiff")
        strategy = "bucketdiff"
        outcome = RUN[strategy](sides, options)
    diffs = outcome.diffs
    if options.rechecks and strategy != "bucketdiff":
        fresh = Sides(apply_filter(read_left(), options), apply_filter(read_right(), options), lplan, rplan)
        diffs = recheck(diffs, fresh)
    else:
        diffs = diffs.withColumn("confirmed", F.lit(True))
    diffs = diffs.persist(StorageLevel.MEMORY_AND_DISK)
    held += [diffs, *outcome.held]
    return DiffResult(_report(sides, outcome, diffs, strategy, options, started, warnings), diffs, held, paths)


def _report(sides: Sides, outcome: Outcome, diffs: DataFrame, strategy: str, options: DiffOptions, started: datetime, warnings: list[str]) -> Report:
    report = Report(TableRef(options.left_name, options.left_name), TableRef(options.right_name, options.right_name), strategy, options.consistency, started_at=started)
    counts = {r.status: r.n for r in diffs.filter("confirmed").groupBy("status").agg(F.count("*").alias("n")).collect()}
    s = report.summary
    s.missing_left, s.missing_right, s.modified = (counts.get(k, 0) for k in (MISSING_LEFT, MISSING_RIGHT, MODIFIED))
    s.left_total, s.right_total = outcome.totals or sides.counts()
    report.shards, report.perf.durations_ms = outcome.shards, outcome.durations
    report.perf.queries_total = outcome.queries + 2
    if not options.summary_only and options.sample:
        rows = diffs.orderBy("key", "status").limit(options.sample).collect()
        report.sample_diffs = [
            {"key": k[0] if len(k := list(r.key)) == 1 else k, "status": r.status, "left": list(r.left) if r.left else None, "right": list(r.right) if r.right else None, "confirmed": r.confirmed}
            for r in rows
        ]
    report.warnings = warnings + outcome.warnings
    report.finished_at = datetime.now(timezone.utc)
    return report


def dry_run(left: DataFrame, right: DataFrame, options: DiffOptions | None = None, *, declared_key: Sequence[str] = ()) -> dict:
    """What a comparison would do: strategy, keys, columns, key range, segments; nothing is compared."""
    options = options or DiffOptions()
    lplan, rplan, warnings = plan_sides(left, right, options, declared_key)
    same = options.left_source == options.right_source
    route = router.choose(lplan, rplan, same_source=same, wish=options.strategy, any_key=options.any_key)
    domain = None
    if router.why_not_bisectable(lplan, rplan) is None:
        rows = checksum.key_domain(apply_filter(left, options), lplan).unionByName(checksum.key_domain(apply_filter(right, options), rplan))
        domain = tuple(rows.agg(F.min("lo"), F.max("hi")).first())
    segments = options.threads * 8 if route.strategy in ("hashdiff", "iblt", "joindiff") and domain else None
    joined = joins.keyed_differences(apply_filter(left, options), apply_filter(right, options), lplan, rplan) if lplan.keys and rplan.keys else None
    return {
        "left": options.left_name,
        "right": options.right_name,
        "strategy": route.strategy,
        "key": route.keys,
        "columns": [f.name for f in lplan.columns],
        "key_domain": domain,
        "first_segments": segments,
        "estimated_queries": 2 * segments if segments else None,
        "consistency": options.consistency,
        "recheck": options.rechecks,
        "statement_timeout": options.statement_timeout,
        "threads": options.threads,
        "warnings": warnings + route.warnings,
        "plan": joined._jdf.queryExecution().explainString(joined.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if joined is not None else None,
    }


def total_rows(df: DataFrame, options: DiffOptions | None = None) -> int:
    return apply_filter(df, options or DiffOptions()).count()


__all__ = ["DiffOptions", "DiffResult", "diff", "dry_run", "recheck", "total_rows"]
