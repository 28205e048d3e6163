"""The read-only gateway: statements with a row cap, a timeout and plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from twinlake.gateway import statements
from twinlake.gateway.errors import GatewayError, classify
from twinlake.gateway.render import render
from twinlake.operators.timeouts import JobTimeout, limited

DEFAULT_ROWS, MOST_ROWS = 1000, 10_000
TIMEOUT_ACTIONS = ("cancel", "disconnect")
EXPLAIN_MODES = ("simple", "extended", "codegen", "cost", "formatted")


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    truncated: bool = False

    def render(self, fmt: str = "table") -> str:
        return render(self.columns, self.rows, fmt)


class Gateway:
    """timeout_action: what follows when a statement runs too long. ``cancel``: its jobs end. ``disconnect``: so does the
    session they ran in, with its views and settings; statements are refused until ``connect`` opens a new one."""

    def __init__(self, spark: SparkSession, *, read_only: bool = True, timeout: float | None = 300, timeout_action: str = "cancel"):
        if timeout_action not in TIMEOUT_ACTIONS:
            raise GatewayError("invalid", f"unknown action {timeout_action!r}; one of {', '.join(TIMEOUT_ACTIONS)}")
        self.spark, self.read_only, self.timeout, self.timeout_action, self.connected = spark, read_only, timeout, timeout_action, True

    def connect(self) -> None:
        """A session of its own in the same application, after a disconnect."""
        if not self.connected:
            self.spark, self.connected = self.spark.newSession(), True

    def cap(self, max_rows: int | None) -> int:
        return min(max(max_rows or DEFAULT_ROWS, 1), MOST_ROWS)

    def check(self, sql: str) -> None:
        if not self.connected:
            raise GatewayError("connection", "disconnected after a statement that ran too long")
        if self.read_only and (why := statements.refused(self.spark, sql)):
            raise GatewayError("read_only", why)

    def frame(self, sql: str, args: list | dict | None = None) -> DataFrame:
        """The statement's frame; ``?`` and ``:name`` are bound from args."""
        self.check(sql)
        bare = sql.strip().rstrip(";")
        return self.spark.sql(bare, args=args) if args else self.spark.sql(bare)

    def limited(self, sql: str, max_rows: int | None = None, args: list | dict | None = None) -> DataFrame:
        """At most max_rows + 1 rows, whatever the statement says itself."""
        return self.frame(sql, args).limit(self.cap(max_rows) + 1)

    def execute(self, sql: str, max_rows: int | None = None, args: list | dict | None = None, timeout: float | None = None) -> Result:
        cap = self.cap(max_rows)
        try:
            df = self.limited(sql, max_rows, args)
            rows = self.timed(df.collect, timeout or self.timeout)
        except Exception as e:
            raise classify(e) from e
        return Result(df.columns, [list(r) for r in rows[:cap]], len(rows) > cap)

    def run(self, sql: str) -> None:
        """A statement whose result is not wanted (refused by a read-only gateway unless it only reads)."""
        self.timed(self.frame(sql).write.format("noop").mode("overwrite").save, self.timeout)

    def timed(self, work: Callable, timeout: float | None):
        """work() with a limit on how long each of its jobs may run."""
        try:
            return limited(self.spark, work, timeout)
        except JobTimeout as e:
            self.connected = self.timeout_action != "disconnect"
            raise GatewayError("timeout", str(e)) from e

    def explain(self, sql: str, mode: str = "formatted", *, analyze: bool = False) -> str:
        """The plan; with analyze the statement runs, and the plan that ran is given with what each of its nodes measured:
        rows, bytes and times, shuffles and spills among them, and the sums of these over the plan."""
        if mode not in EXPLAIN_MODES:
            raise GatewayError("invalid", f"unknown mode {mode!r}; one of {', '.join(EXPLAIN_MODES)}")
        if statements.is_explain(sql):
            raise GatewayError("invalid", "give the statement itself, not an EXPLAIN of it")
        df = self.frame(sql)
        execution = df._jdf.queryExecution()
        if not analyze:
            return execution.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        self.timed(lambda: execution.toRdd().count(), self.timeout)  # runs the plan; no row leaves its task
        plan = execution.executedPlan()
        measured = list(_measured(plan))
        lines = [f"{'  ' * depth}{name} {', '.join(_shown(*m) for m in metrics)}".rstrip() for depth, name, metrics in measured]
        return "\n".join([plan.toString(), *lines, *_sums(measured)])

    def interrupt(self) -> None:
        self.spark.interruptAll()


def _measured(node, depth: int = 0):
    """(depth, name, [(key, description, kind, value)]) of each node that ran, through adaptive and query stages."""
    name, found = node.nodeName(), []
    each = node.metrics().iterator()
    while each.hasNext():
        entry = each.next()
        metric = entry._2()
        if metric.value() > 0 or entry._1() == "numOutputRows":
            found.append((entry._1(), metric.name().getOrElse(None) or entry._1(), metric.metricType(), metric.value()))
    yield depth, name, sorted(found, key=lambda m: (m[0] != "numOutputRows", m[0]))
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
    children = node.children()
    for child in inner + [children.apply(i) for i in range(children.size())]:
        yield from _measured(child, depth + 1)


def _shown(key: str, description: str, kind: str, value: int) -> str:
    if key == "numOutputRows":
        return f"{value} rows"
    unit = {"size": " B", "timing": " ms"}.get(kind, "")
    if kind == "nsTiming":
        value, unit = value // 1_000_000, " ms"
    return f"{description}: {value}{unit}"


def _sums(measured) -> list[str]:
    """Sums over all nodes of the shuffles written and the spills; a stage that is read twice is measured once."""
    total = dict.fromkeys(("shuffleRecordsWritten", "shuffleBytesWritten", "spillSize"), 0)
    for _, _, metrics in measured:
        for key, _, _, value in metrics:
            if key in total:
                total[key] += value
    return [f"shuffled: {total['shuffleRecordsWritten']} rows, {total['shuffleBytesWritten']} B; spilled: {total['spillSize']} B"]
