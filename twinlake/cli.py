"""Command line: ``sql``, ``repl``, ``diff``, ``check``, ``connections`` and ``serve``."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime
from logging.handlers import RotatingFileHandler
from pathlib import Path

from pyspark.sql import SparkSession

from twinlake.diff import DiffOptions, diff, dry_run
from twinlake.gateway.errors import classify
from twinlake.gateway.gateway import Gateway
from twinlake.gateway.render import FORMATS, render, render_report
from twinlake.gateway.repl import Repl
from twinlake.gateway.server import ToolServer
from twinlake.gateway.statements import split_statements
from twinlake.plans.options import STRATEGIES
from twinlake.plans.report import FAILED
from twinlake.sources.registry import Registry, from_environment, load_config, seconds

log = logging.getLogger("twinlake")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinlake", description=__doc__)
    p.add_argument("--config", help="TOML file of sources (default: one source from TWINLAKE_SOURCE)")
    p.add_argument("--log-file")
    sub = p.add_subparsers(dest="command", required=True)

    q = sub.add_parser("sql", help="run statements from the arguments, a file or stdin")
    q.add_argument("sql", nargs="?")
    q.add_argument("--file")
    q.add_argument("--register", nargs="*", default=[], metavar="SOURCE.TABLE", help="tables to open as views")
    q.add_argument("--format", choices=FORMATS, default="table")
    q.add_argument("--max-rows", type=int)
    q.add_argument("--timeout", type=seconds, default=300.0)
    q.add_argument("--write", action="store_true", help="allow statements that do not only read")

    r = sub.add_parser("repl")
    r.add_argument("--register", nargs="*", default=[])
    r.add_argument("--format", choices=FORMATS, default="table")

    d = sub.add_parser("diff", help="compare two tables; exit code 0 identical, 1 different, 2 failed")
    d.add_argument("--left", required=True)
    d.add_argument("--right", required=True)
    for name in ("table", "left-table", "right-table", "key", "columns", "where", "update-column", "update-since", "as-of", "checkpoint", "output"):
        d.add_argument(f"--{name}")
    d.add_argument("--strategy", choices=STRATEGIES, default="auto")
    d.add_argument("--bisection-factor", type=int, default=32)
    d.add_argument("--bisection-threshold", type=int, default=16384)
    d.add_argument("--threads", type=int, default=4)
    d.add_argument("--sample", type=int, default=1000)
    d.add_argument("--iblt-capacity", type=int, default=65536)
    d.add_argument("--fetch-all-threshold", type=int, default=4096)
    d.add_argument("--decimal-scale", type=int)
    d.add_argument("--statement-timeout", type=seconds, default=300.0)
    d.add_argument("--deadline", type=seconds, help="limit on the whole comparison")
    d.add_argument("--consistency", choices=("snapshot", "pinned", "none"), default="snapshot")
    d.add_argument("--format", choices=FORMATS, default="table")
    for name in ("recheck", "strict", "summary-only", "dry-run", "exact-hash", "trust-keys"):
        d.add_argument(f"--{name}", action="store_true")

    c = sub.add_parser("check", help="read one row of a table")
    c.add_argument("source")
    c.add_argument("table")
    sub.add_parser("connections", help="list sources")
    sub.add_parser("serve", help="answer tool calls on stdin")
    return p


def _names(text: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


def diff_options(args: argparse.Namespace, registry: Registry) -> DiffOptions:
    same = ("where", "update_column", "update_since", "strategy", "bisection_factor", "bisection_threshold", "threads", "sample", "recheck", "consistency", "checkpoint")
    same += ("iblt_capacity", "strict", "fetch_all_threshold", "statement_timeout", "deadline", "decimal_scale", "exact_hash", "summary_only", "trust_keys")
    ltable, rtable = args.left_table or args.table, args.right_table or args.table
    if args.table and (args.left_table or args.right_table):
        raise ValueError("--table excludes --left-table and --right-table")
    if not ltable or not rtable:
        raise ValueError("missing table: give --table, or --left-table and --right-table")
    return DiffOptions(
        key=_names(args.key),
        columns=_names(args.columns),
        as_of=datetime.fromisoformat(args.as_of) if args.as_of else None,
        left_name=f"{args.left}.{ltable}",
        right_name=f"{args.right}.{rtable}",
        left_source=registry.resolve(args.left).identity,
        right_source=registry.resolve(args.right).identity,
        **{k: getattr(args, k) for k in same},
    )


def _diff(spark: SparkSession, registry: Registry, args: argparse.Namespace) -> int:
    options = diff_options(args, registry)
    ltable, rtable = args.left_table or args.table, args.right_table or args.table
    keys = [registry.resolve(n).declared_key(t) for n, t in ((args.left, ltable), (args.right, rtable))]
    declared = keys[0] if keys[0] == keys[1] else []
    left, right = (lambda n=n, t=t: registry.open(spark, n, t) for n, t in ((args.left, ltable), (args.right, rtable)))
    if args.dry_run:
        plan = dry_run(left(), right(), options, declared_key=declared)
        text, code = render(list(plan), [list(plan.values())], "vertical"), 0
    else:
        result = diff(left, right, options, declared_key=declared)
        text, code = render_report(result.report, args.format, summary_only=args.summary_only), result.report.exit_code
        result.close()
    if args.output:
        Path(args.output).write_text(text)
    else:
        print(text, end="")
    return code


def _register(spark: SparkSession, registry: Registry, names: list[str]) -> None:
    for name in names:
        source, _, table = name.rpartition(".")
        registry.open(spark, source or None, table).createOrReplaceTempView(table)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.log_file:
        log.addHandler(RotatingFileHandler(args.log_file, maxBytes=10 << 20, backupCount=5))
        log.setLevel(logging.INFO)
    try:
        registry = load_config(args.config) if args.config else from_environment()
        if args.command == "connections":
            listing = registry.listing()
            print(render(["name", "kind", "location", "status"], [[x[k] for k in ("name", "kind", "location", "status")] for x in listing]), end="")
            return 0
        spark = spark or SparkSession.builder.appName("twinlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.command == "diff":
            return _diff(spark, registry, args)
        if args.command == "check":
            ok = registry.check(spark, args.source, args.table)
            print("ok" if ok else f"unavailable: {registry.errors.get(args.source)}")
            return 0 if ok else FAILED
        if args.command == "serve":
            ToolServer(spark, registry).serve()
            return 0
        _register(spark, registry, args.register)
        if args.command == "repl":

            def connect(name: str | None) -> str:
                return f"{registry.resolve(name).name}: {registry.states[registry.resolve(name).name]}"

            Repl(Gateway(spark, read_only=False), connect=connect, fmt=args.format).loop(sys.stdin)
            return 0
        text = args.sql or (Path(args.file).read_text() if args.file else sys.stdin.read())
        gateway = Gateway(spark, read_only=not args.write, timeout=args.timeout)
        for sql in split_statements(text):
            print(gateway.execute(sql, args.max_rows).render(args.format), end="")
        return 0
    except Exception as e:
        log.exception("failed")
        print(f"error: {classify(e).message}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
