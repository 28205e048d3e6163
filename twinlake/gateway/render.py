"""Results as text: boxes, JSON, one line a value, CSV."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Row

FORMATS = ("table", "json", "vertical", "csv")


def jsonable(value):
    """A cell as a JSON value: decimals and times as text, binary as 0x hex."""
    if isinstance(value, (bytes, bytearray)):
        return "0x" + bytes(value).hex()
    if isinstance(value, Row):
        return {k: jsonable(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    if isinstance(value, (Decimal, date, datetime)) or not isinstance(value, (str, int, float, bool, type(None))):
        return str(value)
    return value


def cell(value) -> str:
    value = jsonable(value)
    if value is None:
        return "NULL"
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def collected(df: DataFrame) -> tuple[list[str], list[list]]:
    """Columns and rows; an empty result keeps its columns."""
    return df.columns, [list(r) for r in df.collect()]


def _count(n: int) -> str:
    return "(1 row)" if n == 1 else f"({n} rows)"


def _boxes(columns: Sequence[str], rows: list[list[str]]) -> str:
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(columns)]

    def rule(left: str, mid: str, right: str) -> str:
        return left + mid.join("─" * (w + 2) for w in widths) + right

    def line(cells: Sequence[str]) -> str:
        return "│ " + " │ ".join(c.ljust(w) for c, w in zip(cells, widths)) + " │"

    return "\n".join([rule("┌", "┬", "┐"), line(columns), rule("├", "┼", "┤"), *map(line, rows), rule("└", "┴", "┘")])


def render(columns: Sequence[str], rows: Sequence[Sequence], fmt: str = "table") -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    if not columns:
        return "(0 rows)\n"
    if fmt == "json":
        return json.dumps({"columns": list(columns), "rows": [[jsonable(v) for v in r] for r in rows], "row_count": len(rows)}, indent=2, ensure_ascii=False) + "\n"
    texts = [[cell(v) for v in r] for r in rows]
    if fmt == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([list(columns), *texts])
        return out.getvalue()
    if fmt == "vertical":
        lines = [x for n, r in enumerate(texts, 1) for x in (f"-[ RECORD {n} ]-", *(f"{c} | {v}" for c, v in zip(columns, r)))]
        return "\n".join([*lines, _count(len(rows))]) + "\n"
    return f"{_boxes(columns, texts)}\n\n{_count(len(rows))}\n"


def render_report(report, fmt: str = "table", *, summary_only: bool = False) -> str:
    if fmt == "json":
        return report.to_json() + "\n"
    out = render(*report.summary_rows(), fmt)
    if report.warnings:
        out += f"warnings: {'; '.join(report.warnings)}\n"
    if report.sample_diffs and not summary_only:
        out += "\nsample diffs:\n" + render(*report.sample_rows(), fmt)
    return out
