"""A tool server for model context clients: JSON-RPC 2.0 messages as lines on stdin, answers as lines on stdout.

A client opens with ``initialize``, lists the tools with their input schemas and calls them by ``tools/call``; a
call answers with content blocks, and a tool that fails answers with ``isError``. A tool's name is also a
method of its own, which answers with the bare result.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession

from twinlake import __version__
from twinlake.diff import DiffOptions, diff
from twinlake.gateway import catalog
from twinlake.gateway.errors import classify
from twinlake.gateway.gateway import EXPLAIN_MODES, MOST_ROWS, Gateway
from twinlake.gateway.render import jsonable
from twinlake.plans.options import STRATEGIES
from twinlake.sources.registry import Registry


PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
_TEXT, _WHOLE, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
#: What each tool does, its arguments, and those that it needs.
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "database_info": ("Facts about the session", {}, []),
    "list_tables": ("Tables of a database", {"database": _TEXT}, []),
    "describe_table": ("Columns and declared key of a table", {"table": _TEXT, "connection": _TEXT}, ["table"]),
    "execute_query": ("Run a statement that only reads", {"sql": _TEXT, "max_rows": _WHOLE | {"minimum": 1, "maximum": MOST_ROWS}, "args": {"type": "array"}}, ["sql"]),
    "execution_plan": ("The plan of a statement; with analyze it runs", {"sql": _TEXT, "mode": _TEXT | {"enum": list(EXPLAIN_MODES)}, "analyze": _FLAG}, ["sql"]),
    "list_connections": ("Sources and their states", {}, []),
    "delta_diff": (
        "Compare two tables",
        {
            **{n: _TEXT for n in ("left", "right", "table", "left_table", "right_table", "key", "columns", "where", "update_column", "update_since")},
            "strategy": _TEXT | {"enum": list(STRATEGIES)},
            "consistency": _TEXT | {"enum": ["none", "snapshot", "pinned"]},
            **{n: _WHOLE for n in ("bisection_factor", "bisection_threshold", "threads", "sample", "iblt_capacity", "fetch_all_threshold", "decimal_scale")},
            "statement_timeout": {"type": "number"},
            "deadline": {"type": "number"},
            **{n: _FLAG for n in ("recheck", "strict", "exact_hash", "summary_only", "trust_keys")},
        },
        ["left", "right"],
    ),
}


class ToolServer:
    def __init__(self, spark: SparkSession, registry: Registry, *, timeout: float | None = 300):
        self.spark, self.registry, self.gateway = spark, registry, Gateway(spark, timeout=timeout)
        self.tools: dict[str, Callable[..., object]] = {
            "database_info": lambda: self._rows(catalog.database_info(spark)),
            "list_tables": lambda database=None: self._rows(catalog.list_tables(spark, database)),
            "describe_table": self._describe,
            "execute_query": self._query,
            "execution_plan": lambda sql, mode="formatted", analyze=False: self.gateway.explain(sql, mode, analyze=analyze),
            "list_connections": lambda: registry.listing(),
            "delta_diff": self._diff,
        }

    def _rows(self, df) -> list[dict]:
        return [{k: jsonable(v) for k, v in r.asDict().items()} for r in df.collect()]

    def _describe(self, table: str, connection: str | None = None) -> dict:
        source = self.registry.resolve(connection)
        df = self.registry.open(self.spark, source.name, table)
        return {"columns": self._rows(catalog.table_columns(df, source.declared_key(table))), "indexes": self._rows(catalog.table_indexes(self.spark, source, table))}

    def _query(self, sql: str, max_rows: int | None = None, args: list | None = None) -> dict:
        r = self.gateway.execute(sql, max_rows, args)
        return {"columns": r.columns, "rows": [[jsonable(v) for v in row] for row in r.rows], "row_count": len(r.rows), "truncated": r.truncated}

    def _diff(self, left: str, right: str, table: str | None = None, left_table: str | None = None, right_table: str | None = None, **options) -> dict:
        ltable, rtable = left_table or table, right_table or table
        if not ltable or not rtable:
            raise ValueError("a table is needed for each side")
        for name in ("key", "columns"):
            if isinstance(options.get(name), str):
                options[name] = tuple(x.strip() for x in options[name].split(",") if x.strip())
        l, r = self.registry.resolve(left), self.registry.resolve(right)
        chosen = DiffOptions(**options, left_name=f"{left}.{ltable}", right_name=f"{right}.{rtable}", left_source=l.identity, right_source=r.identity)
        key = l.declared_key(ltable) if l.declared_key(ltable) == r.declared_key(rtable) else []
        result = diff(lambda: self.registry.open(self.spark, left, ltable), lambda: self.registry.open(self.spark, right, rtable), chosen, declared_key=key)
        try:
            return json.loads(result.report.to_json())
        finally:
            result.close()

    def listing(self) -> list[dict]:
        return [
            {"name": n, "description": text, "inputSchema": {"type": "object", "properties": given, "required": needed, "additionalProperties": False}}
            for n, (text, given, needed) in sorted(TOOLS.items())
        ]

    def call(self, name: str, arguments: dict) -> dict:
        """The result of a tool as content blocks; an error of the tool is a result too."""
        try:
            value, failed = self.tools[name](**arguments), False
        except Exception as e:
            value, failed = classify(e).as_dict(), True
        text = value if isinstance(value, str) else json.dumps(value, default=str)
        structured = value if isinstance(value, dict) else {"result": value}
        return {"content": [{"type": "text", "text": text}], "structuredContent": structured, "isError": failed}

    def answer(self, request: dict) -> dict | None:
        """The reply to a request; None to a notification."""
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            asked = params.get("protocolVersion")
            version = asked if asked in PROTOCOLS else PROTOCOLS[0]
            return reply | {"result": {"protocolVersion": version, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "twinlake", "version": __version__}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": self.listing()}}
        if method == "tools/call":
            name = params.get("name")
            if name not in self.tools:
                return reply | {"error": {"code": -32602, "message": f"unknown tool {name!r}"}}
            return reply | {"result": self.call(name, params.get("arguments") or {})}
        if method not in self.tools:
            return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}
        try:
            return reply | {"result": self.tools[method](**params)}
        except Exception as e:
            return reply | {"error": {"code": -32000, "message": classify(e).message, "data": classify(e).as_dict()}}

    def serve(self, lines: TextIO | None = None, out: TextIO | None = None) -> None:
        out = out or sys.stdout
        for line in lines or sys.stdin:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except ValueError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if reply is None:
                continue
            out.write(json.dumps(reply, default=str) + "\n")
            out.flush()
