"""Sources by name: Parquet, ORC, CSV, JSON, catalog tables and JDBC, each read lazily.

A descriptor may list alternatives, tried in order until one can be opened. Passwords are never shown.
"""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from twinlake.plans.tableplan import find_column, is_integer

_SECRET = re.compile(r"(://[^:/@\s]+:)[^@\s]+(@)")
_DURATION = re.compile(r"(\d+(?:\.\d+)?)\s*(ms|s|m|h)?$")
_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, None: 1.0}
JDBC_DRIVERS = {"mysql": "com.mysql.cj.jdbc.Driver", "oracle": "oracle.jdbc.OracleDriver", "postgresql": "org.postgresql.Driver", "gaussdb": "org.postgresql.Driver", "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
PENDING, CONNECTING, CONNECTED, UNAVAILABLE = "pending", "connecting", "connected", "unavailable"


def redact(text: str) -> str:
    """text without the passwords of urls in it."""
    return _SECRET.sub(r"\1***\2", text)


def seconds(text: str | float | int) -> float:
    """A duration such as 30, ``500ms``, ``30s``, ``5m`` or ``1h``."""
    if isinstance(text, (int, float)):
        return float(text)
    if not (m := _DURATION.match(text.strip())):
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * _UNITS[m[2]]


@dataclass(frozen=True)
class Source:
    """kind: parquet, orc, csv, json, table or jdbc; location: path (``{table}`` is filled in), prefix or url."""

    name: str
    kind: str
    location: str = ""
    options: dict = field(default_factory=dict)
    keys: dict = field(default_factory=dict)
    timeout: float | None = None
    fallbacks: tuple[Source, ...] = ()

    def declared_key(self, table: str) -> list[str]:
        return list(self.keys.get(table, ()))

    @property
    def identity(self) -> str:
        """Equal for descriptors of the same place."""
        return f"{self.kind}:{self.location}"


def _path(source: Source, table: str) -> str:
    return source.location.replace("{table}", table) if "{table}" in source.location else f"{source.location.rstrip('/')}/{table}.{source.kind}"


def _files(spark: SparkSession, source: Source, table: str) -> DataFrame:
    return spark.read.format(source.kind).options(**source.options).load(_path(source, table))


def _table(spark: SparkSession, source: Source, table: str) -> DataFrame:
    return spark.read.table(f"{source.location}.{table}" if source.location else table)


def jdbc_options(source: Source, table: str) -> dict:
    """Read options: read-only, with a statement timeout; partitioned if the source says by which column."""
    scheme = source.location.removeprefix("jdbc:").split(":", 1)[0]
    url = source.location if source.location.startswith("jdbc:") else f"jdbc:{source.location}"
    out = {"url": url.replace("jdbc:gaussdb:", "jdbc:postgresql:"), "dbtable": table, "fetchsize": "8192", "pushDownPredicate": "true"}
    if driver := JDBC_DRIVERS.get(scheme):
        out["driver"] = driver
    if source.timeout:
        out["queryTimeout"] = str(max(1, int(source.timeout)))
    return out | source.options


def sql_literal(value, scheme: str) -> str:
    """A key's value as the database reads it."""
    if isinstance(value, str):
        quoted = value.replace("'", "''")
        return "'" + (quoted.replace("\\", "\\\\") if scheme == "mysql" else quoted) + "'"
    return f"{{d '{value}'}}" if isinstance(value, date) else str(value)


def range_predicates(names: Sequence[str], points: Sequence[Sequence[str]]) -> list[str]:
    """Conditions that put each row in one range of the key's order; points: ascending keys as literals.

    Rows with a NULL in the key are in the first range.
    """

    def reached(point) -> str:
        out = f"{names[-1]} >= {point[-1]}"
        for name, value in list(zip(names, point))[-2::-1]:
            out = f"{name} > {value} or ({name} = {value} and ({out}))"
        return f"({out})"

    whole = " and ".join(f"{n} is not null" for n in names)
    null = " or ".join(f"{n} is null" for n in names)
    marks = [reached(p) for p in points]
    inner = [f"{whole} and {a} and not {b}" for a, b in zip(marks, marks[1:])]
    return [f"{null} or not {marks[0]}", *inner, f"{whole} and {marks[-1]}"]


def _quantiles(read: Callable[[str], DataFrame], table: str, names: Sequence[str], n: int, scheme: str) -> list[list[str]]:
    """At most n - 1 distinct keys, by the database's own order, that cut the table's rows into equal parts."""
    columns, given = ", ".join(names), " and ".join(f"{k} is not null" for k in names)
    rows = int(read(f"(select count(*) as n from {table} where {given}) counted").first()[0])
    if rows < 2:
        return []
    # the embedded database numbers rows without an order of their own
    ordered = f"(select {columns} from {table} where {given} order by {columns}) o" if scheme == "derby" else f"{table} where {given}"
    numbered = f"select {columns}, row_number() over ({'' if scheme == 'derby' else f'order by {columns}'}) as place from {ordered}"
    cuts = read(f"(select {columns}, place from ({numbered}) r where mod(place - 1, {-(-rows // n)}) = 0) cuts")
    found = sorted(map(tuple, cuts.collect()), key=lambda r: int(r[-1]))  # n rows, the least key first
    return [list(p) for p in dict.fromkeys(tuple(sql_literal(v, scheme) for v in r[:-1]) for r in found)][1:]


def _jdbc(spark: SparkSession, source: Source, table: str) -> DataFrame:
    """By one connection, or by ``partitions`` of them over ranges of the declared key with equal numbers of rows.

    The ranges are cut at quantiles that the database finds in its own order, so skewed, string and composite keys are
    balanced too. A key's value that repeats stays in one range.
    """
    options = jdbc_options(source, table)
    n, key = int(options.pop("partitions", 1)), source.declared_key(table)

    def read(what: str) -> DataFrame:
        return spark.read.format("jdbc").options(**options | {"dbtable": what}).load()

    df = read(table)
    if n < 2 or not key or "partitionColumn" in options:
        return df
    fields = [find_column(df.schema, k) for k in key]
    if not all(is_integer(f.dataType) or isinstance(f.dataType, (T.StringType, T.DecimalType, T.DateType)) for f in fields):
        return df
    scheme = options["url"].split(":", 2)[1]
    names = [f.name for f in fields]
    points = _quantiles(read, table, names, n, scheme)
    if not points:
        return df
    more = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.options(**more).jdbc(options["url"], table, predicates=range_predicates(names, points))


READERS: dict[str, Callable[[SparkSession, Source, str], DataFrame]] = {"parquet": _files, "orc": _files, "csv": _files, "json": _files, "table": _table, "jdbc": _jdbc}


class Registry:
    """Sources by name with their states; opening is lazy."""

    def __init__(self, sources: Sequence[Source] = ()):
        self.sources = {s.name: s for s in sources}
        self.states = {s.name: PENDING for s in sources}
        self.errors: dict[str, str] = {}

    def add(self, source: Source) -> None:
        if source.kind not in READERS:
            raise ValueError(f"unknown kind {source.kind!r}; one of {', '.join(READERS)}")
        self.sources[source.name], self.states[source.name] = source, PENDING

    def resolve(self, name: str | None = None) -> Source:
        """By name; the only source if no name is given."""
        if name is None and len(self.sources) == 1:
            return next(iter(self.sources.values()))
        if name not in self.sources:
            raise KeyError(f"source {name!r} not found; available: {', '.join(sorted(self.sources))}")
        return self.sources[name]

    def open(self, spark: SparkSession, name: str | None, table: str) -> DataFrame:
        """The table's frame, from the first of the source's alternatives that opens."""
        source = self.resolve(name)
        self.states[source.name] = CONNECTING
        problems = []
        for choice in (source, *source.fallbacks):
            try:
                df = READERS[choice.kind](spark, choice, table)
                df.schema  # noqa: B018  resolves the table
            except Exception as e:
                problems.append(f"{choice.kind}: {redact(str(e)).splitlines()[0] if str(e) else type(e).__name__}")
                continue
            self.states[source.name] = CONNECTED
            return df
        self.states[source.name], self.errors[source.name] = UNAVAILABLE, "; ".join(problems)
        raise ConnectionError(f"source {source.name!r}, table {table!r}: {self.errors[source.name]}")

    def check(self, spark: SparkSession, name: str, table: str) -> bool:
        """Whether one row can be read."""
        try:
            self.open(spark, name, table).limit(1).collect()
            return True
        except Exception as e:
            self.errors[name], self.states[name] = redact(str(e)), UNAVAILABLE
            return False

    def listing(self) -> list[dict]:
        return [{"name": s.name, "kind": s.kind, "location": redact(s.location), "status": self.states[s.name], "error": self.errors.get(s.name)} for s in self.sources.values()]


def _source(name: str, entry: dict, base_timeout) -> Source:
    entry = dict(entry)
    timeout = entry.pop("timeout", base_timeout)
    more = tuple(_source(name, e, base_timeout) for e in entry.pop("fallbacks", []))
    location = os.path.expandvars(entry.pop("location", ""))
    return Source(name, entry.pop("kind"), location, {k: os.path.expandvars(str(v)) for k, v in entry.pop("options", {}).items()}, entry.pop("keys", {}), seconds(timeout) if timeout is not None else None, more)


def load_config(path: str | Path) -> Registry:
    """A TOML file with ``timeout`` and ``[sources.<name>]`` tables; environment variables are filled in."""
    raw = tomllib.loads(Path(path).read_text())
    registry = Registry()
    for name, entry in raw.get("sources", {}).items():
        registry.add(_source(name, entry, raw.get("timeout")))
    return registry


def from_environment(variable: str = "TWINLAKE_SOURCE") -> Registry:
    """One source named ``default`` from ``kind:location`` in an environment variable."""
    registry = Registry()
    if value := os.environ.get(variable):
        kind, _, location = value.partition(":")
        registry.add(Source("default", kind, location) if kind in READERS else Source("default", "jdbc", value))
    return registry


def with_alternatives(source: Source, *others: Source) -> Source:
    return replace(source, fallbacks=(*source.fallbacks, *others))
