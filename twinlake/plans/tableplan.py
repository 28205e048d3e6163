"""Plan of one side: key, compared columns, canonical texts, warnings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions.canonical import canonical, comparable, identifier
from twinlake.functions.hashing import bucket, row_hash

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS) or (isinstance(kind, T.DecimalType) and kind.scale == 0)


def find_column(schema: T.StructType, name: str) -> T.StructField:
    """By exact name, else the only one that differs in case alone."""
    exact = [f for f in schema if f.name == name]
    loose = exact or [f for f in schema if f.name.lower() == name.lower()]
    if len(loose) == 1:
        return loose[0]
    raise ValueError(f"column {name!r} is {'ambiguous' if loose else 'not found'}; columns: {', '.join(schema.names)}")


@dataclass
class TablePlan:
    schema: T.StructType
    keys: list[T.StructField]
    columns: list[T.StructField]
    scale: int | None = None
    exact: bool = False
    nested_json: bool = False
    warnings: list[str] = field(default_factory=list)

    @property
    def key_names(self) -> list[str]:
        return [f.name for f in self.keys]

    @property
    def payload(self) -> list[T.StructField]:
        return [f for f in self.columns if f.name not in self.key_names]

    def _texts(self, fields: Sequence[T.StructField]) -> list[Column]:
        return [canonical(f, scale=self.scale if isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)) else None, nested_json=self.nested_json) for f in fields]

    def normalized(self) -> list[Column]:
        """The canonical text of each compared column, under its name."""
        return [t.alias(f.name) for t, f in zip(self._texts(self.columns), self.columns)]

    def content_hash(self) -> Column:
        """Hash of the compared columns in table order."""
        return row_hash(self._texts(self.columns), exact=self.exact)

    def key_hash(self) -> Column:
        return row_hash(self._texts(self.keys), exact=self.exact)

    def identity_hash(self) -> Column:
        """Hash of the keys first, then of the other compared columns."""
        return row_hash(self._texts([*self.keys, *self.payload]), exact=self.exact)

    def key_bucket(self, n: int) -> Column:
        return bucket(self.key_hash(), n)

    def key_struct(self) -> Column:
        return F.struct(*(identifier(f.name).alias(f.name) for f in self.keys))

    def payload_struct(self) -> Column:
        fields = self.payload or self.keys
        return F.struct(*(identifier(f.name).alias(f.name) for f in fields))


def build_plan(
    df: DataFrame, *, key: Sequence[str] = (), columns: Sequence[str] = (), declared_key: Sequence[str] = (), scale: int | None = None, exact: bool = False, nested_json: bool = False
) -> TablePlan:
    """key: given by the caller; else declared_key (of the source); columns: default all comparable ones."""
    schema = df.schema
    if not schema.fields:
        raise ValueError("table not found or has no columns")
    keys = [find_column(schema, k) for k in (key or declared_key)]
    warnings = []
    if columns:
        chosen = [find_column(schema, c) for c in columns]
        bad = [f.name for f in chosen if not comparable(f.dataType) and not nested_json]
        if bad:
            raise ValueError(f"columns without canonical text were asked for: {', '.join(bad)}")
        chosen.sort(key=lambda f: schema.names.index(f.name))
    else:
        chosen = []
        for f in schema:
            if comparable(f.dataType) or (nested_json and not isinstance(f.dataType, (T.NullType, T.VariantType))):
                chosen.append(f)
            else:
                warnings.append(f"column '{f.name}' of type {f.dataType.simpleString()} is not compared")
    if not chosen:
        raise ValueError("no column can be compared")
    for f in keys:
        if f.nullable:
            warnings.append(f"key column '{f.name}' is nullable; NULL keys are matched with each other")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            warnings.append(f"key column '{f.name}' is temporal")
        if not comparable(f.dataType):
            raise ValueError(f"key column '{f.name}' has no canonical text")
    if key and tuple(key) != tuple(declared_key):
        warnings.append("the given key is not declared unique; duplicate keys are checked before a keyed comparison")
    for f in chosen:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and scale is None:
            warnings.append(f"column '{f.name}' is a float; its text is not portable between engines (use a decimal scale)")
    return TablePlan(schema, keys, chosen, scale, exact, nested_json, warnings)


def pair_warnings(left: TablePlan, right: TablePlan) -> list[str]:
    """Warnings on types that differ between the two sides."""
    other = {f.name.lower(): f for f in right.columns}
    out = []
    for f in left.columns:
        g = other.get(f.name.lower())
        if g is None:
            out.append(f"column '{f.name}' is compared on the left only")
            continue
        kinds = {type(f.dataType), type(g.dataType)}
        if T.DateType in kinds and kinds & {T.TimestampType, T.TimestampNTZType}:
            out.append(f"column '{f.name}' is a date on one side and a timestamp on the other")
        if isinstance(f.dataType, T.DecimalType) and isinstance(g.dataType, T.DecimalType) and f.dataType.scale != g.dataType.scale:
            out.append(f"column '{f.name}' has scale {f.dataType.scale} and {g.dataType.scale}; the larger is used")
    out += [f"column '{f.name}' is compared on the right only" for f in right.columns if f.name.lower() not in {x.name.lower() for x in left.columns}]
    return out


def duplicate_keys(df: DataFrame, plan: TablePlan) -> DataFrame:
    """Key values that occur more than once, with their number."""
    names = [identifier(k) for k in plan.key_names]
    return df.groupBy(*names).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
