"""Canonical text of typed columns, so that equal values of two tables give equal text.

Timestamps are rendered in the session time zone; compare under ``spark.sql.session.timeZone=UTC``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the comparison format: the text of NULL and the text between columns.
NULL_TEXT = "\x1fNULL\x1f"
SEPARATOR = "#"

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def comparable(kind: T.DataType) -> bool:
    """Whether values of the type have a canonical text (nested ones do not, unless as JSON)."""
    return not isinstance(kind, (*_NESTED, T.NullType))


def identifier(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value) -> Column:
    """A value as a literal; text is never parsed, so nothing in it can escape."""
    return F.lit(value)


def canonical(field: T.StructField, *, scale: int | None = None, nested_json: bool = False) -> Column:
    """The canonical text of a column; NULL has a text of its own.

    scale: decimals (and floats, if given) are first rounded to this scale, to align two sides.
    """
    c, kind = identifier(field.name), field.dataType
    if isinstance(kind, T.BooleanType):
        text = c.cast("int").cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, T.DecimalType) or (scale is not None and isinstance(kind, (T.FloatType, T.DoubleType))):
        digits = kind.scale if scale is None else scale
        text = c.cast(T.DecimalType(38, digits) if scale is not None else kind).cast("string")
    elif isinstance(kind, _NESTED):
        if not nested_json:
            raise ValueError(f"column {field.name!r} of type {kind.simpleString()} has no canonical text")
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_TEXT))
