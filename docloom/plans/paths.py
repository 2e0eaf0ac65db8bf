"""Dotted paths over nested rows: reading with fan-out over arrays, setting and removing."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(value) -> Column:
    """A Python value as a typed column; lists and dicts nest."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    if isinstance(value, bool) or value is None or isinstance(value, (str, float)):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("bigint") if -(2**63) <= value < 2**63 else F.lit(Decimal(value)).cast("decimal(38,0)")
    if isinstance(value, Decimal):
        scale = max(0, -value.as_tuple().exponent)
        return F.lit(str(value)).cast(f"decimal(38,{min(scale, 37)})")
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz") if value.tzinfo is None else F.lit(value)
    if isinstance(value, (bytes, date)):
        return F.lit(value)
    raise TypeError(f"no literal for {type(value).__name__}")


def picked(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda x: x[name])


def resolve(schema: T.DataType, path: str, base: Column | None = None) -> tuple[Column, T.DataType] | None:
    """The column at a dotted path and its type; None if the schema has no such path.

    A step through an array of rows yields the array of the rows' values, without nulls, one level flat.
    """
    col, kind = base, schema
    for step in path.split("."):
        if isinstance(kind, T.StructType):
            field = next((f for f in kind.fields if f.name == step), None)
            if field is None:
                return None
            col, kind = (F.col(f"`{step}`") if col is None else col.getField(step)), field.dataType
        elif isinstance(kind, T.MapType):
            col, kind = col[step], kind.valueType
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
            inner = kind.elementType
            if isinstance(inner, T.StructType) and step not in inner.names:
                return None
            found = inner[step].dataType if isinstance(inner, T.StructType) else inner.valueType
            values = F.filter(picked(col, step), lambda x: x.isNotNull())
            col, kind = (F.flatten(values), found) if isinstance(found, T.ArrayType) else (values, T.ArrayType(found))
        else:
            return None
    return col, kind


def with_path(schema: T.StructType, path: str, value: Column, base: Column | None = None) -> tuple[str, Column]:
    """(top-level name, its new column) with the value put at the path; missing parents are made."""
    head, _, rest = path.partition(".")
    field = next((f for f in schema.fields if f.name == head), None)
    here = (F.col(f"`{head}`") if base is None else base.getField(head)) if field is not None else None
    if not rest:
        return head, value
    if field is None or not isinstance(field.dataType, T.StructType):
        for step in reversed(rest.split(".")):
            value = F.struct(value.alias(step))
        return head, value
    name, inner = with_path(field.dataType, rest, value, here)
    blank = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in field.dataType.fields))
    return head, F.coalesce(here, blank).withField(name, inner)


def without_path(schema: T.StructType, path: str) -> tuple[str, Column | None]:
    """(top-level name, its new column, or None to drop it)."""
    head, _, rest = path.partition(".")
    return (head, F.col(f"`{head}`").dropFields(rest)) if rest else (head, None)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)
