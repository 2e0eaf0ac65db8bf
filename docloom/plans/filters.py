"""Filter dicts to Columns, in two-valued logic.

A predicate is compiled in one of two polarities: T gives a column that is true exactly for matches (null counts as
false in WHERE), F one that is true exactly for the others. Plain comparisons stay bare, so Parquet can be asked.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from .paths import literal, resolve

COMPARE: dict[str, tuple[Callable, Callable]] = {
    "$gt": (operator.gt, operator.le),
    "$gte": (operator.ge, operator.lt),
    "$lt": (operator.lt, operator.ge),
    "$lte": (operator.le, operator.gt),
}


class FilterError(ValueError):
    pass


def both(parts: list[Column], join: Callable, empty: bool) -> Column:
    return functools.reduce(join, parts) if parts else F.lit(empty)


def compile_filter(spec: dict, schema: T.StructType, positive: bool = True, base: Column | None = None, text: Callable | None = None, expr: Callable | None = None) -> Column:
    """text and expr compile $text and $expr, if the caller has them."""
    again = functools.partial(compile_filter, schema=schema, base=base, text=text, expr=expr)
    parts: list[Column] = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            inner_positive = positive if key != "$nor" else not positive
            inner = [again(s, positive=inner_positive) for s in value]
            conj = (key == "$and") == positive if key != "$nor" else positive
            parts.append(both(inner, operator.and_ if conj else operator.or_, conj))
        elif key == "$not":
            parts.append(again(value, positive=not positive))
        elif key in ("$expr", "$text"):
            how = expr if key == "$expr" else text
            if how is None:
                raise FilterError(f"{key} has no meaning here")
            parts.append(known(how(value), positive))
        elif callable(key) or not key.startswith("$"):
            parts.append(field(schema, key, value, positive, base))
        elif key in ("$options", "$comment"):
            continue
        else:
            raise FilterError(f"unknown operator {key}")
    return both(parts, operator.and_ if positive else operator.or_, positive)


def known(p: Column, positive: bool) -> Column:
    return p if positive else ~F.coalesce(p, F.lit(False))


def is_operators(value) -> bool:
    return isinstance(value, dict) and bool(value) and any(callable(k) or str(k).startswith("$") for k in value)


def field(schema, path: str, value, positive: bool, base: Column | None) -> Column:
    found = resolve(schema, path, base)
    ops = value if is_operators(value) else {"$eq": value}
    parts = [operator_of(op, arg, found, positive, ops) for op, arg in ops.items() if op not in ("$options", "$maxDistance", "$minDistance")]
    return both(parts, operator.and_ if positive else operator.or_, positive)


def operator_of(op, arg, found, positive: bool, ops: dict) -> Column:
    if found is None:
        found = F.lit(None).cast("string"), T.NullType()
    col, kind = found
    if op == "$not":
        inner = arg if is_operators(arg) else {"$eq": arg}
        parts = [operator_of(o, a, found, not positive, inner) for o, a in inner.items() if o != "$options"]
        return both(parts, operator.or_ if positive else operator.and_, not positive)
    if op == "$ne":
        return operator_of("$eq", arg, found, not positive, ops)
    if op == "$nin":
        return operator_of("$in", arg, found, not positive, ops)
    if op == "$exists":
        return col.isNotNull() if bool(arg) == positive else col.isNull()
    if isinstance(kind, T.NullType) and op in ("$eq", "$in"):
        wants_null = arg is None if op == "$eq" else None in arg
        return F.lit(wants_null == positive)
    if op == "$eq":
        if isinstance(kind, T.ArrayType) and not isinstance(arg, (list, tuple)):
            return known(F.exists(col, lambda x: x.eqNullSafe(literal(arg))), positive)
        if isinstance(kind, T.StructType) and isinstance(arg, dict):
            same = [col.getField(k).eqNullSafe(literal(v)) for k, v in arg.items() if k in kind.names]
            rest = [col.getField(k).isNull() for k in kind.names if k not in arg]
            hit = both([col.isNotNull(), *same, *rest], operator.and_, True) if set(arg) <= set(kind.names) else F.lit(False)
            return known(hit, positive)
        if arg is None:
            return col.isNull() if positive else col.isNotNull()
        if isinstance(arg, (list, tuple)) and not arg:
            return known(F.size(col) == 0, positive)
        return col == literal(arg) if positive else ~col.eqNullSafe(literal(arg))
    if op == "$in":
        values, null = [literal(v) for v in arg if v is not None], None in arg
        if isinstance(kind, T.ArrayType):
            hit = F.exists(col, lambda x: both([x.eqNullSafe(v) for v in map(literal, arg)], operator.or_, False))
            return known(hit, positive)
        hit = col.isin(*values) if values else F.lit(False)
        if positive:
            return hit | col.isNull() if null else hit
        return ~hit & col.isNotNull() if null else col.isNull() | ~hit
    if op in COMPARE:
        yes, no = COMPARE[op]
        if isinstance(kind, T.NullType):
            return F.lit(not positive)
        if isinstance(kind, T.ArrayType):
            return known(F.exists(col, lambda x: yes(x, literal(arg))), positive)
        return yes(col, literal(arg)) if positive else col.isNull() | no(col, literal(arg))
    if op == "$all":
        if not isinstance(kind, T.ArrayType):
            return F.lit(not positive)
        return known(both([holds(col, v) for v in arg], operator.and_, True) & col.isNotNull(), positive)
    if op == "$size":
        return known(F.size(col) == arg, positive)
    if op == "$regex":
        pattern = arg.pattern if isinstance(arg, re.Pattern) else arg
        flags = "".join(f for f in ops.get("$options", "") if f in "imsx")
        pattern = f"(?{flags})" * bool(flags) + pattern
        if isinstance(kind, T.ArrayType):
            return known(F.exists(col, lambda x: x.rlike(pattern)), positive)
        return known(col.cast("string").rlike(pattern), positive)
    if op in ("$near", "$geoWithin", "$geoIntersects"):
        point = geo.point_of(col, kind)
        if op == "$near":
            arg = arg if isinstance(arg, dict) and ("$geometry" in arg or "$maxDistance" in arg) else {"$geometry": arg}
            away = geo.distance(point, geo.literal_point(arg.get("$geometry", arg)))
            most, least = ops.get("$maxDistance", arg.get("$maxDistance")), ops.get("$minDistance", arg.get("$minDistance"))
            first = geo.around(point, geo.literal_point(arg.get("$geometry", arg)), most) if most is not None else F.lit(True)
            hit = first & away.isNotNull() & (away <= most if most is not None else F.lit(True)) & (away >= least if least is not None else F.lit(True))
        else:
            hit = geo.within(point, arg)
        return known(hit, positive)
    if op == "$type":
        names = {type_name(kind), "number" if isinstance(kind, T.NumericType) else ""}
        return known(col.isNotNull() if names & set([arg] if isinstance(arg, str) else arg) else F.lit(False), positive)
    if op == "$mod":
        return known(col - F.floor(col / arg[0]) * arg[0] == arg[1], positive)
    if op == "$elemMatch":
        inner = kind.elementType
        return known(F.exists(col, lambda x: compile_filter(arg, inner, True, x) if isinstance(inner, T.StructType) else both([operator_of(o, a, (x, inner), True, arg) for o, a in arg.items()], operator.and_, True)), positive)
    if callable(op):
        return known(called(op, col, kind, arg), positive)
    raise FilterError(f"unknown operator {op}")


def type_name(kind: T.DataType) -> str:
    """The document type of a column."""
    for names, kinds in ((("string",), T.StringType), (("bool",), T.BooleanType), (("int",), (T.ByteType, T.ShortType, T.IntegerType)), (("long",), T.LongType), (("double",), (T.FloatType, T.DoubleType)), (("decimal",), T.DecimalType), (("date",), (T.DateType, T.TimestampType, T.TimestampNTZType)), (("binData",), T.BinaryType), (("array",), T.ArrayType), (("object",), (T.StructType, T.MapType))):
        if isinstance(kind, kinds):
            return names[0]
    return "null"


def holds(array: Column, value) -> Column:
    return F.exists(array, lambda x: x.eqNullSafe(literal(value)))


def vectorised(fn: Callable) -> Callable:
    """Marks a predicate that takes and returns pandas Series: it runs on Arrow batches."""
    fn.vectorised = True
    return fn


def rowwise(fn: Callable) -> Callable:
    """Marks a predicate of plain values, which is called for every one of them."""
    fn.rowwise = True
    return fn


def called(fn: Callable, col: Column, kind: T.DataType, arg) -> Column:
    """A user's predicate. One of Columns stays in the plan; ``vectorised`` ones get batches; others get single values.

    Which of them an unmarked function is, is found by a call with a Column: what isn't made for one raises or returns no Column.
    """
    args = list(arg) if isinstance(arg, (list, tuple)) else [arg]
    if getattr(fn, "vectorised", False):
        return F.pandas_udf(lambda v: fn(v, *args).fillna(False).astype(bool), "boolean", F.PandasUDFType.SCALAR)(col)
    if not getattr(fn, "rowwise", False):
        try:
            made = fn(col, *args)
        except (TypeError, ValueError, AttributeError, LookupError, ArithmeticError, PySparkException):  # of plain values
            made = None
        if isinstance(made, Column):
            return made
    return F.udf(lambda v: v is not None and bool(fn(v, *args)), "boolean", useArrow=True)(col)
