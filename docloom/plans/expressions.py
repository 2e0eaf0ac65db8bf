"""Expression dicts to Columns."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import ORD
from .paths import is_numeric, literal, resolve


class ExpressionError(ValueError):
    pass


class Scope:
    """Where names are looked up: the fields of df, variables ($$name), and types of columns over df."""

    def __init__(self, df: DataFrame, variables: dict[str, Column] | None = None):
        self.df, self.variables = df, variables or {}

    def type_of(self, col: Column) -> T.DataType:
        return self.df.select(col.alias("x")).schema[0].dataType

    def ref(self, path: str) -> Column:
        if path.startswith("$$"):
            name, _, rest = path[2:].partition(".")
            if name in ("ROOT", "CURRENT"):
                col = F.struct(*(F.col(f"`{c}`") for c in self.df.columns if not c.startswith(ORD)))
                if not rest:
                    return col
                path = "$" + rest
            elif name in self.variables:
                col = self.variables[name]
                if not rest:
                    return col
                found = resolve(self.type_of(col), rest, col)
                return found[0] if found else F.lit(None)
            else:
                raise ExpressionError(f"unknown variable $${name}")
        found = resolve(self.df.schema, path[1:])
        return found[0] if found else F.lit(None)


def truth(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    if is_numeric(kind):
        return F.coalesce(col != 0, F.lit(False))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.length(col) > 0, F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    return F.lit(False) if isinstance(kind, T.NullType) else col.isNotNull()


def compile_expr(spec, scope: Scope) -> Column:
    if isinstance(spec, str) and spec.startswith("$"):
        return scope.ref(spec)
    if isinstance(spec, dict):
        ops = [k for k in spec if k.startswith("$")]
        if not ops:
            return F.struct(*(compile_expr(v, scope).alias(k) for k, v in spec.items()))
        if len(spec) != 1:
            raise ExpressionError(f"one operator is wanted, not {sorted(spec)}")
        build = REGISTRY.get(ops[0])
        if build is None:
            raise ExpressionError(f"unknown expression {ops[0]}")
        return build(spec[ops[0]], scope)
    if isinstance(spec, list):
        return F.array(*(compile_expr(v, scope) for v in spec))
    return literal(spec)


REGISTRY: dict[str, Callable[[object, Scope], Column]] = {}


def register(*names: str):
    def put(fn):
        REGISTRY.update(dict.fromkeys(names, fn))
        return fn

    return put


def operands(arg, scope: Scope) -> list[Column]:
    return [compile_expr(a, scope) for a in (arg if isinstance(arg, list) else [arg])]


def plain(names: tuple[str, ...], fn: Callable[..., Column]) -> None:
    """An operator that is a function of its operands' columns."""
    register(*names)(lambda arg, scope: fn(*operands(arg, scope)))


plain(("$add",), lambda *c: functools.reduce(operator.add, c))
plain(("$subtract",), lambda *c: functools.reduce(operator.sub, c))
plain(("$multiply",), lambda *c: functools.reduce(operator.mul, c))
plain(("$divide",), lambda a, b: F.try_divide(a.cast("double"), b.cast("double")))
plain(("$mod",), lambda a, b: F.when(b != 0, a - b * F.floor(F.try_divide(a, b))))
plain(("$pow",), lambda a, b: F.pow(a.cast("double"), b.cast("double")))
plain(("$sqrt",), lambda a: F.when(a >= 0, F.sqrt(a)))
plain(("$trunc",), lambda a: a.cast("bigint"))
plain(("$cmp",), lambda a, b: F.when(a > b, 1).when(a < b, -1).when(a == b, 0))
plain(("$eq",), lambda a, b: a.eqNullSafe(b))
plain(("$ne",), lambda a, b: ~a.eqNullSafe(b))
for _name, _op in (("$gt", operator.gt), ("$gte", operator.ge), ("$lt", operator.lt), ("$lte", operator.le)):
    plain((_name,), lambda a, b, op=_op: F.coalesce(op(a, b), F.lit(False)))
plain(("$concat",), lambda *c: F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in c)))
plain(("$trim",), lambda a: F.regexp_replace(a, r"(?U)^\s+|\s+$", ""))
plain(("$toDouble",), lambda a: a.try_cast("double"))
plain(("$toString",), lambda a: a.cast("string"))
plain(("$ifNull",), lambda *c: F.coalesce(*c))


def _rounding(fn):
    def build(arg, scope):
        (a,) = operands(arg, scope)
        return fn(a) if is_numeric(scope.type_of(a)) else F.lit(None).cast("bigint")

    return build


register("$ceil")(_rounding(F.ceil))
register("$floor")(_rounding(F.floor))


@register("$abs")
def _abs(arg, scope):
    (a,) = operands(arg, scope)
    return F.abs(a) if is_numeric(scope.type_of(a)) else F.lit(None).cast("double")


@register("$round")
def _round(arg, scope):
    parts = arg if isinstance(arg, list) else [arg]
    a = compile_expr(parts[0], scope)
    return F.bround(a, parts[1]) if len(parts) > 1 and parts[1] is not None else F.bround(a, 0).cast("bigint")


@register("$and")
def _and(arg, scope):
    return functools.reduce(operator.and_, [truth(c, scope.type_of(c)) for c in operands(arg, scope)], F.lit(True))


@register("$or")
def _or(arg, scope):
    return functools.reduce(operator.or_, [truth(c, scope.type_of(c)) for c in operands(arg, scope)], F.lit(False))


@register("$not")
def _not(arg, scope):
    (c,) = operands(arg, scope)
    return ~truth(c, scope.type_of(c))


@register("$toBool")
def _bool(arg, scope):
    (c,) = operands(arg, scope)
    return truth(c, scope.type_of(c))


@register("$toInt", "$toLong")
def _int(arg, scope):
    (c,) = operands(arg, scope)
    return c.try_cast("bigint")


@register("$substr", "$substrCP")
def _substr(arg, scope):
    s, start, length = operands(arg, scope)
    return F.substring(s, F.when(start >= 0, start + 1).otherwise(start).cast("int"), length.cast("int"))


def _case(fn):
    def build(arg, scope):
        (c,) = operands(arg, scope)
        return fn(c) if isinstance(scope.type_of(c), T.StringType) else c

    return build


register("$tolower", "$toLower")(_case(F.lower))
register("$toupper", "$toUpper")(_case(F.upper))


@register("$strlen", "$strLenCP")
def _strlen(arg, scope):
    (c,) = operands(arg, scope)
    return F.length(c).cast("bigint") if isinstance(scope.type_of(c), T.StringType) else F.lit(None).cast("bigint")


@register("$split")
def _split(arg, scope):
    s, by = arg
    return F.split(compile_expr(s, scope), re.escape(by) if isinstance(by, str) and not by.startswith("$") else F.concat(F.lit("\\Q"), compile_expr(by, scope), F.lit("\\E")))


@register("$size")
def _size(arg, scope):
    (c,) = operands(arg if not isinstance(arg, list) or len(arg) == 1 else [arg], scope)
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint") if isinstance(scope.type_of(c), T.ArrayType) else F.lit(0).cast("bigint")


@register("$arrayElemAt")
def _element(arg, scope):
    a, i = operands(arg, scope)
    return F.try_element_at(a, F.when(i >= 0, i + 1).otherwise(i).cast("int")) if isinstance(scope.type_of(a), T.ArrayType) else F.lit(None)


@register("$in")
def _in(arg, scope):
    x, a = operands(arg, scope)
    return F.exists(a, lambda e: e.eqNullSafe(x)) if isinstance(scope.type_of(a), T.ArrayType) else F.lit(None).cast("boolean")


@register("$concatArrays")
def _concat_arrays(arg, scope):
    arrays = [c for c in operands(arg, scope) if isinstance(scope.type_of(c), T.ArrayType)]
    return F.concat(*(F.coalesce(c, F.array().cast(scope.type_of(c))) for c in arrays)) if arrays else F.array()


@register("$isArray")
def _is_array(arg, scope):
    (c,) = operands(arg, scope)
    return c.isNotNull() if isinstance(scope.type_of(c), T.ArrayType) else F.lit(False)


@register("$slice")
def _slice(arg, scope):
    """Slices as Python's: [a, n], n < 0 from the end; [a, skip, n]."""
    a, *rest = operands(arg, scope)
    rest = [c.cast("int") for c in rest]
    size, empty = F.size(a), F.slice(a, 1, 0)
    if len(rest) == 1:
        (n,) = rest
        return F.when(size == 0, a).when(n == 0, empty).when(n > 0, F.slice(a, F.lit(1), n)).otherwise(F.slice(a, -F.least(size, -n), F.least(size, -n)))
    skip, n = rest
    begin = F.when(skip < 0, F.greatest(size + skip, F.lit(0))).otherwise(skip)
    return F.when((begin >= size) | (n <= 0), empty).otherwise(F.slice(a, begin + 1, n))


@register("$literal")
def _literal(arg, scope):
    return literal(arg)


@register("$cond")
def _cond(arg, scope):
    test, yes, no = (arg["if"], arg["then"], arg["else"]) if isinstance(arg, dict) else arg
    c = compile_expr(test, scope)
    return F.when(truth(c, scope.type_of(c)), compile_expr(yes, scope)).otherwise(compile_expr(no, scope))


@register("$switch")
def _switch(arg, scope):
    out = compile_expr(arg["default"], scope) if "default" in arg else F.lit(None)
    for b in reversed(arg["branches"]):
        c = compile_expr(b["case"], scope)
        out = F.when(truth(c, scope.type_of(c)), compile_expr(b["then"], scope)).otherwise(out)
    return out


# ---- accumulators -----------------------------------------------------------------------------------------------


def accumulator(spec: dict, scope: Scope) -> Column:
    (name, arg), *more = spec.items()
    if more:
        raise ExpressionError(f"one accumulator is wanted, not {sorted(spec)}")
    if name == "$count":
        return F.count(F.lit(1))
    col = compile_expr(arg, scope)
    kind, order = scope.type_of(col), F.col(ORD)
    if name == "$sum":
        if isinstance(kind, T.BooleanType):
            col, kind = col.cast("bigint"), T.LongType()
        return F.coalesce(F.sum(col), F.lit(0)) if is_numeric(kind) else F.lit(0).cast("bigint") + F.count(F.lit(None))
    if name == "$avg":
        return F.coalesce(F.avg(col.cast("double") if isinstance(kind, T.BooleanType) else col), F.lit(0.0)) if is_numeric(kind) or isinstance(kind, T.BooleanType) else F.coalesce(F.avg(F.lit(None).cast("double")), F.lit(0.0))
    if name in ("$min", "$max"):
        return (F.min if name == "$min" else F.max)(col)
    if name in ("$first", "$last"):
        pick = F.min if name == "$first" else F.max
        return pick(F.struct(order.alias("o"), F.struct(col.alias("v")).alias("s")))["s"]["v"] if sortable_type(kind) else (F.min_by if name == "$first" else F.max_by)(col, order)
    if name == "$push":
        return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), col.alias("v")))), lambda x: x["v"])
    if name == "$addToSet":
        return F.array_sort(F.collect_set(col))
    if name == "$stdDevPop":
        return F.stddev_pop(col)
    raise ExpressionError(f"unknown accumulator {name}")


def sortable_type(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType, T.StructType, T.ArrayType))
