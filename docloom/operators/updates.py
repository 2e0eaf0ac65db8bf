"""Update dicts to Columns. Operators apply in one fixed order, whatever the dict's."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.filters import COMPARE
from ..plans.paths import is_numeric, literal, resolve, with_path

ORDER = ("$set", "$unset", "$inc", "$mul", "$rename", "$max", "$min", "$push", "$pull", "$addToSet", "$pop", "$pullAll")


class UpdateError(ValueError):
    pass


def apply_update(df: DataFrame, update: dict, match: Column) -> DataFrame:
    """df with the update applied to the rows where match is true. An update without operators replaces the row but its _id."""
    if not any(k.startswith("$") for k in update):
        return replaced(df, update, match)
    unknown = set(update) - set(ORDER)
    if unknown:
        raise UpdateError(f"unknown operators {sorted(unknown)}")
    out = df.withColumn("__hit", F.coalesce(match, F.lit(False)))
    for op in ORDER:
        for path, arg in update.get(op, {}).items():
            out = one(out, op, path, arg)
    return out.drop("__hit")


def replaced(df: DataFrame, doc: dict, match: Column) -> DataFrame:
    out = df.withColumn("__hit", F.coalesce(match, F.lit(False)))
    for name in [*doc, *(c for c in df.columns if c not in doc and c not in ("_id", "__hit") and not c.startswith("__"))]:
        old = F.col(f"`{name}`") if name in df.columns else None
        new = literal(doc.get(name))
        new = new.cast(df.schema[name].dataType) if old is not None else new
        out = out.withColumn(name, F.when(F.col("__hit"), new).otherwise(old) if old is not None else F.when(F.col("__hit"), new))
    return out.drop("__hit")


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    head, whole = with_path(df.schema, path, value)
    return df.withColumn(head, F.when(F.col("__hit"), whole).otherwise(F.col(f"`{head}`")) if head in df.columns else F.when(F.col("__hit"), whole))


def one(df: DataFrame, op: str, path: str, arg) -> DataFrame:
    found = resolve(df.schema, path)
    col, kind = found or (F.lit(None), T.NullType())
    array = isinstance(kind, T.ArrayType)
    if op == "$set":
        value = literal(arg)
        return put(df, path, value.try_cast(kind) if found and not isinstance(kind, (T.StructType, T.ArrayType)) else value.cast(kind) if found and value is not None and array else value)
    if op == "$unset":
        return put(df, path, F.lit(None).cast(kind)) if found else df
    if op in ("$inc", "$mul"):
        if found and not is_numeric(kind):
            return df
        old = F.coalesce(col, F.lit(0))
        new = old + literal(arg) if op == "$inc" else old * literal(arg)
        if found and isinstance(kind, T.IntegralType) and isinstance(arg, float):  # the column widens
            head = path.partition(".")[0]
            return put(df.withColumn(head, F.col(head).cast("double")), path, new) if "." not in path else put(df, path, new)
        return put(df, path, new.cast(kind) if found and isinstance(kind, T.IntegralType) else new)
    if op == "$rename":
        if not found:
            return df
        target = resolve(df.schema, arg)
        out = put(df.withColumn("__old", col), arg, F.coalesce(F.col("__old"), target[0]) if target else F.col("__old"))
        return put(out, path, F.lit(None).cast(kind)).drop("__old")
    if op in ("$max", "$min"):
        if found and not is_numeric(kind):
            return put(df, path, F.coalesce(col, literal(arg).cast(kind)))
        new = (F.greatest if op == "$max" else F.least)(col, literal(arg)) if found else literal(arg)
        return put(df, path, new)
    if op == "$push":
        each = arg["$each"] if isinstance(arg, dict) and "$each" in arg else [arg]
        more = literal(list(each))
        more = more.cast(kind) if array else more
        return put(df, path, F.concat(F.coalesce(col, F.array().cast(kind)), more) if array else more)
    if op == "$addToSet":
        each = arg["$each"] if isinstance(arg, dict) and "$each" in arg else [arg]
        for v in each:
            item = literal(v).cast(kind.elementType) if array else literal(v)
            old = F.coalesce(col, F.array().cast(kind)) if array else None
            new = F.when(F.exists(old, same_as(item)), old).otherwise(F.array_append(old, item)) if array else F.array(item)
            df = put(df, path, new)
            col, kind = resolve(df.schema, path)
            array = True
        return df
    if not array:
        return df
    if op == "$pull":
        tests = arg if isinstance(arg, dict) and any(str(k).startswith("$") for k in arg) else {"$eq": arg}
        return put(df, path, F.filter(col, lambda x: ~F.coalesce(pulls(x, kind.elementType, tests), F.lit(False))))
    if op == "$pop":
        size = F.greatest(F.size(col) - 1, F.lit(0))
        return put(df, path, F.slice(col, F.lit(1 if arg >= 0 else 2), size))
    return put(df, path, F.filter(col, lambda x: ~reduce(operator.or_, [x.eqNullSafe(literal(v).cast(kind.elementType)) for v in arg], F.lit(False))))  # $pullAll


def same_as(item: Column):
    return lambda x: x.eqNullSafe(item)


def pulls(x: Column, kind: T.DataType, tests: dict) -> Column:
    out = F.lit(True)
    for op, v in tests.items():
        if op in COMPARE:
            hit = COMPARE[op][0](x, literal(v))
        elif op in ("$eq", "$ne"):
            hit = x.eqNullSafe(literal(v).cast(kind) if isinstance(v, dict) else literal(v))
            hit = ~hit if op == "$ne" else hit
        elif op in ("$in", "$nin"):
            hit = reduce(operator.or_, [x.eqNullSafe(literal(i)) for i in v], F.lit(False))
            hit = ~hit if op == "$nin" else hit
        else:
            raise UpdateError(f"unknown operator {op} in $pull")
        out = out & hit
    return out
