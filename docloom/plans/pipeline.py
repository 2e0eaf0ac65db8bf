"""Aggregation pipelines: a list of stage dicts folded over a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as textsearch
from ..operators import buckets, joins
from .expressions import Scope, accumulator, compile_expr
from .filters import compile_filter
from .order import ORD, in_order, ordered, sort_key
from .paths import literal, resolve, with_path
from .session import checkpoint


class PipelineError(ValueError):
    pass


class Context:
    """What stages may look up: other tables by name."""

    def __init__(self, tables: Mapping[str, DataFrame] | Callable[[str], DataFrame | None] | None = None):
        self.tables = tables or {}

    def table(self, name: str) -> DataFrame | None:
        return self.tables(name) if callable(self.tables) else self.tables.get(name)


def predicate(spec: dict, df: DataFrame, positive: bool = True):
    """The Column of a filter over df."""
    names = [f for f in df.schema.fields if not f.name.startswith(ORD)]
    schema = T.StructType(names)
    return compile_filter(spec, schema, positive, expr=lambda e: compile_expr({"$and": [e]}, Scope(df)), text=lambda t: textsearch.contains_any(df, t["$search"] if isinstance(t, dict) else t))


def match(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    return df.where(predicate(spec, df))


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(ORD)]


def keep_hidden(df: DataFrame) -> list:
    return [F.col(c) for c in df.columns if c.startswith(ORD)]


def leaf_tree(paths: dict) -> dict:
    """{"a.b": x, "a.c": y} as {"a": {"b": x, "c": y}}."""
    tree: dict = {}
    for path, value in paths.items():
        *steps, last = path.split(".")
        at = tree
        for step in steps:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                raise PipelineError(f"{path} lies inside another path of the stage")
        if last in at:
            raise PipelineError(f"{path} collides with another path of the stage")
        at[last] = value
    return tree


WHOLE = object()


def shaped(col, kind, tree):
    """A row with only the fields of the tree. A leaf is WHOLE (the value as it is) or a Column (a value of its own)."""
    if tree is WHOLE:
        return col
    if isinstance(tree, Column):
        return tree
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: shaped(x, kind.elementType, tree))
    names = kind.names if isinstance(kind, T.StructType) else []
    made = [shaped(None, None, v).alias(k) for k, v in tree.items() if k not in names and new_values(v)]
    if not names:
        return F.struct(*made) if made else col
    fields = [shaped(col.getField(f.name), f.dataType, tree[f.name]).alias(f.name) for f in kind.fields if f.name in tree]
    whole = F.struct(*fields, *made) if fields or made else F.lit(None)
    return whole if any(new_values(v) for v in tree.values()) else F.when(col.isNotNull(), whole)


def new_values(tree) -> bool:
    return isinstance(tree, Column) or isinstance(tree, dict) and any(map(new_values, tree.values()))


def without(col, kind, tree):
    """A row less the fields of the tree; inside arrays, less those of every element."""
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: without(x, kind.elementType, tree))
    if not isinstance(kind, T.StructType):
        return col
    kept = [(f, tree.get(f.name)) for f in kind.fields if tree.get(f.name) is not WHOLE]
    fields = [(without(col.getField(f.name), f.dataType, t) if t else col.getField(f.name)).alias(f.name) for f, t in kept]
    return F.when(col.isNotNull(), F.struct(*fields)) if fields else F.lit(None)


def grafted(col, kind, tree):
    """A row with the tree's Columns put in; parents that are missing are made, and arrays get them in every element."""
    if isinstance(tree, Column):
        return tree
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(col, lambda x: grafted(x, kind.elementType, tree))
    old = kind.fields if isinstance(kind, T.StructType) else []
    fields = [(grafted(col.getField(f.name), f.dataType, tree[f.name]) if f.name in tree else col.getField(f.name)).alias(f.name) for f in old]
    names = [f.name for f in old]
    return F.struct(*fields, *(grafted(None, None, v).alias(k) for k, v in tree.items() if k not in names))


def field_of(df: DataFrame, name: str) -> T.StructField | None:
    return next((f for f in df.schema.fields if f.name == name), None)


def project(df: DataFrame, spec: dict, ctx: Context | None = None) -> DataFrame:
    flags = {k: v for k, v in spec.items() if isinstance(v, (int, bool)) and v in (0, 1, True, False)}
    dropped = [k for k, v in flags.items() if not v]
    if any(k != "_id" for k in dropped) or (dropped and len(spec) == 1):
        out = df
        for head, tree in leaf_tree(dict.fromkeys(dropped, WHOLE)).items():
            field = field_of(out, head)
            if field is not None:
                out = out.drop(head) if tree is WHOLE else out.withColumn(head, without(F.col(f"`{head}`"), field.dataType, tree))
        return out
    scope, leaves = Scope(df), {}
    if "_id" in df.columns and spec.get("_id", 1) in (1, True):
        leaves["_id"] = WHOLE
    leaves |= {k: WHOLE if k in flags else compile_expr(v, scope) for k, v in spec.items() if flags.get(k, 1)}
    cols = {}
    for name, tree in leaf_tree(leaves).items():
        field = field_of(df, name)
        if field is not None:
            cols[name] = shaped(F.col(f"`{name}`"), field.dataType, tree)
        elif new_values(tree):
            cols[name] = shaped(None, None, tree)
    return df.select(*(c.alias(k) for k, c in cols.items()), *keep_hidden(df))


def add_fields(df: DataFrame, spec: dict, ctx: Context | None = None) -> DataFrame:
    """All values are of the incoming document; paths under one parent are put in together."""
    scope = Scope(df)
    tree = leaf_tree({path: compile_expr(value, scope) for path, value in spec.items()})
    fields = {head: field_of(df, head) for head in tree}
    return df.withColumns({head: grafted(F.col(f"`{head}`") if (f := fields[head]) else None, f.dataType if f else None, inner) for head, inner in tree.items()})


def group(df: DataFrame, spec: dict, ctx: Context | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """within: columns that groups never cross; they are kept."""
    df = ordered(df)
    scope = Scope(df)
    aggs = [accumulator(v, scope).alias(k) for k, v in spec.items() if k != "_id"]
    key = spec.get("_id")
    constant = not (isinstance(key, str) and key.startswith("$")) and not isinstance(key, dict)
    if constant:
        out = df.groupBy(*within).agg(F.min(ORD).alias(ORD), *aggs)
        return out.select(*within, literal(key).alias("_id"), *(k for k in spec if k != "_id"), ORD)
    if isinstance(key, dict) and key and not any(k.startswith("$") for k in key):  # flat keys, packed afterwards
        names = [f"__key{i}" for i in range(len(key))]
        out = df.groupBy(*within, *(compile_expr(v, scope).alias(n) for n, v in zip(names, key.values()))).agg(F.min(ORD).alias(ORD), *aggs)
        packed = F.struct(*(F.col(n).alias(k) for n, k in zip(names, key)))
        return out.select(*within, packed.alias("_id"), *(k for k in spec if k != "_id"), ORD)
    out = df.groupBy(*within, compile_expr(key, scope).alias("_id")).agg(F.min(ORD).alias(ORD), *aggs)
    return out.select(*within, "_id", *(k for k in spec if k != "_id"), ORD)


def order_columns(df: DataFrame, keys) -> tuple[list, list]:
    """(orderBy columns, ascending key columns) of [(path, direction)]."""
    by, parts = [], []
    for path, direction in keys:
        found = resolve(df.schema, path)
        if found is None:
            continue
        col, kind = found
        by.append(col.asc_nulls_last() if direction >= 0 else col.desc_nulls_last())
        parts += sort_key(col, kind, direction >= 0)
    return by, parts


def sort(df: DataFrame, spec, ctx: Context | None = None) -> DataFrame:
    df = ordered(df)
    by, parts = order_columns(df, spec.items() if isinstance(spec, dict) else spec)
    new = F.struct(*(p.alias(f"s{i}") for i, p in enumerate(parts)), F.col(ORD).alias("was"))
    return df.orderBy(*by, F.col(ORD)).withColumn(ORD, new)


def unwind(df: DataFrame, spec, ctx: Context | None = None) -> DataFrame:
    spec = {"path": spec} if isinstance(spec, str) else spec
    path = spec["path"].lstrip("$")
    preserve, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    found = resolve(df.schema, path)
    if found is None or not isinstance(found[1], T.ArrayType):
        return df if preserve else df.where(F.lit(False))
    df = ordered(df)
    explode = F.posexplode_outer if preserve else F.posexplode
    rows = df.select("*", explode(found[0]).alias("__at", "__item"))
    head, whole = with_path(df.schema, path, F.col("__item"))
    rows = rows.withColumns({head: whole, ORD: F.struct(F.col(ORD).alias("was"), F.col("__at").alias("at"))} | ({index: F.col("__at").cast("bigint")} if index else {}))
    return rows.drop("__at", "__item")


WIDE = re.compile(r"^[\s:+-]*(Join|Aggregate|Window|Sort|Repartition|RepartitionByExpression|Distinct|GlobalLimit)\b", re.M)


def facet(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """One row of arrays. Every branch is an aggregate over the same input, so each has one row to be joined.

    An input that takes shuffles to make is made once, as a checkpoint. One that is a scan with filters and projections is
    read by each branch for itself, with its own columns and filters pushed down: less than writing and reading it again.
    """
    df, out = ordered(df), None
    if len(spec) > 1 and WIDE.search(df._jdf.queryExecution().optimizedPlan().toString()):
        df = checkpoint(df)
    for name, stages in spec.items():
        branch = ordered(apply(df, stages, ctx, hidden=True))
        row = F.struct(*(F.col(f"`{c}`") for c in visible(branch)))
        one = branch.agg(F.coalesce(in_order(row, F.col(ORD)), F.array()).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def skip(df: DataFrame, n: int, ctx: Context | None = None) -> DataFrame:
    return ordered(df).orderBy(ORD).offset(n)


def limit(df: DataFrame, n: int, ctx: Context | None = None) -> DataFrame:
    return ordered(df).orderBy(ORD).limit(n)


def sort_by_count(df: DataFrame, spec, ctx: Context | None = None) -> DataFrame:
    return sort(group(df, {"_id": spec, "count": {"$count": {}}}), {"count": -1})


def union_with(df: DataFrame, spec, ctx: Context) -> DataFrame:
    """The other collection's documents after these."""
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = ctx.table(spec["coll"])
    if other is None:
        return df
    other = apply(ordered(other), spec.get("pipeline", []), ctx)
    return df.drop(ORD).unionByName(other, allowMissingColumns=True)


def count(df: DataFrame, name: str, ctx: Context | None = None) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def unset(df: DataFrame, spec, ctx: Context | None = None) -> DataFrame:
    return project(df, dict.fromkeys([spec] if isinstance(spec, str) else spec, 0))


STAGES: dict[str, Callable[[DataFrame, object, Context], DataFrame]] = {
    "$match": match,
    "$project": project,
    "$addFields": add_fields,
    "$set": add_fields,
    "$unset": unset,
    "$group": group,
    "$sort": sort,
    "$skip": skip,
    "$limit": limit,
    "$sortByCount": sort_by_count,
    "$unionWith": union_with,
    "$count": count,
    "$unwind": unwind,
    "$facet": facet,
    "$bucket": buckets.bucket,
    "$bucketAuto": buckets.bucket_auto,
    "$lookup": joins.lookup,
    "$graphLookup": joins.graph_lookup,
    "$replaceRoot": lambda df, spec, ctx: df.select(compile_expr(spec["newRoot"], Scope(df)).alias("r"), *keep_hidden(df)).select("r.*", *(c for c in df.columns if c.startswith(ORD))),
}


#: These leave rows where they are.
ROW_BY_ROW = {"$match", "$project", "$addFields", "$set", "$unset", "$unwind", "$replaceRoot"}
#: After these the documents are others, in an order of their own.
REGROUP = {"$group", "$count", "$facet", "$bucket", "$bucketAuto", "$unionWith"}


def apply(df: DataFrame, stages: list[dict], ctx: Context | Mapping | None = None, hidden: bool = False) -> DataFrame:
    """The pipeline's result, lazily. Unknown stages raise. hidden keeps the order column.

    $skip and $limit take documents in their order, whatever joins and groups came before; straight after a $sort they share
    its top-k plan. The result of a pipeline with a $sort comes in that order.
    """
    ctx = ctx if isinstance(ctx, Context) else Context(ctx)
    # top: the plan ends in a sort, so $limit can share it; lying: rows come out in order; sorted_by: a $sort gave the order
    i, top, lying, sorted_by = 0, False, False, False
    while i < len(stages):
        if len(stages[i]) != 1:
            raise PipelineError(f"a stage has one operator: {stages[i]}")
        ((name, spec),) = stages[i].items()
        if name not in STAGES:
            raise PipelineError(f"unknown stage {name}")
        fused = joins.fuse(df, stages[i:], ctx) if name == "$lookup" else None
        if fused is not None:
            df, used = fused
            i, top, lying = i + used, False, False
            continue
        if top and name in ("$skip", "$limit"):
            df = df.offset(spec) if name == "$skip" else df.limit(spec)
        elif name == "$graphLookup":
            df = joins.graph_lookup(df, spec, ctx, joins.fields_read(stages[i + 1 :], spec["as"]))
        else:
            df = STAGES[name](df, spec, ctx)
        top = name in ("$sort", "$skip", "$limit", "$sortByCount")
        lying = top or lying and name in ROW_BY_ROW
        sorted_by = name in ("$sort", "$sortByCount") or sorted_by and name not in REGROUP
        i += 1
    if hidden:
        return df
    if sorted_by and not lying and ORD in df.columns:
        df = df.orderBy(ORD)
    return df.select(*(F.col(f"`{c}`") for c in visible(df)))


def aggregate(df: DataFrame, stages: list[dict], tables=None, order: list[str] | None = None) -> DataFrame:
    """Entry point: order names the columns that say how documents follow each other (``_id`` by default)."""
    return apply(ordered(df, order), stages, Context(tables))
