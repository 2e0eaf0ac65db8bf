"""$lookup and $graphLookup as joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expressions import Scope, compile_expr
from ..plans.order import ORD, in_order, ordered
from ..plans.paths import resolve
from ..plans.session import checkpoint, stored


def whole(df: DataFrame):
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("__")))


def key_of(df: DataFrame, path: str):
    found = resolve(df.schema, path)
    return found[0] if found else F.lit(None)


def foreign(spec: dict, ctx) -> DataFrame | None:
    table = ctx.table(spec["from"])
    return None if table is None else ordered(table)


#: A filter that says more than that something is there, or a limit.
FILTERED = re.compile(r"^[\s:+-]*(Filter (?!isnotnull\([^()]*\)$)|GlobalLimit)", re.M)


def lookup(df: DataFrame, spec: dict, ctx) -> DataFrame:
    """Left nest join: the matching foreign documents as an array, in their order; null matches null."""
    right = foreign(spec, ctx)
    if right is None:
        return df.withColumn(spec["as"], F.array())
    if "pipeline" in spec:
        return correlated(df, right, spec, ctx)
    docs = right.select(key_of(right, spec["foreignField"]).alias("__k"), whole(right).alias("__doc"), ORD)
    if FILTERED.search(df._jdf.queryExecution().optimizedPlan().toString()):
        # few local documents: only foreign ones that some of them want are gathered
        wanted = df.select(key_of(df, spec["localField"]).alias("__w")).distinct()
        docs = docs.join(wanted, F.col("__k").eqNullSafe(F.col("__w")), "left_semi")
    nested = docs.groupBy("__k").agg(in_order(F.col("__doc"), F.col(ORD)).alias("__docs"))
    empty = F.array().cast(nested.schema["__docs"].dataType)
    out = df.withColumn("__l", key_of(df, spec["localField"]))
    out = out.join(nested, F.col("__l").eqNullSafe(F.col("__k")), "left")
    return out.withColumn(spec["as"], F.coalesce("__docs", empty)).drop("__l", "__k", "__docs")


def uses(spec, name: str) -> bool:
    return f"$${name}" in repr(spec)


def correlated(df: DataFrame, right: DataFrame, spec: dict, ctx) -> DataFrame:
    """$lookup with let and pipeline.

    Foreign documents are gathered once for every distinct tuple of let values and joined back by it. Conjuncts that
    equate a variable with a foreign expression become join keys; other $expr conditions are the residual. Stages after them
    run for every tuple by itself: $group and $count group by it too. A tuple without documents has an empty array.
    """
    from ..plans import pipeline

    names = list(spec.get("let", {}))
    scope = Scope(df)
    lets = {n: compile_expr(spec["let"][n], scope) for n in names}
    values = df.select(*(c.alias(f"__v{i}") for i, c in enumerate(lets.values()))).distinct() if names else df.sparkSession.range(1).select(F.lit(0).alias("__v0"))
    cols = [f"__v{i}" for i in range(max(1, len(names)))]
    keys, residual, after = [], [], []
    for stage in spec["pipeline"]:
        ((name, body),) = stage.items()
        if name == "$match" and "$expr" in body and not after:
            if plain := {k: v for k, v in body.items() if k != "$expr"}:
                right = pipeline.match(right, plain, ctx)
            conjuncts = body["$expr"]["$and"] if isinstance(body["$expr"], dict) and set(body["$expr"]) == {"$and"} else [body["$expr"]]
            for c in conjuncts:
                sides = c.get("$eq") if isinstance(c, dict) else None
                outer = [isinstance(s, str) and any(s == f"$${n}" for n in names) for s in sides] if sides else [False]
                if sides and sum(outer) == 1 and not any(uses(s, n) for s, o in zip(sides, outer) if not o for n in names):
                    var, other = (sides[0], sides[1]) if outer[0] else (sides[1], sides[0])
                    keys.append((f"__v{names.index(var[2:])}", compile_expr(other, Scope(right))))
                else:
                    residual.append(c)
        elif name in ("$match", "$project", "$addFields", "$set", "$unset", "$unwind") and not after and not residual and not keys:
            right = pipeline.apply(right, [stage], ctx, hidden=True)
        else:
            after.append(stage)
    right = ordered(right)
    flat = right.select("*", *(k.alias(f"__k{i}") for i, (_, k) in enumerate(keys)))
    on = [F.col(v).eqNullSafe(F.col(f"__k{i}")) for i, (v, _) in enumerate(keys)]
    rows = values.join(flat, on, "inner") if on else values.join(flat, F.lit(True))
    if residual:
        rows = rows.where(compile_expr({"$and": residual}, Scope(rows, {n: F.col(f"__v{i}") for i, n in enumerate(names)})))
    rows = rows.drop(*(f"__k{i}" for i in range(len(keys))))
    for stage in after:
        ((name, body),) = stage.items()
        if name == "$sort":
            rows = pipeline.sort(rows, body)
        elif name in ("$limit", "$skip"):
            n = F.row_number().over(W.partitionBy(*cols).orderBy(ORD))
            rows = rows.withColumn("__n", n).where(F.col("__n") <= body if name == "$limit" else F.col("__n") > body).drop("__n")
        elif name in ("$match", "$addFields", "$set", "$unwind", "$unset"):
            rows = pipeline.STAGES[name](rows, body, ctx)
        elif name == "$group":
            rows = pipeline.group(rows, body, within=tuple(cols))
        elif name == "$count":
            rows = pipeline.group(rows, {"_id": None, body: {"$count": {}}}, within=tuple(cols)).drop("_id")
        elif name == "$project":
            kept = pipeline.project(rows.select(F.struct(*(F.col(c) for c in cols)).alias("__v"), *(c for c in rows.columns if c not in cols)), {**body, "__v": 1} if any(v not in (0, False) for k, v in body.items()) else body)
            rows = kept.select("__v.*", *(c for c in kept.columns if c != "__v"))
        else:
            raise ValueError(f"{name} isn't supported inside $lookup")
    doc = F.struct(*(F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")))
    nested = rows.groupBy(*cols).agg(in_order(doc, F.col(ORD)).alias("__docs"))
    empty = F.array().cast(nested.schema["__docs"].dataType)
    if not names:
        out = df.withColumn("__l0", F.lit(0))
    else:
        out = df.withColumns({f"__l{i}": c for i, c in enumerate(lets.values())})
    joined = out.join(nested, [F.col(f"__l{i}").eqNullSafe(F.col(c)) for i, c in enumerate(cols)], "left")
    return joined.withColumn(spec["as"], F.coalesce("__docs", empty)).drop(*cols, "__docs", *(f"__l{i}" for i in range(len(cols))))


def fuse(df: DataFrame, stages: list[dict], ctx):
    """Plain joins for $lookup followed by $unwind of its array, or by a test whether that is empty; else None."""
    spec = stages[0]["$lookup"]
    right = foreign(spec, ctx)
    if right is None or "pipeline" in spec or len(stages) < 2:
        return None
    (name, body), at = next(iter(stages[1].items())), spec["as"]
    left = ordered(df).withColumn("__l", key_of(df, spec["localField"]))
    if name == "$unwind" and at not in df.columns:
        body = {"path": body} if isinstance(body, str) else body
        if body["path"] != f"${at}" or body.get("includeArrayIndex"):
            return None
        docs = right.select(key_of(right, spec["foreignField"]).alias("__k"), whole(right).alias(at), F.col(ORD).alias("__o"))
        how = "left" if body.get("preserveNullAndEmptyArrays") else "inner"
        out = left.join(docs, F.col("__l").eqNullSafe(F.col("__k")), how)
        return out.withColumn(ORD, F.struct(F.col(ORD).alias("was"), F.col("__o").alias("at"))).drop("__l", "__k", "__o"), 2
    if name == "$match" and isinstance(body, dict) and (inner := inner_test(body, at)) and leaves_behind(stages[2:], at):
        from ..plans import pipeline

        # some document of the array holds the value: a semi join with those that do
        keys = right.where(pipeline.predicate(inner, right)).select(key_of(right, spec["foreignField"]).alias("__k"))
        return left.join(keys, F.col("__l").eqNullSafe(F.col("__k")), "left_semi").drop("__l"), 2
    if name == "$match" and isinstance(body, dict) and set(body) == {at} and body[at] in ([], {"$ne": []}, {"$eq": []}):
        anti = body[at] != {"$ne": []}
        if not anti and not leaves_behind(stages[2:], at):
            return None
        keys = right.select(key_of(right, spec["foreignField"]).alias("__k"))
        out = left.join(keys, F.col("__l").eqNullSafe(F.col("__k")), "left_anti" if anti else "left_semi").drop("__l")
        doc = T.ArrayType(right.select(whole(right).alias("d")).schema["d"].dataType)
        return (out.withColumn(at, F.array().cast(doc)) if anti else out), 2
    return None


def inner_test(body: dict, at: str) -> dict | None:
    """The filter for single foreign documents, if body is one positive test of a field inside the array."""
    ((key, value), *more) = body.items()
    if more or not isinstance(key, str) or not key.startswith(f"{at}."):
        return None
    if isinstance(value, dict):
        positive = len(value) == 1 and set(value) <= {"$eq", "$in", "$gt", "$gte", "$lt", "$lte"}
        operands = next(iter(value.values())) if positive else None
    else:
        positive, operands = not isinstance(value, (list, tuple)), value
    if not positive or operands is None or isinstance(operands, dict) or isinstance(operands, (list, tuple)) and None in operands:
        return None
    return {key[len(at) + 1 :]: value}


def leaves_behind(stages: list[dict], at: str) -> bool:
    """Whether later stages drop the array before anything reads it."""
    for stage in stages:
        if at in repr(stage):
            return False
        ((name, body),) = stage.items()
        if name in ("$group", "$count") or name == "$project" and any(v not in (0, False) for v in body.values()):
            return True
    return False


def fields_read(stages: list[dict], at: str) -> set[str] | None:
    """Fields of the documents in the array that later stages read; None: whole documents, or not known."""
    if not stages or "." in at:
        return None
    ((name, body),) = stages[0].items()
    if not isinstance(body, dict) or name == "$project" and not any(v not in (0, False) for v in body.values()) or name not in ("$project", "$group"):
        return None
    if name == "$project" and any(k.split(".")[0] == at for k in body):
        return None
    found: set[str] = set()

    def known(x) -> bool:
        if isinstance(x, str):
            if x.startswith(f"${at}."):
                found.add(x.split(".")[1])
            return x != f"${at}" and not x.startswith("$$")
        if isinstance(x, dict):
            return x == {"$size": f"${at}"} or all(map(known, x.values()))
        return all(map(known, x)) if isinstance(x, (list, tuple)) else True

    return found if known(body) else None


def graph_lookup(df: DataFrame, spec: dict, ctx, fields: set[str] | None = None) -> DataFrame:
    """Breadth-first search for all distinct starting values together; a document's depth is that of its value.

    ``chains`` answers where values lead to one value each and all that are reached are starts themselves, ``levels`` elsewhere.
    fields: what later stages read of the documents, if not all.
    """
    from ..plans import pipeline

    df, right = ordered(df), foreign(spec, ctx)
    at, limit, named = spec["as"], spec.get("maxDepth"), spec.get("depthField")
    if right is None:
        return df.withColumn(at, F.array())
    if where := spec.get("restrictSearchWithMatch"):
        right = pipeline.match(right, where, ctx)
    if pipeline.WIDE.search(right._jdf.queryExecution().optimizedPlan().toString()):
        right = checkpoint(right)
    kept = [c for c in right.columns if not c.startswith("__") and (fields is None or c in fields)]

    def doc(depth, row=None):
        cols = {c: F.col(f"`{c}`") if row is None else row.getField(c) for c in kept}
        if named and (fields is None or named in fields):
            cols[named] = depth.cast("bigint")
        return F.struct(*(c.alias(n) for n, c in (cols or {"__none": F.lit(0)}).items()))

    empty = F.array().cast(T.ArrayType(right.select(doc(F.lit(0)).alias("d")).schema["d"].dataType))
    start = compile_expr(spec["startWith"], Scope(df))
    to, start_kind = resolve(right.schema, spec["connectToField"]), Scope(df).type_of(start)
    if to is None or T.NullType() in (to[1], start_kind) or limit is not None and limit < 0:
        return df.withColumn(at, empty)
    link, link_kind = resolve(right.schema, spec["connectFromField"]) or (F.lit(None), T.NullType())
    docs = right.select(to[0].alias("to"), (link if isinstance(link_kind, T.ArrayType) else F.array(link)).alias("onward"), F.col(ORD).alias("o"), F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in kept)).alias("doc")).where("to is not null")
    tos = docs.groupBy("to").agg(F.count(F.lit(1)).alias("n"))

    def reaching(rows: DataFrame) -> DataFrame:
        """Distinct rows with the documents' value (to) that their value equals; those that equal none go."""
        rows = rows.where("value is not null").distinct()
        return rows.join(tos.select("to"), F.col("value") == F.col("to")).drop("value")

    links = stored(reaching(docs.select(F.col("to").alias("of"), F.explode("onward").alias("value"))))
    starts = df.select(start.alias("start")).where("start is not null").distinct()
    many = isinstance(start_kind, T.ArrayType)
    first = stored(reaching(starts.select("start", (F.explode("start") if many else F.col("start")).alias("value"))))
    paths = chains(first.select("to").distinct(), links, limit)
    if paths is not None and not kept and not many and tos.agg(F.max("n")).first()[0] == 1:
        # nothing is read of the documents, each value has one: the paths say all
        paths = paths.withColumnRenamed("to", "start") if start_kind == to[1] else first.join(paths, "to")
        nested = paths.select("start", F.transform("path", lambda x, i: doc(i)).alias("__docs"))
    else:
        if paths is not None:
            pairs = first.join(paths, "to").select("start", F.posexplode("path").alias("depth", "to"))
            pairs = pairs.groupBy("start", "to").agg(F.min("depth").alias("depth")) if many else pairs
        else:
            pairs = levels(first, links, limit)
        rows = pairs.join(docs.select("to", "o", "doc"), "to").repartition("start")
        nested = rows.groupBy("start").agg(in_order(doc(F.col("depth"), F.col("doc")), F.struct("depth", "o")).alias("__docs"))
    out = df.withColumn("__start", start).join(nested, F.col("__start") == F.col("start"), "left")
    return out.withColumn(at, F.coalesce("__docs", empty)).drop("__start", "start", "__docs")


def chains(values: DataFrame, links: DataFrame, limit: int | None) -> DataFrame | None:
    """(to, path: the values from to on, each at its depth); None if some value leads to several, or out of the values.

    Paths double: every round appends, to each that isn't at its end, the path of the value after its last. So there is one round
    for a depth twice as large, and paths are no more than the result. One that comes back to a value of its own ends there.
    """
    ahead = links.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("then")).withColumnRenamed("of", "to")
    ahead = stored(values.join(ahead, "to", "left"))
    if (ahead.agg(F.max("n")).first()[0] or 0) > 1 or not ahead.where("then is not null").select("then").distinct().join(values, F.col("then") == F.col("to"), "left_anti").isEmpty():
        return None

    def cut(path, then) -> list:
        if limit is not None:
            path, then = F.slice(path, 1, limit + 1), F.when(F.size(path) <= limit, then)
        return [path.alias("path"), then.alias("then")]

    paths, ended = ahead.select("to", *cut(F.array("to"), F.col("then"))), None
    while True:
        done, paths = paths.where("then is null"), paths.where("then is not null")
        ended = done if ended is None else ended.unionByName(done)
        if paths.isEmpty():
            return ended.select("to", "path")
        # as files, the few that are wanted are seen to be small, and then no path moves
        wanted = stored(paths.select("then").distinct())
        more = stored(ended.unionByName(paths).join(wanted.select(F.col("then").alias("to")), "to", "left_semi").select(F.col("to").alias("next"), F.col("path").alias("more"), F.col("then").alias("beyond")))
        rows = paths.join(more, F.col("then") == F.col("next"))
        round_trip = F.arrays_overlap("path", "more")
        path = F.when(round_trip, F.array_distinct(F.concat("path", "more"))).otherwise(F.concat("path", "more"))
        paths = stored(rows.select("to", *cut(path, F.when(~round_trip, F.col("beyond")))))


def levels(first: DataFrame, links: DataFrame, limit: int | None) -> DataFrame:
    """(start, to, depth), level by level.

    What was reached before is taken out by an anti join once as much has come since the last one as there was then: all of
    these together read a few times what there is, however deep the graph. In between values may come again, deeper.
    """
    found, reached, depth, clean, since, again = None, first.select("start", "to"), 0, 0, 0, False
    while True:
        level = reached.select("start", "to", F.lit(depth).alias("depth"))
        n = level.count()
        if found is not None and not n:
            break
        found = level if found is None else found.unionByName(level)
        since += n
        if not n or limit is not None and depth >= limit:
            break
        new = reached.withColumnRenamed("to", "of").join(links, "of").select("start", "to").distinct()
        if since >= clean:
            new, clean, since = new.join(found.select("start", "to"), ["start", "to"], "left_anti"), clean + since, 0
        else:
            again = True
        reached, depth = stored(new), depth + 1
    return found.groupBy("start", "to").agg(F.min("depth").alias("depth")) if again else found
