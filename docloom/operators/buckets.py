"""$bucket and $bucketAuto."""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expressions import Scope, accumulator, compile_expr
from ..plans.order import ORD, ordered
from ..plans.paths import literal


def bucket(df: DataFrame, spec: dict, ctx=None) -> DataFrame:
    """Buckets [b0, b1), [b1, b2), ...; what is outside goes to ``default``, whose bucket is there even if empty."""
    df = ordered(df)
    scope, bounds = Scope(df), sorted(spec["boundaries"])
    value = compile_expr(spec["groupBy"], scope)
    place = F.lit(None).cast("int")
    for i in reversed(range(len(bounds) - 1)):
        place = F.when((value >= literal(bounds[i])) & (value < literal(bounds[i + 1])), i).otherwise(place)
    has_default = "default" in spec
    if has_default:
        place = F.coalesce(place, F.lit(len(bounds) - 1))
    output = spec.get("output") or {"count": {"$count": {}}}
    aggs = [accumulator(v, scope).alias(k) for k, v in output.items()]
    rows = df.withColumn("__place", place)
    out = rows.where("__place is not null").groupBy("__place").agg(*aggs)
    if has_default:
        rows = rows.where(F.col("__place") == len(bounds) - 1)
        out = out.where(F.col("__place") != len(bounds) - 1).unionByName(rows.agg(F.lit(len(bounds) - 1).alias("__place"), *aggs))
    labels = [*bounds[:-1], *([spec["default"]] if has_default else [])]
    kinds = {str if isinstance(x, str) else bool if isinstance(x, bool) else float for x in labels}
    named = F.lit(None)
    for i, x in enumerate(labels):
        named = F.when(F.col("__place") == i, literal(x).cast("string") if len(kinds) > 1 else literal(x)).otherwise(named)
    return out.select(named.alias("_id"), *output, F.struct(F.col("__place").alias("k0")).alias(ORD))


#: Steps of the granularity series, within a decade.
SERIES = {
    "R5": [1, 2, 5],
    "R10": [1],
    "R20": [1, 2, 4, 5],
    "R40": [1, 2, 2.5, 4, 5],
    "R80": [1, 1.25, 1.5, 2, 2.5, 3, 4, 5, 6, 8],
    "R128": [1, 1.25, 1.6, 2, 2.5, 3.15, 4, 5, 6.3, 8],
    "R256": [1, 1.12, 1.25, 1.4, 1.6, 1.8, 2, 2.24, 2.5, 2.8, 3.15, 3.55, 4, 4.5, 5, 5.6, 6.3, 7.1, 8, 9],
}


def width_of(span: float, buckets: int, granularity: str | None) -> float:
    """The buckets' common width; with a granularity the nearest step of its series in the decade that holds the width."""
    width = span / buckets
    if granularity is None:
        return width
    unit = 10.0 ** math.floor(math.log10(width))
    steps = [unit * x for x in SERIES.get(granularity, [1])]
    return steps[bisect.bisect([(a + b) / 2 for a, b in itertools.pairwise(steps)], width)]


def edges(low: float, high: float, buckets: int, granularity: str | None = None) -> list[float]:
    """Ends of the buckets, ascending from the smallest value; the last lies a thousandth of the range above the largest.

    Values that are all equal get one bucket of width 1. A rounded width may leave the last bucket wider than the others, or
    reach past the largest value: the last end never lies under the one before it.
    """
    span = high - low
    if not span:
        return [low, low + 1]
    width = width_of(span, buckets, granularity)
    inner = [low + width * k for k in range(buckets)]
    return [*inner, max(high + span / 1000, inner[-1])]


def bucket_auto(df: DataFrame, spec: dict, ctx=None) -> DataFrame:
    """Two passes: the range of the values, then a group by bucket; a value on an edge belongs to the lower bucket."""
    df = ordered(df)
    scope = Scope(df)
    value = compile_expr(spec["groupBy"], scope)
    output = {"count": {"$count": {}}} | (spec.get("output") or {})
    if not isinstance(scope.type_of(value), T.NumericType):
        value = F.lit(None).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    bounds = edges(low, high, spec["buckets"], spec.get("granularity")) if low is not None else [0.0, 1.0]
    bounds = [float(b) for b in bounds]
    place = F.when(value.isNotNull(), len(bounds) - 2)
    for i in reversed(range(len(bounds) - 1)):
        place = F.when((value >= bounds[i]) & (value <= bounds[i + 1]), i).otherwise(place)
    # inside a bucket documents are in order of their values
    rows = df.withColumns({"__place": place, ORD: F.struct(value.alias("v"), F.col(ORD).alias("was"))}).where("__place is not null")
    scope = Scope(rows)
    out = rows.groupBy("__place").agg(*(accumulator(v, scope).alias(k) for k, v in output.items()))
    ident = F.struct(F.element_at(F.array(*map(F.lit, bounds)), F.col("__place") + 1).alias("min"), F.element_at(F.array(*map(F.lit, bounds)), F.col("__place") + 2).alias("max"))
    return out.select(ident.alias("_id"), *output, F.struct(F.col("__place").alias("k0")).alias(ORD))
