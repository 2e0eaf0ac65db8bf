"""A lazy find cursor: sort, skip, limit and projection apply in that order, however they were called."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans import pipeline
from ..plans.order import ORD, ordered
from ..plans.paths import resolve


class Results:
    """What both cursors offer over their dataframe(); ``timed`` gives a context in which an action runs."""

    timed: Callable = staticmethod(contextlib.nullcontext)

    def dataframe(self) -> DataFrame:
        raise NotImplementedError

    def all(self) -> list:
        with self.timed():
            return self.dataframe().collect()

    def toArray(self) -> list:  # noqa: N802
        return self.all()

    def first(self):
        with self.timed():
            rows = self.dataframe().limit(1).collect()
        return rows[0] if rows else None

    def count(self) -> int:
        with self.timed():
            return self.dataframe().count()

    def __iter__(self):
        with self.timed():
            yield from self.dataframe().toLocalIterator()

    def __len__(self) -> int:
        return self.count()

    def __getitem__(self, i):
        """Rows by place, or a list by a slice; no more are fetched than up to there, unless it counts from the end."""
        if isinstance(i, int) and i >= 0:
            rows = self.dataframe().offset(i).limit(1).collect()
            if not rows:
                raise IndexError(i)
            return rows[0]
        if isinstance(i, slice) and i.stop is not None and i.stop >= 0 and (i.start or 0) >= 0 and (i.step or 1) > 0:
            begin = i.start or 0
            return self.dataframe().offset(begin).limit(max(0, i.stop - begin)).collect()[:: i.step or 1]
        return self.all()[i]


class AggregationCursor(Results):
    """The result of a pipeline."""

    def __init__(self, df: DataFrame, timed: Callable | None = None):
        self.df, self.timed = df, timed or self.timed

    def dataframe(self) -> DataFrame:
        return self.df


class Cursor(Results):
    def __init__(self, df: DataFrame, spec: dict | None = None, projection: dict | None = None, order: list[str] | None = None, timed: Callable | None = None):
        self.timed = timed or self.timed
        self.matched = pipeline.match(ordered(df, order), spec or {}, None)
        self._sort, self._skip, self._limit, self._project, self._near = [], 0, 0, projection, None
        for key, value in (spec or {}).items():
            if isinstance(value, dict) and "$near" in value:
                near = value["$near"]
                self.near(key, near.get("$geometry", near) if isinstance(near, dict) else near, value.get("$maxDistance"), value.get("$minDistance"))

    def sort(self, key, direction: int = 1) -> Cursor:
        self._sort = list(key) if isinstance(key, (list, tuple)) else [*self._sort, (key, direction)]
        return self

    def skip(self, n: int) -> Cursor:
        self._skip = n
        return self

    def limit(self, n: int) -> Cursor:
        self._limit = n
        return self

    def projection(self, spec: dict) -> Cursor:
        self._project = spec
        return self

    def near(self, field: str, point, max_distance: float | None = None, min_distance: float | None = None) -> Cursor:
        self._near = (field, point, max_distance, min_distance)
        return self

    def dataframe(self) -> DataFrame:
        df = self.matched
        if self._near:
            field, point, most, least = self._near
            found = resolve(df.schema, field)
            name = f"_geo_distance_{field.replace('.', '_')}"
            away = geo.distance(geo.point_of(*found), geo.literal_point(point)) if found else F.lit(None).cast("double")
            if found and most is not None:
                df = df.where(geo.around(geo.point_of(*found), geo.literal_point(point), most))
            df = df.withColumn(name, away).where(F.col(name).isNotNull())
            df = df.where(F.col(name) <= most) if most is not None else df
            df = df.where(F.col(name) >= least) if least is not None else df
            df = pipeline.sort(df, [(name, 1)])
        elif self._sort:
            df = pipeline.sort(df, self._sort)
        elif self._skip or self._limit:
            df = df.orderBy(ORD)
        df = df.offset(self._skip) if self._skip else df
        df = df.limit(self._limit) if self._limit else df
        df = pipeline.project(df, self._project) if self._project else df
        return df.drop(ORD)

    def count(self) -> int:
        """Matches before skip and limit."""
        with self.timed():
            return self.matched.count()


def distinct(df: DataFrame, key: str, spec: dict | None = None) -> DataFrame:
    """The distinct values at a path, nulls included, in order of first appearance."""
    df = pipeline.match(ordered(df), spec or {}, None)
    found = resolve(df.schema, key)
    col = found[0] if found else F.lit(None)
    return df.groupBy(col.alias(key.replace(".", "_"))).agg(F.min(ORD).alias(ORD)).orderBy(ORD).drop(ORD)
