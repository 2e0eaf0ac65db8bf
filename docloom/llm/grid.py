"""Vectors in packed blocks, and every block of queries against every block of points.

Rows that repeat both vec_id and vector become one point with their number, by an aggregate that combines before it
shuffles. Points are dealt by a hash of both into blocks of about ``per_block``; a block is indexed in one task and
kept as one row (its packed index). Query points are packed into parts of about ``per_part``. An index goes once to the
task of its block, where the parts follow it one by one: memory holds one index and one part. Only where there are more
than ``per_lane`` parts is a block's work dealt to several tasks, each with a copy of the index. A query's best of each
block meet in a window per query. Nothing depends on how the input's files are split.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, small_batches


def clean(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, embedding of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return rows.where(F.exists(x, lambda v: v != 0)) if nonzero else rows


def points_of(rows: DataFrame) -> DataFrame:
    """vec_id, x (array<double>), dim, n (how many rows are this point)."""
    found = rows.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("n"))
    return found.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.size("embedding").alias("dim"), "n")


def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, how many rows each stands for, vectors; in order of id, then vector."""
    ids, n = t.column("vec_id").to_numpy(), t.column("n").to_numpy()
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("x").chunks]).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*x.T[::-1], ids))
    return ids[order], n[order], x[order]


def short(x: np.ndarray) -> np.ndarray:
    """The same numbers in 32 bits, if they all fit."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y if (y == x).all() else x


def packed(points: DataFrame, number: Column, build: Callable, name: str) -> DataFrame:
    """A row per dim and number with the pickled outcome of build(ids, n, vectors)."""

    def one(t: pa.Table) -> pa.Table:
        data = pickle.dumps(build(*arrays(t)), protocol=5)
        return pa.table({"dim": pa.array([t.column("dim")[0].as_py()], pa.int32()), name: pa.array([t.column(name)[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    keyed = points.withColumn(name, number.cast("int"))
    return keyed.groupBy("dim", name).applyInArrow(one, f"dim int, {name} int, data binary")


def own_place(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray) -> int:
    """The place of the query's own point in a block, -1 if it is elsewhere."""
    for at in np.flatnonzero(ids == query_id):
        if (x[at] == q).all():
            return int(at)
    return -1


def expanded(places: np.ndarray, n: np.ndarray, own: int, k: int) -> np.ndarray:
    """The first k rows of points in order: a point that stands for many rows comes as often, the query's own once less."""
    times = n[places] - (places == own)
    return np.repeat(places, np.minimum(times, k))[:k]


def search(vectors: DataFrame, k: int, every: int, build: Callable, look: Callable, nonzero: bool, score: str, per_block: int = 16384, per_part: int = 1024, per_lane: int = 64, label: str = "grid") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query (row whose vec_id is divisible by ``every``), ties to smaller ids.

    build(ids, n, vectors) indexes a block; look(index, ids, n, vectors) gives (query's number, ids, scores) of the best k
    rows of it. A query's candidates are all rows but its own, so rows that repeat a vec_id are candidates of each other,
    and each is a query. Vectors are only compared to those of equal length.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, label)
    rows = clean(vectors, nonzero)
    is_query = F.col("vec_id") % every == 0
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, parts = max(1, -(-total // per_block)), max(1, -(-asked // per_part))
    lanes = -(-parts // per_lane)
    spread = F.xxhash64("vec_id", "x")
    index = scratch.save(packed(points_of(rows), F.pmod(spread, F.lit(blocks)), build, "block"), "index")
    queries = scratch.save(packed(points_of(rows.where(is_query)), F.pmod(spread, F.lit(parts)), lambda ids, n, x: (ids, n, short(x)), "part"), "queries")
    # a copy of each index for every lane; small parts go to every block
    held = index.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).alias("part"), "data")
    coming = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (F.col("part") % lanes).alias("lane"), "part", "data")
    dealt = held.unionByName(coming).repartition(max(1, min(2 * blocks * lanes, 20_000)), "dim", "block", "lane").sortWithinPartitions("dim", "block", "lane", "part")
    kind = pa.int64() if score == "long" else pa.float64()

    def found(batches):
        at, now = None, None
        for batch in batches:
            for dim, block, lane, part, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "lane", "part", "data"))):
                if part < 0:
                    at, now = (dim, block, lane), pickle.loads(data)
                elif at == (dim, block, lane):
                    ids, n, x = pickle.loads(data)
                    q, near, scores = look(now, ids, n, x)
                    q = np.asarray(q, np.int64)
                    cols = [pa.array(dim * (parts << 32) + (part << 32) + q, pa.int64()), pa.array(ids[q], pa.int64()), pa.array(n[q], pa.int64()), pa.array(near, pa.int64()), pa.array(scores, kind)]
                    yield pa.RecordBatch.from_arrays(cols, ["asker", "query_id", "times", "vec_id", "score"])

    with small_batches(spark, 1):
        best = scratch.save(dealt.mapInArrow(found, f"asker long, query_id long, times long, vec_id long, score {score}"), "best")
    scratch.drop("index", "queries")
    rank = F.row_number().over(W.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id"))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
