"""Approximate nearest neighbours by collision counting with query-centred windows.

Each of 64 hash functions is one projection; per block and projection the points' projections are kept as a sorted array
with their rows. A query takes, in every array, the window around its own projection, widens all windows step by
step (virtual rehashing) and counts for every point in how many windows it lies. A point that reaches the
collision threshold is verified: its inner product with the query is computed from the original vectors. Widening ends when
``share`` of the block, and no fewer than LEAST times k, have been verified, or the windows hold everything.

The largest inner product is the smallest distance once a coordinate is added that gives all points of a block one
norm and queries are scaled to it. Projections are taken in orthogonal groups, from a fixed seed. Every row is indexed.

First windows are wide. On directions without structure the nearest of 16 384 points of 64 dimensions have about a third of
the query's projections only; what tells them apart is that they are seldom far off. Points that must be verified for a
recall of 0.95, by the share of points that a window holds: 0.05: 0.88 of the block, 0.2: 0.66, 0.4: 0.36, 0.6: 0.15,
0.8: 0.07, 0.9: 0.12. So windows begin at 0.8, and the few points outside are counted.

Cases: vectors that are null, zero or hold null or non-finite components take no part. Ties go to the smaller vec_id.
Rows that repeat a vec_id are queries and candidates each (see grid.search). Blocks depend on ids and vectors alone, so
results don't change with the split of the input's files. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import grid

HASHES, THRESHOLD, SHARE, LEAST = 64, 56, 0.25, 25
#: The share of points that a query's first windows hold.
FIRST = 0.8
#: Queries that are counted together.
TOGETHER = 256


def projections(dim: int) -> np.ndarray:
    rng = np.random.default_rng(dim)
    groups = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-HASHES // dim))]
    return np.concatenate(groups)[:HASHES]


def build(ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> dict:
    norms = np.sqrt((x * x).sum(1))
    top = norms.max()
    y = np.concatenate((x / top, np.sqrt(np.maximum(1 - (norms / top) ** 2, 0))[:, None]), 1)
    hashes = (y @ projections(y.shape[1]).T).T.astype(np.float32)
    order = np.argsort(hashes, axis=1, kind="stable").astype(np.uint16 if len(ids) <= 2**16 else np.uint32)
    return {"ids": ids, "n": n, "x": grid.short(x), "order": order, "sorted": np.take_along_axis(hashes, order.astype(np.intp), 1)}


def candidates(index: dict, hashed: np.ndarray, enough: int, threshold: int) -> list[np.ndarray]:
    """For each query (a row of hashed) the rows of the points that reach the threshold; queries widen together.

    A first window holds most of the points, so the points outside are counted, and taken from all HASHES.
    """
    order, keys = index["order"].astype(np.intp), index["sorted"]
    n, m = order.shape[1], len(hashed)
    sample = keys[:, :: max(1, n // 64)]
    away = np.abs(sample[:, None, :] - hashed.T[:, :, None])
    width = np.quantile(away, FIRST, axis=(0, 2)).astype(np.float32) + np.float32(1e-7)
    begin, end = np.zeros((HASHES, m), np.intp), np.full((HASHES, m), n, np.intp)
    for j in range(HASHES):
        begin[j], end[j] = np.searchsorted(keys[j], hashed[:, j] - width, "left"), np.searchsorted(keys[j], hashed[:, j] + width, "right")
    counts = np.empty((m, n), np.int16)
    for q in range(m):
        outside = [order[j, : begin[j, q]] for j in range(HASHES)] + [order[j, end[j, q] :] for j in range(HASHES)]
        counts[q] = HASHES - np.bincount(np.concatenate(outside), minlength=n)
    out: list[np.ndarray] = [np.zeros(0, np.intp)] * m
    waiting = np.arange(m)
    while len(waiting):
        left = []
        for q in waiting.tolist():
            out[q] = np.flatnonzero(counts[q] >= threshold)
            if len(out[q]) < enough and not ((begin[:, q] == 0).all() and (end[:, q] == n).all()):
                left.append(q)
        waiting = np.array(left, np.intp)
        if not left:
            break
        width[waiting] *= np.float32(1.08)
        was_begin, was_end = begin[:, waiting].copy(), end[:, waiting].copy()
        for j in range(HASHES):
            begin[j, waiting] = np.minimum(was_begin[j], np.searchsorted(keys[j], hashed[waiting, j] - width[waiting], "left"))
            end[j, waiting] = np.maximum(was_end[j], np.searchsorted(keys[j], hashed[waiting, j] + width[waiting], "right"))
        for k, q in enumerate(left):
            rings = [order[j, begin[j, q] : was_begin[j, k]] for j in range(HASHES)] + [order[j, was_end[j, k] : end[j, q]] for j in range(HASHES)]
            counts[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.int16)
    return out


def look(index: dict, ids: np.ndarray, n: np.ndarray, x: np.ndarray, k: int, threshold: int = THRESHOLD, share: float = SHARE):
    """Numbers of the queries, ids and scores of their k nearest rows of the block."""
    size, points = len(index["ids"]), index["x"].astype(np.float64)
    enough = min(size, max(LEAST * k, int(np.ceil(share * size))) + 1)
    out: tuple[list, list, list] = ([], [], [])
    x = x.astype(np.float64)
    lengths = np.sqrt((x * x).sum(1))[:, None]
    hashed = (np.concatenate((x / lengths, np.zeros((len(x), 1))), 1) @ projections(x.shape[1] + 1).T).astype(np.float32)
    for begin in range(0, len(x), TOGETHER):
        for number, met in enumerate(candidates(index, hashed[begin : begin + TOGETHER], enough, threshold), begin):
            own = grid.own_place(index["ids"], points, ids[number], x[number])
            met = met[met != own] if own >= 0 and index["n"][own] == 1 else met
            scores = points[met] @ x[number]
            if len(met) > k:
                # all that tie with the k-th stay for the order by id
                near = scores >= np.partition(scores, -k)[-k]
                met, scores = met[near], scores[near]
            order = np.lexsort((index["ids"][met], -scores))[:k]
            rows = grid.expanded(met[order], index["n"], own, k)
            score = dict(zip(met[order].tolist(), scores[order].tolist()))
            for got, more in zip(out, ([number] * len(rows), index["ids"][rows].tolist(), [score[p] for p in rows.tolist()])):
                got += more
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    return grid.search(vectors, k, every, build, lambda index, ids, n, x: look(index, ids, n, x, k), True, "double", label="lsh")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
