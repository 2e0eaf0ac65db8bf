"""Exact top-k by inner product with an M-tree and best-first search.

The largest inner product is the smallest distance once a coordinate is added that gives all points one norm M:
|q - x|^2 = |q|^2 + M^2 - 2 q.x. Over such points each block holds an M-tree: inner nodes are pages of routing
objects with covering radii and distances to their parent, leaves are pages of points with distances to their
routing object. A query goes to the node with the smallest lower bound first; by the triangle inequality and
the stored distances it skips subtrees and points without computing their distance. Bounds carry a slack for
rounding, scores are whole numbers, so the result is exact.

Components are scaled and rounded down to whole numbers. Sums of products are computed in the shortest numbers that hold
them all: 32 or 64-bit floats, 64-bit integers, or Python's own integers for components of any size.

Cases: vectors that are null, or hold null or non-finite components, take no part. Ties go to the smaller vec_id. Rows
that repeat a vec_id are queries and candidates each (see grid.search). A score beyond the range of a long is given as
the nearest long; scores that are cut so count as ties. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from . import grid

LEAF, FANOUT = 512, 16
LEAST_LONG, LARGEST_LONG = -(2**63), 2**63 - 1


def distances(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - c) ** 2).sum(1), 0))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: as floats, or as Python's integers where components are too large. scale is a power of two."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**500:
        return np.floor(x * scale)
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in row] for row in x.tolist()], object)


def largest(x: np.ndarray) -> int:
    return max(1, int(np.abs(x).max())) if x.size else 1


def build(ids: np.ndarray, n: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Pages of an M-tree, loaded top down: a node's points go to the nearest of up to FANOUT drawn routing objects.

    Distances are taken in units of the largest component.
    """
    unit = largest(x)
    y = (x / unit).astype(np.float64)
    norms = (y * y).sum(1)
    top = norms.max()
    aug = np.concatenate((y, np.sqrt(np.maximum(top - norms, 0))[:, None]), 1)
    rng = np.random.default_rng(len(ids))
    nodes: list[dict] = []
    placed: list[np.ndarray] = []

    def page(rows: np.ndarray, center: np.ndarray | None) -> int:
        at = len(nodes)
        nodes.append({})
        if len(rows) <= leaf:
            away = distances(center, aug[rows]) if center is not None else np.zeros(len(rows))
            order = np.argsort(away, kind="stable")
            # the points of a page lie together
            begin = sum(map(len, placed))
            placed.append(rows[order])
            nodes[at] = {"rows": slice(begin, begin + len(rows)), "away": away[order]}
            return at
        chosen = rng.choice(rows, max(2, min(FANOUT, -(-2 * len(rows) // leaf))), replace=False)
        every = np.stack([distances(aug[c], aug[rows]) for c in chosen])
        near = every.argmin(0)
        if (near == near[0]).all():  # copies: cut the page by number
            near = np.arange(len(rows)) * len(chosen) // len(rows)
        used = [j for j in range(len(chosen)) if (near == j).any()]
        children = [page(rows[near == j], aug[chosen[j]]) for j in used]
        centers = aug[chosen[used]]
        nodes[at] = {
            "children": children, "centers": centers,
            "radius": np.array([every[j][near == j].max() for j in used]),
            "away": distances(center, centers) if center is not None else np.zeros(len(used)),
        }
        return at

    page(np.arange(len(ids)), None)
    order = np.concatenate(placed)
    return {"ids": ids[order], "n": n[order], "x": x[order] if x.dtype == object else grid.short(x[order]), "unit": unit, "top": top, "nodes": nodes}


def search_one(tree: dict, query_id: int, q: np.ndarray, k: int) -> tuple[list[int], list[int], int]:
    """ids and scores of the k best rows but the query's own, and how many inner products were computed. x and q are of one kind."""
    x, ids, nodes, unit = tree["x"], tree["ids"], tree["nodes"], tree["unit"]
    # Python's integers may be too large for the floats of the bounds: then all points are looked at
    bounded = x.dtype != object
    target = np.append(q / unit, 0).astype(float) if bounded else np.zeros(x.shape[1] + 1)
    base = float(target @ target) + float(tree["top"])
    slack = 1e-6 * (1 + np.sqrt(base))
    own = grid.own_place(ids, x, query_id, q)
    alone = own if own >= 0 and tree["n"][own] == 1 else -1
    places, best = np.zeros(0, np.int64), np.zeros(0, object if not bounded else np.int64)
    bound, computed = np.inf, 0
    heap: list[tuple[float, int, float]] = [(0.0, 0, np.nan)]
    while heap:
        low, at, to_parent = heapq.heappop(heap)
        if low > bound:
            break
        node = nodes[at]
        if "rows" in node:
            page = np.arange(node["rows"].start, node["rows"].stop)
            if not np.isnan(to_parent) and bound < np.inf:
                near = np.abs(node["away"] - to_parent) <= bound + slack
                n = np.count_nonzero(near)
                if not n:
                    continue
                page = page if n > 0.6 * len(near) else page[near]
            computed += len(page)
            found = x[node["rows"]] @ q if len(page) == node["rows"].stop - node["rows"].start else x[page] @ q
            found = found.astype(np.int64) if bounded else np.array([min(max(int(s), LEAST_LONG), LARGEST_LONG) for s in found], object)
            ok = page != alone
            if len(best) == k:
                ok &= (found >= best[-1]).astype(bool)
            if not ok.any():
                continue
            places, best = np.concatenate((places, page[ok])), np.concatenate((best, found[ok]))
            order = np.lexsort((ids[places], -best)) if bounded else np.array(sorted(range(len(best)), key=lambda i: (-best[i], ids[places[i]])))
            order = order[:k]
            places, best = places[order], best[order]
            if len(best) == k and bounded:
                bound = np.sqrt(max(base - 2 * float(best[-1]) / unit / unit, 0)) + slack
            continue
        open_ = np.ones(len(node["radius"]), bool)
        if not np.isnan(to_parent):
            open_ = np.abs(node["away"] - to_parent) - node["radius"] <= bound + slack
        picked = np.flatnonzero(open_)
        away = distances(target, node["centers"][picked])
        lower = np.maximum(away - node["radius"][picked] - slack, 0) if bounded else np.zeros(len(picked))
        for j, d, b in zip(picked.tolist(), away.tolist(), lower.tolist()):
            if b <= bound:
                heapq.heappush(heap, (b, node["children"][j], d))
    rows = grid.expanded(places, tree["n"], own, k)
    score = dict(zip(places.tolist(), best.tolist()))
    return ids[rows].tolist(), [score[p] for p in rows.tolist()], computed


def look(tree: dict, ids: np.ndarray, x: np.ndarray, k: int = 5):
    most = largest(tree["x"]) * largest(x) * x.shape[1]
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
    if kind is object:
        tree, x = tree | {"x": exact(tree["x"])}, exact(x)
    else:
        tree, x = tree | {"x": tree["x"].astype(kind)}, x.astype(kind)
    out: tuple[list, list, list] = ([], [], [])
    for number, (query_id, q) in enumerate(zip(ids.tolist(), x)):
        found, scores, _ = search_one(tree, query_id, q, k)
        for got, more in zip(out, ([number] * len(found), found, scores)):
            got += more
    return out


def exact(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object)


def top(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    return grid.search(vectors, k, every, lambda ids, n, x: build(ids, n, whole(x, scale)), lambda tree, ids, n, x: look(tree, ids, whole(x, scale), k), False, "long", label="mtree")


def query(spark, sf_dir: str) -> DataFrame:
    return top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
