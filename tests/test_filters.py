"""Filters against a two-valued evaluator, and a small fixture."""

import random

import pytest
from docloom.plans.filters import FilterError, rowwise, vectorised
from docloom.plans.pipeline import predicate

HENS = [("Mabel", 12, None), ("Dot", 9, None), ("Amabella", 6, None), ("Hetty", 20, 4), ("Pip", None, 4), ("Una", None, None)]


def multiple(v, by):
    return v % by == 0


@pytest.fixture(scope="module")
def hens(spark):
    return spark.createDataFrame(HENS, "name string, eggs bigint, pen bigint").cache()


@pytest.mark.parametrize(
    "spec, n",
    [
        ({}, 6), ({"eggs": {"$gt": 6}}, 3), ({"eggs": {"$exists": True}}, 4), ({"eggs": {"$exists": False}}, 2),
        ({"eggs": {(lambda v, a, b: v % a == b): [4, 1]}}, 1), ({"eggs": {multiple: 3}}, 3), ({"eggs": {"$gt": 5, "$lt": 12}}, 2),
        ({"$or": [{"name": "Mabel"}, {"eggs": 6}]}, 2), ({"$and": [{"name": "Mabel"}, {"eggs": 12}]}, 1),
        ({"$or": [{"name": "Mabel"}, {"eggs": {"$lt": 12}, "name": {"$regex": "bel"}}]}, 2),
        ({"$nor": [{"eggs": {"$lt": 12}}, {"name": "Dot"}]}, 4), ({"eggs": {"$not": {"$gt": 12}}}, 5), ({"eggs": {"$ne": 12}}, 5),
        ({"eggs": {"$eq": 12}}, 1), ({"eggs": {"$lt": 13}}, 3), ({"eggs": {"$gt": 19}}, 1), ({"missing": 1}, 0), ({"missing": {"$ne": 1}}, 6),
        ({"$not": {"name": "Dot"}}, 5), ({"eggs": {"$in": [6, None]}}, 3), ({"eggs": {"$nin": [6, None]}}, 3), ({"name": {"$regex": "^MA", "$options": "i"}}, 1),
        ({"pen": {"$type": "long"}}, 2), ({"name": {"$type": ["number", "bool"]}}, 0), ({"eggs": {"$type": "number"}}, 4),
    ],
)
def test_counts(hens, spec, n):
    assert hens.where(predicate(spec, hens)).count() == n
    assert hens.where(predicate(spec, hens, positive=False)).count() == 6 - n


def test_unknown_operator(hens):
    with pytest.raises(FilterError):
        predicate({"eggs": {"$what": 1}}, hens)


def test_kinds_of_callables(hens):
    assert hens.where(predicate({"name": {(lambda v, ends: str(v).endswith(ends)): "a"}}, hens)).count() == 2
    assert hens.where(predicate({"name": {rowwise(lambda v, n: len(v) > n): 3}}, hens)).count() == 3
    assert hens.where(predicate({"eggs": {vectorised(lambda v, least: v >= least): 9}}, hens)).count() == 3
    assert hens.where(predicate({"eggs": {vectorised(lambda v, least: v >= least): 9}}, hens, positive=False)).count() == 3


def holds(spec, doc):
    for k, v in spec.items():
        if k == "$and":
            ok = all(holds(s, doc) for s in v)
        elif k == "$or":
            ok = any(holds(s, doc) for s in v)
        elif k == "$nor":
            ok = not any(holds(s, doc) for s in v)
        else:
            x = doc[k]
            ((op, a),) = v.items()
            if op == "$not":
                ok = not holds({k: a}, doc)
            else:
                ok = {"$eq": lambda: x == a, "$ne": lambda: x != a, "$in": lambda: x in a, "$nin": lambda: x not in a}.get(op, lambda: x is not None and {"$gt": x > a, "$gte": x >= a, "$lt": x < a, "$lte": x <= a}[op])()
        if not ok:
            return False
    return True


def test_two_valued_logic(spark):
    rng = random.Random(7)
    docs = [{"id": i, "a": rng.choice([None, 1, 2, 3, 4]), "b": rng.choice([None, 1, 2, 3])} for i in range(40)]
    df = spark.createDataFrame([(d["id"], d["a"], d["b"]) for d in docs], "id bigint, a bigint, b bigint").cache()

    def leaf():
        op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin"])
        cond = {op: [rng.choice([None, 1, 2]), 3] if op in ("$in", "$nin") else rng.randint(1, 4)}
        return {rng.choice("ab"): {"$not": cond} if rng.random() < 0.3 else cond}

    def tree(depth):
        return leaf() if depth == 0 or rng.random() < 0.3 else {rng.choice(["$and", "$or", "$nor"]): [tree(depth - 1) for _ in range(rng.randint(1, 3))]}

    specs = [tree(3) for _ in range(60)]
    got = df.select("id", *(predicate(s, df).alias(f"s{i}") for i, s in enumerate(specs))).collect()
    for row in got:
        for i, s in enumerate(specs):
            assert bool(row[f"s{i}"]) == holds(s, docs[row["id"]]), (s, docs[row["id"]])


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(predicate({"x": {"$gt": 5}, "id": {"$ne": 3}}, df))._jdf.queryExecution().toString()
    assert "GreaterThan(x,5)" in plan and "Not(EqualNullSafe(id,3))" in plan
