"""Stages, expressions and accumulators on small fixtures."""

import pytest
from docloom.operators.buckets import edges
from docloom.plans.expressions import ExpressionError
from docloom.plans.pipeline import PipelineError, aggregate

BOATS = [(1, "Heron", 9, "Oban", 410, "ferry"), (2, "Petrel", 14, "Lerwick", 520, "trawler"), (3, "Skua", 21, "Oban", 660, "ferry"), (4, "Dipper", 12, "Lerwick", 480, "tug"), (5, "Wigeon", 17, "Oban", 590, "trawler"), (6, "Smew", 33, "Wick", 900, "ferry")]


@pytest.fixture(scope="module")
def boats(spark):
    return spark.createDataFrame(BOATS, "_id bigint, name string, age bigint, port string, tons bigint, kind string").cache()


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def test_group(boats):
    got = {r["_id"]: r for r in rows(aggregate(boats, [{"$group": {"_id": "$kind", "total": {"$sum": "$tons"}, "young": {"$min": "$age"}, "names": {"$push": "$name"}, "first": {"$first": "$name"}, "last": {"$last": "$name"}}}]))}
    assert got["ferry"] == {"_id": "ferry", "total": 1970, "young": 9, "names": ["Heron", "Skua", "Smew"], "first": "Heron", "last": "Smew"}


def test_tiers(boats):
    tier = {"$cond": [{"$gte": ["$age", 30]}, "old", {"$cond": [{"$gte": ["$age", 15]}, "used", "new"]}]}
    got = {r["name"]: r["tier"] for r in rows(aggregate(boats, [{"$addFields": {"tier": tier}}]))}
    assert (got["Smew"], got["Wigeon"], got["Heron"]) == ("old", "used", "new")


def test_sort_then_push(boats):
    got = rows(aggregate(boats, [{"$sort": {"port": -1, "age": -1}}, {"$group": {"_id": None, "names": {"$push": "$name"}}}]))
    assert got == [{"_id": None, "names": ["Smew", "Skua", "Wigeon", "Heron", "Petrel", "Dipper"]}]


def test_buckets(spark):
    goods = spark.createDataFrame([(1, "pin", 7), (2, "jar", 31), (3, "bed", 800)], "_id bigint, name string, cost bigint")
    out = {"goods": {"$push": "$name"}}
    got = rows(aggregate(goods, [{"$bucket": {"groupBy": "$cost", "boundaries": [0, 20, 40], "default": "dear", "output": out}}, {"$sort": {"_id": 1}}]))
    assert got == [{"_id": "0", "goods": ["pin"]}, {"_id": "20", "goods": ["jar"]}, {"_id": "dear", "goods": ["bed"]}]
    none = rows(aggregate(goods, [{"$bucket": {"groupBy": "$cost", "boundaries": [0, 1000], "default": "dear"}}, {"$sort": {"_id": 1}}]))
    assert [(r["_id"], r["count"]) for r in none] == [("0", 3), ("dear", 0)]
    values = spark.createDataFrame([(i, 3 * i) for i in range(12)], "_id bigint, value bigint")
    got = rows(aggregate(values, [{"$bucketAuto": {"groupBy": "$value", "buckets": 4}}]))
    assert sorted(r["count"] for r in got) == [3, 3, 3, 3]
    assert rows(aggregate(values.where("false"), [{"$bucketAuto": {"groupBy": "$value", "buckets": 3}}])) == []


def test_bucket_edges():
    assert edges(-6.0, 6.0, 3) == [-6.0, -2.0, 2.0, 6.012]
    assert edges(5.0, 5.0, 3) == [5.0, 6.0]
    # widths under 1 are rounded in their own decade: 0.07 / 2 = 0.035 to 0.04 of 0.01, 0.02, 0.04, 0.05
    assert edges(0.0, 0.07, 2, "R20")[1] == pytest.approx(0.04)
    assert edges(0.0, 44.0, 2, "R5")[1] == 20.0 and edges(0.0, 80.0, 2, "R5")[1] == 50.0
    for low, high, n, series in ((0.0, 1e-6, 7, "R5"), (-1e9, 3.0, 11, "R80"), (2.0, 2.5, 3, "R128")):
        ends = edges(low, high, n, series)
        assert len(ends) == n + 1 and ends == sorted(ends) and ends[-1] > high


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_order_through_joins(spark, threshold):
    """$skip and $limit follow the documents' order, and results a $sort, whatever shuffles came between."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        left = spark.createDataFrame([(i, i * 7 % 2000, i % 3) for i in range(2000)], "_id bigint, x bigint, k bigint").repartition(8)
        right = spark.createDataFrame([(k, f"n{k}") for k in range(3)], "k bigint, name string")
        look = {"$lookup": {"from": "right", "localField": "k", "foreignField": "k", "as": "r"}}
        top = aggregate(left, [{"$sort": {"x": -1}}, look, {"$limit": 5}], {"right": right}).collect()
        assert [r.x for r in top] == [1999, 1998, 1997, 1996, 1995] and all(r.r[0]["name"] == f"n{r.k}" for r in top)
        top = aggregate(left, [{"$sort": {"x": 1}}, look, {"$unwind": "$r"}, {"$skip": 2}, {"$limit": 3}], {"right": right}).collect()
        assert [r.x for r in top] == [2, 3, 4]
        assert [r.x for r in aggregate(left, [{"$sort": {"x": -1}}, {"$match": {"x": {"$lt": 900}}}, look], {"right": right}).collect()] == list(range(899, -1, -1))
        assert [r._id for r in aggregate(left, [look, {"$match": {"x": {"$gte": 0}}}, {"$skip": 10}, {"$limit": 4}], {"right": right}).collect()] == [10, 11, 12, 13]
        groups = aggregate(left, [{"$group": {"_id": "$k", "n": {"$count": {}}}}, {"$skip": 1}, {"$limit": 1}]).collect()
        assert [r["_id"] for r in groups] == [1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sort_and_limit_share_a_plan(spark):
    df = aggregate(spark.range(50).selectExpr("id AS _id", "-id AS x"), [{"$sort": {"x": 1}}, {"$skip": 2}, {"$limit": 3}])
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString() and [r.x for r in df.collect()] == [-47, -46, -45]


def test_paths_in_stages(spark):
    df = spark.createDataFrame([(1, (2, 3), [(4, 5), (6, 7)]), (2, None, None)], "_id bigint, a struct<b:bigint,c:bigint>, l array<struct<x:bigint,y:bigint>>")
    one, two = sorted(rows(aggregate(df, [{"$addFields": {"a.b": 20, "a.c": {"$add": ["$a.b", 1]}, "a.d.e": "new", "l.z": "$_id"}}])), key=lambda r: r["_id"])
    assert one["a"] == {"b": 20, "c": 3, "d": {"e": "new"}} and one["l"] == [{"x": 4, "y": 5, "z": 1}, {"x": 6, "y": 7, "z": 1}]
    assert two["a"] == {"b": 20, "c": None, "d": {"e": "new"}} and two["l"] is None
    got = rows(aggregate(df, [{"$project": {"_id": 0, "p.q": "$a.b", "p.r": {"$size": "$l"}, "a.c": 1}}]))
    assert got[0] == {"p": {"q": 2, "r": 2}, "a": {"c": 3}} and got[1] == {"p": {"q": None, "r": 0}, "a": None}
    assert rows(aggregate(df, [{"$project": {"l.x": 0, "a.b": 0, "a.none": 0}}])) == [{"_id": 1, "a": {"c": 3}, "l": [{"y": 5}, {"y": 7}]}, {"_id": 2, "a": None, "l": None}]
    assert rows(aggregate(df, [{"$unset": "a"}, {"$project": {"l": 0}}])) == [{"_id": 1}, {"_id": 2}]
    for clash in ({"a": 1, "a.b": 2}, {"a.b": 1, "a.b.c": 2}):
        with pytest.raises(PipelineError):
            aggregate(df, [{"$addFields": clash}])


def test_lookup_of_few(spark):
    """Few local documents gather only what they want; a test inside the array alone is a semi join."""
    left = spark.range(100).selectExpr("id AS _id", "id % 7 AS k")
    right = spark.range(50).selectExpr("id AS _id", "id % 10 AS k", "id AS v")
    look = {"$lookup": {"from": "r", "localField": "k", "foreignField": "k", "as": "a"}}
    few = aggregate(left, [{"$match": {"_id": {"$lt": 2}}}, look], {"r": right})
    assert "LeftSemi" in few._jdf.queryExecution().optimizedPlan().toString()
    assert {r._id: [d["v"] for d in r.a] for r in few.collect()} == {0: [0, 10, 20, 30, 40], 1: [1, 11, 21, 31, 41]}
    for test, want in (({"a.v": {"$gt": 45}}, {6}), ({"a.v": 12}, {2}), ({"a.v": {"$in": [3, 14]}}, {3, 4}), ({"a.v": {"$ne": 12}}, {0, 1, 3, 4, 5, 6}), ({"a.v": {"$gt": 45, "$lt": 3}}, set())):
        df = aggregate(left, [look, {"$match": test}, {"$project": {"k": 1}}], {"r": right})
        assert {r.k for r in df.collect()} == want
        assert ("LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()) == (list(test.values())[0] not in ({"$ne": 12}, {"$gt": 45, "$lt": 3}))


def test_inside_lookup(spark):
    """Stages after a correlated match run for each document by itself."""
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "_id bigint, k bigint")
    right = spark.createDataFrame([(1, 10, "a", [1, 2]), (2, 10, "b", [3]), (3, 10, "a", []), (4, 20, "a", [5])], "_id bigint, fk bigint, t string, v array<bigint>")
    match = {"$match": {"$expr": {"$eq": ["$fk", "$$k"]}}}

    def inside(*more):
        got = aggregate(left, [{"$lookup": {"from": "r", "let": {"k": "$k"}, "pipeline": [match, *more], "as": "out"}}], {"r": right})
        return {r["_id"]: r["out"] for r in rows(got)}

    assert inside({"$group": {"_id": "$t", "n": {"$count": {}}}}, {"$sort": {"_id": 1}}) == {1: [{"_id": "a", "n": 2}, {"_id": "b", "n": 1}], 2: [{"_id": "a", "n": 1}], 3: []}
    assert inside({"$count": "n"}) == {1: [{"n": 3}], 2: [{"n": 1}], 3: []}
    assert [d["v"] for d in inside({"$unwind": "$v"})[1]] == [1, 2, 3]


def test_facet_reads_once(spark):
    """An input that takes a shuffle is a checkpoint, which every branch reads."""
    made = spark.range(100).repartition(3).selectExpr("id AS _id", "id % 5 AS k")
    df = aggregate(made, [{"$group": {"_id": "$k", "n": {"$count": {}}}}, {"$facet": {"a": [{"$count": "n"}], "b": [{"$match": {"_id": {"$gt": 2}}}]}}])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0" not in plan and plan.count("LogicalRDD") == 2
    row = df.first()
    assert row.a[0]["n"] == 5 and sorted(x["_id"] for x in row.b) == [3, 4]


def test_facet_of_nothing(boats):
    assert rows(aggregate(boats.where("false"), [{"$facet": {"count": [{"$count": "total"}], "names": [{"$project": {"name": 1, "_id": 0}}]}}])) == [{"count": [{"total": 0}], "names": []}]


def test_lookup_and_graph(spark):
    trips = spark.createDataFrame([(1, "peat", 31), (2, "wool", 32), (3, "salt", 31), (4, "coal", 77)], "trip bigint, cargo string, boat bigint")
    fleet = spark.createDataFrame([(31, "Heron", "Oban"), (32, "Skua", "Wick")], "boat bigint, name string, port string")
    spec = {"from": "fleet", "localField": "boat", "foreignField": "boat", "as": "by"}
    tables = {"fleet": fleet}
    got = rows(aggregate(trips, [{"$lookup": spec}, {"$match": {"by.name": "Heron"}}], tables))
    assert sorted(r["trip"] for r in got) == [1, 3]
    got = {r["trip"]: r["names"] for r in rows(aggregate(trips, [{"$lookup": spec}, {"$project": {"trip": 1, "names": "$by.name"}}], tables))}
    assert got == {1: ["Heron"], 2: ["Skua"], 3: ["Heron"], 4: []}
    assert [r["trip"] for r in rows(aggregate(trips, [{"$lookup": spec}, {"$match": {"by": []}}], tables))] == [4]
    assert all(r["by"] == [] for r in rows(aggregate(trips, [{"$lookup": {**spec, "from": "none"}}], tables)))
    rivers = spark.createDataFrame([(10, "Tay", None), (11, "Earn", 10), (12, "Isla", 10), (13, "Ruchill", 11), (14, "Machany", 11), (15, "Knaik", 13)], "key bigint, name string, into bigint")
    down = {"from": "rivers", "startWith": "$into", "connectFromField": "into", "connectToField": "key", "as": "below", "depthField": "depth"}
    got = {r["name"]: {a["name"]: a["depth"] for a in r["below"]} for r in rows(aggregate(rivers, [{"$graphLookup": down}], {"rivers": rivers}))}
    assert got["Knaik"] == {"Ruchill": 0, "Earn": 1, "Tay": 2} and got["Tay"] == {}
    got = {r["name"]: {a["name"] for a in r["below"]} for r in rows(aggregate(rivers, [{"$graphLookup": {**down, "maxDepth": 1}}], {"rivers": rivers}))}
    assert got["Knaik"] == {"Ruchill", "Earn"}
    ring = spark.createDataFrame([("n", "e"), ("e", "s"), ("s", "w"), ("w", "n")], "at string, next string")
    loop = {"from": "ring", "startWith": "$next", "connectFromField": "next", "connectToField": "at", "as": "chain"}
    assert {len(r["chain"]) for r in rows(aggregate(ring, [{"$graphLookup": loop}], {"ring": ring}))} == {4}


def test_unwind_null_and_empty(spark):
    docs = spark.createDataFrame([(1, [3, 4]), (2, None), (3, [])], "k bigint, turns array<bigint>")
    assert sorted((r["k"], r["turns"]) for r in rows(aggregate(docs, [{"$unwind": "$turns"}], order=["k"]))) == [(1, 3), (1, 4)]
    kept = rows(aggregate(docs, [{"$unwind": {"path": "$turns", "preserveNullAndEmptyArrays": True}}], order=["k"]))
    assert sorted((r["k"], r["turns"] or 0) for r in kept) == [(1, 3), (1, 4), (2, 0), (3, 0)]


@pytest.mark.parametrize(
    "expr, value",
    [
        ({"$abs": -42}, 42), ({"$ceil": 3.7}, 4), ({"$floor": 3.7}, 3), ({"$mod": [-5, 3]}, 1), ({"$mod": [5, -3]}, -1), ({"$mod": [5, 0]}, None), ({"$pow": [2, 3]}, 8.0), ({"$sqrt": 16}, 4.0), ({"$sqrt": -1}, None),
        ({"$round": [3.14159, 2]}, 3.14), ({"$round": 2.5}, 2), ({"$trunc": -3.9}, -3), ({"$cmp": [5, 10]}, -1), ({"$divide": [1, 0]}, None), ({"$concat": ["a", None, 1]}, "a1"),
        ({"$substr": ["  Hello World  ", 2, 5]}, "Hello"), ({"$strlen": "  Hello World  "}, 15), ({"$trim": "\t x \n"}, "x"), ({"$split": ["a.b.", "."]}, ["a", "b", ""]), ({"$toupper": "ab"}, "AB"),
        ({"$size": {"$literal": [1, 2]}}, 2), ({"$size": "x"}, 0), ({"$arrayElemAt": [{"$literal": [1, 2, 3]}, -1]}, 3), ({"$arrayElemAt": [{"$literal": [1]}, 5]}, None), ({"$concatArrays": [{"$literal": [1]}, {"$literal": [2]}]}, [1, 2]),
        ({"$in": [3, {"$literal": [1, 3]}]}, True), ({"$slice": [{"$literal": [1, 2, 3, 4, 5]}, 1, 3]}, [2, 3, 4]), ({"$slice": [{"$literal": [1, 2, 3]}, -10]}, [1, 2, 3]), ({"$slice": [{"$literal": [1, 2, 3]}, 2]}, [1, 2]),
        ({"$toInt": "12.5"}, None), ({"$toInt": " 42 "}, 42), ({"$toInt": 3.99}, 3), ({"$toDouble": "x"}, None), ({"$toBool": "false"}, True), ({"$isArray": "x"}, False), ({"$in": [1, "x"]}, None), ({"$arrayElemAt": ["x", 0]}, None), ({"$ceil": "x"}, None), ({"$eq": [None, None]}, True), ({"$gt": [None, 1]}, False),
        ({"$and": [1, "", True]}, False), ({"$or": [0, "a"]}, True), ({"$not": [0]}, True), ({"$cond": {"if": {"$gt": [1, 2]}, "then": "a", "else": "b"}}, "b"),
    ],
)
def test_expressions(spark, expr, value):
    got = aggregate(spark.range(1).withColumnRenamed("id", "_id"), [{"$addFields": {"x": expr}}]).first()["x"]
    assert got == value


def test_unknown_names_raise(boats):
    with pytest.raises(PipelineError):
        aggregate(boats, [{"$nothing": {}}])
    with pytest.raises(ExpressionError):
        aggregate(boats, [{"$addFields": {"x": {"$nothing": 1}}}])


def test_projection(spark):
    df = spark.createDataFrame([(1, (2, 3), [(4, 5)])], "_id int, a struct<b:int,c:int>, l array<struct<x:int,y:int>>")
    assert rows(aggregate(df, [{"$project": {"a.b": 1, "l.x": 1}}])) == [{"_id": 1, "a": {"b": 2}, "l": [{"x": 4}]}]
    assert rows(aggregate(df, [{"$project": {"a.b": 0, "l": 0}}])) == [{"_id": 1, "a": {"c": 3}}]
    assert rows(aggregate(df, [{"$project": {"_id": 0}}])) == [{"a": {"b": 2, "c": 3}, "l": [{"x": 4, "y": 5}]}]
    assert rows(aggregate(df, [{"$unwind": "$l"}, {"$project": {"_id": 0, "z": "$l.y", "all": "$$ROOT"}}]))[0]["z"] == 5
