"""$graphLookup against a plain search, and the rows that it moves."""

import random

import pytest
from docloom.plans.pipeline import aggregate


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def walked(docs, starts, limit):
    """{to: (least depth, documents)} by a plain search. docs: (to, onward values, name)."""
    depth, front, at = {}, {s for s in starts if s is not None}, 0
    while front and (limit is None or at <= limit):
        here = [d for d in docs if d[0] is not None and d[0] in front and d[0] not in depth]
        depth |= {d[0]: at for d in here}
        front, at = {v for d in here for v in d[1] if v is not None}, at + 1
    return sorted((depth[d[0]], d[2]) for d in docs if d[0] in depth)


@pytest.mark.parametrize("kind", ["rings", "twins", "branches", "few", "arrays"])
def test_graph_against_plain_search(spark, kind):
    """Chains with rings, several documents of one value, arrays of links, few starts, arrays of starts, with limits of depth."""
    rng, n = random.Random(kind), 40
    if kind in ("branches", "few", "arrays"):
        links = [[rng.choice([*range(n), None, 99]) for _ in range(rng.randint(0, 2 if kind != "arrays" else 1))] for _ in range(n)]
    else:
        links = [[rng.choice([*range(n), None, 99])] for _ in range(n)]
    docs = [(k if rng.random() < 0.95 else None, links[k], f"{k}") for k in range(n)]
    if kind == "twins":
        docs += [(k, links[k], f"{k}b") for k in range(0, n, 3)]
    begin = [[rng.choice([*range(n), None, 99]) for _ in range(rng.randint(0, 3))] if kind == "arrays" else d[1][0] if d[1] else None for d in docs]
    if kind in ("few", "branches"):
        begin = [b if kind == "branches" or i < 3 else None for i, b in enumerate(begin)]
    nodes = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "_id int, at bigint, onward array<bigint>, name string")
    left = spark.createDataFrame([(i, b) for i, b in enumerate(begin)], f"_id int, begin {'array<int>' if kind == 'arrays' else 'int' if kind == 'few' else 'bigint'}")
    for limit in {"twins": (0,), "few": (None,), "arrays": (None,)}.get(kind, (None, 2)):
        spec = {"from": "nodes", "startWith": "$begin", "connectFromField": "onward", "connectToField": "at", "as": "met", "depthField": "d"} | ({} if limit is None else {"maxDepth": limit})
        want = {i: walked(docs, b if isinstance(b, list) else [b], limit) for i, b in enumerate(begin)}
        got = {r["_id"]: [(x["d"], x["name"]) for x in r["met"]] for r in rows(aggregate(left, [{"$graphLookup": spec}], {"nodes": nodes}))}
        assert {k: sorted(v) for k, v in got.items()} == want and all([d for d, _ in v] == sorted(d for d, _ in v) for v in got.values())
        # only what a later stage reads of the documents is gathered
        brief = rows(aggregate(left, [{"$graphLookup": spec}, {"$project": {"n": {"$size": "$met"}, "depths": "$met.d"}}], {"nodes": nodes}))
        assert {r["_id"]: (r["n"], r["depths"]) for r in brief} == {k: (len(v), [d for d, _ in v]) for k, v in want.items()}


def test_graph_from_nothing(spark):
    nodes = spark.createDataFrame([(1, 2), (2, None)], "at bigint, next bigint")
    spec = {"from": "nodes", "startWith": "$next", "connectFromField": "next", "connectToField": "at", "as": "met"}
    assert rows(aggregate(nodes.where("false"), [{"$graphLookup": spec}], {"nodes": nodes})) == []
    for odd in ({"startWith": None}, {"connectToField": "none"}, {"restrictSearchWithMatch": {"at": 7}}):
        assert [r["met"] for r in rows(aggregate(nodes, [{"$graphLookup": spec | odd}], {"nodes": nodes}))] == [[], []]
    assert [len(r["met"]) for r in rows(aggregate(nodes.where("at = 1"), [{"$graphLookup": spec | {"connectFromField": "none"}}], {"nodes": nodes}))] == [1]


def moved(spark) -> int:
    """Rows written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("links", [1, 2])
def test_graph_moves_few_rows(spark, links):
    """Deep graphs, chains or with two links a value: rows that move keep to the rows found, not to levels times them."""
    deep, wide = 30, 10 if links == 1 else 2
    nodes = spark.createDataFrame([(k, [k // wide * wide - wide + (k + j) % wide for j in range(links)] if k >= wide else []) for k in range(deep * wide)], "_id bigint, up array<bigint>")
    found = deep * (deep - 1) // 2 * wide * links
    spec = {"from": "nodes", "startWith": "$up", "connectFromField": "up", "connectToField": "_id", "as": "above", "depthField": "d"}
    before, old = moved(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rows(aggregate(nodes, [{"$graphLookup": spec}, {"$project": {"n": {"$size": "$above"}, "depths": "$above.d"}}], {"nodes": nodes}))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(r["n"] for r in out) == found and all(r["depths"] == sorted([*range(r["n"] // links)] * links) for r in out)
    assert moved(spark) - before < 12 * found
