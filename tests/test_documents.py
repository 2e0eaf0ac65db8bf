"""Updates, cursors, text, geo, JSON envelopes, collections and streams."""

import gzip
import json
import math
import os
import random
import threading
from datetime import datetime
from decimal import Decimal

import pytest
from docloom.functions import geo
from docloom.functions.text import TextIndex, scan
from docloom.operators.updates import apply_update
from docloom.plans.pipeline import predicate
from docloom.sources import jsonio
from docloom.sources.cursor import Cursor
from docloom.sources import store
from docloom.sources.store import Client, Collection, Database, DuplicateKeyError, WriteConflict
from docloom.streaming.windows import event_counts, read_events
from pyspark.sql import functions as F


def test_array_updates(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [80, 90, 100], None)], "_id int, tags array<string>, scores array<bigint>, new array<string>")
    update = {"$pullAll": {"tags": ["a", "b"]}, "$pop": {"tags": 1}, "$addToSet": {"tags": "e"}, "$pull": {"scores": {"$lt": 90}}, "$push": {"tags": {"$each": ["c", "d"]}, "new": "x"}}
    row = apply_update(df, update, F.lit(True)).first()
    assert (row.tags, row.scores, row.new) == (["c", "d"], [90, 100], ["x"])


def test_scalar_updates(spark):
    df = spark.createDataFrame([(1, 5, (1,)), (2, None, (2,))], "_id int, n bigint, p struct<q:int>")
    out = apply_update(df, {"$inc": {"n": 2}, "$set": {"p.q": 9}, "$max": {"n": 7}, "$rename": {"_none": "x"}}, predicate({"_id": {"$in": [1, 2]}}, df))
    assert [(r.n, r.p.q) for r in out.orderBy("_id").collect()] == [(7, 9), (7, 9)]
    assert apply_update(df, {"n": 1}, F.col("_id") == 1).orderBy("_id").first().p is None


WALKS = [(1, "Brae", 7, "north", 3), (2, "Glen", 4, "west", 5), (3, "Strath", 11, "north", 1), (4, "Corrie", 6, "east", 4), (5, "Loch", 9, "west", 2), (6, "Moor", None, "north", 6)]


def test_cursor(spark):
    df = spark.createDataFrame(WALKS, "_id int, name string, miles int, side string, rank int")
    assert [r.name for r in Cursor(df).sort([("side", 1), ("miles", -1)]).all()] == ["Corrie", "Strath", "Brae", "Moor", "Loch", "Glen"]
    c = Cursor(df, {"side": "north"}).limit(1).skip(1).sort("miles")
    assert [r.miles for r in c] == [11] and c.count() == 3 and len(c) == 3 and c.first().name == "Strath" and c[0].miles == 11
    assert Cursor(df).sort("miles", -1).all()[-1].name == "Moor"
    assert Cursor(df, {}, {"name": 1}).first().asDict() == {"_id": 1, "name": "Brae"}
    c = Cursor(df).sort("rank")
    assert [r.rank for r in c[1:4]] == [2, 3, 4] and c[5].rank == 6 and c[-1].rank == 6 and [r.rank for r in c[::2]] == [1, 3, 5] and c.toArray() == c.all()
    with pytest.raises(IndexError):
        c[6]


def test_text(spark):
    docs = spark.createDataFrame([(1, "On the heather moor", "Heather is a plant"), (2, "Bog and Heather", "more"), (3, "the", "of"), (4, "Fen", None), (5, None, None)], "_id int, title string, content string")
    index = TextIndex(docs, ["title", "content"])
    found = index.search("HEATHER").collect()
    assert sorted(r.id for r in found) == [1, 2]
    idf = math.log(3 / (1 + 2)) + 1
    assert {r.id: r.score for r in found} == pytest.approx({1: 2 / 4 * idf, 2: 1 / 2 * idf})
    assert index.search("the of").count() == 0 and index.search("").count() == 0 and index.search("absent").count() == 0
    assert index.stats().first().asDict() == {"vocabulary_size": 5, "num_documents": 3, "avg_doc_length": 7 / 3}
    assert TextIndex(docs.where("false"), ["title"]).search("heather").count() == 0 and TextIndex(docs.where("false"), ["title"]).stats().first().num_documents == 0
    assert scan(docs, "Heath").count() == 2


def test_saved_postings(spark, tmp_path):
    """A search by saved postings answers as one of the texts, and reads no text."""
    rng = random.Random(4)
    words = ["ash", "elm", "oak", "yew", "fir", "bay", "don't", "été", "the", "x", "oak_tree"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(200)], "_id int, body string")
    plain, saved = TextIndex(docs, ["body"]), TextIndex(docs, ["body"]).save(str(tmp_path / "p"))
    for q in ("oak", "Oak elm oak", "ÉTÉ yew", "don", "fir absent", "the"):
        both = [{r.id: round(r.score, 12) for r in x.search(q).collect()} for x in (plain, saved)]
        assert both[0] == both[1] and [r.id for r in plain.search(q, 5).collect()] == [r.id for r in saved.search(q, 5).collect()]
    assert plain.stats().first() == saved.stats().first()


def test_geo(spark):
    beijing, shanghai = (116.4074, 39.9042), (121.4737, 31.2304)
    rows = spark.createDataFrame([(1, [*beijing]), (2, [*shanghai]), (3, None)], "_id int, location array<double>")
    got = Cursor(rows).near("location", {"type": "Point", "coordinates": [*beijing]}, 1_200_000).all()
    assert [r._id for r in got] == [1, 2] and abs(got[1]._geo_distance_location - 1_067_310) < 5
    for shape in ({"$box": [[116, 39.5], [117, 40.5]]}, {"$center": [*beijing], "$radius": 100_000}, {"$geometry": {"type": "Polygon", "coordinates": [[[116, 39.5], [117, 39.5], [117, 40.5], [116, 40.5], [116, 39.5]]]}}):
        assert [r._id for r in rows.where(predicate({"location": {"$geoWithin": shape}}, rows)).collect()] == [1]
    points = [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), beijing, (-5.603, 42.605)]
    df = spark.createDataFrame(points, "x double, y double")
    got = [r[0] for r in df.select(geo.geohash(F.col("x"), F.col("y"), 12)).collect()]
    assert got == [geo.encode(x, y) for x, y in points] and got[4].startswith("ezs42")
    assert len(geo.geohash_neighbours("ezs42")) == 8
    low = geo.geohash_bounds("ezs42")
    assert low[0] <= -5.603 <= low[2] and low[1] <= 42.605 <= low[3]


def test_envelope(spark, tmp_path):
    path = tmp_path / "c.json.gz"
    doc = {"data": [{"_id": 1, "d": {"_type": "decimal", "value": "1.5"}, "n": None, "m": [1, 2]}, {"_id": 2, "m": []}], "_indexes": []}
    path.write_bytes(gzip.compress(json.dumps(doc).encode()))
    assert spark.read.option("multiLine", True).json(str(path)).count() == 1
    got = jsonio.read_envelope(spark, str(path)).orderBy("_id").collect()
    assert got[0].d == Decimal("1.5") and got[1].m == []
    variant = jsonio.read_variant(spark, str(path))
    assert variant.where(jsonio.present("n")).count() == 1
    value = {"t": datetime(2024, 1, 2, 3), "d": Decimal("1.25"), "b": b"\x00x", "l": [1, {"x": None}]}
    assert jsonio.from_json_value(json.loads(json.dumps(jsonio.to_json_value(value)))) == value
    df = spark.createDataFrame([(1, Decimal("2.5"), datetime(2024, 1, 2))], "_id int, d decimal(5,2), t timestamp_ntz")
    jsonio.write_envelope(df, str(tmp_path / "out.json"))
    back = jsonio.read_envelope(spark, str(tmp_path / "out.json")).first()
    assert back.d == Decimal("2.5") and back.t == datetime(2024, 1, 2)
    key = "0123456789abcdef"
    assert jsonio.decrypt(jsonio.encrypt(df, ["d"], key), ["d"], key).first().d == "2.50"


def test_collection(spark, tmp_path):
    db = Client(spark, str(tmp_path)).shop
    c = db.people
    assert c.insert_many([]).inserted_ids == []
    assert c.insert_many([{"name": "Alice", "balance": 1000}, {"name": "Bob", "balance": 500, "tags": ["x"]}]).inserted_ids == [1, 2]
    assert c.insert_one({"name": "Cy"}).inserted_id == 3
    assert c.find_one({"name": "Bob"})["tags"] == ["x"] and c.count_documents({"balance": {"$gte": 500}}) == 2
    r = c.update_many({"balance": {"$gt": 0}}, {"$max": {"balance": 600}})
    assert (r.matched_count, r.modified_count) == (2, 1)
    assert c.update_one({"name": "Dee", "balance": {"$gt": 5}}, {"$set": {"balance": 7}}, upsert=True).upserted_id == 4
    assert c.find_one({"name": "Dee"})["balance"] == 7
    c.create_index("name", unique=True)
    with pytest.raises(DuplicateKeyError):
        c.insert_one({"name": "Bob"})
    assert c.count_documents({}) == 4 and c.delete_many({"balance": {"$lt": 100}}).deleted_count == 1
    assert c.find_one_and_update({"name": "Cy"}, {"$set": {"balance": 1}}, return_document="after")["balance"] == 1
    assert c.replace_one({"name": "Cy"}, {"name": "Cyd"}).modified_count == 1 and c.find_one({"name": "Cyd"})["balance"] is None
    with db.transaction() as t:
        t["people"].update_one({"name": "Alice"}, {"$inc": {"balance": -300}})
        t["people"].update_one({"name": "Bob"}, {"$inc": {"balance": 300}})
        assert db.people.find_one({"name": "Alice"})["balance"] == 1000
        with pytest.raises(RuntimeError), db.transaction():
            pass
        object.__setattr__(db, "_open", t)
    assert [d["balance"] for d in (c.find_one({"name": n}) for n in ("Alice", "Bob"))] == [700, 900]
    with pytest.raises(ZeroDivisionError), db.transaction() as t:
        t["people"].delete_many({})
        1 / 0
    assert c.estimated_document_count() == 3
    late = db.transaction()
    late["people"].delete_one({"name": "Alice"})
    c.insert_one({"name": "Zed"})
    with pytest.raises(WriteConflict):
        late.commit()
    assert c.insert_frame(spark.createDataFrame([("New", 1)], "name string, balance bigint")) == 1 and c.estimated_document_count() == 5
    assert db.list_collection_names() == ["people"] and db.command("ping") == {"ok": 1} and "name_1" in c.list_indexes()
    assert {d["name"] for d in c.full_text_search("Zed")} == {"Zed"}
    db.drop_collection("people")
    assert db.list_collection_names() == []


def test_near_box(spark):
    """The box before the distance loses no point, at poles and the date line either."""
    rng = random.Random(3)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(3000)] + [(4000, 179.99, 0.5), (4001, -179.99, -0.5), (4002, 10.0, 89.9), (4003, -170.0, 89.95)]
    df = spark.createDataFrame(points, "_id int, lng double, lat double").cache()
    at = (F.col("lng"), F.col("lat"))
    for center in ((0.0, 0.0), (180.0, 0.0), (-179.5, 10.0), (20.0, 89.8), (-60.0, -89.9), (100.0, 60.0)):
        for radius in (20_000.0, 2_000_000.0, 19_000_000.0):
            within = df.where(geo.distance(at, center) <= radius)
            assert within.where(~geo.around(at, center, radius)).count() == 0
            assert df.where(geo.in_circle(at, center, radius)).count() == within.count()
    plan = df.where(geo.around(at, (100.0, 60.0), 1000.0))
    assert plan.count() < 10


def test_types_meet(spark, tmp_path):
    """Inserts and replacements of another type follow one rule; tags of one column decode to one type."""
    c = Collection(spark, str(tmp_path / "c"))
    c.insert_many([{"v": 1, "w": "a"}, {"v": 2}])
    c.insert_one({"v": 2.5})
    assert [r.v for r in c.find().sort("_id").all()] == [1.0, 2.0, 2.5]
    assert c.replace_one({"_id": 2}, {"v": "two"}).modified_count == 1
    assert [r.v for r in c.find().sort("_id").all()] == ["1.0", "two", "2.5"]
    assert c.replace_one({"v": "two"}, {"v": "two"}).modified_count == 0 and c.update_one({"v": "none"}, {"v": "x"}).matched_count == 0
    lines = tmp_path / "mixed.json"
    lines.write_text('{"a": {"_type": "datetime", "value": "2024-01-02T00:00:00"}, "b": [{"t": {"_type": "decimal", "value": "1.5"}}], "m": {"_type": "decimal", "value": "2"}}\n{"m": {"_type": "datetime", "value": "2024-01-02"}}\n')
    got = jsonio.read_lines(spark, str(lines))
    assert dict(got.dtypes)["a"] == "timestamp_ntz" and got.where(F.col("a") > "2024-01-01").count() == 1 and got.first().b[0].t == Decimal("1.5")
    assert sorted(f.name for f in got.schema["m"].dataType.fields) == ["datetime", "decimal"]


@pytest.mark.parametrize("links", [True, False])
def test_create_if_absent(spark, tmp_path, monkeypatch, links):
    """By a link on local disks, by a rename that doesn't overwrite elsewhere."""
    monkeypatch.setattr(store.Files, "links", links)
    files = store.Files(spark)
    assert files.create(f"{tmp_path}/d/a.json", "one") and not files.create(f"{tmp_path}/d/a.json", "two")
    assert files.read(f"{tmp_path}/d/a.json") == "one" and files.names(f"{tmp_path}/d") == ["a.json"]


def test_two_writers(spark, tmp_path):
    """Of writers that start from one version one commits; the others fail and lose nothing of its."""
    Collection(spark, str(tmp_path / "c")).insert_many([{"k": 0}])
    base = Collection(spark, str(tmp_path / "c")).manifest()
    won, gate = [], threading.Barrier(4)

    def write(i):
        c = Collection(spark, str(tmp_path / "c"))
        gate.wait()
        try:
            c.put(base, {**base, "indexes": {f"i{i}": {}}})
            won.append(i)
        except WriteConflict:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    c = Collection(spark, str(tmp_path / "c"))
    assert len(won) == 1 and list(c.list_indexes()) == [f"i{won[0]}"] and c.count_documents() == 1


def test_appends_and_versions(spark, tmp_path, monkeypatch):
    """Inserts add a part and leave the others; old versions can be read; parts and manifests that nothing needs go."""
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    monkeypatch.setattr(store, "KEPT", 2)
    c = Collection(spark, str(tmp_path / "c"))
    for i in range(3):
        c.insert_one({"i": i})
    parts = [p["folder"] for p in c.manifest()["parts"]]
    assert len(parts) == 3 and c.as_of(2).count_documents() == 2
    c.insert_one({"i": 3, "more": "x"})
    assert len(c.manifest()["parts"]) == 1 and sorted(r.i for r in c.find().all()) == [0, 1, 2, 3]
    c.delete_many({"i": 3})
    assert c.insert_one({"i": 9}).inserted_id == 4
    for i in range(4):
        c.update_many({"i": {"$gte": 0}}, {"$inc": {"i": 1}})
    assert not set(parts) & set(os.listdir(tmp_path / "c/data")) and len(c.numbers()) <= 5 and c.count_documents({"i": {"$gt": 3}}) == 4
    assert c.update_many({"i": {"$gte": 0}}, {"$set": {"more": None}}).modified_count == 0


def test_crashes(spark, tmp_path, monkeypatch):
    """A writer that stops half-way is never seen: before its manifest, before its transaction's decision, or never deciding."""
    db = Database(spark, str(tmp_path))
    db["a"].insert_one({"x": 1})
    db["b"].insert_one({"x": 1})
    left = db["a"]._write(spark.range(5).withColumnRenamed("id", "_id"))
    assert db["a"].count_documents() == 1 and left["folder"] not in json.dumps(db["a"].manifest())
    t = db.transaction()
    t["a"].insert_one({"x": 2})
    t["b"].insert_one({"x": 2})
    t.prepare()
    assert [Database(spark, str(tmp_path))[n].count_documents() for n in "ab"] == [1, 1]
    with pytest.raises(WriteConflict):
        db["a"].insert_one({"x": 3})
    monkeypatch.setattr(store, "STALE_S", -1)
    db["a"].insert_one({"x": 3})
    with pytest.raises(WriteConflict):
        t.commit()
    assert sorted(r.x for r in db["a"].find().all()) == [1, 3] and db["b"].count_documents() == 1
    monkeypatch.setattr(store, "STALE_S", 60)
    done = db.transaction()
    done["a"].insert_one({"x": 4})
    with pytest.raises(WriteConflict):  # the other collection's undecided manifest is in the way, and recent
        late = db.transaction()
        late["b"].insert_one({"x": 5})
        late.prepare()
        done["b"].insert_one({"x": 4})
        done.commit()
    assert db["a"].count_documents() == 2 and db.list_collection_names() == ["a", "b"]


def test_text_indexes_are_kept(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.insert_many([{"t": "oak and ash", "u": "bog"}, {"t": "oak", "u": "fen oak"}])
    name = c.create_text_index("t")
    assert [d["_id"] for d in c.full_text_search("oak")] == [2, 1]
    again = Collection(spark, str(tmp_path / "c"))
    assert again.list_text_indexes() == {name: ["t"]} and again.text_index(name).saved is not None
    c.insert_one({"t": "ash ash"})
    assert [d["_id"] for d in again.full_text_search("ash", index=name)] == [3, 1] and again.full_text_search("fen", fields=["u"])[0]["_id"] == 2
    c.drop_text_index(name)
    assert again.list_text_indexes() == {} and [d["_id"] for d in again.full_text_search("bog")] == [1]


def test_planner_and_cache(spark, tmp_path):
    """Times are those of actions; the cache answers for one version, and can be cleared and turned off."""
    c = Collection(spark, str(tmp_path / "c"))
    c.insert_many([{"x": i} for i in range(20)])
    c.recorder.slow_s = 0.0
    lazy = c.find({"x": {"$gt": 3}})
    assert c.slow_queries() == [] and c.query_patterns() == []
    for _ in range(3):
        lazy.all()
    c.aggregate([{"$count": "n"}]).first()
    slow = c.slow_queries(2)
    assert len(slow) == 2 and slow[0]["seconds"] >= slow[1]["seconds"] > 0
    assert c.query_patterns()[0]["count"] == 3 and c.suggest_indexes() == ["sort or bucket by x (3 filters)"]
    spec = {"x": {"$lt": 5}}
    assert [c.count_documents(spec) for _ in range(3)] == [5] * 3 and c.cache_stats()["hits"] == 2
    c.insert_one({"x": 0})
    assert c.count_documents(spec) == 6 and c.cache_stats()["misses"] == 2
    c.clear_cache()
    assert c.cache_stats()["size"] == 0
    c.set_cache_enabled(False)
    assert c.count_documents(spec) == 6 and c.cache_stats()["size"] == 0


def test_aggregation_cursor(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.insert_many([{"x": i % 3} for i in range(9)])
    got = c.aggregate([{"$group": {"_id": "$x", "n": {"$count": {}}}}, {"$sort": {"_id": -1}}])
    assert len(got) == got.count() == 3 and got.first()["_id"] == 2 and [r["_id"] for r in got] == [2, 1, 0] and got[1].n == 3 and got.toArray() == got.all() and len(got[0:2]) == 2


def test_exports():
    import docloom

    assert all(getattr(docloom, n) is not None for n in docloom.__all__) and docloom.Client is Client
    with pytest.raises(AttributeError):
        docloom.nothing


def test_shared_folder_is_needed_on_clusters(spark, monkeypatch):
    from docloom.plans import session

    class Elsewhere:
        sparkContext = type("C", (), {"master": "spark://host:7077"})()  # noqa: N815
        conf = type("F", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere())


def test_stream(spark):
    events = read_events(spark, "/root/testdata/sf0.001")
    out = event_counts(events, {"value": {"$gt": 0}})
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert spark.table("counts").agg(F.sum("n")).first()[0] == batch.where("value > 0").count()
