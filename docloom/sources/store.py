"""Client, databases and collections over versioned Parquet tables.

A collection is a folder of immutable Parquet parts and of manifests, one JSON file per version that lists the version's
parts; the highest number holds. A manifest is created only if its number is free, so of two writers that start from one
version the second fails, and readers see whole versions only. Inserts add a part; other writes make a new part from all.

A transaction writes the next manifest of each of its collections, marked with its name, and then creates one file: that
decides all of them together. Until then, and if the file says that it was given up, readers pass such manifests over. What a
crashed writer leaves is given up by the next writer after ``STALE_S`` seconds.
"""

from __future__ import annotations

import functools
import json
import os
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import updates
from ..plans import pipeline
from ..plans.filters import is_operators
from ..plans.paths import resolve
from . import cursor
from .stats import QueryCache, Recorder

#: Seconds after which an undecided transaction counts as crashed; parts that make a collection be written anew; manifests kept.
STALE_S, MOST_PARTS, KEPT = 60, 32, 20


class DuplicateKeyError(ValueError):
    pass


class WriteConflict(RuntimeError):
    pass


@dataclass
class InsertOneResult:
    inserted_id: int


@dataclass
class InsertManyResult:
    inserted_ids: list[int]


@dataclass
class UpdateResult:
    matched_count: int
    modified_count: int
    upserted_id: int | None = None


@dataclass
class DeleteResult:
    deleted_count: int


class Files:
    """Small files and folders through Hadoop's file systems, so any path that Spark reads will do."""

    links = True

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def age(self, path: str) -> float:
        fs, p = self.at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def create(self, path: str, content: str) -> bool:
        """The file with its whole content, unless there is one of that name: then False, and that one stays."""
        fs, p = self.at(path)
        _, new = self.at(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        fs.mkdirs(p.getParent())
        stream = fs.create(new, True)
        stream.write(bytearray(content.encode()))
        stream.close()
        try:
            if self.links and fs.getUri().getScheme() == "file":  # atomic on a local disk, where a rename only looks first
                os.link(new.toUri().getPath(), p.toUri().getPath())
                return True
            none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.org.apache.hadoop.fs.Options.Rename._java_lang_class, 0)
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(new, p, none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(p):
                return False
            raise
        finally:
            if fs.exists(new):
                fs.delete(new, False)

    def names(self, path: str, folders: bool = False) -> list[str]:
        fs, p = self.at(path)
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted(n for s in found if s.isDirectory() == folders and not (n := s.getPath().getName()).startswith("."))

    def remove(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)


EMPTY = {"version": 0, "parts": [], "schema": None, "count": 0, "last_id": 0, "indexes": {}, "text_indexes": {}}


class Collection:
    def __init__(self, spark: SparkSession, path: str, name: str = "", database: Database | None = None):
        self.spark, self.path, self.name, self.database = spark, path.rstrip("/"), name or path.rstrip("/").rpartition("/")[2], database
        self.files, self.cache, self.recorder = Files(spark), QueryCache(), Recorder()
        self.staged: dict | None = None
        self.at_version: int | None = None

    # ---- versions

    def _log(self, number: int) -> str:
        return f"{self.path}/manifests/{number:020d}.json"

    def _decision(self, name: str) -> str:
        return f"{self.path.rpartition('/')[0]}/.transactions/{name}.json"

    def _state(self, name: str) -> str:
        """of a transaction: committed, aborted or open."""
        path = self._decision(name)
        return json.loads(self.files.read(path))["state"] if self.files.exists(path) else "open"

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]

    def manifest(self) -> dict:
        if self.staged is not None:
            return self.staged
        for number in reversed(self.numbers()):
            if self.at_version is not None and number > self.at_version:
                continue
            found = json.loads(self.files.read(self._log(number)))
            if not found.get("transaction") or self._state(found["transaction"]) == "committed":
                return {**EMPTY, **found}
        return dict(EMPTY)

    def as_of(self, version: int) -> Collection:
        """The collection as it was at a version that is still kept; for reading."""
        old = Collection(self.spark, self.path, self.name, self.database)
        old.at_version = version
        return old

    def dataframe(self) -> DataFrame | None:
        return self._read(self.manifest())

    def _read(self, manifest: dict) -> DataFrame | None:
        """All parts; those of one schema in one scan. Fields that a part lacks are null."""
        if not manifest["parts"]:
            return None
        by_schema: dict[str, list[str]] = {}
        for part in manifest["parts"]:
            by_schema.setdefault(part["schema"], []).append(f"{self.path}/data/{part['folder']}")
        frames = [self.spark.read.schema(T.StructType.fromJson(json.loads(k))).parquet(*v) for k, v in by_schema.items()]
        return functools.reduce(aligned, frames)

    def _write(self, df: DataFrame) -> dict:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{folder}")
        return {"folder": folder, "schema": json.dumps(df.schema.jsonValue())}

    def _discard(self, part: dict) -> None:
        self.files.remove(f"{self.path}/data/{part['folder']}")

    def commit(self, base: dict, **changes) -> None:
        """base with changes becomes the current version, if base still is."""
        new = {**base, **changes, "version": base["version"] + 1}
        new.pop("transaction", None)
        if self.staged is not None:
            self.staged = new
        else:
            self.put(base, new)
            self._clean()

    def put(self, base: dict, new: dict) -> int:
        """Creates the next manifest; its number."""
        numbers = self.numbers()
        for number in reversed(numbers):
            if number <= base["version"]:
                break
            name = json.loads(self.files.read(self._log(number))).get("transaction")
            state = self._state(name) if name else "committed"
            if state == "open" and self.files.age(self._log(number)) > STALE_S:
                self.files.create(self._decision(name), json.dumps({"state": "aborted"}))
                state = self._state(name)
            if state != "aborted":
                raise WriteConflict(self.name)
        number = max([base["version"], *numbers]) + 1
        if not self.files.create(self._log(number), json.dumps({**new, "version": number})):
            raise WriteConflict(self.name)
        return number

    def _clean(self) -> None:
        """Old manifests go, and parts that only they list."""
        numbers = self.numbers()
        if len(numbers) <= 2 * KEPT:
            return
        read = lambda n: json.loads(self.files.read(self._log(n)))
        now = self.manifest()
        needed = {p["folder"] for m in [now, *map(read, numbers[-KEPT:])] for p in m["parts"]}
        for n in numbers[:-KEPT]:
            if n == now["version"]:
                continue
            for part in read(n)["parts"]:
                if part["folder"] not in needed:
                    self._discard(part)
            self.files.remove(self._log(n))

    def check_unique(self, df: DataFrame, index: dict, old: DataFrame | None = None) -> None:
        """No key twice in df, nor in df and old; only new rows are grouped."""
        if not index.get("unique"):
            return

        def keys_of(frame: DataFrame) -> DataFrame:
            found = [resolve(frame.schema, k) for k, _ in index["keys"]]
            keys = frame.select(*((f[0] if f else F.lit(None)).alias(f"k{i}") for i, f in enumerate(found)))
            return keys.na.drop("all") if index.get("sparse") else keys

        new = keys_of(df)
        twice = not new.groupBy(*new.columns).count().where("count > 1").isEmpty()
        if not twice and old is not None:
            was = keys_of(old)
            twice = not new.join(was, [new[c].eqNullSafe(was[c]) for c in new.columns], "left_semi").isEmpty()
        if twice:
            raise DuplicateKeyError(f"{self.name}: {index['keys']}")

    # ---- inserts

    def insert_one(self, doc: dict) -> InsertOneResult:
        return InsertOneResult(self.insert_many([doc]).inserted_ids[0])

    def insert_many(self, docs: list[dict]) -> InsertManyResult:
        if not docs:
            return InsertManyResult([])
        if any("_id" in d for d in docs):
            raise ValueError("_id is given by the collection")
        base = self.manifest()
        ids = list(range(base["last_id"] + 1, base["last_id"] + 1 + len(docs)))
        self._append(base, self._rows_of(docs, ids, base), len(docs), ids[-1])
        return InsertManyResult(ids)

    def _rows_of(self, docs: list[dict], ids: list[int], base: dict) -> DataFrame:
        names = [n for n in dict.fromkeys(k for d in docs for k in d) if n != "_id"]
        rows = [{"_id": i, **{n: d.get(n) for n in names}} for i, d in zip(ids, docs)]
        return self.spark.createDataFrame(rows, schema=self._schema(rows, self._read(base)))

    def insert_frame(self, df: DataFrame) -> int:
        """How many rows of a DataFrame were inserted. Ids follow the largest, in the DataFrame's order, dealt by partition totals."""
        base = self.manifest()
        marked = df.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
        totals = marked.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
        before = totals.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
        # one row per partition
        rows = marked.join(F.broadcast(before), "__p").withColumn("_id", F.col("__before") + F.col("__m").bitwiseAND(F.lit(2**33 - 1)) + base["last_id"] + 1)
        seen = Observation()
        n = self._append(base, rows.select("_id", *(f"`{c}`" for c in df.columns)).observe(seen, F.count(F.lit(1)).alias("n")), None, None, seen)
        return n

    def _append(self, base: dict, rows: DataFrame, n: int | None, last: int | None, seen: Observation | None = None) -> int:
        part = self._write(rows)
        n = seen.get["n"] if n is None else n
        new = self._read({**base, "parts": [part]})
        try:
            for index in base["indexes"].values():
                self.check_unique(new, index, self._read(base))
        except DuplicateKeyError:
            self._discard(part)
            raise
        parts = [*base["parts"], part]
        if len(parts) > MOST_PARTS:
            parts = [self._write(self._read({**base, "parts": parts}))]
        self.commit(base, parts=parts, count=base["count"] + n, last_id=base["last_id"] + n if last is None else last)
        return n

    def _schema(self, rows: list[dict], now: DataFrame | None):
        def kind(values: list[Any]):
            values = [v for v in values if v is not None]
            if not values:
                return T.StringType()
            first = values[0]
            if all(isinstance(v, bool) for v in values):
                return T.BooleanType()
            if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
                return T.LongType()
            if all(isinstance(v, (int, float)) for v in values):
                return T.DoubleType()
            if isinstance(first, dict):
                names = list(dict.fromkeys(k for v in values for k in v))
                return T.StructType([T.StructField(n, kind([v.get(n) for v in values])) for n in names])
            if isinstance(first, (list, tuple)):
                return T.ArrayType(kind([x for v in values for x in v]))
            return T._infer_type(first) if not hasattr(first, "isoformat") or not hasattr(first, "hour") else T.TimestampNTZType()

        names = list(rows[0])
        fields = {f.name: f for f in now.schema.fields} if now is not None else {}
        out = []
        for n in names:
            found = kind([r[n] for r in rows])
            if n in fields and (all(r[n] is None for r in rows) or fields[n].dataType == found):
                found = fields[n].dataType
            out.append(T.StructField(n, found))
        for n, field in ((f.name, f) for f in out):
            if isinstance(field.dataType, T.DoubleType):
                for r in rows:
                    r[n] = float(r[n]) if r[n] is not None else None
        return T.StructType(out)

    # ---- reads

    def find(self, spec: dict | None = None, projection: dict | None = None) -> cursor.Cursor:
        return cursor.Cursor(self._rows(), spec, projection, timed=functools.partial(self.recorder.timed, "find", spec or {}))

    def _rows(self) -> DataFrame:
        df = self.dataframe()
        return df if df is not None else self.spark.createDataFrame([], "_id long")

    def find_one(self, spec: dict | None = None) -> dict | None:
        row = self.find(spec).limit(1).first()
        return row.asDict(True) if row else None

    def aggregate(self, stages: list[dict]) -> cursor.AggregationCursor:
        tables = (lambda name: self.database[name].dataframe()) if self.database else None
        return cursor.AggregationCursor(pipeline.aggregate(self._rows(), stages, tables), functools.partial(self.recorder.timed, "aggregate", {}))

    def count_documents(self, spec: dict | None = None) -> int:
        now = self.manifest()
        if not spec:
            return now["count"]
        key = ("count", json.dumps(spec, sort_keys=True, default=str), now["version"], json.dumps(now["parts"]))
        return self.cache.get(key, lambda: self.find(spec).count())

    def estimated_document_count(self) -> int:
        return self.manifest()["count"]

    def distinct(self, key: str, spec: dict | None = None) -> list:
        with self.recorder.timed("distinct", spec or {}):
            return [r[0] for r in cursor.distinct(self._rows(), key, spec).collect()]

    # ---- the query cache and what the planner has seen

    def cache_stats(self) -> dict:
        return self.cache.stats()

    def clear_cache(self) -> None:
        self.cache.clear()

    def set_cache_enabled(self, enabled: bool) -> None:
        self.cache.enabled = enabled
        if not enabled:
            self.cache.clear()

    def query_patterns(self) -> list[dict]:
        return self.recorder.patterns()

    def slow_queries(self, limit: int = 10) -> list[dict]:
        return sorted(self.recorder.slow, key=lambda x: -x["seconds"])[:limit]

    def suggest_indexes(self, least: int = 3) -> list[str]:
        return self.recorder.suggestions(least)

    # ---- writes

    def _targets(self, df: DataFrame, spec: dict, many: bool):
        hit = F.coalesce(pipeline.predicate(spec, df), F.lit(False))
        if many:
            return hit
        first = df.where(hit).agg(F.min("_id")).first()[0]
        return F.col("_id") == first if first is not None else F.lit(False)

    def _update(self, spec: dict, update: dict, many: bool, upsert: bool) -> UpdateResult:
        """Where something matches, the new version is written in one pass that counts its changes; an upsert is one commit."""
        if not any(k.startswith("$") for k in update):
            return self.replace_one(spec, update, upsert)
        base, df = self.manifest(), self._rows()
        target = self._targets(df, spec, many)
        if df.where(target).isEmpty():
            return self._upsert(spec, update, base) if upsert else UpdateResult(0, 0)
        was = df.withColumns({"__target": target, "__was": F.struct(*(F.col(f"`{c}`") for c in df.columns))})
        new = updates.apply_update(was, update, F.col("__target"))
        kept = [c for c in new.columns if not c.startswith("__")]
        changed = functools.reduce(lambda a, b: a | b, [~F.to_json(F.struct(F.col(f"`{c}`").alias("x"))).eqNullSafe(F.to_json(F.struct(F.col(f"__was.`{c}`").alias("x")))) if c in df.columns else F.col(f"`{c}`").isNotNull() for c in kept])
        seen = Observation()
        part = self._write(new.observe(seen, F.count_if("__target").alias("matched"), F.count_if(F.col("__target") & changed).alias("changed")).select(*(F.col(f"`{c}`") for c in kept)))
        matched, modified = seen.get["matched"], seen.get["changed"]
        if not modified:
            self._discard(part)
            return UpdateResult(matched, 0)
        self._replace_all(base, part)
        return UpdateResult(matched, modified)

    def _upsert(self, spec: dict, update: dict, base: dict) -> UpdateResult:
        known = {k: v for k, v in spec.items() if k != "_id" and not k.startswith("$") and "." not in k and not is_operators(v)}
        made = base["last_id"] + 1
        row = aligned_to(self._rows_of([known], [made], base), self._read(base))
        self._append(base, updates.apply_update(row, update, F.lit(True)), 1, made)
        return UpdateResult(0, 0, made)

    def _replace_all(self, base: dict, part: dict, **changes) -> None:
        new = self._read({**base, "parts": [part]})
        try:
            for index in base["indexes"].values():
                self.check_unique(new, index)
        except DuplicateKeyError:
            self._discard(part)
            raise
        self.commit(base, parts=[part], **changes)

    def update_one(self, spec: dict, update: dict, upsert: bool = False) -> UpdateResult:
        return self._update(spec, update, False, upsert)

    def update_many(self, spec: dict, update: dict, upsert: bool = False) -> UpdateResult:
        """An update without operators replaces the first match."""
        return self._update(spec, update, True, upsert)

    def replace_one(self, spec: dict, doc: dict, upsert: bool = False) -> UpdateResult:
        """The first match becomes doc, with its _id. Types that differ meet as they do on insert: the wider number, or text."""
        base, df = self.manifest(), self._rows()
        found = df.where(pipeline.predicate(spec, df)).orderBy("_id").limit(1).collect()
        if not found:
            return UpdateResult(0, 0, self.insert_one({k: v for k, v in doc.items() if k != "_id"}).inserted_id if upsert else None)
        old = found[0].asDict(True)
        if {k: v for k, v in old.items() if v is not None and k != "_id"} == {k: v for k, v in doc.items() if v is not None and k != "_id"}:
            return UpdateResult(1, 0)
        row = self._rows_of([doc], [old["_id"]], base)
        self._replace_all(base, self._write(aligned(df.where(F.col("_id") != old["_id"]), row)))
        return UpdateResult(1, 1)

    def _delete(self, spec: dict, many: bool) -> DeleteResult:
        base, df = self.manifest(), self._rows()
        gone, seen = self._targets(df, spec, many), Observation()
        if df.where(gone).isEmpty():
            return DeleteResult(0)
        kept = df.where(~gone).observe(seen, F.count(F.lit(1)).alias("n"), F.max("_id").alias("last"))
        part = self._write(kept)
        n, last = seen.get["n"], seen.get["last"]
        self.commit(base, parts=[part], count=n, last_id=last or 0)
        return DeleteResult(base["count"] - n)

    def delete_one(self, spec: dict) -> DeleteResult:
        return self._delete(spec, False)

    def delete_many(self, spec: dict) -> DeleteResult:
        return self._delete(spec, True)

    def find_one_and_delete(self, spec: dict) -> dict | None:
        found = self.find_one(spec)
        if found:
            self.delete_one({"_id": found["_id"]})
        return found

    def _find_and(self, change, spec: dict, new: dict, upsert: bool, return_document: str) -> dict | None:
        found = self.find_one(spec)
        done = change({"_id": found["_id"]} if found else spec, new, upsert)
        if return_document == "after":
            return self.find_one({"_id": found["_id"] if found else done.upserted_id}) if found or done.upserted_id is not None else None
        return found

    def find_one_and_update(self, spec: dict, update: dict, upsert: bool = False, return_document: str = "before") -> dict | None:
        return self._find_and(self.update_one, spec, update, upsert, return_document)

    def find_one_and_replace(self, spec: dict, doc: dict, upsert: bool = False, return_document: str = "before") -> dict | None:
        return self._find_and(self.replace_one, spec, doc, upsert, return_document)

    # ---- indexes: constraints and hints; lookups are Parquet's statistics

    def create_index(self, keys, unique: bool = False, sparse: bool = False, name: str | None = None) -> str:
        keys = [(keys, 1)] if isinstance(keys, str) else [tuple(k) if not isinstance(k, str) else (k, 1) for k in keys]
        name, base = name or "_".join(f"{k}_{d}" for k, d in keys), self.manifest()
        index = {"keys": keys, "unique": unique, "sparse": sparse}
        if base["parts"]:
            self.check_unique(self._read(base), index)
        self.commit(base, indexes={**base["indexes"], name: index})
        return name

    def drop_index(self, name: str) -> None:
        base = self.manifest()
        self.commit(base, indexes={k: v for k, v in base["indexes"].items() if k != name})

    def list_indexes(self) -> dict:
        return self.manifest()["indexes"]

    def get_index(self, name: str) -> dict | None:
        return self.list_indexes().get(name)

    # ---- text indexes: their fields are kept in the manifest, their postings beside the data

    def create_text_index(self, fields: list[str] | str, name: str | None = None) -> str:
        fields = [fields] if isinstance(fields, str) else list(fields)
        base, name = self.manifest(), name or "fulltext_" + "_".join(fields)
        self.commit(base, text_indexes={**base["text_indexes"], name: fields})
        return name

    def drop_text_index(self, name: str) -> None:
        base = self.manifest()
        self.commit(base, text_indexes={k: v for k, v in base["text_indexes"].items() if k != name})
        self.files.remove(f"{self.path}/postings/{name}")

    def list_text_indexes(self) -> dict:
        return self.manifest()["text_indexes"]

    def text_index(self, name: str) -> text.TextIndex:
        """The index with the postings of the current version, written the first time they are asked for."""
        now, df = self.manifest(), self._rows()
        index = text.TextIndex(df, now["text_indexes"][name], name=name)
        # a version's parts name its postings
        folder = f"{self.path}/postings/{name}/{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(now['parts'])).hex}"
        if self.files.exists(f"{folder}/_SUCCESS"):
            index.saved = self.spark.read.parquet(folder)
            return index
        self.files.remove(f"{self.path}/postings/{name}")
        return index.save(folder)

    def text_index_stats(self, name: str) -> dict:
        return self.text_index(name).stats().first().asDict()

    def full_text_search(self, query: str, fields: list[str] | None = None, limit: int | None = None, index: str | None = None) -> list[dict]:
        """By the named index, the index of the fields, or else the first one; without any, all top-level values are scanned."""
        df, known = self._rows(), self.list_text_indexes()
        if index is None and fields is not None:
            index = next((k for k, v in known.items() if v == list(fields)), None)
        elif index is None:
            index = next(iter(known), None)
        if index is None and not fields:
            found = text.scan(df, query).orderBy("_id")
            return [r.asDict(True) for r in (found.limit(limit) if limit else found).collect()]
        hits = (self.text_index(index) if index else text.TextIndex(df, fields)).search(query, limit)
        rows = df.join(hits.withColumnRenamed("id", "__id").withColumnRenamed("score", "_score"), F.col("_id") == F.col("__id")).orderBy(F.col("_score").desc(), "_id")
        return [r.asDict(True) for r in rows.drop("__id").collect()]

    def drop(self) -> None:
        self.files.remove(self.path)


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type in which two columns of one name meet; None where rows are merged field by field."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return None
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def aligned(now: DataFrame | None, new: DataFrame) -> DataFrame:
    """Both together; a column whose types differ becomes the wider number, or text."""
    if now is None:
        return new
    for name in sorted(set(now.columns) & set(new.columns)):
        kind = wider(now.schema[name].dataType, new.schema[name].dataType)
        if kind is not None and now.schema[name].dataType != new.schema[name].dataType:
            now, new = now.withColumn(name, F.col(name).cast(kind)), new.withColumn(name, F.col(name).cast(kind))
    return now.unionByName(new, allowMissingColumns=True)


def aligned_to(row: DataFrame, now: DataFrame | None) -> DataFrame:
    """row with the columns of now, null where it has none."""
    return row if now is None else aligned(row, now.limit(0))


class Database:
    def __init__(self, spark: SparkSession, path: str, name: str = ""):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name or path.rstrip("/").rpartition("/")[2]
        self.collections: dict[str, Collection] = {}

    def __getitem__(self, name: str) -> Collection:
        return self.collections.setdefault(name, Collection(self.spark, f"{self.path}/{name}", name, self))

    def __getattr__(self, name: str) -> Collection:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def create_collection(self, name: str) -> Collection:
        files = Files(self.spark)
        fs, p = files.at(f"{self.path}/{name}")
        fs.mkdirs(p)
        return self[name]

    def list_collection_names(self) -> list[str]:
        return Files(self.spark).names(self.path, folders=True)

    def drop_collection(self, name: str) -> None:
        self[name].drop()
        self.collections.pop(name, None)

    def command(self, name: str) -> dict:
        if name == "ping":
            return {"ok": 1}
        if name == "listCollections":
            return {"ok": 1, "collections": self.list_collection_names()}
        if name == "serverStatus":
            return {"ok": 1, "collections": len(self.list_collection_names()), "version": self.spark.version}
        raise NotImplementedError(name)

    def transaction(self) -> Transaction:
        return Transaction(self)


class Client:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.databases = spark, path.rstrip("/"), {}

    def __getitem__(self, name: str) -> Database:
        return self.databases.setdefault(name, Database(self.spark, f"{self.path}/{name}", name))

    def __getattr__(self, name: str) -> Database:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def list_database_names(self) -> list[str]:
        return Files(self.spark).names(self.path, folders=True)

    def drop_database(self, name: str) -> None:
        Files(self.spark).remove(f"{self.path}/{name}")
        self.databases.pop(name, None)

    def admin_command(self, name: str) -> dict:
        if name == "ping":
            return {"ok": 1}
        if name == "buildInfo":
            return {"ok": 1, **self.server_info()}
        if name == "listDatabases":
            return {"ok": 1, "databases": self.list_database_names()}
        raise NotImplementedError(name)

    def server_info(self) -> dict:
        return {"engine": "spark", "version": self.spark.version, "ok": 1}

    def close(self) -> None:
        self.databases.clear()


class Transaction:
    """Reads see the versions pinned at the first touch; writes are staged; commit decides all of them by one file, abort none."""

    def __init__(self, database: Database):
        self.database, self.pinned, self.name = database, {}, uuid.uuid4().hex

    def __getitem__(self, name: str) -> Collection:
        if name not in self.pinned:
            original = self.database[name]
            staged = Collection(original.spark, original.path, name, self.database)
            base = original.manifest()
            staged.staged = dict(base)
            self.pinned[name] = (original, staged, base)
        return self.pinned[name][1]

    def __enter__(self) -> Transaction:
        if getattr(self.database, "_open", None):
            raise RuntimeError("a transaction is open")
        object.__setattr__(self.database, "_open", self)
        return self

    def __exit__(self, kind, *_) -> None:
        object.__setattr__(self.database, "_open", None)
        if kind is None:
            self.commit()

    def prepare(self) -> None:
        """The marked manifests, in order of names; none stays in the way if one can't be put."""
        changed = sorted((n, o, s, b) for n, (o, s, b) in self.pinned.items() if s.staged["version"] != b["version"])
        try:
            for _, original, staged, base in changed:
                original.put(base, {**staged.staged, "transaction": self.name})
        except WriteConflict:
            self._decide("aborted")
            raise

    def _decide(self, state: str) -> bool:
        return Files(self.database.spark).create(f"{self.database.path}/.transactions/{self.name}.json", json.dumps({"state": state}))

    def commit(self) -> None:
        if self.pinned:
            self.prepare()
            if not self._decide("committed"):
                raise WriteConflict(self.name)
        self.pinned = {}

    def abort(self) -> None:
        if self.pinned:
            self._decide("aborted")
        self.pinned = {}
