"""The JSON envelope {"data": [...], "_indexes": [...]}, tagged values, gzip and encrypted columns."""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import json
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import picked


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of an envelope file; .gz files are unpacked. Tagged values are decoded.

    An envelope is one JSON value, so one task reads it: it is for interchange. read_lines reads what json_lines writes, in parallel.
    """
    return untagged(spark.read.option("multiLine", True).json(path).selectExpr("inline(data)"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents of tagged JSON, one a line; files may be gzipped and many."""
    return untagged(spark.read.json(path))


def untagged(docs: DataFrame) -> DataFrame:
    """docs with tagged values decoded. One pass over the tags tells which occur in each column."""
    found = {}
    for f in docs.schema.fields:
        tags_of(F.col(f"`{f.name}`"), f.dataType, f.name, found)
    seen = docs.agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f"t{i}") for i, c in enumerate(found.values()))).first() if found else []
    tags = dict(zip(found, seen))
    return docs.select(*(decoded(F.col(f"`{f.name}`"), f.dataType, f.name, tags).alias(f.name) for f in docs.schema.fields))


def tags_of(col: Column, kind: T.DataType, path: str, found: dict) -> None:
    """Puts into found, by path, a column that is the array of the tags that a row holds there."""
    if is_tagged(kind):
        found[path] = F.array_compact(F.array(col.getField("_type")))
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            tags_of(col.getField(f.name), f.dataType, f"{path}.{f.name}", found)
    elif isinstance(kind, T.ArrayType):
        if is_tagged(kind.elementType):
            found[path] = F.coalesce(F.array_compact(F.transform(col, lambda x: x["_type"])), F.array().cast("array<string>"))
        elif isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                if is_tagged(f.dataType):
                    found[f"{path}.{f.name}"] = F.coalesce(F.array_compact(F.transform(picked(col, f.name), lambda x: x["_type"])), F.array().cast("array<string>"))


def read_variant(spark: SparkSession, path: str) -> DataFrame:
    """(pos, doc): each document as a VARIANT, which tells missing from null and keeps every document's own types."""
    spark.read.format("json").option("multiLine", True).option("singleVariantColumn", "v").load(path).createOrReplaceTempView("__envelope")
    return spark.sql("SELECT e.pos, e.value AS doc FROM __envelope, LATERAL variant_explode(v:data) AS e")


def present(path: str) -> Column:
    """Whether a document of read_variant has the path, null or not."""
    return F.expr(f"variant_get(doc, '$.{path}', 'variant')").isNotNull()


def is_tagged(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and set(kind.names) == {"_type", "value"}


MAKE = {
    "datetime": lambda v: v.try_cast("timestamp_ntz"),
    "decimal": lambda v: v.try_cast("decimal(38,18)"),
    "binary": lambda v: F.try_to_binary(v, F.lit("base64")),
}


def decoded(col: Column, kind: T.DataType, path: str = "", tags: dict | None = None) -> Column:
    """Tagged values become timestamps, decimals or binary where one tag occurs in the column (tags: path to tags); values of
    several tags become a row with a field for each."""
    tags = tags or {}
    if is_tagged(kind):
        names = [t for t in tags.get(path) or MAKE if t in MAKE]
        value = lambda t: F.when(col.getField("_type") == t, MAKE[t](col.getField("value").cast("string")))
        return value(names[0]) if len(names) == 1 else F.struct(*(value(t).alias(t) for t in names)) if names else col.getField("value")
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(decoded(col.getField(f.name), f.dataType, f"{path}.{f.name}", tags).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(col, lambda x: decoded(x, kind.elementType, path, tags))
    return col


def encoded(col: Column, kind: T.DataType) -> Column:
    """The inverse: timestamps, decimals and binary as tagged structs."""
    tag = lambda name, value: F.when(col.isNotNull(), F.struct(F.lit(name).alias("_type"), value.alias("value")))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return tag("datetime", F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.DecimalType):
        return tag("decimal", col.cast("string"))
    if isinstance(kind, T.BinaryType):
        return tag("binary", F.base64(col))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(encoded(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: encoded(x, kind.elementType))
    return col


def json_lines(df: DataFrame) -> DataFrame:
    """One column, a document of tagged JSON per row: what a distributed export writes."""
    return df.select(F.to_json(F.struct(*(encoded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields)), {"ignoreNullFields": "false"}).alias("value"))


def to_json_value(value):
    """A Python value in the envelope's form."""
    if isinstance(value, datetime):
        return {"_type": "datetime", "value": value.isoformat()}
    if isinstance(value, Decimal):
        return {"_type": "decimal", "value": str(value)}
    if isinstance(value, (bytes, bytearray)):
        return {"_type": "binary", "value": base64.b64encode(bytes(value)).decode()}
    if isinstance(value, dict):
        return {k: to_json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json_value(v) for v in value]
    return value


def from_json_value(value):
    """The inverse of to_json_value."""
    if isinstance(value, dict):
        if set(value) == {"_type", "value"}:
            make = {"datetime": datetime.fromisoformat, "decimal": Decimal, "binary": base64.b64decode}.get(value["_type"])
            if make:
                return make(value["value"])
        return {k: from_json_value(v) for k, v in value.items()}
    return [from_json_value(v) for v in value] if isinstance(value, list) else value


def write_envelope(df: DataFrame, path: str, indexes: list | None = None) -> None:
    """A single envelope file, streamed row by row through the driver: for interchange, not for large tables. .gz is packed."""
    with gzip.open(path, "wt", encoding="utf-8") if path.endswith(".gz") else open(path, "w", encoding="utf-8") as out:
        out.write('{"data": [')
        for i, row in enumerate(json_lines(df).toLocalIterator()):
            out.write(",\n" * (i > 0) + row["value"])
        out.write('], "_indexes": ' + json.dumps(indexes or []) + "}")


def key_of(key: Column | str | bytes | None, password: str | None, salt: bytes) -> Column:
    return key if isinstance(key, Column) else F.lit(key if key is not None else derive_key(password, salt))


def encrypt(df: DataFrame, columns: list[str], key: Column | str | bytes | None = None, password: str | None = None, salt: bytes = b"") -> DataFrame:
    """Columns as AES-GCM of their text, by a key of 16, 24 or 32 bytes or one derived from a password and salt."""
    key = key_of(key, password, salt)
    return df.withColumns({c: F.aes_encrypt(F.col(c).cast("string"), key, F.lit("GCM")) for c in columns})


def decrypt(df: DataFrame, columns: list[str], key: Column | str | bytes | None = None, password: str | None = None, salt: bytes = b"") -> DataFrame:
    key = key_of(key, password, salt)
    return df.withColumns({c: F.aes_decrypt(F.col(c), key, F.lit("GCM")).cast("string") for c in columns})


@functools.lru_cache(64)
def derive_key(password: str, salt: bytes) -> bytes:
    """A 256-bit key by PBKDF2-SHA256 with 100 000 rounds."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, 100_000, 32)
