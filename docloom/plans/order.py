"""Order of documents. Frames carry it as the hidden column ORD, a struct that sorts ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORD = "__ord"


def sort_key(col: Column, kind: T.DataType, ascending: bool) -> list[Column]:
    """Columns whose ascending order is that of col, nulls last either way."""
    if ascending:
        key = col
    elif isinstance(kind, T.BooleanType):
        key = ~col
    elif isinstance(kind, T.NumericType):
        key = -col.cast("decimal(38,0)") if isinstance(kind, T.IntegralType) else -col
    elif isinstance(kind, T.TimestampNTZType):
        key = -F.unix_micros(col.cast("timestamp"))
    elif isinstance(kind, T.TimestampType):
        key = -F.unix_micros(col)
    elif isinstance(kind, T.DateType):
        key = -F.unix_date(col)
    else:  # digits of the UTF-8 bytes, turned round; the end sorts after every digit
        key = F.translate(F.concat(F.hex(F.encode(col.cast("string"), "UTF-8")), F.lit("G")), "0123456789ABCDEFG", "FEDCBA9876543210G")
    return [col.isNull(), key]


def sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return sortable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def ordered(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df with ORD: the columns named, or else all that sort. Unused, it is pruned."""
    if ORD in df.columns:
        return df
    names = by or (["_id"] if "_id" in df.columns else [f.name for f in df.schema.fields if sortable(f.dataType)])
    keys = [F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)] or [F.lit(0).alias("k0")]
    return df.withColumn(ORD, F.struct(*keys))


def in_order(values: Column, order: Column) -> Column:
    """An aggregate: the list of values, nulls kept, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x["v"])
