"""Queries of the document engine over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, text
from .operators.updates import apply_update
from .plans.filters import vectorised
from .plans.pipeline import aggregate, predicate
from .plans.session import shared_path
from .sources import jsonio
from .sources.cursor import Cursor, distinct
from .sources.store import Client, Collection, Database, DuplicateKeyError, WriteConflict
from .streaming.windows import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def stages(name: str, sql: str, table: str, *pipeline: dict, order: tuple[str, ...] = (), tables: tuple[str, ...] = (), view: Callable | None = None) -> None:
    """Registers an aggregation pipeline over a table (or a view made of it)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        df = view(spark, sf_dir, df) if view else df
        return aggregate(df, list(pipeline), {t: read(spark, sf_dir, t) for t in tables}, list(order) or None)

    QUERIES[name], SQL[name] = run, sql


def find(name: str, sql: str, table: str, spec: dict, columns: str, view: Callable | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        df = view(spark, sf_dir, df) if view else df
        return df.where(predicate(spec, df)).select(*columns.split())

    QUERIES[name], SQL[name] = run, sql


# ---- filters ----------------------------------------------------------------------------------------------------

LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice"
LINE_SQL = LINE.replace(" ", ", ")
find("match_range", f"SELECT {LINE_SQL} FROM lineitem WHERE l_quantity > 20 AND l_quantity <= 30 AND l_discount >= 0.05 AND l_shipdate < TIMESTAMP '1997-01-01'", "lineitem", {"l_quantity": {"$gt": 20, "$lte": 30}, "l_discount": {"$gte": 0.05}, "l_shipdate": {"$lt": datetime(1997, 1, 1)}}, LINE)
find("match_or_nested", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderpriority = '1-URGENT' AND (o_orderstatus = 'P' OR o_custkey < 100))", "orders", {"$or": [{"o_orderstatus": "F", "o_totalprice": {"$gt": 300000}}, {"$and": [{"o_orderpriority": "1-URGENT"}, {"$or": [{"o_orderstatus": "P"}, {"o_custkey": {"$lt": 100}}]}]}]}, "o_orderkey")
find("match_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)", "part", {"p_size": {"$in": [1, 5, 9]}}, "p_partkey p_size")
find("match_nin", "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 5, 9) AND p_brand <> 'Brand#11'", "part", {"p_size": {"$nin": [1, 5, 9]}, "p_brand": {"$ne": "Brand#11"}}, "p_partkey p_size")
find("match_regex_i", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^BLUE', 'i')", "part", {"p_name": {"$regex": "^BLUE", "$options": "i"}}, "p_partkey p_name")
find("callable_predicate", "SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3", "orders", {"o_custkey": {(lambda v, by, rest: v % by == rest): [7, 3]}}, "o_orderkey")


def maybe_lines(spark, sf_dir, df):
    """Orders with what they shipped, null where they have no lines."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_quantity").alias("max_qty"))
    return df.join(lines, df.o_orderkey == lines.l_orderkey, "left")


MAYBE = "orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, max(l_quantity) AS max_qty FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"
find("exists_false", f"SELECT o_orderkey FROM {MAYBE} WHERE n_lines IS NULL", "orders", {"n_lines": {"$exists": False}}, "o_orderkey", maybe_lines)
find("ne_null_safe", f"SELECT o_orderkey, n_lines FROM {MAYBE} WHERE n_lines IS DISTINCT FROM 4 AND o_orderstatus = 'P'", "orders", {"n_lines": {"$ne": 4}, "o_orderstatus": "P"}, "o_orderkey n_lines", maybe_lines)
find("match_nor_not", f"SELECT o_orderkey FROM {MAYBE} WHERE NOT coalesce(max_qty > 20 OR o_totalprice < 1000, false) AND NOT coalesce(n_lines >= 6, false)", "orders", {"$nor": [{"max_qty": {"$gt": 20}}, {"o_totalprice": {"$lt": 1000}}], "n_lines": {"$not": {"$gte": 6}}}, "o_orderkey", maybe_lines)
find("match_expr", "SELECT o_orderkey FROM orders WHERE o_totalprice > o_custkey * 200", "orders", {"$expr": {"$gt": ["$o_totalprice", {"$multiply": ["$o_custkey", 200]}]}}, "o_orderkey")


def word_arrays(spark, sf_dir, df):
    return df.withColumns({"words": F.split("p_name", " "), "box": F.struct(F.col("p_size").alias("size"), F.array(F.struct(F.col("p_size").alias("n")), F.struct((F.col("p_size") * 2).alias("n"))).alias("parts"))})


find("match_all_array", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['blue', 'bolt'])", "part", {"words": {"$all": ["blue", "bolt"]}}, "p_partkey", word_arrays)
find("match_array_contains", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'bolt') AND len(string_split(p_name, ' ')) = 2", "part", {"words": "bolt", "words ": {"$exists": False}, "$and": [{"words": {"$size": 2}}]}, "p_partkey", word_arrays)
find("match_dotted_fanout", "SELECT p_partkey FROM part WHERE (p_size = 20 OR p_size * 2 = 20) AND p_size > 5", "part", {"box.parts.n": 20, "box.size": {"$gt": 5}}, "p_partkey", word_arrays)


find("match_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey >= 100", "orders", {"o_orderstatus": {"$eq": "P"}, "o_custkey": {"$gte": 100}}, "o_orderkey")
find("match_not_top", f"SELECT o_orderkey FROM {MAYBE} WHERE NOT coalesce(n_lines > 3 AND o_orderstatus = 'O', false)", "orders", {"$not": {"n_lines": {"$gt": 3}, "o_orderstatus": "O"}}, "o_orderkey", maybe_lines)
find("exists_true", f"SELECT o_orderkey FROM {MAYBE} WHERE n_lines IS NOT NULL", "orders", {"n_lines": {"$exists": True}}, "o_orderkey", maybe_lines)
find("match_mod", "SELECT p_partkey FROM part WHERE p_size % 4 = 1", "part", {"p_size": {"$mod": [4, 1]}}, "p_partkey")
find("match_type", f"SELECT o_orderkey FROM {MAYBE} WHERE n_lines IS NOT NULL", "orders", {"n_lines": {"$type": "long"}, "o_orderstatus": {"$not": {"$type": "number"}}}, "o_orderkey", maybe_lines)
find("match_elem_match", "SELECT p_partkey FROM part WHERE p_size BETWEEN 11 AND 19 OR p_size * 2 BETWEEN 11 AND 19", "part", {"box.parts": {"$elemMatch": {"n": {"$gt": 10, "$lt": 20}}}}, "p_partkey", word_arrays)
find("match_subdocument", "SELECT p_partkey FROM part WHERE p_size = 11 AND p_brand = 'Brand#2'", "part", {"of": {"size": 11, "brand": "Brand#2"}}, "p_partkey", lambda spark, sf_dir, df: df.withColumn("of", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))))
find("vectorised_predicate", "SELECT o_orderkey FROM orders WHERE o_totalprice - floor(o_totalprice) > 0.5", "orders", {"o_totalprice": {vectorised(lambda v, least: v % 1 > least): [0.5]}}, "o_orderkey")


@query("SELECT p_partkey, p_size AS size, p_size::VARCHAR || ',' || (2 * p_size)::VARCHAR AS parts FROM part")
def find_nested_projection(spark, sf_dir):
    found = Cursor(word_arrays(spark, sf_dir, read(spark, sf_dir, "part")), {}, {"p_partkey": 1, "box.size": 1, "box.parts.n": 1}, order=["p_partkey"]).dataframe()
    return found.select("p_partkey", "box.size", F.array_join(F.transform("box.parts", lambda x: x["n"].cast("string")), ",").alias("parts"))


@query("""WITH f AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P')
SELECT count(*) AS n, count(*) FILTER (k BETWEEN 4 AND 13) AS page, min(o_orderkey) FILTER (k = 4) AS first, min(o_orderkey) FILTER (k = 6) AS third, sum(o_orderkey) FILTER (k IN (5, 6))::BIGINT AS middle FROM f""")
def cursor_methods(spark, sf_dir):
    """count ignores skip and limit; all, first, items and slices don't; the cursor runs anew each time."""
    c = Cursor(read(spark, sf_dir, "orders"), {"o_orderstatus": "P"}, order=["o_orderkey"]).skip(3).limit(10).sort("o_totalprice", -1)
    middle = sum(r.o_orderkey for r in c[1:3])
    return spark.createDataFrame([(len(c), len(c.all()), c.first().o_orderkey, c[2].o_orderkey, middle)], "n long, page long, first long, third long, middle long")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def find_sort_skip_limit(spark, sf_dir):
    cursor = Cursor(read(spark, sf_dir, "orders"), {"o_orderstatus": "O"}, order=["o_orderkey"])
    return cursor.limit(50).sort([("o_totalprice", -1), ("o_orderkey", 1)]).skip(20).projection({"o_orderkey": 1, "o_totalprice": 1, "o_orderdate": 1}).dataframe()


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_name DESC LIMIT 25")
def find_sort_strings_desc(spark, sf_dir):
    return Cursor(read(spark, sf_dir, "customer"), {}, {"c_acctbal": 0}, order=["c_custkey"]).sort("c_mktsegment", -1).sort("c_name", -1).limit(25).dataframe()


@query("SELECT DISTINCT event_type FROM events WHERE value > 10")
def distinct_values(spark, sf_dir):
    return distinct(read(spark, sf_dir, "events"), "event_type", {"value": {"$gt": 10}})


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def count_documents(spark, sf_dir):
    return aggregate(read(spark, sf_dir, "orders"), [{"$match": {"o_totalprice": {"$gt": 100000}}}, {"$count": "n"}])


# ---- expressions ------------------------------------------------------------------------------------------------

stages("project_expr_arith", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_extendedprice / l_quantity AS unit, l_quantity + l_tax - 1 AS odd FROM lineitem", "lineitem",
       {"$project": {"_id": 0, "l_orderkey": 1, "l_linenumber": 1, "net": {"$round": [{"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, 4]}, "unit": {"$divide": ["$l_extendedprice", "$l_quantity"]}, "odd": {"$subtract": [{"$add": ["$l_quantity", "$l_tax"]}, 1]}}})
stages("expr_math", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, trunc(c_acctbal)::BIGINT AS t, (c_custkey - 700) - 7 * floor((c_custkey - 700) / 7)::BIGINT AS m, pow(c_nationkey, 2) AS p, CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS s, CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END AS d FROM customer", "customer",
       {"$project": {"c_custkey": 1, "a": {"$abs": "$c_acctbal"}, "c": {"$ceil": "$c_acctbal"}, "f": {"$floor": "$c_acctbal"}, "t": {"$trunc": "$c_acctbal"}, "m": {"$mod": [{"$subtract": ["$c_custkey", 700]}, 7]}, "p": {"$pow": ["$c_nationkey", 2]}, "s": {"$sqrt": "$c_acctbal"}, "d": {"$divide": ["$c_acctbal", "$c_nationkey"]}}})
stages("expr_string", "SELECT p_partkey, upper(p_name) || '-' || p_size AS label, substr(p_name, 2, 3) AS part3, length(p_type)::BIGINT AS n, string_split(p_name, ' ')[1] AS first, trim('  ' || lower(p_brand) || ' ') AS brand FROM part", "part",
       {"$project": {"p_partkey": 1, "label": {"$concat": [{"$toupper": "$p_name"}, "-", "$p_size"]}, "part3": {"$substr": ["$p_name", 1, 3]}, "n": {"$strlen": "$p_type"}, "first": {"$arrayElemAt": [{"$split": ["$p_name", " "]}, 0]}, "brand": {"$trim": {"$concat": ["  ", {"$tolower": "$p_brand"}, " "]}}}})
stages("expr_array", "SELECT p_partkey, len(w)::BIGINT AS n, w[2] AS second, w[-1] AS last, array_to_string(list_concat(w, w), ' ') AS twice, list_contains(w, 'blue') AS blue, array_to_string(w[-1:], ' ') AS tail, true AS is_array FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)", "part",
       {"$addFields": {"w": {"$split": ["$p_name", " "]}}},
       {"$project": {"p_partkey": 1, "n": {"$size": "$w"}, "second": {"$arrayElemAt": ["$w", 1]}, "last": {"$arrayElemAt": ["$w", -1]}, "twice": {"$concatArrays": ["$w", "$w"]}, "blue": {"$in": ["blue", "$w"]}, "tail": {"$slice": ["$w", -1]}, "is_array": {"$isArray": "$w"}}})
_arrays = QUERIES["expr_array"]
QUERIES["expr_array"] = lambda spark, sf_dir: _arrays(spark, sf_dir).withColumns({c: F.array_join(c, " ") for c in ("twice", "tail")})
stages("expr_cast_cond", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS tier, o_totalprice::VARCHAR IS NOT NULL AS has_text, trunc(o_totalprice)::BIGINT AS whole, TRY_CAST(o_orderstatus AS BIGINT) AS bad, o_custkey <> 0 AS truth, substr(o_orderpriority, 1, 1)::DOUBLE AS prio FROM orders", "orders",
       {"$project": {"o_orderkey": 1, "tier": {"$cond": [{"$gt": ["$o_totalprice", 300000]}, "big", {"$cond": {"if": {"$gt": ["$o_totalprice", 100000]}, "then": "mid", "else": "small"}}]}, "has_text": {"$ne": [{"$toString": "$o_totalprice"}, None]}, "whole": {"$toInt": "$o_totalprice"}, "bad": {"$toInt": "$o_orderstatus"}, "truth": {"$toBool": "$o_custkey"}, "prio": {"$toDouble": {"$substr": ["$o_orderpriority", 0, 1]}}}})
stages("expr_cmp_logic", f"SELECT o_orderkey, CASE WHEN n_lines > 4 THEN 1 WHEN n_lines < 4 THEN -1 WHEN n_lines = 4 THEN 0 END AS cmp, n_lines IS NOT DISTINCT FROM NULL AS no_lines, coalesce(n_lines >= 3, false) AS many, (coalesce(n_lines, 0) <> 0 AND o_custkey <> 0) AS both_, (coalesce(max_qty > 49, false) OR n_lines IS NULL) AS any_, NOT (coalesce(n_lines, 0) <> 0) AS none_, 'fixed' AS lit FROM {MAYBE}", "orders",
       {"$project": {"o_orderkey": 1, "cmp": {"$cmp": ["$n_lines", 4]}, "no_lines": {"$eq": ["$n_lines", None]}, "many": {"$gte": ["$n_lines", 3]}, "both_": {"$and": ["$n_lines", "$o_custkey"]}, "any_": {"$or": [{"$gt": ["$max_qty", 49]}, {"$eq": ["$n_lines", None]}]}, "none_": {"$not": "$n_lines"}, "lit": {"$literal": "fixed"}}}, view=maybe_lines)
stages("add_fields_chain", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_totalprice AS old, o_totalprice * 2 + 1 AS later FROM orders", "orders",
       {"$addFields": {"o_totalprice": {"$multiply": ["$o_totalprice", 2]}, "old": "$o_totalprice"}}, {"$addFields": {"later": {"$add": ["$o_totalprice", 1]}}}, {"$project": {"o_orderkey": 1, "o_totalprice": 1, "old": 1, "later": 1}})

# ---- groups -----------------------------------------------------------------------------------------------------

stages("q_pricing_summary", "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", "lineitem",
       {"$match": {"l_shipdate": {"$lte": datetime(1998, 9, 2)}}},
       {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "base": {"$sum": "$l_extendedprice"}, "disc": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "avg_qty": {"$avg": "$l_quantity"}, "n": {"$count": {}}}},
       {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "qty": 1, "base": {"$round": ["$base", 2]}, "disc": {"$round": ["$disc", 2]}, "avg_qty": 1, "n": 1}})
stages("group_basic", "SELECT c_mktsegment AS _id, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, (count(*) * 2)::BIGINT AS twos FROM customer GROUP BY 1", "customer",
       {"$group": {"_id": "$c_mktsegment", "n": {"$count": {}}, "low": {"$min": "$c_acctbal"}, "high": {"$max": "$c_acctbal"}, "twos": {"$sum": 2}}})
stages("group_null_key", f"SELECT n_lines AS _id, count(*) AS n, coalesce(avg(max_qty), 0.0) AS q FROM {MAYBE} GROUP BY 1", "orders",
       {"$group": {"_id": "$n_lines", "n": {"$sum": 1}, "q": {"$avg": "$max_qty"}}}, view=maybe_lines)
stages("group_all_empty", "SELECT NULL::INT AS _id, count(*) AS n, coalesce(sum(o_custkey), 0)::BIGINT AS s FROM orders WHERE o_totalprice < 0", "orders",
       {"$match": {"o_totalprice": {"$lt": 0}}}, {"$group": {"_id": None, "n": {"$count": {}}, "s": {"$sum": "$o_custkey"}}}, {"$project": {"_id": {"$toInt": {"$literal": None}}, "n": 1, "s": 1}})
stages("group_first_last_push", "SELECT o_custkey AS _id, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS keys FROM orders GROUP BY 1", "orders",
       {"$sort": {"o_orderdate": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_totalprice"}, "last": {"$last": "$o_totalprice"}, "keys": {"$push": {"$toString": "$o_orderkey"}}}}, order=("o_orderkey",))
_push = QUERIES["group_first_last_push"]
QUERIES["group_first_last_push"] = lambda spark, sf_dir: _push(spark, sf_dir).withColumn("keys", F.array_join("keys", ","))
stages("sort_skip_limit", "SELECT event_id, user_id, value FROM events ORDER BY user_id DESC, value, event_id LIMIT 40 OFFSET 10", "events",
       {"$sort": {"user_id": -1, "value": 1}}, {"$skip": 10}, {"$limit": 40}, {"$project": {"event_id": 1, "user_id": 1, "value": 1}}, order=("event_id",))
stages("count_stage_empty", "SELECT 0::BIGINT AS n", "events", {"$match": {"value": {"$lt": -1e9}}}, {"$count": "n"})
stages("bucket_default", "SELECT CASE WHEN p_retailprice >= 900 AND p_retailprice < 930 THEN '900' WHEN p_retailprice >= 930 AND p_retailprice < 960 THEN '930' ELSE 'other' END AS _id, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1 UNION ALL SELECT 'other', 0, 0.0 WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_retailprice < 900 OR p_retailprice >= 960)", "part",
       {"$bucket": {"groupBy": "$p_retailprice", "boundaries": [930, 900, 960], "default": "other", "output": {"n": {"$count": {}}, "mean": {"$avg": "$p_retailprice"}}}}, {"$project": {"_id": 1, "n": 1, "mean": {"$round": ["$mean", 6]}}})
stages("bucket_plain", "SELECT CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 10 ELSE 30 END::BIGINT AS _id, count(*) AS n FROM part WHERE p_size < 50 GROUP BY 1", "part",
       {"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 30, 50], "output": {"n": {"$sum": 1}}}})
stages("bucket_auto", """WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), e AS (SELECT a, b, (b - a) / 5 AS s FROM r),
p AS (SELECT o_totalprice AS x, CASE WHEN o_totalprice <= a + s THEN 0 WHEN o_totalprice <= a + 2 * s THEN 1 WHEN o_totalprice <= a + 3 * s THEN 2 WHEN o_totalprice <= a + 4 * s THEN 3 ELSE 4 END AS i, a, b, s FROM orders, e)
SELECT round(CASE WHEN i = 0 THEN any_value(a) ELSE any_value(a + i * s) END, 4) AS low, round(CASE WHEN i = 4 THEN any_value(b + (b - a) * 0.001) ELSE any_value(a + (i + 1) * s) END, 4) AS high, count(*) AS count, max(x) AS top FROM p GROUP BY i""", "orders",
       {"$bucketAuto": {"groupBy": "$o_totalprice", "buckets": 5, "output": {"top": {"$max": "$o_totalprice"}}}}, {"$project": {"_id": 0, "low": {"$round": ["$_id.min", 4]}, "high": {"$round": ["$_id.max", 4]}, "count": 1, "top": 1}})
stages("facet", "SELECT (SELECT count(*) FROM customer) AS total, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS segments, (SELECT string_agg(c_name, ',' ORDER BY c_acctbal DESC, c_custkey) FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3)) AS richest", "customer",
       {"$facet": {"total": [{"$count": "n"}], "segments": [{"$group": {"_id": "$c_mktsegment", "n": {"$count": {}}}}], "richest": [{"$sort": {"c_acctbal": -1}}, {"$limit": 3}, {"$project": {"c_name": 1}}]}},
       {"$project": {"total": {"$arrayElemAt": ["$total.n", 0]}, "segments": {"$size": "$segments"}, "richest": "$richest.c_name"}}, order=("c_custkey",))
_facet = QUERIES["facet"]
QUERIES["facet"] = lambda spark, sf_dir: _facet(spark, sf_dir).withColumn("richest", F.array_join("richest", ","))


stages("sort_lookup_limit", "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", "orders",
       {"$sort": {"o_totalprice": -1}}, {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "who"}}, {"$unwind": "$who"}, {"$skip": 5}, {"$limit": 20}, {"$project": {"o_orderkey": 1, "o_totalprice": 1, "c_name": "$who.c_name"}}, order=("o_orderkey",), tables=("customer",))
stages("group_skip_limit", "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 ORDER BY min(o_orderkey) LIMIT 10 OFFSET 7", "orders", {"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$skip": 7}, {"$limit": 10}, order=("o_orderkey",))
stages("add_fields_siblings", "SELECT p_partkey, p_size + 1 AS size, 'x' AS tag, p_size * 10 AS tens, p_size AS old FROM part", "part",
       {"$addFields": {"box.size": {"$add": ["$p_size", 1]}, "box.tag": "x", "box.deep.tens": {"$multiply": ["$p_size", 10]}, "old": "$box.size"}}, {"$project": {"p_partkey": 1, "size": "$box.size", "tag": "$box.tag", "tens": "$box.deep.tens", "old": 1}}, view=word_arrays)
stages("project_dotted", "SELECT p_partkey, upper(p_name) AS name, p_size AS size, p_retailprice * 2 AS twice FROM part", "part",
       {"$project": {"p_partkey": 1, "box.size": 1, "box.name": {"$toupper": "$p_name"}, "price.twice": {"$multiply": ["$p_retailprice", 2]}}}, {"$project": {"p_partkey": 1, "name": "$box.name", "size": "$box.size", "twice": "$price.twice"}}, view=word_arrays)


def pairs_of_parts(spark, sf_dir, df):
    return df.select("p_partkey", F.array(F.struct(F.col("p_size").alias("x"), F.col("p_brand").alias("y")), F.struct((F.col("p_size") + 1).alias("x"), F.col("p_type").alias("y"))).alias("l"))


stages("project_exclude_array", "SELECT p_partkey, '{\"y\":\"' || p_brand || '\"},{\"y\":\"' || p_type || '\"}' AS l FROM part", "part", {"$project": {"l.x": 0}}, view=pairs_of_parts)
_exclude = QUERIES["project_exclude_array"]
QUERIES["project_exclude_array"] = lambda spark, sf_dir: _exclude(spark, sf_dir).withColumn("l", F.array_join(F.transform("l", lambda x: F.to_json(x)), ","))
stages("project_literals", "SELECT c_mktsegment AS segment, 'orders' AS kind, 7::BIGINT AS seven, count(*) AS n FROM customer GROUP BY 1", "customer", {"$group": {"_id": "$c_mktsegment", "n": {"$count": {}}}}, {"$project": {"_id": 0, "segment": "$_id", "kind": "orders", "seven": {"$literal": 7}, "n": 1}})
stages("set_unset_replace_root", "SELECT p_size AS size, p_size * 2 AS twice FROM part", "part", {"$set": {"of": {"size": "$p_size", "gone": 1}}}, {"$unset": ["of.gone", "p_name"]}, {"$set": {"of.twice": {"$multiply": ["$p_size", 2]}}}, {"$replaceRoot": {"newRoot": "$of"}})
stages("sort_by_count", "SELECT o_orderstatus AS _id, count(*) AS count FROM orders GROUP BY 1", "orders", {"$sortByCount": "$o_orderstatus"})
stages("union_with", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 0", "customer", {"$project": {"k": "$c_nationkey"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$match": {"s_acctbal": {"$gt": 0}}}, {"$project": {"k": "$s_nationkey"}}]}}, tables=("supplier",))
stages("group_root", "SELECT c_nationkey AS _id, string_agg(c_name, ',' ORDER BY c_custkey) AS names, arg_min(c_acctbal, c_custkey) AS first FROM customer GROUP BY 1", "customer",
       {"$group": {"_id": "$c_nationkey", "docs": {"$push": "$$ROOT"}, "one": {"$first": "$$ROOT"}}}, {"$project": {"_id": 1, "names": "$docs.c_name", "first": "$one.c_acctbal"}}, order=("c_custkey",))
_root = QUERIES["group_root"]
QUERIES["group_root"] = lambda spark, sf_dir: _root(spark, sf_dir).withColumn("names", F.array_join("names", ","))
stages("group_optional", "SELECT o_orderstatus AS _id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds, round(stddev_pop(o_totalprice), 4) AS spread FROM orders GROUP BY 1", "orders",
       {"$group": {"_id": "$o_orderstatus", "kinds": {"$addToSet": "$o_orderpriority"}, "spread": {"$stdDevPop": "$o_totalprice"}}}, {"$project": {"_id": 1, "kinds": 1, "spread": {"$round": ["$spread", 4]}}})
_optional = QUERIES["group_optional"]
QUERIES["group_optional"] = lambda spark, sf_dir: _optional(spark, sf_dir).withColumn("kinds", F.array_join("kinds", ","))
stages("bucket_auto_negatives", """WITH r AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), e AS (SELECT a, b, (b - a) / 4 AS s FROM r),
p AS (SELECT c_acctbal AS x, CASE WHEN c_acctbal <= a + s THEN 0 WHEN c_acctbal <= a + 2 * s THEN 1 WHEN c_acctbal <= a + 3 * s THEN 2 ELSE 3 END AS i, a, b, s FROM customer, e)
SELECT round(any_value(a + i * s), 4) AS low, count(*) AS count, min(x) AS least FROM p GROUP BY i""", "customer",
       {"$bucketAuto": {"groupBy": "$c_acctbal", "buckets": 4, "output": {"least": {"$min": "$c_acctbal"}}}}, {"$project": {"_id": 0, "low": {"$round": ["$_id.min", 4]}, "count": 1, "least": 1}})
stages("bucket_auto_granularity", """WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), u AS (SELECT a, b, (b - a) / 4 AS w, pow(10, floor(log10((b - a) / 4))) AS u FROM r),
e AS (SELECT a, b, u * CASE WHEN w / u < 1.5 THEN 1 WHEN w / u < 3 THEN 2 WHEN w / u < 4.5 THEN 4 ELSE 5 END AS s FROM u),
p AS (SELECT o_totalprice AS x, CASE WHEN o_totalprice <= a + s THEN 0 WHEN o_totalprice <= a + 2 * s THEN 1 WHEN o_totalprice <= a + 3 * s THEN 2 ELSE 3 END AS i, a, s FROM orders, e)
SELECT round(any_value(a + i * s), 4) AS low, count(*) AS count FROM p GROUP BY i""", "orders",
       {"$bucketAuto": {"groupBy": "$o_totalprice", "buckets": 4, "granularity": "R20"}}, {"$project": {"_id": 0, "low": {"$round": ["$_id.min", 4]}, "count": 1}})
stages("facet_buckets", "SELECT (SELECT string_agg(_id || ':' || n, ',' ORDER BY _id) FROM (SELECT CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 10 ELSE 30 END AS _id, count(*) AS n FROM part WHERE p_size < 60 GROUP BY 1)) AS sizes, (SELECT count(*) FROM part WHERE p_size * 2 > 50) AS large, (SELECT count(DISTINCT p_brand) FROM part) AS brands", "part",
       {"$facet": {"sizes": [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 30, 60]}}], "large": [{"$addFields": {"twice": {"$multiply": ["$p_size", 2]}}}, {"$match": {"twice": {"$gt": 50}}}, {"$count": "n"}], "brands": [{"$group": {"_id": "$p_brand"}}, {"$count": "n"}]}},
       {"$project": {"sizes": 1, "large": {"$arrayElemAt": ["$large.n", 0]}, "brands": {"$arrayElemAt": ["$brands.n", 0]}}}, order=("p_partkey",))
_buckets = QUERIES["facet_buckets"]
QUERIES["facet_buckets"] = lambda spark, sf_dir: _buckets(spark, sf_dir).withColumn("sizes", F.array_join(F.transform("sizes", lambda x: F.concat(x["_id"].cast("string"), F.lit(":"), x["count"].cast("string"))), ","))
stages("expr_to_string", "SELECT o_orderkey, o_orderkey::VARCHAR AS key, CASE WHEN o_custkey > 500 THEN 'true' ELSE 'false' END AS high, NULL::BOOLEAN AS no_array, NULL::BIGINT AS no_number FROM orders", "orders",
       {"$project": {"o_orderkey": 1, "key": {"$toString": "$o_orderkey"}, "high": {"$toString": {"$gt": ["$o_custkey", 500]}}, "no_array": {"$in": ["x", "$o_orderstatus"]}, "no_number": {"$ceil": "$o_orderstatus"}}})


def conversation_docs(spark, sf_dir, df):
    """A row per conversation, its turns in an array."""
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))


def system_turns(spark, sf_dir, df):
    """A row per conversation with its system turns: an empty array where it has none, null where it has a single turn."""
    docs = conversation_docs(spark, sf_dir, df)
    return docs.withColumn("turns", F.when(F.size("turns") > 1, F.filter("turns", lambda t: t["role"] == "system")))


TURNS = {"$project": {"conv_id": 1, "turn": "$turns.turn", "role": "$turns.role"}}
stages("unwind", "SELECT conv_id, turn, role FROM conversations", "conversations", {"$unwind": "$turns"}, TURNS, view=conversation_docs)
stages("unwind_preserve", """WITH n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS s FROM conversations GROUP BY 1)
SELECT conv_id, turn, role FROM conversations JOIN n USING (conv_id) WHERE role = 'system' AND n > 1 UNION ALL SELECT conv_id, NULL, NULL FROM n WHERE n = 1 OR s = 0""", "conversations", {"$unwind": {"path": "$turns", "preserveNullAndEmptyArrays": True}}, TURNS, view=system_turns)
stages("unwind_index", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1)::BIGINT AS place, role FROM conversations", "conversations", {"$unwind": {"path": "$turns", "includeArrayIndex": "place"}}, {"$project": {"conv_id": 1, "place": 1, "role": "$turns.role"}}, view=conversation_docs)

# ---- joins ------------------------------------------------------------------------------------------------------

CUSTOMER_ORDERS = {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}
stages("lookup_nest", "SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", "customer", CUSTOMER_ORDERS, {"$project": {"c_custkey": 1, "n": {"$size": "$orders"}, "prices": "$orders.o_totalprice"}}, tables=("orders",))
_nest = QUERIES["lookup_nest"]
QUERIES["lookup_nest"] = lambda spark, sf_dir: _nest(spark, sf_dir).select("c_custkey", "n", F.array_max("prices").alias("top"))
stages("lookup_inner", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000", "customer", CUSTOMER_ORDERS, {"$unwind": "$orders"}, {"$match": {"orders.o_totalprice": {"$gt": 200000}}}, {"$project": {"c_custkey": 1, "o_orderkey": "$orders.o_orderkey", "o_totalprice": "$orders.o_totalprice"}}, tables=("orders",))
ORDER_LINES = {"$lookup": {"from": "lineitem", "localField": "o_orderkey", "foreignField": "l_orderkey", "as": "lines"}}
stages("lookup_left", "SELECT o_orderkey, l_quantity AS qty FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", "orders", ORDER_LINES, {"$unwind": {"path": "$lines", "preserveNullAndEmptyArrays": True}}, {"$project": {"o_orderkey": 1, "qty": "$lines.l_quantity"}}, tables=("lineitem",))
stages("lookup_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "orders", ORDER_LINES, {"$match": {"lines": []}}, {"$project": {"o_orderkey": 1}}, tables=("lineitem",))
stages("lookup_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "orders", ORDER_LINES, {"$match": {"lines": {"$ne": []}}}, {"$project": {"o_orderkey": 1}}, tables=("lineitem",))
stages("lookup_pipeline", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_totalprice > c_acctbal * 20 GROUP BY 1", "customer",
       {"$lookup": {"from": "orders", "let": {"c": "$c_custkey", "bal": {"$multiply": ["$c_acctbal", 20]}}, "pipeline": [{"$match": {"o_orderstatus": "F", "$expr": {"$and": [{"$eq": ["$o_custkey", "$$c"]}, {"$gt": ["$o_totalprice", "$$bal"]}]}}}], "as": "found"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$found"}}}, tables=("orders",))
stages("lookup_theta", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey < n_nationkey AND s_acctbal > 5000) AS n FROM nation", "nation",
       {"$lookup": {"from": "supplier", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"s_acctbal": {"$gt": 5000}}}, {"$match": {"$expr": {"$lt": ["$s_nationkey", "$$k"]}}}], "as": "found"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$found"}}}, tables=("supplier",))
stages("lookup_top_per_key", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM customer JOIN orders ON c_custkey = o_custkey) WHERE k <= 2", "customer",
       {"$lookup": {"from": "orders", "let": {"c": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}], "as": "best"}}, {"$unwind": "$best"}, {"$project": {"c_custkey": 1, "o_orderkey": "$best.o_orderkey"}}, tables=("orders",))


stages("lookup_semi_nested", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "customer", CUSTOMER_ORDERS, {"$match": {"orders.o_totalprice": {"$gt": 400000}}}, {"$project": {"c_custkey": 1}}, tables=("orders",))
stages("lookup_missing", "SELECT n_nationkey, 0::BIGINT AS n FROM nation", "nation", {"$lookup": {"from": "nowhere", "localField": "n_nationkey", "foreignField": "k", "as": "found"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$found"}}})
stages("lookup_group_inside", "SELECT c_custkey, count(DISTINCT o_orderstatus) AS kinds, coalesce(max(n), 0) AS most FROM (SELECT c_custkey, o_orderstatus, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1", "customer",
       {"$lookup": {"from": "orders", "let": {"c": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}}}, {"$group": {"_id": "$o_orderstatus", "n": {"$count": {}}}}], "as": "by"}}, {"$project": {"c_custkey": 1, "kinds": {"$size": "$by"}, "n": "$by.n"}}, tables=("orders",))
_inside = QUERIES["lookup_group_inside"]
QUERIES["lookup_group_inside"] = lambda spark, sf_dir: _inside(spark, sf_dir).select("c_custkey", "kinds", F.coalesce(F.array_max("n"), F.lit(0)).alias("most"))


def ancestors(events):
    """Every event with the number of events above it in the tree of halved ids, and the depth of the farthest."""
    tree = events.select(F.col("event_id").alias("node"), F.expr("nullif(event_id div 2, event_id)").alias("parent"))
    spec = {"from": "tree", "startWith": "$parent", "connectFromField": "parent", "connectToField": "node", "as": "above", "depthField": "depth"}
    out = aggregate(tree, [{"$graphLookup": spec}, {"$project": {"node": 1, "n": {"$size": "$above"}, "depths": "$above.depth"}}], {"tree": tree}, ["node"])
    return out.select("node", "n", F.array_max("depths").alias("deepest"))


@query("""WITH RECURSIVE t AS (SELECT event_id AS node, nullif(event_id // 2, event_id) AS parent FROM events),
r(start, node, depth) AS (SELECT s.node, p.node, 0 FROM t s JOIN t p ON p.node = s.parent UNION ALL SELECT r.start, p.node, depth + 1 FROM r JOIN t c ON c.node = r.node JOIN t p ON p.node = c.parent)
SELECT t.node, count(r.node) AS n, max(depth)::BIGINT AS deepest FROM t LEFT JOIN r ON r.start = t.node GROUP BY 1""")
def graph_lookup(spark, sf_dir):
    return ancestors(read(spark, sf_dir, "events"))


# ---- text -------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = f"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})) AS w FROM documents"


@query(f"""WITH t AS ({_TOKENS}), l AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t WHERE len(w) > 0), c AS (SELECT doc_id, term, n, count(*) AS tf FROM l WHERE term IN ('ach', 'ado') GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS total FROM t WHERE len(w) > 0)
SELECT doc_id AS id, round(sum(tf / c.n * (ln(total / (1 + df)) + 1)), 9) AS score FROM c JOIN d USING (term), n GROUP BY doc_id""")
def text_search(spark, sf_dir):
    found = text.TextIndex(read(spark, sf_dir, "documents"), ["text"], "doc_id").search("Ach, ado the")
    return found.select("id", F.round("score", 9).alias("score"))


@query(SQL["text_search"].replace("SELECT doc_id AS id", "SELECT id, score FROM (SELECT doc_id AS id", 1) + ") ORDER BY score DESC, id LIMIT 15")
def text_search_limit(spark, sf_dir):
    """By saved postings: the best of them, ties to the smaller id."""
    index = text.TextIndex(read(spark, sf_dir, "documents"), ["text"], "doc_id").save(f"{shared_path(spark, 'text')}/postings")
    found = index.search("ado ach")
    return found.select("id", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(15)


find("text_filter", f"SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(concat_ws(' ', text, lang, source)), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('ach', 'ado'))) > 0", "documents", {"$text": {"$search": "Ach ado"}}, "doc_id")


@query(f"WITH t AS ({_TOKENS}) SELECT count(*) AS num_documents, round(avg(len(w)), 6) AS avg_doc_length, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM t)) AS vocabulary_size FROM t WHERE len(w) > 0")
def text_stats(spark, sf_dir):
    return text.TextIndex(read(spark, sf_dir, "documents"), ["text"], "doc_id").stats().withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@query("SELECT doc_id FROM documents WHERE contains(text, 'License') OR contains(lang, 'License') OR contains(source, 'License')")
def text_scan(spark, sf_dir):
    return text.scan(read(spark, sf_dir, "documents"), "License").select("doc_id")


# ---- geo --------------------------------------------------------------------------------------------------------

GEO = "(SELECT p_partkey, ((p_partkey * 37) % 360) - 180 + 0.5 AS lng, ((p_partkey * 13) % 170) - 85 + 0.5 AS lat FROM part)"


def geo_parts(spark, sf_dir, df=None):
    parts = read(spark, sf_dir, "part")
    return parts.select("p_partkey", F.struct(((F.col("p_partkey") * 37) % 360 - 180 + 0.5).cast("double").alias("lng"), ((F.col("p_partkey") * 13) % 170 - 85 + 0.5).cast("double").alias("lat")).alias("at"))


def haversine_sql(lng: float, lat: float) -> str:
    return f"2 * 6371000.0 * asin(sqrt(least(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lng} - lng) / 2), 2), 1.0)))"


@query(f"SELECT p_partkey, round(d, 3) AS away FROM (SELECT p_partkey, {haversine_sql(10.0, 50.0)} AS d FROM {GEO}) WHERE d BETWEEN 100000 AND 2000000")
def geo_near(spark, sf_dir):
    cursor = Cursor(geo_parts(spark, sf_dir), {}, order=["p_partkey"]).near("at", [10.0, 50.0], 2_000_000, 100_000)
    return cursor.dataframe().select("p_partkey", F.round("_geo_distance_at", 3).alias("away"))


find("geo_within_box", f"SELECT p_partkey FROM {GEO} WHERE lng BETWEEN -20 AND 40.5 AND lat BETWEEN 10 AND 60", "part", {"at": {"$geoWithin": {"$box": [[-20, 10], [40.5, 60]]}}}, "p_partkey", geo_parts)
find("geo_within_circle", f"SELECT p_partkey FROM {GEO} WHERE {haversine_sql(10.0, 50.0)} <= 1500000", "part", {"at": {"$geoWithin": {"type": "Circle", "center": [10, 50], "radius": 1_500_000}}}, "p_partkey", geo_parts)
_RING = [(0.0, 0.0), (60.0, 5.0), (40.0, 30.0), (70.0, 60.0), (10.0, 45.0)]
_CROSS = " + ".join(f"CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lng < (lat - {y1}) * {(x2 - x1) / (y2 - y1)!r} + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1]))
find("geo_within_polygon", f"SELECT p_partkey FROM {GEO} WHERE ({_CROSS}) % 2 = 1", "part", {"at": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [_RING]}}}}, "p_partkey", geo_parts)


def geohash_sql(lng: str, lat: str, precision: int) -> str:
    """Base 32 from the bits of two cell numbers in turn, longitude first."""
    n = 5 * precision
    cells = [f"floor(({lng} + 180.0) / 360.0 * {2 ** ((n + 1) // 2)})::BIGINT", f"floor(({lat} + 90.0) / 180.0 * {2 ** (n // 2)})::BIGINT"]
    sizes = [(n + 1) // 2, n // 2]
    digit = lambda c: " + ".join(f"(({cells[b % 2]} >> {sizes[b % 2] - 1 - b // 2}) & 1) * {2 ** (4 - k)}" for k, b in enumerate(range(5 * c, 5 * c + 5)))
    return " || ".join(f"substr('{geo.BASE32}', 1 + {digit(c)}, 1)" for c in range(precision))


@query(f"SELECT p_partkey, {geohash_sql('lng', 'lat', 6)} AS geohash FROM {GEO}")
def geo_geohash(spark, sf_dir):
    parts = geo_parts(spark, sf_dir)
    return parts.select("p_partkey", geo.geohash(F.col("at.lng"), F.col("at.lat"), 6).alias("geohash"))


find("geo_intersects", f"SELECT p_partkey FROM {GEO} WHERE ({_CROSS}) % 2 = 1", "part", {"at": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [_RING]}}}}, "p_partkey", geo_parts)
find("geo_near_filter", f"SELECT p_partkey FROM {GEO} WHERE {haversine_sql(-170.0, 10.0)} <= 3000000", "part", {"at": {"$near": [-170.0, 10.0], "$maxDistance": 3_000_000}}, "p_partkey", geo_parts)
find("geo_and_equality", f"SELECT p_partkey FROM {GEO} WHERE lng BETWEEN -20 AND 90.5 AND lat BETWEEN 10 AND 60 AND p_partkey % 2 = 1", "part", {"at": {"$geoWithin": {"$box": [[-20, 10], [90.5, 60]]}}, "p_partkey": {"$mod": [2, 1]}}, "p_partkey", geo_parts)

# ---- updates ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN hit THEN o_custkey + 1000 ELSE o_custkey END AS o_custkey, CASE WHEN hit THEN least(o_totalprice, 300000) ELSE o_totalprice END AS o_totalprice, CASE WHEN NOT hit THEN o_orderpriority END AS o_orderpriority, CASE WHEN hit THEN o_orderdate END AS placed FROM (SELECT *, o_totalprice > 200000 AS hit FROM orders)")
def update_set_inc(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    update = {"$inc": {"o_custkey": 1000}, "$set": {"o_orderstatus": "X"}, "$min": {"o_totalprice": 300000}, "$unset": {"o_orderpriority": ""}, "$rename": {"o_orderdate": "placed"}}
    out = apply_update(df, update, predicate({"o_totalprice": {"$gt": 200000}}, df))
    return out.select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice", "o_orderpriority", "placed")


@query("""SELECT p_partkey, array_to_string(list_filter(CASE WHEN list_contains(w2, 'new') THEN w2 ELSE list_append(w2, 'new') END, lambda x: x <> 'blue'), ' ') AS words
FROM (SELECT p_partkey, p_size, list_filter(list_append(w, 'pushed'), lambda x: x <> 'bolt') AS w2 FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)) WHERE p_size < 25
UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size >= 25""")
def update_arrays(spark, sf_dir):
    df = word_arrays(spark, sf_dir, read(spark, sf_dir, "part"))
    update = {"$pullAll": {"words": ["blue"]}, "$addToSet": {"words": "new"}, "$push": {"words": "pushed"}, "$pull": {"words": "bolt"}}
    return apply_update(df, update, predicate({"p_size": {"$lt": 25}}, df)).select("p_partkey", F.array_join("words", " ").alias("words"))


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN greatest(p_size, 30) ELSE p_size END AS p_size, CASE WHEN p_size > 10 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice,
CASE WHEN p_size > 10 THEN array_to_string(string_split(p_name, ' ')[1:-2], ' ') ELSE p_name END AS words FROM part""")
def update_max_mul_pop(spark, sf_dir):
    df = word_arrays(spark, sf_dir, read(spark, sf_dir, "part"))
    out = apply_update(df, {"$max": {"p_size": 30}, "$mul": {"p_retailprice": 2}, "$pop": {"words": 1}}, predicate({"p_size": {"$gt": 10}}, df))
    return out.select("p_partkey", "p_size", "p_retailprice", F.array_join("words", " ").alias("words"))


@query(f"SELECT o_orderkey FROM {MAYBE} WHERE NOT coalesce(max_qty > 30, false)")
def delete_many(spark, sf_dir):
    df = maybe_lines(spark, sf_dir, read(spark, sf_dir, "orders"))
    return df.where(predicate({"max_qty": {"$gt": 30}}, df, positive=False)).select("o_orderkey")


@query("SELECT (props::JSON->>'k')::BIGINT % 5 AS _id, count(*) AS n FROM events WHERE (props::JSON->>'k')::BIGINT > 20 GROUP BY 1")
def json_props(spark, sf_dir):
    docs = read(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k bigint"))
    return aggregate(docs, [{"$match": {"props.k": {"$gt": 20}}}, {"$group": {"_id": {"$mod": ["$props.k", 5]}, "n": {"$count": {}}}}], order=["event_id"])


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """The same plan that runs on a stream, over the whole table."""
    return event_counts(read(spark, sf_dir, "events")).select("event_type", "day", "n", F.round("total", 4).alias("total"))


# ---- collections: written to the shared folder and read back --------------------------------------------------------


def stored(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> Collection:
    made = Database(spark, shared_path(spark, "store"))[table]
    made.insert_frame(read(spark, sf_dir, table).select(*columns or "*"))
    return made


@query("SELECT row_number() OVER (ORDER BY n_nationkey)::BIGINT AS _id, n_nationkey, n_name FROM nation UNION ALL VALUES (26, 100, 'ATLANTIS'), (27, NULL, 'LEMURIA'), (28, 102, NULL)")
def store_insert(spark, sf_dir):
    """insert_frame, insert_many and insert_one; ids follow one another, fields that are left out are null."""
    c = Database(spark, shared_path(spark, "store")).nations
    c.insert_frame(read(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(1).sortWithinPartitions("n_nationkey"))
    assert c.insert_many([{"n_nationkey": 100, "n_name": "ATLANTIS"}, {"n_name": "LEMURIA"}]).inserted_ids == [26, 27]
    assert c.insert_one({"n_nationkey": 102}).inserted_id == 28
    return c.dataframe().select("_id", F.col("n_nationkey").cast("int"), "n_name")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 1 END::BIGINT AS seen, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS matched, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS modified FROM orders")
def store_update_many(spark, sf_dir):
    c = stored(spark, sf_dir, "orders")
    done = c.update_many({"o_totalprice": {"$gt": 200000}}, {"$set": {"o_orderstatus": "big"}, "$inc": {"seen": 1}})
    return c.dataframe().select("o_orderkey", "o_orderstatus", "seen", F.lit(done.matched_count).cast("long").alias("matched"), F.lit(done.modified_count).cast("long").alias("modified"))


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'three' WHEN 5 THEN 'five' ELSE n_name END AS n_name, CASE WHEN n_nationkey NOT IN (4) THEN n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (77, 'new', 9), (78, NULL, NULL)")
def store_one_document(spark, sf_dir):
    """update_one, find_one_and_update, replace_one, find_one_and_replace and upserts."""
    c = stored(spark, sf_dir, "nation")
    assert c.update_one({"n_nationkey": 3}, {"$set": {"n_name": "three"}}).modified_count == 1
    assert c.find_one_and_update({"n_nationkey": 5}, {"$set": {"n_name": "five"}}, return_document="after")["n_name"] == "five"
    four = c.find_one({"n_nationkey": 4})
    assert c.replace_one({"n_nationkey": 4}, {"n_nationkey": 4, "n_name": four["n_name"]}).modified_count == 1
    assert c.update_one({"n_nationkey": 77}, {"$set": {"n_name": "new", "n_regionkey": 9}}, upsert=True).upserted_id == 26
    assert c.find_one_and_replace({"n_nationkey": 78}, {"n_nationkey": 78}, upsert=True) is None
    return c.dataframe().select(*(F.col(n).cast(k) for n, k in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS deleted FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus <> 'P')")
def store_delete(spark, sf_dir):
    """delete_many, delete_one and find_one_and_delete of nothing."""
    c = stored(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    deleted = c.delete_many({"o_orderstatus": "P"}).deleted_count
    first = c.aggregate([{"$group": {"_id": None, "low": {"$min": "$o_orderkey"}}}]).first().low
    assert c.delete_one({"o_orderkey": first}).deleted_count == 1 and c.find_one_and_delete({"o_orderkey": first}) is None
    return c.dataframe().select("o_orderkey", F.lit(deleted).cast("long").alias("deleted"))


@query("SELECT (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS rich, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS segments, (SELECT min(c_custkey) FROM customer WHERE c_acctbal > 5000) AS first, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS poor")
def store_reads(spark, sf_dir):
    """count_documents, estimated_document_count, distinct, find_one and aggregate."""
    c = stored(spark, sf_dir, "customer")
    first = c.find({"c_acctbal": {"$gt": 5000}}).sort("c_custkey").first().c_custkey
    poor = c.aggregate([{"$match": {"c_acctbal": {"$lt": 0}}}, {"$count": "n"}]).all()[0].n
    assert c.find_one({"c_custkey": first})["c_acctbal"] > 5000 and c.estimated_document_count() == c.count_documents()
    return spark.createDataFrame([(c.estimated_document_count(), c.count_documents({"c_acctbal": {"$gt": 0}}), len(c.distinct("c_mktsegment")), first, poor)], "total long, rich long, segments long, first long, poor long")


@query("SELECT 'n_name_1' AS index, true AS unique, count(*) AS n FROM nation")
def store_unique_index(spark, sf_dir):
    """create_index, list, get and drop; a second document of a unique key is refused, whole batches with it."""
    c = stored(spark, sf_dir, "nation")
    name = c.create_index("n_name", unique=True)
    taken = c.find_one()["n_name"]
    for docs in ([{"n_name": taken}], [{"n_name": "a"}, {"n_name": "a"}]):
        try:
            c.insert_many(docs)
        except DuplicateKeyError:
            continue
        raise AssertionError("a key twice")
    c.create_index([("n_regionkey", 1), ("n_name", -1)], name="both")
    c.drop_index("both")
    return spark.createDataFrame([(n, i["unique"], c.count_documents()) for n, i in c.list_indexes().items() if c.get_index(name)], "index string, unique boolean, n long")


@query("SELECT count(*) FILTER (n_regionkey = 1) AS before, count(*) FILTER (n_regionkey = 1) + 1 AS after, 2::BIGINT AS hits, 2::BIGINT AS misses, 2::BIGINT AS asked, 'sort or bucket by n_regionkey (2 filters)' AS hint FROM nation")
def store_cache_and_planner(spark, sf_dir):
    """Counts are answered by the cache until the collection changes; what ran is recorded, with a hint for its layout."""
    c = stored(spark, sf_dir, "nation")
    spec = {"n_regionkey": 1}
    before = [c.count_documents(spec) for _ in range(3)]
    c.insert_one(spec)
    after = c.count_documents(spec)
    found, (shape,) = c.cache_stats(), c.query_patterns()
    return spark.createDataFrame([(min(before), after, found["hits"], found["misses"], shape["count"], c.suggest_indexes(2)[0])], "before long, after long, hits long, misses long, asked long, hint string")


@query("SELECT (SELECT count(*) FROM customer) AS now, (SELECT count(*) FROM customer) AS was, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS gone")
def store_versions(spark, sf_dir):
    """An earlier version is read as it was."""
    c = stored(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    first = c.manifest()["version"]
    gone = c.delete_many({"c_acctbal": {"$lt": 0}}).deleted_count
    return spark.createDataFrame([(c.count_documents() + gone, c.as_of(first).dataframe().count(), gone)], "now long, was long, gone long")


@query("SELECT n_nationkey, n_regionkey, 1::BIGINT AS log FROM nation WHERE n_regionkey <> 2")
def store_transaction(spark, sf_dir):
    """Two collections change together; one that is given up, or meets a newer version, changes nothing."""
    nations = stored(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    db = nations.database = Database(spark, nations.path.rpartition("/")[0])
    with db.transaction() as t:
        t["nation"].delete_many({"n_regionkey": 2})
        t["log"].insert_one({"what": "deleted region 2"})
        assert db["log"].count_documents() == 0
    late = db.transaction()
    late["nation"].delete_many({})
    late["log"].insert_one({"what": "never"})
    db["nation"].update_many({"n_regionkey": 3}, {"$set": {"n_regionkey": 3}})
    db["log"].insert_one({"what": "later"})
    db["log"].delete_one({"what": "later"})
    try:
        late.commit()
    except WriteConflict:
        pass
    else:
        raise AssertionError("a lost update")
    return db["nation"].dataframe().select("n_nationkey", "n_regionkey", F.lit(db["log"].count_documents()).cast("long").alias("log"))


@query("""WITH t AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 2) AS w FROM part), c AS (SELECT p_partkey, len(w) AS n, len(list_filter(w, lambda x: x = 'bolt')) AS tf FROM t)
SELECT p_partkey AS id, round(tf / n * (ln((SELECT count(*) FROM c) / (1 + (SELECT count(*) FROM c WHERE tf > 0))) + 1), 9) AS score FROM c WHERE tf > 0""")
def store_text_index(spark, sf_dir):
    """Create, list and drop text indexes; the named one is searched, by its saved postings."""
    c = stored(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    c.create_text_index(["p_type"])
    name = c.create_text_index(["p_name"], "names")
    c.drop_text_index("fulltext_p_type")
    assert c.list_text_indexes() == {"names": ["p_name"]} and c.text_index_stats(name)["num_documents"] == c.count_documents()
    found = c.text_index(name).search("Bolt")
    return found.join(c.dataframe(), found.id == F.col("_id")).select(F.col("p_partkey").alias("id"), F.round("score", 9).alias("score"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice::DECIMAL(18, 2)::DECIMAL(38, 18) AS price, hex(encode(o_orderstatus)) AS status FROM orders")
def json_round_trip(spark, sf_dir):
    """Timestamps, decimals and binary through lines of tagged JSON, gzipped."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.encode("o_orderstatus", "UTF-8").alias("status"))
    path = f"{shared_path(spark, 'json')}/lines"
    jsonio.json_lines(orders).write.option("compression", "gzip").text(path)
    back = jsonio.read_lines(spark, path)
    return back.select("o_orderkey", "o_orderdate", "price", F.hex("status").alias("status"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def encrypted_columns(spark, sf_dir):
    """AES-GCM by a key from a password, written, read and opened."""
    path = f"{shared_path(spark, 'sealed')}/customers"
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    jsonio.encrypt(customers, ["c_name", "c_mktsegment"], password="secret", salt=b"pepper").write.parquet(path)
    sealed = spark.read.parquet(path)
    assert dict(sealed.dtypes)["c_name"] == "binary"
    return jsonio.decrypt(sealed, ["c_name", "c_mktsegment"], password="secret", salt=b"pepper")


@query("SELECT 'shop' AS database, unnest(['customer', 'orders']) AS collection, 1::BIGINT AS ok")
def store_catalog(spark, sf_dir):
    """Clients, databases and collections: made, listed, dropped; commands."""
    client = Client(spark, shared_path(spark, "store"))
    for name in ("orders", "customer", "gone"):
        client.shop.create_collection(name)
    client.shop.drop_collection("gone")
    client.other.create_collection("x")
    client.drop_database("other")
    ok = client.admin_command("ping")["ok"] * client.shop.command("ping")["ok"] * client.server_info()["ok"]
    assert client.shop.command("serverStatus")["collections"] == 2
    return spark.createDataFrame([(d, c, ok) for d in client.list_database_names() for c in client[d].list_collection_names()], "database string, collection string, ok long")
