"""Mixing sources to target weights (native).

Every source gets a target in words: its weight's part of ``budget`` times all words, at most ``max_repeat`` times
its own words; what a capped source can't take is reshared by weight (water filling). A source is cut into
hashed blocks: ``blocks`` of them, or as many times that as keep a block near PER_BLOCK documents. Its target is met by
whole passes over the source, then by whole blocks in a permuted order, then by documents of the one block where the
target falls, so a source misses its target by half a document at most. The taken blocks are dealt to ``shards`` outputs by a
splitting tree: at every node half of its blocks, drawn without replacement, go left, so the counts by source that go
left are multivariate hypergeometric and the quotas stay exact. Inside a shard rows are shuffled by a hash. All draws are
md5 hashes: reruns agree.

Cases: null text has size 0; documents of size 0 are never taken. A null source is a source of its own, last in
order. Repeated rows are documents of their own, each counted. Documents with a null id are told apart by their text.
An empty table gives an empty result. Extra columns are ignored.

Scale: words are counted in one pass over the texts, kept as (id, source, size). All decisions are made from that: sums by
block, and an order of documents only in the blocks where targets fall, one of each source. Texts are met by these decisions,
a row per source and block; only texts of those few blocks are sorted. What runs in one task is one row per source. The
tree goes over groups of sources with about PER_GROUP blocks each, so it has no root that all blocks go through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)
#: Documents of a block, and taken blocks of a tree, above which there are more blocks and more trees.
PER_BLOCK, PER_GROUP = 1_000_000, 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: Sequence[int], budget: float, max_repeat: float) -> DataFrame:
    """by_source: (source_key, source, source_size), a row per source. Adds target.

    Sources are filled in the order in which they reach their caps as the water level rises; the level that holds
    is the largest of the levels that assume a prefix of them capped.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    level = F.max("level").over(everything)
    return (
        by_source.withColumns({"weight": weight, "cap": cap})
        .withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(everything) - capped) / open_weight)
        .select("source_key", "source_size", F.least(level * F.col("weight"), F.col("cap")).alias("target"))
    )


def split_tree(items: DataFrame, levels: int, seed: str) -> DataFrame:
    """items: (group, source_key, block, copy), one for each time a block is taken. Adds shard, 0 to 2**levels - 1."""
    out = items.withColumn("shard", F.lit(0))
    for level in range(levels):
        draw = F.md5(F.concat_ws("|", F.lit(f"{seed}{level}"), "source_key", F.col("block").cast("string"), F.col("copy").cast("string")))
        node = W.partitionBy("group", "shard")
        right = F.row_number().over(node.orderBy(draw, "source_key", "block", "copy")) > F.floor((F.count(F.lit(1)).over(node) + 1) / 2)
        out = out.withColumn("right", right).select("group", "source_key", "block", "copy", (F.col("shard") * 2 + F.col("right").cast("int")).alias("shard"))
    return out


def described(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, source_key, draw (what orders documents and gives the block) and more columns."""
    text = F.col("text").cast("string")
    source = F.col("source").cast("string")
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text)), F.lit("")))
    return docs.select("doc_id", source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("source_key"), draw.alias("draw"), *more)


def in_blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    return rows.join(counts.select("source_key", "blocks"), "source_key").withColumn("block", (F.conv(F.substring("draw", 1, 6), 16, 10).cast("long") % F.col("blocks")).cast("int")).drop("blocks")


def plan_blocks(docs: DataFrame, weights: Sequence[int], budget: float, max_repeat: float, blocks: int, levels: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all documents as doc_id, source_key, draw, size; blocks by source; what is taken of each block)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(described(docs, word_count(F.col("text")).alias("size")), "sized")
    many = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (blocks * PER_BLOCK))) * blocks
    counts = scratch.save(sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), many.cast("long").alias("blocks")), "counts")
    by_block = in_blocks(sized, counts).groupBy("source_key", "block").agg(F.sum("size").alias("block_size"))
    permuted = W.partitionBy("source_key").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "source_key", F.col("block").cast("string"))), "block")
    before = F.coalesce(F.sum("block_size").over(permuted.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    taken = (
        by_block.join(targets(counts.drop("blocks"), weights, budget, max_repeat), "source_key")
        .withColumns({"passes": passes, "before": before})
        # what the last, partial pass still asks of this block
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size") - F.col("before"))
        .withColumn("items", F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0))
    )
    taken = scratch.save(taken, "blocks")
    groups = max(1, -(-(taken.agg(F.sum(F.when(F.col("block_size") > 0, F.col("items")))).first()[0] or 0) // PER_GROUP))
    group = (F.conv(F.substring(F.md5("source_key"), 1, 6), 16, 10).cast("long") % groups).alias("group")
    items = taken.where("block_size > 0 and items > 0").select(group, "source_key", "block", F.explode(F.sequence(F.lit(1), F.col("items"))).alias("copy"))
    dealt = split_tree(items, levels, seed).groupBy("source_key", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    names = ["source_key", "block", "block_size", "source_size", "target", "passes", "rest"]
    return sized, counts, scratch.save(taken.join(dealt, ["source_key", "block"], "left").select(*names, "shards"), "taken")


def decided(rows: DataFrame, counts: DataFrame, taken: DataFrame) -> DataFrame:
    """rows (source_key, draw, doc_id, size, full: whether it has words, ...) with copies and shards.

    Where a target falls inside a block its documents are put in order; in all others they share one answer.
    """
    joined = in_blocks(rows, counts).join(taken, ["source_key", "block"])
    inside = W.partitionBy("source_key", "block").orderBy("draw", "doc_id", "size")
    middle = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2
    cut = (F.col("rest") > 0) & (F.col("rest") < F.col("block_size"))
    ordered = joined.where(cut).withColumn("middle", middle).withColumn("extra", (F.col("middle") <= F.col("rest")).cast("int")).drop("middle")
    plain = joined.where(~cut).withColumn("extra", (F.col("rest") > 0).cast("int"))
    both = plain.unionByName(ordered).withColumn("copies", F.when(F.col("full"), F.col("passes") + F.col("extra")).otherwise(0))
    return both.withColumn("shards", F.when(F.col("copies") > 0, F.slice("shards", F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, max_repeat: float = 2.0, blocks: int = 256, levels: int = 3, seed: str = "mix") -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words), copies and shards (one per copy)."""
    sized, counts, taken = plan_blocks(docs, weights, budget, max_repeat, blocks, levels, seed)
    drawn = decided(sized.drop("source").withColumn("full", F.col("size") > 0), counts, taken)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, max_repeat: float = 2.0, blocks: int = 256, levels: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: docs' columns, a row for each copy, with mix_shard and mix_order (the place inside the shard)."""
    _, counts, taken = plan_blocks(docs, weights, budget, max_repeat, blocks, levels, seed)
    full = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    rows = described(docs, word_count(F.col("text")).alias("size"), full.alias("full"), F.struct(*docs.columns).alias("row")).drop("source")
    copies = decided(rows, counts, taken).select("row", "draw", F.posexplode("shards").alias("copy", "mix_shard"))
    return copies.select("row.*", "mix_shard", F.md5(F.concat_ws("|", F.lit(seed), "mix_shard", "draw", "copy")).alias("mix_order"))


def in_order(mixed: DataFrame) -> DataFrame:
    """mix()'s rows dealt by shard and place, in shuffled order within every partition; a shard may span several."""
    return mixed.repartition("mix_shard", F.substring("mix_order", 1, 2)).sortWithinPartitions("mix_shard", "mix_order")


def write_mix(mixed: DataFrame, path: str) -> None:
    """One folder per shard, rows in shuffled order; a shard may span several files, each sorted."""
    in_order(mixed).drop("mix_order").write.partitionBy("mix_shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", F.concat_ws(",", F.transform("shards", lambda x: x.cast("string"))).alias("shards"))


def _tree_sql(levels: int, seed: str) -> str:
    ctes = ["tree0 AS (SELECT source_key, block, copy, 0 AS shard FROM items)"]
    for level in range(levels):
        ctes.append(
            f"""tree{level + 1} AS (SELECT source_key, block, copy, shard * 2 + CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY
              md5('{seed}{level}|' || source_key || '|' || block || '|' || copy), source_key, block, copy) > (count(*) OVER (PARTITION BY shard) + 1) // 2 THEN 1 ELSE 0 END AS shard FROM tree{level})"""
        )
    return ",\n".join(ctes)


ORACLE_SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '-' || md5(text), '')) AS draw FROM documents),
sourced AS (SELECT *, coalesce('s' || source, 'n') AS source_key FROM sized),
keyed AS (SELECT *, (('0x' || substr(draw, 1, 6))::BIGINT % (256 * greatest(1, ceil(count(*) OVER (PARTITION BY source_key) / (256 * {PER_BLOCK})))::BIGINT))::INT AS block FROM sourced),
by_block AS (SELECT source_key, block, any_value(source) AS source, sum(size)::BIGINT AS block_size FROM keyed GROUP BY ALL),
by_source AS (SELECT source_key, any_value(source) AS source, sum(block_size)::BIGINT AS source_size FROM by_block GROUP BY source_key),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM by_source),
levels AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
targets AS (SELECT source_key, source_size, least((max(level) OVER ()) * weight, cap) AS target FROM levels),
placed AS (SELECT b.source_key, b.block, b.block_size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::INT AS passes,
  coalesce(sum(block_size) OVER (PARTITION BY b.source_key ORDER BY md5('mix|' || b.source_key || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM by_block b JOIN targets t USING (source_key)),
taken AS (SELECT *, target - passes * source_size - before AS rest FROM placed),
counted AS (SELECT *, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END AS n FROM taken),
items AS (SELECT source_key, block, unnest(range(1, n + 1)) AS copy FROM counted WHERE block_size > 0),
{_tree_sql(3, "mix")},
dealt AS (SELECT source_key, block, list(shard ORDER BY copy) AS shards FROM tree3 GROUP BY ALL),
drawn AS (SELECT doc_id, size, source_size, target, coalesce(shards, []) AS shards,
  CASE WHEN size > 0 THEN passes + CASE WHEN sum(size) OVER (PARTITION BY k.source_key, k.block ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 <= rest THEN 1 ELSE 0 END ELSE 0 END AS copies
  FROM keyed k JOIN counted USING (source_key, block) LEFT JOIN dealt USING (source_key, block))
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, array_to_string(shards[1:copies], ',') AS shards FROM drawn
"""
