"""Chat formatting (native): multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant and all
others as named users; the loss mask is 1 on what the assistant says and 0 on headers and other speakers' turns.

A dialogue is returned as its segments, one row per conversation, perspective and turn: conv_id, perspective, turn,
seq (place in the dialogue, from 0), segment (its rendered text), seg_start and seg_end (code points in the
rendered dialogue), mask_start and mask_end (the masked span; null where nothing is learnt).
``assemble`` joins the segments of each dialogue into one text with its list of spans (query perspective_dialogues).

Cases: a null role takes part as ``unknown``; a null text is empty; rows with a null conv_id form one conversation;
a null turn comes first. Ties of turn are ordered by role, then text; repeated rows are turns of their own.
An empty table gives an empty result. Extra columns are ignored.

Scale: turns are dealt by (conversation, run of ``chunk`` turn numbers), so a hot conversation is spread; offsets are
prefix sums inside a chunk plus the sums of the chunks before. The only rows that meet per conversation are one per
chunk and role. Turns of one conversation that share a turn number are put in order in one task, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASSISTANT, END = "<|assistant|>\n", "<|end|>\n"


def rotate(turns: DataFrame, chunk: int = 1024) -> DataFrame:
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said"),
    ).withColumns({"chunk": F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(2**60))), "conv_key": F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))})
    header = F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n"))
    plain = F.length(header) + F.length("said") + len(END)
    own = F.length("said") + len(ASSISTANT) + len(END)
    # a row per conversation, chunk and role: how long its turns are as users', how much that changes as the assistant's
    sums = rows.groupBy("conv_key", "chunk", "role").agg(F.sum(plain).alias("plain"), F.sum(own - plain).alias("change"), F.count(F.lit(1)).alias("n"))
    speakers = sums.select("conv_key", F.col("role").alias("perspective")).distinct()
    by_chunk = (
        sums.join(speakers, "conv_key")
        .groupBy("conv_key", "perspective", "chunk")
        .agg(F.sum(F.col("plain") + F.when(F.col("role") == F.col("perspective"), F.col("change")).otherwise(0)).alias("len"), F.sum("n").alias("n"))
    )
    earlier = W.partitionBy("conv_key", "perspective").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    by_chunk = by_chunk.select("conv_key", "perspective", "chunk", F.coalesce(F.sum("len").over(earlier), F.lit(0)).alias("len_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    mine = F.col("role") == F.col("perspective")
    inside = W.partitionBy("conv_key", "chunk", "perspective").orderBy("turn", "role", "said")
    length = F.length("segment")
    start = F.col("len_before") + F.sum(length).over(inside.rowsBetween(W.unboundedPreceding, 0)) - length
    return (
        rows.join(by_chunk, ["conv_key", "chunk"])
        .withColumn("segment", F.concat(F.when(mine, F.lit(ASSISTANT)).otherwise(header), "said", F.lit(END)))
        .withColumns({"seg_start": start, "seq": F.col("n_before") + F.row_number().over(inside) - 1})
        .select(
            "conv_id", "perspective", "turn", "seq", "segment", "seg_start",
            (F.col("seg_start") + length).alias("seg_end"),
            F.when(mine, F.col("seg_start") + len(ASSISTANT)).alias("mask_start"),
            F.when(mine, F.col("seg_start") + length).alias("mask_end"),
        )
    )


def assemble(segments: DataFrame, most: int = 1024) -> DataFrame:
    """Rendered dialogues with their masked spans: conv_id, perspective, part, start (of its text in the dialogue), rendered,
    masks (spans in the dialogue). A dialogue of up to ``most`` turns is one row, part 0; longer ones go on in further parts."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "segment", "seg_start", "mask_start", "mask_end")))
    grouped = segments.groupBy("conv_id", "perspective", F.floor(F.col("seq") / most).alias("part")).agg(parts.alias("parts"))
    return grouped.select(
        "conv_id", "perspective", "part",
        F.col("parts")[0]["seg_start"].alias("start"),
        F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("rendered"),
        F.filter(F.transform("parts", lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))), lambda x: x["start"].isNotNull()).alias("masks"),
    )


def dialogues(spark, sf_dir: str) -> DataFrame:
    """Every dialogue from every perspective, as text with its masks written start-end."""
    whole = assemble(rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return whole.withColumn("masks", F.array_join(F.transform("masks", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " "))


def query(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
s AS (SELECT t.conv_id, perspective, turn, role, said, role = perspective AS mine,
  CASE WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) || said || '<|end|>' || chr(10) AS segment
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, row_number() OVER w - 1 AS seq, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, said ROWS UNBOUNDED PRECEDING))::BIGINT AS seg_end FROM s
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, said))
SELECT conv_id, perspective, turn, seq, segment, seg_end - length(segment) AS seg_start, seg_end,
  CASE WHEN mine THEN seg_end - length(segment) + {len(ASSISTANT)} END AS mask_start, CASE WHEN mine THEN seg_end END AS mask_end FROM o
"""

DIALOGUES_SQL = f"""
WITH s AS ({ORACLE_SQL.strip()})
SELECT conv_id, perspective, seq // 1024 AS part, min(seg_start)::BIGINT AS start, string_agg(segment, '' ORDER BY seq) AS rendered,
  coalesce(string_agg(mask_start || '-' || mask_end, ' ' ORDER BY seq) FILTER (mask_start IS NOT NULL), '') AS masks FROM s GROUP BY conv_id, perspective, seq // 1024
"""
