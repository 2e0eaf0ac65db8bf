"""From documents to packed sequences: toxicity, line dedup, near-dedup, mixing and packing, each over all that is left.

Cases: a null or empty text is scored by the classifier's bias, has no lines or shingles in common with any other, and has no
words, so the mix never takes it. Texts of any length go whole through every stage. Ties: of equal pieces and of near copies
the smallest doc_id keeps its own. Rows that repeat a doc_id and text are one document to the two dedup stages: all get the same
result, and all stay; the mix counts each. Rows without a doc_id are no copies of any, and stay. A null source is a source of its
own; null lang and n_chars pass through. Extra columns are carried along whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import linedup, minhash, mixing, packing, toxicity
from docloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document has are cut out; every document stays, perhaps empty."""
    return linedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return minhash.deduplicate(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by shard and in shuffled order; those without words are never taken."""
    return mixing.in_order(mixing.mix(docs)).drop("mix_shard", "mix_order")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; files are read in any order, rows in theirs."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Line chunks, the classifier and the tokenizer have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
