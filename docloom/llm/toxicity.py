"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are lower-cased (ASCII), cut at white space and stripped of punctuation at their ends. Features are the
distinct words and their stems (first STEM bytes, so that rare forms share what is learnt), pairs of neighbours and pairs with one word between, hashed to 2**BITS places. FTRL-proximal keeps a
learning rate for every coordinate and sets most weights to zero (L1); the weights that are left, a few thousand, go
to the executors with the task and every text is scored whole.

Training uses a bounded sample: of the labelled rows that may be learnt from about ``sample`` (a parameter; by a hash
of the id), gone through ``epochs`` times in one task in hashed order. Everything else runs over all rows.

Cases: null and empty texts, and those without words, score by the bias alone. Labels that are null are no labels;
if an id has several, any 1 makes it 1. Without labels every score is 0. Repeated rows are scored each; a null
doc_id is scored, not held out. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

BITS = 20
SAMPLE = 20_000
#: Bytes of a word that make its stem.
STEM = 4


class Tokens(dict):
    """Word -> 64-bit hash of its bare form, or of its stem, remembered up to a limit."""

    def __init__(self, stem: int = 0):
        super().__init__()
        self.stem = stem

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        bare = word.strip(b".,;:!?\"'()[]{}|#$%&*") or word
        value = self[word] = xxhash.xxh3_64_intdigest(bare[: self.stem] + b"~") if self.stem else xxhash.xxh3_64_intdigest(bare)
        return value


def caches() -> tuple[Tokens, Tokens]:
    return Tokens(), Tokens(STEM)


def grams(text: bytes | None, cache: tuple[Tokens, Tokens]) -> np.ndarray:
    """Places of the distinct features' hashes, with repeats."""
    tokens = (text or b"").lower().split()
    h, stems = (np.fromiter(map(c.__getitem__, tokens), np.uint64, len(tokens)) for c in cache)
    shift, one, two = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pairs, skips = (h[:-1] * one + h[1:]) * two, (h[:-2] * two + h[2:]) * one
    return np.concatenate(((h * one) >> shift, (stems * one) >> shift, pairs >> shift, skips >> shift)).astype(np.int32)


def featured(batches):
    """draw, label, text -> draw, label, places (distinct, 32 bits each)."""
    cache = caches()
    with np.errstate(over="ignore"):
        for batch in batches:
            places = [np.unique(grams(x, cache)).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), pa.array(places, pa.binary())], ["draw", "label", "places"])


def ftrl(rows: list[tuple[int, np.ndarray]], epochs: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1.5, l2: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, places and weights that aren't zero."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    bias = 2**BITS

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    for _ in range(epochs):
        for label, places in rows:
            at = np.append(places, bias)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(2**BITS + 1))
    at = np.flatnonzero(w[:-1])
    return float(w[-1]), at, w[at]


def trained(batches, epochs: int):
    rows = []
    for batch in batches:
        rows += [(y, np.frombuffer(x, np.int32)) for y, x in zip(batch.column("label").to_pylist(), batch.column("places").to_pylist())]
    if not rows:
        return
    bias, at, w = ftrl(rows, epochs)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *w.tolist()], pa.float64())], ["place", "weight"])


def remainder(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int) -> DataFrame:
    """draw, label, text of about ``sample`` labelled documents; ``learn`` says of doc_id which may be used."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(learn)
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(1, usable.count()))
    drawn = usable.withColumn("draw", F.xxhash64("doc_id", F.lit(label))).where(F.col("draw") <= F.lit(int(-(2**63) + min(share * 2**64, 2**64 - 1))))
    # at most about ``sample`` rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").select("draw", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE, epochs: int = 3) -> tuple[float, np.ndarray, np.ndarray] | None:
    scratch = Scratch(docs.sparkSession, "toxicity")
    drawn = labelled_sample(docs, labels, label, learn, sample)
    with small_batches(docs.sparkSession, 500):
        features = scratch.save(drawn.mapInArrow(featured, "draw long, label int, places binary"), "features")
        model = features.repartition(1).sortWithinPartitions("draw", "places").mapInArrow(lambda it: trained(it, epochs), "place long, weight double").collect()
    scratch.drop("features")
    if not model:
        return None
    at = sorted((r["place"], r["weight"]) for r in model)
    return at[0][1], np.array([p for p, _ in at[1:]], np.int64), np.array([w for _, w in at[1:]])


def scored(batches, model):
    """doc_id, held_out, text -> doc_id, held_out, score, predicted."""
    cache, dense = caches(), np.zeros(2**BITS, np.float32)
    bias, at, w = model if model is not None else (-np.inf, np.zeros(0, int), np.zeros(0))
    dense[at] = w
    live = dense != 0
    with np.errstate(over="ignore"):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                places = grams(text, cache)
                out.append(bias + float(dense[np.unique(places[live[places]])].sum(dtype=np.float64)))
            score = 1 / (1 + np.exp(-np.clip(out, -700, 700)))
            score = np.where(np.isneginf(out), 0.0, score) if len(out) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, out: int = 0, **options) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted. Rows with crc32(doc_id) mod ``mod`` = ``out`` are never learnt from."""
    model = fit(docs, labels, remainder(F.col("doc_id"), mod) != out, **options)
    held = F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(lambda it: scored(it, model), "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that are predicted toxic. Whole rows go through the classifier, so verdicts need no join."""
    model = fit(docs, labels, remainder(F.col("doc_id"), 5) != 0, **options)
    names = docs.columns
    schema = docs.select(F.lit(None).cast("binary").alias("_bytes"), F.struct(*names).alias("_row")).schema
    rows = docs.select(F.col("text").cast("string").cast("binary").alias("_bytes"), F.struct(*names).alias("_row"))

    def passing(batches):
        for batch in batches:
            keys = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.bool_()), batch.column("_bytes")], ["doc_id", "held_out", "text"])
            verdict = next(scored([keys], model)).column("predicted").to_numpy()
            yield batch.filter(pa.array(verdict == 0))

    return rows.mapInArrow(passing, schema).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
