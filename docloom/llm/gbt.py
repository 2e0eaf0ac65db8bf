"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text becomes a row of statistics (counts of kinds of bytes, words, repeats, lines). Features are cut into
at most 64 bins at sample quantiles; trees are grown level by level from gradient histograms, with second-order gains
and shrinkage. The trees are flattened into arrays (feature, threshold, leaf value by place in a complete tree), and
numpy walks all rows of a batch down a tree at once.

Training uses a bounded sample: of the labelled rows that may be learnt from about ``sample`` (a parameter; by a hash
of the id), as rows of statistics, in one task. Everything else runs over all rows.

Cases: null and empty texts are rows of zeros and are scored like all others. Labels that are null are no labels; if
an id has several, any 1 makes it 1. Without labels every score is 0.5. Repeated rows are scored each; a null doc_id
is scored, not held out. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .toxicity import labelled_sample, remainder

SAMPLE = 40_000
BINS, DEPTH, TREES, RATE = 64, 4, 120, 0.12

KINDS = np.zeros((256, 8), np.float64)
for _i, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#$%&*|@^~<>=+_\\/")):
    KINDS[list(_set), _i] = 1


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    n = len(text)
    low, up, digit, space, newline, stop, shout, odd = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ KINDS
    words = text.split()
    w = len(words)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    lines = text.split(b"\n")
    uniq = len(set(lines))
    most = max(counts.values(), default=0)
    pairs = len(set(zip(words[:-1], words[1:])))
    triples = len(set(zip(words[:-2], words[1:-1], words[2:])))
    per = lambda x, of: x / of if of else 0.0
    upper = sum(map(bytes.isupper, words))
    letters = n - low - up - digit - space - newline - stop - shout - odd
    return [
        np.log1p(n), np.log1p(w), per(n, w), per(low, n), per(up, n), per(digit, n), per(space, n), per(newline, n), per(stop, n), per(shout, n), per(odd, n),
        per(letters, n), odd, shout, upper, per(upper, w), per(len(counts), w), per(most, w), most, per(same, w), same, per(pairs, w), w - 1 - pairs if w > 1 else 0,
        per(triples, w), w - 2 - triples if w > 2 else 0, len(lines), per(uniq, len(lines)), len(lines) - uniq, per(w, len(lines)), per(stop, w), max(map(len, lines)),
        text.count(b"!!"), text.count(b" | "),
    ]


def featured(batches):
    """draw, label, text -> draw, label, stats."""
    for batch in batches:
        rows = [statistics(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), pa.array([np.asarray(r, float) for r in rows], pa.list_(pa.float64()))], ["draw", "label", "stats"])


def boost(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the model: bias; feature and threshold [trees, 2**DEPTH - 1]; leaf [trees, 2**DEPTH]."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(mean / (1 - mean)))
    raw = np.full(len(y), bias)
    inner = 2**DEPTH - 1
    feature, threshold, leaf = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-3)
            choice = np.zeros((width, 2), np.int64) - 1
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                at = node * BINS + binned[:, f]
                gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 2) | (ht - hs < 2)] = 0
                gain[:, len(edges[f]) :] = 0
                b = gain.argmax(1)
                better = gain[np.arange(width), b] > best
                best[better] = gain[np.arange(width), b][better]
                choice[better] = np.stack((np.full(width, f), b), 1)[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                feature[t, first + k], threshold[t, first + k] = choice[k, 0], edges[choice[k, 0]][choice[k, 1]]
            node = node * 2 + (x[np.arange(len(y)), feature[t, first + node]] > threshold[t, first + node])
        leaf[t] = -RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + 1)
        raw += leaf[t][node]
    return {"bias": np.array([bias]), "feature": feature, "threshold": threshold, "leaf": leaf}


def walk(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities; all rows go down each flattened tree together."""
    raw, rows = np.full(len(x), model["bias"][0]), np.arange(len(x))
    for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"]):
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        raw += leaf[at - (2**DEPTH - 1)]
    return 1 / (1 + np.exp(-raw))


def trained(batches):
    x, y = [], []
    for batch in batches:
        x += batch.column("stats").to_pylist()
        y += batch.column("label").to_pylist()
    if y:
        model = boost(np.array(x, float), np.array(y, float))
        yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array([np.asarray(v, float).ravel() for v in model.values()], pa.list_(pa.float64()))], ["name", "numbers"])


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    scratch = Scratch(docs.sparkSession, "quality")
    drawn = labelled_sample(docs, labels, label, learn, sample)
    with small_batches(docs.sparkSession, 1000):
        features = scratch.save(drawn.mapInArrow(featured, "draw long, label int, stats array<double>"), "features")
        found = features.repartition(1).sortWithinPartitions("draw", "stats").mapInArrow(trained, "name string, numbers array<double>").collect()
    scratch.drop("features")
    if not found:
        return None
    model = {r["name"]: np.array(r["numbers"], float) for r in found}
    inner = 2**DEPTH - 1
    return {"bias": model["bias"], "feature": model["feature"].astype(np.int64).reshape(-1, inner), "threshold": model["threshold"].reshape(-1, inner), "leaf": model["leaf"].reshape(-1, inner + 1)}


def scored(batches, model, cut: float):
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, -1)
        score = walk(model, x) if model is not None and len(x) else np.full(len(x), 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, labels: DataFrame, mod: int = 4, out: int = 2, cut: float = 0.7, **options) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted. Rows with crc32(doc_id) mod ``mod`` = ``out`` are never learnt from."""
    model = fit(docs, labels, remainder(F.col("doc_id"), mod) != out, **options)
    held = F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(lambda it: scored(it, model, cut), "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
