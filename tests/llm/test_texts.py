"""Chat formatting, licence scans, packing, classifiers and the pipeline."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from docloom.llm import chat, gbt, licenses, mixing, packing, toxicity
from docloom.llm.queries import oracle_sql, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def brute_rotation(turns):
    out = {}
    for conv in {c for c, *_ in turns}:
        rows = sorted(((t if t is not None else -1, r or "unknown", x or "") for c, t, r, x in turns if c == conv))
        for who in {r for _, r, _ in rows}:
            text, spans = "", []
            for _, r, x in rows:
                text += chat.ASSISTANT if r == who else f"<|user name={r}|>\n"
                begin = len(text)
                text += x + chat.END
                if r == who:
                    spans.append((begin, len(text)))
            out[conv, who] = text, spans
    return out


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_rotation(spark, chunk):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "hé \U0001f600"), (1, 2, "cy", ""), (1, 3, "ann", None), (2, 0, None, "x"), (2, 0, "ann", "tie"), (2, 0, "ann", "tie"), (None, 5, "z", "lost"), (3, None, "q", "no turn"), (3, 9, "r", "y" * 5000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))
    got = {(r.conv_id, r.perspective): (r.rendered, [tuple(m) for m in r.masks]) for r in chat.assemble(chat.rotate(df, chunk)).collect()}
    assert got == brute_rotation(turns)
    for r in chat.rotate(df, chunk).collect():
        assert got[r.conv_id, r.perspective][0][r.seg_start : r.seg_end] == r.segment
    assert chat.rotate(df.where("false")).count() == 0
    # parts of long dialogues: the texts follow one another
    parts = chat.assemble(chat.rotate(df, chunk), most=2).orderBy("part").collect()
    joined = {}
    for r in parts:
        assert r.start == len(joined.get((r.conv_id, r.perspective), ("", []))[0])
        text, masks = joined.get((r.conv_id, r.perspective), ("", []))
        joined[r.conv_id, r.perspective] = text + r.rendered, masks + [tuple(m) for m in r.masks]
    assert joined == got and max(r.part for r in parts) > 0


def brute_licenses(rows, threshold=0.8):
    """Every unit against every template, by Python's sets."""
    grams = lambda w: set(zip(w, w[1:]))
    templates = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}
    out = []
    for i, text in rows:
        lines = [(k, w) for k, x in enumerate((text or "").split("\n"), 1) if (w := licenses.words_of(x))]
        flat = [x for _, w in lines for x in w]
        at = 0
        for k, w in [(0, flat), *lines]:
            units = [(w, t) for t in templates]
            if k:
                units += [(flat[at : at + len(b)], t) for t, b in templates.items() if len(w) < len(b) and at + len(w) < len(flat)]
                at += len(w)
            hits = []
            for unit, t in units:
                a, b = grams(unit), grams(templates[t])
                if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                    hits.append((-2 * len(a & b) / (len(a) + len(b)), t))
            if hits:
                out.append((i if i is not None else -1, k, min(hits)[1], round(-min(hits)[0], 9)))
    return sorted(out)


def wrapped(text, width, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0-notice"]
    code = "import os\n\ndef main(argv):\n    return os.path.join(*argv)\n"
    docs = [(1, "prose here\nReleased under the MIT license.\nmore"), (2, mit.upper().replace("COPYRIGHT HOLDERS", "PEOPLE")), (3, None), (4, ""), (5, "license"), (6, "word " * 50_000 + "\nLicensed under CC BY-NC 4.0"), (7, "This license is for fishing in the lake only"), (8, mit + "\n" + mit), (1, "prose here\nReleased under the MIT license.\nmore"),
            (10, "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + wrapped(mit, 70)), (11, "#!/bin/sh\n# Copyright 2021 Some Body\n#\n" + wrapped(apache, 60, "# ") + "\n" + code * 30), (12, code * 400 + wrapped(licenses.TEMPLATES["bsd-3-clause"], 76, " * ") + "\n" + code), (None, "/* Released under\n the MIT License. */ x"), (14, wrapped(licenses.TEMPLATES["gpl-3.0-notice"], 9)),
            (15, wrapped(mit[:400], 50)), (16, "\n" * 3000 + "Licensed under CC\n\n--\nBY-NC 4.0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = licenses.scan(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.line, r.license, round(r.dice, 9)) for r in got) == brute_licenses(docs)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, {})[r.line] = r.license
    assert found[1] == {2: "mit-notice"} and found[2] == {0: "mit", 1: "mit"} and found[6][2] == "cc-by-nc-4.0" and found[None] == {0: "mit-notice", 1: "mit-notice"}
    assert found[10][5] == "mit" and found[11][4] == "apache-2.0-notice" and found[12][1601] == "bsd-3-clause" and found[14][1] == "gpl-3.0-notice"
    assert not {3, 4, 5, 7, 15} & set(found) and found[16][3001] == "cc-by-nc-4.0"
    assert licenses.scan(df.where("false")).count() == 0
    # ties: the smaller name
    tied = licenses.scan(df.where("doc_id = 6"), {"b": "Licensed under CC BY-NC 4.0", "a": "licensed under cc by nc 4 0"}).collect()
    assert {r.license for r in tied} == {"a"}


def test_license_anchors():
    sets = {k: licenses.bigrams_of(v) for k, v in licenses.TEMPLATES.items()}
    pattern = re.compile(licenses.one_of(licenses.anchors(sets, 0.8)).replace("[^\\p{L}\\p{N}]+", " "))
    for grams in sets.values():
        assert sum(not pattern.search(g) for g in grams) < 0.8 / 1.2 * len(grams)


def test_packing(spark):
    odd = ["don't stop", "İstanbul ß ΣΑΣ", "a b\x1cc", "x² ½ 1234", "<|endoftext|> a<|endoftext|>b", "日本語 ﬁ", "#$%&&* «ÉTÉ»", "\U0001d518 ﻿a ​", "I'LL we'Ve", "é e ́", "x" * 300]
    rows = [(1, None), (2, ""), (None, "lost"), (3, "same"), (3, "same"), (4, "many words " * 9000), *((10 + i, t) for i, t in enumerate(odd))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(3).cache()
    real = df.collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in real:
        want.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    pieces = packing.pack(df, window=256, with_ids=True)
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    flat, texts = [], []
    for k, r in enumerate(got):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.sequence_id * 256 + r.offset == len(flat) and len(ids) == r.length and r.offset + r.length <= 256
        assert r.ids_crc32 == zlib.crc32(r.ids)
        if r.start == 0:
            texts.append((r.doc_id, []))
        assert texts[-1][0] == r.doc_id and len(texts[-1][1]) == r.start
        texts[-1][1].extend(ids)
        assert r.doc_tokens == len(want[r.doc_id][0])
        flat += ids
    by = {}
    for i, ids in texts:
        by.setdefault(i, []).append(ids)
    assert by == want
    whole = {r.sequence_id: r for r in packing.sequences(pieces, 256).collect()}
    assert all(len(r.ids) == 4 * 256 for r in whole.values() if r.length & (r.length - 1)) and sum(r.length for r in whole.values()) == len(flat)
    assert packing.pack(df.where("false")).count() == 0


def test_toxicity_cases(spark):
    bad, good = "zork flib", "nice words"
    rows = [(i, f"{good} {i} {bad if i % 3 == 0 else good} tail") for i in range(300)] + [(900, None), (901, ""), (None, f"{bad} x"), (902, "clean " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn("score", F.lit(7))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for i in range(300):
        assert got[i].predicted == int(i % 3 == 0) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[None].predicted == 1 and not got[None].held_out and got[901].score == got[900].score < 0.5 and got[902].predicted == 0
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in got.values())
    none = toxicity.classify(docs, labels.where("false")).agg(F.max("score")).first()[0]
    assert none == 0.0 and toxicity.classify(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("name, label, mod, out, least", [("op8_ftrl_toxicity", "toxic", 5, 0, 0.93), ("op10_quality_trees", "quality", 4, 2, 0.97)])
def test_held_out(spark, name, label, mod, out, least):
    got = queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % mod == out and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r[label] for r in got]) >= least


def plain_places(text):
    """Places of a text's distinct features, from Python's integers."""
    words = [w.strip(b".,;:!?\"'()[]{}|#$%&*") or w for w in (text or "").encode().lower().split()]
    one, two, top = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 2**64
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    found = {x * one % top >> 44 for x in [*h, *(xxhash.xxh3_64_intdigest(w[:4] + b"~") for w in words)]}
    found |= {(a * one + b) % top * two % top >> 44 for a, b in zip(h, h[1:])}
    return found | {(a * two + b) % top * one % top >> 44 for a, b in zip(h, h[2:])}


def plain_ftrl(rows, epochs=3, alpha=0.3, beta=1.0, l1=1.5, l2=1.0):
    """FTRL-proximal one coordinate at a time; returns the function that scores a set of places."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    score = lambda places: 1 / (1 + math.exp(-sum(weight(i) for i in [*sorted(places), "bias"])))
    for _ in range(epochs):
        for label, places in rows:
            g = score(places) - label
            old = {i: weight(i) for i in [*places, "bias"]}
            for i, w in old.items():
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * w
                n[i] = was + g * g
    return score


def small_corpus(spark, k=300):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("mel", "tor", "vin", "zor", "quab", "fli") for b in ("a", "ek", "ist", "und", "or", "ely", "im")]
    rows = []
    for i in range(k):
        bad = rng.random() < 0.4
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))] + (["grubblik", rng.choice(words), "snark!!"] if bad else [])
        rng.shuffle(body)
        rows.append((i, rng.choice([" ", "\n"]).join(body) + rng.choice([".", "", " 12 | 7"]), int(bad)))
    rows += [(k, None, 0), (k + 1, "", 1), (k + 2, rows[0][1], rows[0][2]), (k + 3, rows[1][1], 1 - rows[1][2])]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[5][:2]], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, toxic int, quality int")


def learning_order(docs, label, mod, out):
    """Rows that may be learnt from, in the order in which the operators draw them."""
    drawn = docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(label)).alias("draw")).collect()
    return sorted((r.draw, r.doc_id, r.text) for r in drawn if zlib.crc32(str(r.doc_id).encode()) % mod != out)


def test_toxicity_against_plain(spark):
    rows, docs, labels = small_corpus(spark)
    truth = {i: y for i, _, y in rows}
    model = plain_ftrl([(truth[i], plain_places(t)) for _, i, t in learning_order(docs, "toxic", 5, 0)])
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + 1
    text = {i: t for i, t, _ in rows}
    assert all(abs(r.score - model(plain_places(text[r.doc_id]))) < 1e-5 for r in got)
    assert len({round(r.score, 3) for r in got}) > 50


def plain_boost(x, y, trees, depth=4, bins=64, rate=0.12):
    """Boosted trees grown node by node: every edge of every feature is tried on the rows of the node. Returns the scores of x."""
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
    raw = np.full(len(y), math.log(mean / (1 - mean)))

    def grow(rows, level):
        if level == depth:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        best, split = 1e-3, None
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            for e in edges[f]:
                left = x[rows, f] <= e
                gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - whole
                if hl >= 2 and hr >= 2 and gain > best + 1e-9:
                    best, split = gain, (f, e)
        if split is None:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        left = x[rows, split[0]] <= split[1]
        grow(rows[left], level + 1)
        grow(rows[~left], level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-raw))


def test_trees_against_plain(monkeypatch):
    monkeypatch.setattr(gbt, "TREES", 6)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0) ^ (rng.random(300) < 0.1)).astype(float)
    assert np.abs(gbt.walk(gbt.boost(x, y), x) - plain_boost(x, y, 6)).max() < 1e-9


def test_quality_against_plain(spark, monkeypatch):
    """The whole query: the statistics of the learnt rows in drawn order, then trees that are walked one row at a time."""
    rows, docs, labels = small_corpus(spark)
    truth, text = {i: y for i, _, y in rows}, {i: t for i, t, _ in rows}
    model = gbt.boost(*(np.array(v, float) for v in zip(*((gbt.statistics((t or "").encode()), truth[i]) for _, i, t in learning_order(docs, "quality", 4, 2)))))

    def walk(i):
        x, raw = gbt.statistics((text[i] or "").encode()), model["bias"][0]
        for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"]):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
            raw += leaf[at - len(feature)]
        return 1 / (1 + math.exp(-raw))

    got = gbt.classify(docs, labels).collect()
    assert len(got) == len(rows) + 1 and all(abs(r.score - walk(r.doc_id)) < 1e-9 and r.predicted == int(r.score >= 0.7) for r in got)


def test_statistics():
    s = gbt.statistics("Aa bb bb, 12!!\n\nAa bb X | q".encode())
    words = "Aa bb bb, 12!! Aa bb X | q".split()
    assert s[1] == math.log(1 + len(words)) and s[16] == len(set(words)) / len(words) and s[18] == 2 and s[25] == 3 and s[27] == 0 and s[-2:] == [1, 1]
    assert gbt.statistics(None) == gbt.statistics(b"") and len(s) == len(gbt.statistics(b"x " * 100_000))


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c. " * 5), (3, "x" * 200_000), (3, "x" * 200_000)], "doc_id long, text string").withColumn("stats", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert gbt.classify(docs, labels.where("false")).where("score = 0.5").count() == 5
    assert gbt.classify(docs, labels).count() == 5 and gbt.classify(docs.where("false"), labels).count() == 0
    x = np.random.default_rng(0).normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    assert ((gbt.walk(gbt.boost(x, y), x) > 0.5) == y).mean() > 0.97


def follow(spark, docs, sf, tables):
    """Every stage of the pipeline on its predecessor's whole output, held against a brute-force version of it."""
    from .test_pairs import brute_components, brute_lines, brute_targets

    steps, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        steps.append(now)
        if name != "packing":
            assert now.columns == docs.columns
    start, clean, lines, unique, mixed, packed = steps
    verdict = Counter((r.doc_id, r.predicted) for r in toxicity.classify(docs, tables).collect())
    assert Counter(r.doc_id for r in clean.collect()) == Counter({i: n for (i, p), n in verdict.items() if p == 0})
    want = brute_lines([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id: r.text for r in lines.collect()} == want
    kept = {i for i, (_, _, k) in brute_components([(i, t) for i, t in want.items()], 5).items() if k}
    assert {r.doc_id for r in unique.collect()} == kept
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in unique.collect()}
    source = {r.doc_id: r.source for r in unique.collect()}
    by, target = brute_targets(sizes, source)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= kept and max(copies.values(), default=0) <= 2
    for s in by:
        took = sum(n * sizes[i] for i, n in copies.items() if source[i] == s)
        assert abs(took - target[s]) <= max(n for i, n in sizes.items() if source[i] == s)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in mixed.dropDuplicates(["doc_id"]).collect()}
    at, whole = 0, Counter()
    for r in packed.orderBy("sequence_id", "offset").collect():
        assert r.sequence_id * 4096 + r.offset == at and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at += r.length
        whole[r.doc_id] += r.length
    assert whole == Counter({i: n * len(ids[i]) for i, n in copies.items()})


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("copies", F.lit(1)).cache()
    follow(spark, docs, sf, spark.read.parquet(f"{sf}/labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]


def test_pipeline_cases(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names; and empty tables."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    rows = [(i, text(rng.randint(1, 8)), "en", rng.choice(["a", "b", None]), None) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, rows[3][1], "xx", "c", 7), (103, text(1500), "en", "b", 1), (104, rows[4][1] + " more", None, "a", 3), (105, " \n \n", "en", "z", 5)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, label string, key int, score double"
    docs = spark.createDataFrame([(*r, "clash", 1, 0.5) for r in rows], shape)
    labels = [(i, int(i % 9 == 0)) for i in range(60)] + [(None, 1), (5, None)]
    tables = spark.createDataFrame(labels, "doc_id long, toxic int")
    tables.write.parquet(str(tmp_path / "labels.parquet"))
    follow(spark, docs.cache(), str(tmp_path), tables)
    # rows without an id, and repeated rows, through the whole
    extra = docs.unionByName(docs.where("doc_id < 9")).unionByName(spark.createDataFrame([(None, text(3), "en", "a", 1, "x", 1, 1.0)] * 2 + [(None, None, None, None, None, None, None, None)], shape))
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} >= {None} and len(packed) > 40
    (tmp_path / "empty").mkdir()
    docs.where("false").write.parquet(str(tmp_path / "empty/documents.parquet"))
    tables.where("false").write.parquet(str(tmp_path / "empty/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_pipeline_mixes_order(spark, tmp_path):
    """Sources and the copies of a document are spread over the packed sequences, by shard and in the mix's order."""
    rows = [(i, f"text number {i} of many words", "en", f"s{i // 400}", 0) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, None)
    mixed.write.parquet(str(tmp_path / "mixed"))
    packed = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), None).where("start = 0").orderBy("sequence_id", "offset")
    order = [r.doc_id for r in packed.collect()]
    places = {(r.doc_id, r.mix_shard): r.mix_order for r in mixing.mix(docs).collect()}
    assert len(order) > len(set(order)) > 800
    sources = [i // 400 for i in order]
    share = [sources.count(s) / len(sources) for s in range(4)]
    same = sum(a == b for a, b in zip(sources, sources[1:])) / (len(sources) - 1)
    assert same < sum(x * x for x in share) + 0.08
    assert sum(a == b for a, b in zip(order, order[1:])) < len(order) / 100
    # most neighbours share a shard and follow each other in it
    follows = [any((a, s) in places and (b, s) in places and places[a, s] <= places[b, s] for s in range(8)) for a, b in zip(order, order[1:])]
    assert sum(follows) > 0.9 * len(follows)


def test_all_registered():
    assert [sum(n.startswith(f"op{k}_") for n in queries()) for k in range(1, 11)] == [1] * 10 and set(oracle_sql()) <= set(queries())
