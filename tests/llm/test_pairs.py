"""Near-dedup, line dedup, searches and the mix against brute force."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from docloom.llm import grid, linedup, lsh, minhash, mixing, mtree
from docloom.llm.common import Scratch
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=3):
    """Random texts, chains of ever more changed copies, exact copies, hostile rows."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(9):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                base[rng.randrange(len(base))] = rng.choice(WORDS)
            texts.append(rng.choice([" ", "\n", "\t "]).join(base).upper() if rng.random() < 0.3 else " ".join(base))
    texts += [None, "", "  \n ", "one", "ONE", "one two", "one two", "Été été", "été été", " ".join(WORDS * 30)]
    return [(i, t, "en", f"s{i % 4}" if i % 7 else None, 0) for i, t in enumerate(texts)]


def brute_components(rows, k):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("words, block", [(2, 512), (5, 3)])
def test_components(spark, words, block):
    rows = corpus()
    got = minhash.components(spark.createDataFrame(rows, DOCS), words=words, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(rows, words)


def test_components_cases(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "a b c"), (7, None)], "doc_id long, text string").withColumn("component_id", F.lit(1)).withColumn("key", F.lit(1))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.components(df).collect())
    assert got == [(False, 0, None, True), (True, 5, 5, True), (True, 5, 5, True), (True, 7, 7, True), (True, 9, 5, False)]
    assert minhash.components(df.where("false")).count() == 0
    assert sorted(r.doc_id or 0 for r in minhash.deduplicate(df).collect()) == [0, 5, 5, 7]


def test_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7), (200, 150)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.label for r in minhash.connected_components(df, Scratch(spark, "t"), "t").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 150: 150, 200: 150}


def plain_pieces(text, every=4, longest=16, long_words=50):
    """Chunks and windows by their definitions, written anew: every run is looked at on its own."""
    lines = text.split(b"\n")
    words = [len(x.split()) for x in lines]
    full = [i for i, n in enumerate(words) if n]
    runs = set()
    for i in full:
        onward = [j for j in full if j >= i and sum(words[i : j + 1]) >= long_words]
        backward = [j for j in full if j <= i and sum(words[j : i + 1]) >= long_words]
        runs |= {(i, onward[0] + 1)} if onward else set()
        runs |= {(backward[-1], i + 1)} if backward else set()
    runs |= {(i, j + 1) for i, j in zip(full, full[1:]) if words[i] >= long_words and j - i > 1}
    ends, since, last = [], 0, 0
    for i, line in enumerate(lines):
        if words[i] >= long_words:
            ends += [i, i + 1]
            since, last = i + 1, 0
            continue
        h = xxhash.xxh3_64_intdigest(line)
        roll = (last * 0x9E3779B97F4A7C15 + h) * 0xD6E8FEB86659FD93 % 2**64
        last = h
        if (roll >> 32) % every == 0 or i + 1 - since >= longest:
            ends.append(i + 1)
            since = i + 1
    ends = sorted({0, len(lines), *ends})
    for x, y in zip(ends, ends[1:]):
        if sum(words[x:y]) >= long_words or sum(n > 0 for n in words[x:y]) > 1:
            runs.add((x, y))
    out = []
    for x, y in sorted(runs):
        piece = b"\n".join(lines[x:y])
        first = next((e for b, e, p in out if p == piece), None)
        if first is None or x >= first:
            out.append((x, y, piece))
    return out


def brute_lines(rows, options=(4, 16, 50)):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines, gone = (t or "").split("\n"), set()
        for begin, end, piece in plain_pieces((t or "").encode(), *options):
            if piece in seen:
                gone |= set(range(begin, end))
            seen.add(piece)
        out[i] = t if t is None or not gone else "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_line_cutter():
    """The product's cutter against the plain one, on texts of every shape."""
    rng = random.Random(8)
    for k in range(400):
        line = lambda: rng.choice(["", " ", "a", "b c", "x y z", " ".join(rng.choice(WORDS[:9]) for _ in range(rng.choice([3, 20, 49, 50, 80])))])
        text = "\n".join(line() for _ in range(rng.randint(1, 40))).encode()
        options = rng.choice([(4, 16, 50), (1, 3, 10), (2, 2, 4)])
        got = list(linedup.cut(text, *options))
        assert got == plain_pieces(text, *options) or len(text.split(b"\n")) == 1 and not got and len(text.split()) < options[2]


def test_line_chunks(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 9))) for _ in range(300)]
    passage, long_line = lines[:24], " ".join(WORDS[:60])
    rows = []
    for i in range(40):
        own = rng.sample(lines[30:], 12)
        at = rng.randint(0, 12)
        rows.append((i, "\n".join(own[:at] + (passage if i % 3 == 0 else []) + ([long_line] if i % 4 == 0 else []) + own[at:])))
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (53, rows[0][1]), (54, long_line + " x\n" * 3000)]
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars int, k1 string")
    got = linedup.deduplicate(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    want = brute_lines(rows)
    found = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in found.items()} == want
    assert len(found[53].text) < len(rows[0][1]) / 2 and sum(long_line in (t or "") for t in want.values()) < 3
    assert all(r.n_chars == len(r.text or "") for r in found.values())
    assert linedup.deduplicate(df.where("false")).count() == 0


def brute_runs(rows, least=50):
    """Lines of every run of lines with ``least`` words that an earlier text has."""
    out = {}
    for k, (i, t) in enumerate(rows):
        mine, gone = t.split("\n"), set()
        for _, other in rows[:k]:
            theirs = other.split("\n")
            for a, x in enumerate(mine):
                for b, y in enumerate(theirs):
                    n = 0
                    while x == y and a + n < len(mine) and b + n < len(theirs) and mine[a + n] == theirs[b + n]:
                        n += 1
                    if sum(len(z.split()) for z in mine[a : a + n]) >= least:
                        gone |= set(range(a, a + n))
        out[i] = "\n".join(x for j, x in enumerate(mine) if j not in gone)
    return out


def test_line_chunks_short_passages(spark):
    """Passages of 2 to 6 lines, each line under 50 words, between lines of their own text."""
    rng = random.Random(11)
    line = lambda low, high: " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high)))
    passages = [[line(52 // n + 1, 45) for _ in range(n)] for n in (2, 3, 4, 5, 6) for _ in range(4)] + [[line(30, 30), line(30, 30), line(3, 3)], [line(3, 3), line(60, 60), line(4, 4)]]
    rows = []
    for copy in range(3):
        for p in passages:
            rows.append((len(rows), "\n".join([line(3, 20) for _ in range(rng.randint(1, 5))] + p + [line(3, 20) for _ in range(rng.randint(1, 5))])))
    want = brute_runs(rows)
    assert all(("\n".join(p) in want[k]) == (k < len(passages)) for k, p in enumerate(passages * 3))
    got = {r.doc_id: r.text for r in linedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_chunks_cover():
    """Any run of 50 words is covered by windows inside it; lines that repeat themselves keep a first run."""
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([0, 1, 5, 20, 49, 70]) for _ in range(rng.randint(1, 14))]
        found = linedup.windows(words, 50)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if words[a] and words[b - 1] and sum(words[a:b]) >= 50:
                    assert set().union(*(range(x, y) for x, y in found if a <= x and y <= b)) == set(range(a, b))
    kept = brute_lines([(1, "x\n" * 400)])[1].split("\n")
    assert 50 <= kept.count("x") < 100


def test_line_chunk_repeats_of_rows(spark):
    text = "\n".join(f"line number {i} of it" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "other\nlines here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, len(r.text)) for r in linedup.deduplicate(df).collect())
    assert got[0] == (0, len(text)) and got[1] == got[2] and got[1][0] == 1 and got[1][1] < len(text) / 4 and got[3] == (2, 16)


def vectors(spark, n, dim, seed=1, extra=()):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))


HOSTILE = [(1000, None), (2000, []), (3000, [float("nan")] * 16), (3500, [None] + [1.0] * 15), (4000, [float("inf")] * 16), (5000, [0.0] * 16), (6000, [1.0, 2.0])]


def brute_top(rows, every, k, score, skip=lambda e: False):
    """Answers of every row with a fitting id, as a multiset: rows are told apart by their place."""
    rows = [(i, e) for i, e in rows if e and None not in e and np.isfinite(np.array(e, float)).all() and not skip(e)]
    out = []
    for a, (q, e) in enumerate(rows):
        if q % every == 0:
            best = sorted((-score(e, y), i) for b, (i, y) in enumerate(rows) if b != a and len(y) == len(e))[:k]
            out += [(q, j + 1, i, -s) for j, (s, i) in enumerate(best)]
    return sorted(out)


def whole_product(a, b):
    return min(max(sum(math.floor(Fraction(x) * 256) * math.floor(Fraction(y) * 256) for x, y in zip(a, b)), -(2**63)), 2**63 - 1)


def answers(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


REPEATED = [(7001, [0.25] * 16), (7002, [0.25] * 16), (7002, [0.25] * 16), (7050, [0.25] * 16), (7100, [0.5] * 16), (7100, [0.5] * 16), (7100, [0.5] * 16), (7100, [0.125] * 16)]


def test_mtree(spark):
    """Ties, repeated rows and repeated ids with other vectors, vectors that take no part, vectors of another length."""
    _, df = vectors(spark, 900, 16, extra=[*HOSTILE, *REPEATED])
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert answers(mtree.top(df)) == answers(mtree.top(df.repartition(5))) == brute_top(rows, 50, 5, whole_product)
    assert mtree.top(df.where("false")).count() == 0


def test_mtree_several_blocks(spark):
    _, df = vectors(spark, 700, 8)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    build = lambda ids, n, x: mtree.build(ids, n, mtree.whole(x, 256), 64)
    got = grid.search(df, 5, 10, build, lambda t, ids, n, x: mtree.look(t, ids, mtree.whole(x, 256), 5), False, "long", per_block=90, per_part=7, per_lane=3)
    assert answers(got) == brute_top(rows, 10, 5, whole_product)


def test_mtree_large_components(spark):
    """No finite vector is left out: components of millions, products near the limits of a long and beyond them."""
    large = [[2e6, 1.0], [-2e6, 1.0], [1e7, 1e7], [1.1e7, -1.1e7], [3e6, 5.5], [1e300, -1e300], [-1.7e308, 1.7e308], [5e-324, 1.0], [1.0, 0.5]]
    rows = [(50 * i if i % 2 else i, v) for i, v in enumerate(large * 2)]
    for some in (rows, [r for r in rows if max(map(abs, r[1])) < 2.5e6], [r for r in rows if max(map(abs, r[1])) < 1e8]):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>")
        assert answers(mtree.top(df)) == brute_top(some, 50, 5, whole_product)


def test_mtree_skips(spark):
    """On points in clusters the bounds save most inner products."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 8)), 100, 0) + rng.normal(size=(4000, 8)) * 0.02))
    tree = mtree.build(np.arange(4000), np.ones(4000, int), x, leaf=64)
    tree["x"] = tree["x"].astype(float)
    work = [mtree.search_one(tree, i, x[i], 5)[2] for i in range(0, 4000, 50)]
    assert np.mean(work) < 1000


def test_collision_counting(spark):
    x, df = vectors(spark, 3000, 64, extra=[(9000, None), (9020, [0.0] * 64), (9040, [float("nan")] * 64)])
    got = {}
    for r in lsh.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    x = x.astype(np.float32).astype(float)
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -9
        assert len(got[q]) == 20 and all(abs(v - s[i]) < 1e-12 for i, v in got[q])
        hit += len({i for i, _ in got[q]} & set(np.argsort(-s)[:20].tolist()))
    assert set(got) == set(range(0, 3000, 20)) and hit / (150 * 20) >= 0.9
    small = df.where("vec_id < 400 or vec_id >= 9000").unionByName(spark.createDataFrame([(*r, "x") for r in [(8000, [0.125] * 64), (8000, [0.125] * 64), (8000, [0.25] * 64), (8001, [0.25] * 64), (8002, [0.25] * 64)]], df.schema))
    exact = [(q, j, i, round(v, 9)) for q, j, i, v in answers(lsh.nearest(small))]
    rows = [(r.vec_id, r.embedding) for r in small.collect()]
    # the windows of so few points hold everything: repeated rows and ties come out as by brute force
    want = [(q, j, i, round(v, 9)) for q, j, i, v in brute_top(rows, 20, 20, lambda a, b: float(np.dot(a, b)), lambda e: not any(e))]
    assert exact == want == [(q, j, i, round(v, 9)) for q, j, i, v in answers(lsh.nearest(small.repartition(7)))]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in lsh.nearest(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert lsh.nearest(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1000, 2000, 3000, 3800, 4000, 6000, 16384])
def test_collision_recall(n):
    """Recall of one block is clearly over 0.9 at every size, over several seeds."""
    for seed in (21, 22, 23):
        x = np.random.default_rng(seed).normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ask = np.arange(0, n, n // 50)[:50]
        got = {}
        index = lsh.build(np.arange(n), np.ones(n, int), x)
        for number, i, _ in zip(*lsh.look(index, ask, np.ones(50, int), x[ask], 20)):
            got.setdefault(int(ask[number]), set()).add(i)
        best = x[ask] @ x.T
        best[np.arange(50), ask] = -9
        assert sum(len(got[q] & set(b.tolist())) for q, b in zip(ask.tolist(), np.argsort(-best, axis=1)[:, :20])) / 1000 >= 0.96


def test_collision_recall_several_blocks(spark):
    """Through the whole grid: six blocks, several parts and lanes."""
    x, df = vectors(spark, 6000, 64, seed=4)
    got = {}
    look = lambda index, ids, n, y: lsh.look(index, ids, n, y, 20)
    for r in grid.search(df, 20, 20, lsh.build, look, True, "double", per_block=1000, per_part=64, per_lane=2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    best = x[::20] @ x.T
    best[np.arange(300), np.arange(0, 6000, 20)] = -9
    hit = sum(len(got[20 * q] & set(b.tolist())) for q, b in enumerate(np.argsort(-best, axis=1)[:, :20]))
    assert all(len(v) == 20 for v in got.values()) and hit / 6000 >= 0.95


def brute_targets(sizes, source):
    """(words, target) of each source, by capping one round of sources after another."""
    by = Counter()
    for i, n in sizes.items():
        by[source[i]] += n
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(by.values()), set()
    while True:
        rest = budget - sum(2 * by[s] for s in capped)
        target = {s: 2 * by[s] if s in capped else rest * weight[s] / sum(weight[t] for t in by if t not in capped) for s in by}
        over = {s for s in by if target[s] > 2 * by[s] + 1e-9}
        if not over:
            return by, target
        capped |= over


def test_mix(spark):
    rows = corpus(9) + [(900 + i, "a b c " * 40, "en", "zz\U0001f600", 0) for i in range(5)]
    df = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = mixing.plan_mix(df).collect()
    sizes = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows}
    assert {r.doc_id: r.size for r in got} == sizes
    source = {i: s for i, _, _, s, _ in rows}
    by, target = brute_targets(sizes, source)
    taken = Counter()
    for r in got:
        assert r.source_size == by[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size) and len(r.shards) == r.copies and all(0 <= s < 8 for s in r.shards)
        taken[source[r.doc_id]] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= max(n for i, n in sizes.items() if source[i] == s)
    assert sorted(map(tuple, mixing.plan_mix(df.repartition(7)).drop("shards").collect())) == sorted(map(tuple, mixing.plan_mix(df).drop("shards").collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "mix_shard", "mix_order"]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.plan_mix(df.where("false")).count() == 0


def test_mix_cases(spark):
    """Null and repeated ids, repeated rows, a very long text, no texts; all from any split of the files."""
    rows = [(None, f"w{i} x y", "en", "a", 0) for i in range(40)] + [(None, "same words here", "en", "a", 0)] * 5 + [(7, "b c", "en", "b", 0)] * 30 + [(7, "another text", "en", "b", 0), (8, None, "en", None, 0), (9, "", "en", "c", 0), (10, "long " * 200_000, "en", "d", 0), (11, "last one", "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.plan_mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, *_ in rows)
    assert all(r.taken <= 2 * r.size and (r.size or not r.copies) for r in got)
    for target in {r.target for r in got}:
        mine = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
    again = mixing.plan_mix(df.repartition(9)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mix(df).count() == sum(r.copies for r in got)
    assert mixing.mix(df.where("false")).count() == mixing.plan_mix(df.where("text is null")).where("copies > 0").count() == 0


def test_mix_files(spark, tmp_path):
    df = spark.createDataFrame(corpus(2), DOCS)
    mixing.write_mix(mixing.mix(df), str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.count() == mixing.mix(df).count() and back.select("mix_shard").distinct().count() == 8


def test_tree_is_exact(spark):
    """Every node of the tree sends half its blocks left, so shards hold equal numbers of blocks."""
    items = spark.range(1000).selectExpr("0 AS group", "concat('s', id % 3) AS source_key", "cast(id AS int) AS block", "1 AS copy")
    n = Counter(r.shard for r in mixing.split_tree(items, 3, "x").collect())
    assert len(n) == 8 and set(n.values()) == {125}
