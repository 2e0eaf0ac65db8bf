"""MinHash near-deduplication: universal hash minima, banding, signature and set verification, star components.

Texts are lower-cased (A-Z) and split at ASCII white space; a document's set holds its distinct ``words``-word
shingles, as 64-bit hashes. Documents whose sets have 100 * intersection >= percent * union are linked, and a
component is everything that links reach.

1. Documents with equal sets form a class; from here on a class is one node, named by its smallest doc_id.
2. 128 minima of a class, in 32 bands of 4: of two sets with similarity 0.8 one in 20 million pairs shares no band.
3. In each bucket (classes that share a band) a leader is drawn; a class is compared to the leader with which it
   shares most buckets. What passes the signatures and then the full sets is a link. Two such rounds connect
   most of every group with one comparison per class.
4. Buckets that still hold several components are gone through exhaustively, but only pairs of different components:
   signatures first, then, where they pass, full sets. Large buckets are cut into blocks of ``block`` classes and
   each pair of blocks, but for two of the bucket's largest component, is
   gone through by itself, so memory is bounded; links are only sent on when they join components.
5. Components of all links by alternating large-star and small-star.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing. A text with fewer
words than a shingle is one shingle. A row without a doc_id is linked with nothing, has component_id null and is kept.
Rows that repeat a doc_id are one node; each gets a row of the result. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

BANDS, ROWS = 32, 4
SIGNATURE = BANDS * ROWS
#: Matching 8-bit minima, of 128, below which a pair is not compared: 4.5 standard deviations under those of 0.8. A pair of
#: that similarity is passed over with a chance of 8 in a million (0 as the parameter ``enough`` compares all).
ENOUGH = 82


#: Edges of a file, where there are that many.
PER_FILE = 100_000


def universal() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], words: int, cache: WordHashes) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    for text in texts:
        tokens = (text or b"").lower().split()
        n = len(tokens)
        h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, n)
        k = min(words, n)
        if not k:
            yield h
            continue
        s = h[: n - k + 1].copy()
        for j in range(1, k):
            s *= factor
            s += h[j : n - k + 1 + j]
        yield np.unique(mixed(s + np.uint64(k)))


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 512) -> np.ndarray:
    """The minima; a run of ``step`` shingles and its hashes fit in the processor's cache."""
    out = np.full(SIGNATURE, 2**64 - 1, np.uint64)
    hashed = np.empty((SIGNATURE, min(step, len(s))), np.uint64)
    for i in range(0, len(s), step):
        run = s[i : i + step]
        h = np.multiply(run, a[:, None], out=hashed[:, : len(run)])
        h += b[:, None]
        np.minimum(out, h.min(1), out=out)
    return out >> np.uint64(32)


def sketched(batches, words: int):
    """doc_id, text -> doc_id, n, h1, h2 (of the set), bands (a hash for each), minima (8 bits each)."""
    import xxhash

    cache, (a, b) = WordHashes(), universal()
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    with np.errstate(over="ignore"):
        for batch in batches:
            n, h1, h2, bands, minima = [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words, cache):
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                if not len(s):
                    bands.append(None)
                    minima.append(None)
                    continue
                m = signature(s, a, b)
                key = salt.copy()
                for r in range(ROWS):
                    key = mixed(key ^ (m[r::ROWS] + np.uint64(r)))
                bands.append(key.astype(np.int64))
                minima.append(m.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(minima, pa.binary())],
                ["doc_id", "n", "h1", "h2", "bands", "minima"],
            )


def set_rows(batches, words: int):
    """cid, text, minima -> cid, minima, members (the set's bytes)."""
    cache = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words, cache)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("minima"), pa.array(sets, pa.binary())], ["cid", "minima", "members"])


def similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def agreeing(a: bytes, b: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))


def verified(batches, percent: int, enough: int):
    """u, v with minima and sets of both -> the pairs that are links."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("u", "v", "minima_u", "minima_v", "members_u", "members_v")]
        found = [(u, v) for u, v, p, q, x, y in zip(*cols) if agreeing(p, q) >= enough and similar(x, y, percent)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def whole_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Cuts a sorted stream where the key changes; every table holds whole groups, many small ones at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.ones(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            last &= values == values[-1]
        cut = batch.num_rows - int(last.sum())
        begun = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if cut == 0 and (begun or not held):
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def group_slices(t: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    change = np.zeros(t.num_rows, bool)
    for k in keys:
        v = t.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    cuts = np.flatnonzero(change)
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), t.num_rows])


def passing_pairs(minima: np.ndarray, bands: np.ndarray, key: int, comp: np.ndarray, own: np.ndarray, cross: bool, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rows of a bucket's block) of different components whose minima agree and whose first common band this is."""
    at = np.flatnonzero(bands[0] == key)[0]
    left = np.flatnonzero(own == 0) if cross else np.arange(len(comp))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in left:
        others = np.flatnonzero(own == 1) if cross else np.arange(i + 1, len(comp))
        others = others[comp[others] != comp[i]]
        if not len(others):
            continue
        same = (minima[others] == minima[i]).sum(1)
        ok = same >= enough
        others, same = others[ok], same[ok]
        if at and len(others):
            first = ~(bands[others, :at] == bands[i, :at]).any(1)
            others, same = others[first], same[first]
        if len(others):
            out.append((np.full(len(others), i), others, same))
    if not out:
        return (np.zeros(0, int),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


GROUP = ["key", "part_a", "part_b"]


def block_arrays(t: pa.Table, i: int, j: int):
    part = t.slice(i, j - i)
    minima = np.frombuffer(b"".join(part.column("minima").to_pylist()), np.uint8).reshape(j - i, SIGNATURE)
    bands = np.array(part.column("bands").to_pylist(), np.int64)
    comp, mine = part.column("comp").to_numpy(), part.column("part").to_numpy()
    a, b = part.column("part_a")[0].as_py(), part.column("part_b")[0].as_py()
    return part, minima, bands, comp, (mine == b).astype(int), a != b


def hopeful(batches, enough: int):
    """Blocks of buckets -> (key, part_a, part_b, cid): the classes that are in some pair that passes."""
    for t in whole_groups(batches, GROUP):
        rows: list[tuple[int, int, int, int]] = []
        for i, j in group_slices(t, GROUP):
            part, minima, bands, comp, own, cross = block_arrays(t, i, j)
            if (comp == comp[0]).all():
                continue
            key = part.column("key")[0].as_py()
            x, y, _ = passing_pairs(minima, bands, key, comp, own, cross, enough)
            cid = part.column("cid").to_numpy()
            a, b = part.column("part_a")[0].as_py(), part.column("part_b")[0].as_py()
            rows += [(key, a, b, c) for c in np.unique(cid[np.concatenate((x, y))]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], [*GROUP, "cid"])


def joining(batches, percent: int, enough: int):
    """Blocks of buckets with sets -> links that join components, the most alike first."""
    for t in whole_groups(batches, GROUP):
        u, v = [], []
        for i, j in group_slices(t, GROUP):
            part, minima, bands, comp, own, cross = block_arrays(t, i, j)
            x, y, same = passing_pairs(minima, bands, part.column("key")[0].as_py(), comp, own, cross, enough)
            cid, sets = part.column("cid").to_numpy(), part.column("members").to_pylist()
            parent = {c: c for c in comp.tolist()}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            for k in np.argsort(-same, kind="stable"):
                p, q = root(int(comp[x[k]])), root(int(comp[y[k]]))
                if p != q and similar(sets[x[k]], sets[y[k]], percent):
                    parent[p] = q
                    u.append(int(cid[x[k]]))
                    v.append(int(cid[y[k]]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Alternating large-star and small-star, until every node hangs on one that hangs on none.

    edges: u, v. Returns node, label (the smallest node of its component).
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # stars never have more edges than there are links: few links needn't be a file for each partition, round by round
    files = max(1, -(-edges.count() // PER_FILE))
    now = scratch.save(edges.distinct().coalesce(files), f"{tag}-0")
    for k in itertools.count(1):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("hangs")))
        if not ends.groupBy("node").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("low")).where("n > 1 or n = 1 and low = 0").count():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.save(small.coalesce(files), f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
    # stars of (node, smallest): the smallest names itself
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def stars(labels: DataFrame) -> DataFrame:
    """The edges that components are known by; later links are added to these."""
    return labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))


def components(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 512, enough: int = ENOUGH) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    with small_batches(spark, 500):
        base = scratch.save(texts.mapInArrow(lambda it: sketched(it, words), "doc_id long, n long, h1 long, h2 long, bands array<long>, minima binary"), "base")
    nodes = base.where("n > 0 and doc_id is not null")
    classes = scratch.save(nodes.groupBy("h1", "h2").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.first("minima").alias("minima")), "classes")
    keyed = classes.select("cid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.save(keyed.join(shared, "key"), "members")
    scratch.tidy()
    involved = members.select("cid").distinct().join(classes.select("cid", "minima"), "cid")
    with small_batches(spark, 500):
        sets = scratch.save(texts.join(involved, texts.doc_id == involved.cid).select("cid", "text", "minima").mapInArrow(lambda it: set_rows(it, words), "cid long, minima binary, members binary"), "sets")
    scratch.tidy()

    def side(name: str) -> DataFrame:
        return sets.select(F.col("cid").alias(name), F.col("minima").alias(f"minima_{name}"), F.col("members").alias(f"members_{name}"))

    labels = None
    for k in range(2):
        at = members if labels is None else members.join(labels, members.cid == labels.node, "left").select("key", "cid", "size", F.coalesce("label", "cid").alias("comp"))
        at = at if labels is not None else at.withColumn("comp", F.col("cid"))
        leaders = at.groupBy("key").agg(F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("draw"), F.col("cid").alias("leader"), F.col("comp").alias("other"))).alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        pairs = at.join(leaders, "key").where("comp <> lead.other").groupBy("cid", "lead.leader").agg(F.count(F.lit(1)).alias("n"))
        best = pairs.groupBy("cid").agg(F.max(F.struct("n", F.xxhash64("leader").alias("draw"), "leader")).alias("best")).select(F.col("cid").alias("u"), F.col("best.leader").alias("v"))
        compared = best.join(side("u"), "u").join(side("v"), "v").select("u", "v", "minima_u", "minima_v", "members_u", "members_v")
        with small_batches(spark, 500):
            found = scratch.save(compared.mapInArrow(lambda it: verified(it, percent, enough), "u long, v long"), f"links{k}")
        scratch.tidy()
        links = found if labels is None else found.unionByName(stars(labels))
        labels = connected_components(links, scratch, f"stars{k}")
    at = members.join(labels, members.cid == labels.node, "left").select("key", "cid", F.coalesce("label", "cid").alias("comp"))
    sizes = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_buckets = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    cut = open_buckets.select("key", "major.comp", F.ceil((F.col("size") - F.col("major.n")) / block).alias("minors"), F.ceil(F.col("major.n") / block).alias("majors")).withColumnRenamed("comp", "major")
    # blocks of the bucket's largest component (numbered after the others) needn't meet each other
    big = F.col("comp") == F.col("major")
    draw = F.xxhash64("cid")
    left = at.join(cut, "key").withColumn("part", F.when(big, F.col("minors") + F.pmod(draw, "majors")).otherwise(F.pmod(draw, "minors")))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(big, F.col("minors") - 1).otherwise(F.col("minors") + F.col("majors") - 1))))
    left = scratch.save(left.select("key", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "cid", "comp"), "left")
    sketches = classes.select("cid", "bands", "minima")
    dealt = left.join(sketches, "cid").repartition("key", "part_a", "part_b").sortWithinPartitions(*GROUP, "cid")
    with small_batches(spark, 2000):
        hopes = scratch.save(dealt.mapInArrow(lambda it: hopeful(it, enough), "key long, part_a long, part_b long, cid long"), "hopes")
    scratch.tidy()
    again = left.join(hopes, [*GROUP, "cid"], "left_semi").join(sketches, "cid").join(sets.select("cid", "members"), "cid").repartition("key", "part_a", "part_b").sortWithinPartitions(*GROUP, "cid")
    with small_batches(spark, 500):
        found = scratch.save(again.mapInArrow(lambda it: joining(it, percent, enough), "u long, v long"), "links2")
    scratch.tidy()
    labels = connected_components(found.unionByName(stars(labels)), scratch, "stars2")
    named = classes.join(labels, classes.cid == labels.node, "left").select("h1", "h2", F.coalesce("label", "cid").alias("component_id"))
    out = base.select("doc_id", "n", "h1", "h2", (F.col("n") > 0).alias("full")).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("full") & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller doc_id. Rows without doc_id stay."""
    gone = components(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id.cast("long") == gone["_gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)


ORACLE_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS cid, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
grams AS (SELECT cid, n, unnest(s) AS g FROM classes),
rare AS (SELECT g, count(*) AS c FROM grams GROUP BY g),
ranked AS (SELECT cid, n, g, row_number() OVER (PARTITION BY cid ORDER BY c, g) AS k FROM grams JOIN rare USING (g)),
pre AS (SELECT cid, n, g FROM ranked WHERE k <= n - (8 * n + 9) // 10 + 1),
cand AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM pre a JOIN pre b ON a.g = b.g AND a.cid < b.cid AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
links AS (SELECT a, b FROM cand JOIN classes x ON x.cid = a JOIN classes y ON y.cid = b WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT cid, cid FROM classes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
byset AS (SELECT s, root FROM classes JOIN comp ON node = cid)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
FROM sets d LEFT JOIN byset ON byset.s = list_sort(d.s)
"""
