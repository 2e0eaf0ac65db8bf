"""Line deduplication by content-defined chunks of lines, and windows of lines around them.

A text is cut into lines, and lines into chunks: a chunk ends after a line where a rolling hash over the hashes of the
last two lines is divisible by ``every``, or after ``longest`` lines; a line of ``long_words`` words or more is a chunk
of its own. Boundaries depend on nearby lines only, so passages that are shifted by an insertion are cut alike.
A chunk counts if it has two lines that aren't blank, or ``long_words`` words. Chunks are too coarse for passages of few
lines inside other text, so windows count as well: from every line that isn't blank the shortest run of lines, onward
and backward, that has ``long_words`` words. Whatever run of lines with so many words is repeated, the windows inside it
cover it from its first to its last line that isn't blank.
Of pieces (chunks and windows) whose bytes are equal, over all documents, the first in order of (doc_id, place) stays
and all others are removed, with their lines. A piece that overlaps the first equal one of its own text doesn't count,
so of lines that repeat themselves a first run stays.
Candidates are found by 128-bit hashes; what is removed has been compared byte by byte with the first.

Cases: null texts stay null, empty ones empty. Rows that repeat both doc_id and text are one document: all get the
same result. A null doc_id comes first in order. A text that is removed whole becomes empty; no row is dropped.
An empty table gives an empty result. Extra columns are carried along.

Scale: hashes of pieces are shuffled, not texts; of the pieces that repeat as many are compared as cover their lines. One
join on the hash meets hot pieces, with one row per hash on its other side, so Spark can split it. Texts meet the marks by
shuffled hash joins at every size: texts are never sorted, and the plan doesn't change as tables grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches


def windows(words: list[int], least: int) -> set[tuple[int, int]]:
    """The shortest runs of ``least`` words from every line onward and backward; they begin and end at lines with words."""
    full = [i for i, n in enumerate(words) if n]
    # blank lines after a line that is a window of its own
    out, total, far = {(i, j + 1) for i, j in zip(full, full[1:]) if words[i] >= least and j > i + 1}, 0, 0
    for i in full:
        while total < least and far < len(full):
            total += words[full[far]]
            far += 1
        if total < least:
            break
        out.add((i, full[far - 1] + 1))
        total -= words[i]
    total, far = 0, 0
    for i in full:
        total += words[i]
        while total - words[full[far]] >= least:
            total -= words[full[far]]
            far += 1
        if total >= least:
            out.add((full[far], i + 1))
    return out


def cut(text: bytes, every: int, longest: int, long_words: int) -> Iterator[tuple[int, int, bytes]]:
    """The chunks and windows that count, in order: first line, end line, bytes."""
    import xxhash

    lines = text.split(b"\n")
    if len(lines) == 1 and len(text) < 2 * long_words - 1:
        return
    words = [len(x.split()) for x in lines]
    found, begin, last = windows(words, long_words), 0, 0

    def close(end: int) -> None:
        nonlocal begin
        if end > begin:
            n = sum(words[begin:end])
            if n >= long_words or sum(w > 0 for w in words[begin:end]) > 1:
                found.add((begin, end))
            begin = end

    for i, line in enumerate(lines):
        if words[i] >= long_words:
            close(i)
            close(i + 1)
            last = 0
            continue
        own = xxhash.xxh3_64_intdigest(line)
        rolled = ((last * 0x9E3779B97F4A7C15 + own) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        last = own
        if (rolled >> 32) % every == 0 or i + 1 - begin >= longest:
            close(i + 1)
    close(len(lines))
    at = [0, *accumulate(len(x) + 1 for x in lines)]
    first_end: dict[bytes, int] = {}
    for begin, end in sorted(found):
        piece = text[at[begin] : at[end] - 1]
        if begin >= (e := first_end.setdefault(xxhash.xxh3_128_digest(piece), end)) or e == end:
            yield begin, end, piece


def chunk_rows(batches, options):
    """k1, k2, text -> k1, k2, begin, end, h1, h2."""
    import xxhash

    for batch in batches:
        rows: list[tuple] = []
        keys = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
        for k1, k2, text in zip(*keys, batch.column("text").to_pylist()):
            for begin, end, piece in cut(text or b"", *options):
                d = xxhash.xxh3_128_digest(piece)
                rows.append((k1, k2, begin, end, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["k1", "k2", "begin", "end", "h1", "h2"])


RANGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
HIT = ["begin", "end", "h1", "h2", "l1", "l2", "least"]


def cover_rows(batches):
    """k1, k2, hits (list of HIT) -> a row for each of the hits that are needed to cover all lines of all."""
    for batch in batches:
        rows: list[tuple] = []
        for k1, k2, hits in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "hits"))):
            covered, best = -1, None
            for h in sorted([h[c] for c in HIT] for h in hits):
                if best and h[0] > covered:
                    rows.append((k1, k2, *best))
                    covered, best = best[1], None
                if h[1] > covered:
                    covered = max(covered, h[0]) if best is None else covered
                    best = h if best is None or h[1] > best[1] else best
            if best:
                rows.append((k1, k2, *best))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(9)], ["k1", "k2", *HIT])


def merged_rows(batches):
    """k1, k2, ranges -> the same, ranges in order and those that overlap joined."""
    for batch in batches:
        out = []
        for ranges in batch.column("ranges").to_pylist():
            joined: list[dict] = []
            for r in sorted(ranges, key=lambda r: (r["begin"], r["end"])):
                if joined and r["begin"] < joined[-1]["end"]:
                    joined[-1]["end"] = max(joined[-1]["end"], r["end"])
                else:
                    joined.append(r)
            out.append(joined)
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, RANGES)], ["k1", "k2", "ranges"])


def piece_rows(batches):
    """k1, k2, text, found (list of begin, end, h1, h2, first) -> a row for each, with its bytes."""
    for batch in batches:
        rows: list[tuple] = []
        for k1, k2, text, found in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "found"))):
            lines = text.split(b"\n")
            rows += [(k1, k2, f["begin"], f["end"], f["h1"], f["h2"], f["first"], b"\n".join(lines[f["begin"] : f["end"]])) for f in found]
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(8)], ["k1", "k2", "begin", "end", "h1", "h2", "first", "piece"])


def keyed(docs: DataFrame) -> DataFrame:
    """Keys of a row: its id, null as the smallest, and a hash of its text."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "k2": F.xxhash64(F.col("text").cast("string"))})


def repeats(docs: DataFrame, every: int = 4, longest: int = 16, long_words: int = 50) -> DataFrame:
    """k1, k2 (see keyed) and ranges, the [begin, end) lines of the chunks to remove; only documents that have any."""
    scratch = Scratch(docs.sparkSession, "linedup")
    texts = keyed(docs.select("doc_id", "text")).select("k1", "k2", F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    options = (every, longest, long_words)
    with small_batches(docs.sparkSession, 1000):
        chunks = scratch.save(texts.mapInArrow(lambda it: chunk_rows(it, options), "k1 long, k2 long, begin long, end long, h1 long, h2 long"), "chunks")
    place = F.struct("k1", "k2", "begin")
    firsts = chunks.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("most")).where("first <> most").select("h1", "h2", "first")
    hit = F.struct("begin", "end", "h1", "h2", F.col("first.k1").alias("l1"), F.col("first.k2").alias("l2"), F.col("first.begin").alias("least"))
    again = chunks.join(firsts, ["h1", "h2"]).where(place != F.col("first")).groupBy("k1", "k2").agg(F.collect_set(hit).alias("hits"))
    with small_batches(docs.sparkSession, 1000):
        chosen = scratch.save(again.mapInArrow(cover_rows, "k1 long, k2 long, begin long, end long, h1 long, h2 long, l1 long, l2 long, least long"), "chosen")
    scratch.tidy()
    model = chosen.select(F.col("l1").alias("k1"), F.col("l2").alias("k2"), F.col("least").alias("begin"), (F.col("least") + F.col("end") - F.col("begin")).alias("end"), "h1", "h2", F.lit(True).alias("first")).distinct()
    wanted = chosen.select("k1", "k2", "begin", "end", "h1", "h2", F.lit(False).alias("first")).unionByName(model)
    per_doc = scratch.save(wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end", "h1", "h2", "first")).alias("found")), "found")
    scratch.tidy()
    with small_batches(docs.sparkSession, 500):
        pieces = texts.join(per_doc.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "found")
        pieces = scratch.save(pieces.mapInArrow(piece_rows, "k1 long, k2 long, begin long, end long, h1 long, h2 long, first boolean, piece binary"), "pieces")
    scratch.tidy()
    model = pieces.where("first").groupBy("h1", "h2").agg(F.first("piece").alias("model"))
    same = pieces.where("not first").join(model, ["h1", "h2"]).where("piece = model")
    ranges = same.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    with small_batches(docs.sparkSession, 1000):
        out = scratch.save(ranges.mapInArrow(merged_rows, "k1 long, k2 long, ranges array<struct<begin:long,end:long>>"), "repeats")
    scratch.drop("chunks", "chosen", "found", "pieces")
    scratch.tidy()
    return out


def remove(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs with the marked lines taken out of text; n_chars, where it is, follows."""
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("row"), "doc_id", "text")
    joined = keyed(whole).join(marked.hint("shuffle_hash"), ["k1", "k2"], "left")
    gone = lambda i: F.exists("ranges", lambda r: (i >= r["begin"]) & (i < r["end"]))
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~gone(i)), "\n")
    text = F.when(F.col("ranges").isNull(), F.col("row.text").cast("string")).otherwise(kept)
    new = {"text": text.alias("text")} | ({"n_chars": F.when(F.col("ranges").isNull(), F.col("row.n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in names else {})
    return joined.select(*(new.get(c, F.col(f"row.`{c}`")) for c in names))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    return remove(docs, repeats(docs, **options))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, removed_chunks, removed_lines, kept_chars, kept_md5 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = repeats(docs)
    counts = keyed(docs).join(marked.hint("shuffle_hash"), ["k1", "k2"], "left")
    lines = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    gone = lambda i: F.exists("ranges", lambda r: (i >= r["begin"]) & (i < r["end"]))
    kept = F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~gone(i)), "\n"))
    out = counts.select("doc_id", F.coalesce(F.size(F.col("ranges")), F.lit(0)).alias("n"), F.coalesce(lines, F.lit(0)).alias("removed_lines"), F.explode(F.array(kept)).alias("kept"))
    return out.select("doc_id", F.greatest("n", F.lit(0)).cast("long").alias("removed_chunks"), "removed_lines", F.length("kept").cast("long").alias("kept_chars"), F.md5("kept").alias("kept_md5"))
