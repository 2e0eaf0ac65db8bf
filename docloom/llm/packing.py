"""Packing by concatenation and cutting.

Documents are tokenized, each is closed by an end token, and all are laid end to end; fixed windows of ``window``
tokens are the sequences. First pass: each partition of the scan writes its documents' ids with their place in the
partition, and its total. The totals' prefix sums give every partition, and so every document, a global
offset. Second pass: documents are cut where windows end; a piece is a boundary record (document, start in it, length, sequence,
offset there). Only the last sequence is not full.

Ids are those of the tokenizer file over the whole text. White space only separates words there, so a text's ids are
those of its words in turn; words are tokenized once and remembered, up to a limit. Words of ASCII and Latin letters
go through the same merges by a byte-pair coder built from the file, all others through the file's own library.

Cases: a null text is empty; an empty text is its end token alone. Repeated rows are packed each. A null doc_id is
kept. An empty table gives an empty result. Extra columns are ignored.

Scale: no text is shuffled; what meets in one place is one total per partition.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, small_batches

TOKENIZER, WINDOW, END = "word_bpe_49k.json", 4096, 2

#: A letter of the words that the byte-pair coder takes: ASCII and Latin-1, whose lower case and normal form are single.
PLAIN = "[\\x21-\\x7EÀ-ÖØ-öø-ÿ]+"
#: Fixed value: the tokenizer file's own pattern.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: What that finds in ASCII letters and digits.
ASCII_PIECES = re.compile(b"[a-z]+|[0-9]").findall


class Words(dict):
    """Word (UTF-8) -> its ids as little-endian 32-bit numbers."""

    def __init__(self, name: str, limit: int = 250_000):
        import json

        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        path = public_tokenizers.path(name) if "/" not in name else name
        self.slow, self.limit, self.pieces = Tokenizer.from_file(path), limit, {}
        with open(path) as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        # the file writes bytes as printable characters: those that print stand for themselves, the others follow from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in spec["added_tokens"]}
        # a word's end is marked by byte 255, which no UTF-8 text holds
        ranks = {}
        for token, k in vocab.items():
            if token not in special:
                end = suffix and token.endswith(suffix) and token != suffix
                raw = bytes(byte_of[c] for c in (token[: -len(suffix)] if end else token))
                ranks.setdefault(raw + b"\xff" * bool(end), k)
        self.coder = tiktoken.Encoding("words", pat_str="\\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.find_ascii = re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.find, self.plain = regex.compile(PIECES).findall, regex.compile(PLAIN).fullmatch
        self.special = tuple(special)

    def piece(self, p: bytes) -> bytes:
        out = self.pieces.get(p)
        if out is None:
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            out = self.pieces[p] = array("I", self.coder.encode_single_piece(p + b"\xff")).tobytes()
        return out

    def __missing__(self, word: bytes) -> bytes:
        if len(word) < 200 and word.isascii() and word.isalnum():
            low = word.lower()
            out = self.piece(low) if low.isalpha() else b"".join([self.piece(p) for p in ASCII_PIECES(low)])
        elif len(word) < 200 and word.isascii() and b"<|" not in word and min(word) > 32 and max(word) < 127:
            out = b"".join([self.piece(p) for p in self.find_ascii(word.lower())])
        elif len(word) < 200 and b"<|" not in word and self.plain(text := word.decode("utf-8", "replace")):
            out = b"".join([self.piece(p.encode()) for p in self.find(text.lower())])
        else:
            out = np.array(self.slow.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) < 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out

    def ids(self, text: bytes) -> bytes:
        return b"".join([self[w] for w in text.split()])


def tokenized(batches, name: str, end: int):
    """doc_id, part, text -> doc_id, part, before (tokens in the partition before it), n, ids (little-endian, 32 bits each)."""
    words, before = Words(name), {}
    closing = np.array([end], "<u4").tobytes()
    for batch in batches:
        ids, starts, counts = [], [], []
        for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
            got = words.ids(text or b"") + closing
            starts.append(before.get(part, 0))
            counts.append(len(got) // 4)
            before[part] = starts[-1] + counts[-1]
            ids.append(got)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "ids"])


def pieces_of(batches, window: int, with_ids: bool):
    """doc_id, at (global offset), n, ids -> the pieces."""
    for batch in batches:
        rows = []
        for doc_id, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids"))):
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, window)
                length = min(window - offset, n - start)
                piece = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None))
                start += length
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)] + ([pa.array([r[7] for r in rows], pa.binary())] if with_ids else [])
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece; with_ids adds its ids, little-endian unsigned 32-bit."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().cast("long").alias("part"), F.col("text").cast("string").cast("binary").alias("text"))
    with small_batches(spark, 500):
        tokens = scratch.save(texts.mapInArrow(lambda it: tokenized(it, tokenizer, end), "doc_id long, part long, before long, n long, ids binary"), "tokens")
    # one row per partition of the scan
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    # few columns and one row per partition, whatever the size of the texts
    placed = tokens.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("at"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return placed.mapInArrow(lambda it: pieces_of(it, window, with_ids), schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """pack(..., with_ids=True) -> sequence_id, ids (padded to window, but for a length that is a power of two), length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda x: x["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    out = pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
    is_power = F.bit_count("length") == 1
    filling = F.unhex(F.repeat(F.lit(np.array([pad], "<u4").tobytes().hex()), (F.lit(window) - F.col("length")).cast("int")))
    return out.select("sequence_id", "length", F.when(is_power, F.col("ids")).otherwise(F.concat("ids", filling)).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
