"""Full-text search: postings with term frequencies, TF-IDF scores, and a scan without an index."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.session import checkpoint

#: Words that aren't indexed.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with", "this", "but", "they", "have",
    "had", "what", "when", "where", "who", "which", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "can", "just", "should", "now",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _, of two characters or more, without stop words."""
    return of_lower(F.lower(text))


def of_lower(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


#: Finds the first token of a lower-cased text, if it has any.
ANY_TOKEN = rf"(?U)(?<!\w)(?!(?:{'|'.join(STOP_WORDS)})(?!\w))\w{{2,}}"


def query_tokens(query: str) -> Counter:
    return Counter(w for w in re.findall(r"\w+", query.lower()) if len(w) >= 2 and w not in STOP_WORDS)


def same_as(term: str):
    return lambda w: w == term


def joined(df: DataFrame, fields: list[str]) -> Column:
    return F.concat_ws(" ", *(F.col(f).cast("string") for f in fields))


class TextIndex:
    """A full-text index over some fields.

    Without saved postings a search reads the texts once: it counts the documents, and splits only those that hold a query's
    term somewhere. ``save`` writes the postings (id, length, term, tf), by which later searches read no text.
    """

    def __init__(self, df: DataFrame, fields: list[str], id_col: str = "_id", name: str | None = None, saved: DataFrame | None = None):
        self.df, self.fields, self.id_col, self.name = df, fields, id_col, name or "fulltext_" + "_".join(fields)
        self.saved = saved

    def _found(self) -> DataFrame:
        """id, words: documents that have any."""
        return self.df.select(F.col(self.id_col).alias("id"), F.explode(F.array(tokens(joined(self.df, self.fields)))).alias("words")).where(F.size("words") > 0)

    def _words(self) -> DataFrame:
        """id, length, term: a row per word, and one with a null term for each document, so that their number needs no other table."""
        return self._found().select("id", F.size("words").cast("bigint").alias("length"), F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("term"))

    def build(self) -> DataFrame:
        """Postings: for each document a row per term, and one with a null term. All its words are in its row, so none moves."""
        rows = self._found().select("id", F.explode(F.array(F.sort_array("words"))).alias("words"))
        n = F.size("words")
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("words", i) != F.get("words", i - 1)))
        runs = rows.select("id", "words", F.explode(F.array(F.concat(F.array(F.lit(0)), ends))).alias("ends"))
        flat = runs.select("id", "words", "ends", F.posexplode("ends").alias("at", "end"))
        tf = F.when(F.col("at") == 0, 1).otherwise(F.col("end") - F.get("ends", F.col("at") - 1))
        return flat.select("id", n.cast("bigint").alias("length"), F.get("words", F.col("end") - 1).alias("term"), tf.cast("bigint").alias("tf"))

    def save(self, path: str) -> TextIndex:
        """Writes the postings, in each file those of a term together, and searches by them from now on.

        A file has the postings of the documents of one partition, so none is shuffled; a search reads a term's pages in each.
        """
        self.build().sortWithinPartitions("term").write.parquet(path)
        self.saved = self.df.sparkSession.read.parquet(path)
        return self

    def _hits(self, terms: list[str]) -> tuple[DataFrame, int, list[int]]:
        """(id, length, tfs: a count for each term), documents in all, documents that have each term."""
        seen = Observation()
        if self.saved is not None:
            wanted = self.saved.where(F.col("term").isin(*terms))
            n = self.saved.where("term is null").count()
            tfs = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"t{i}") for i, t in enumerate(terms)]
            rows = wanted.groupBy("id", "length").agg(*tfs).select("id", "length", F.array(*(f"t{i}" for i in range(len(terms)))).alias("tfs"))
        else:
            low = self.df.select(F.col(self.id_col).alias("id"), F.explode(F.array(F.lower(joined(self.df, self.fields)))).alias("low"))
            # whole words of letters, digits and _ only, so a term is found as it stands; most texts lack its letters altogether
            found = F.when(reduce(or_, [F.col("low").contains(t) for t in terms]), F.regexp_extract_all("low", F.lit(rf"(?U)(?<!\w)(?:{'|'.join(terms)})(?!\w)"), F.lit(0)))
            hits = low.select("id", "low", F.col("low").rlike(ANY_TOKEN).alias("counts"), F.explode(F.array(found)).alias("found"))
            hits, n = hits.observe(seen_all := Observation(), F.count_if("counts").alias("n")), None
            tfs = F.array(*(F.size(F.filter("found", same_as(t))).cast("bigint") for t in terms))
            rows = hits.where(F.size("found") > 0).select("id", F.size(of_lower(F.col("low"))).cast("bigint").alias("length"), tfs.alias("tfs"))
        rows = rows.where(F.exists("tfs", lambda x: x > 0)).observe(seen, *(F.count_if(F.col("tfs")[i] > 0).alias(f"d{i}") for i in range(len(terms))))
        hits = checkpoint(rows.select("id", "length", "tfs"))
        return hits, seen_all.get["n"] if n is None else n, [seen.get[f"d{i}"] for i in range(len(terms))]

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """id and score, best first; any query term may match, repeated ones count again. Runs a job while the plan is made."""
        wanted = query_tokens(query)
        if not wanted:
            return self.df.select(F.col(self.id_col).alias("id"), F.lit(0.0).alias("score")).where(F.lit(False))
        terms = sorted(wanted)
        hits, n, have = self._hits(terms)
        parts = [F.lit(float(wanted[t])) * F.col("tfs")[i] / F.col("length") * F.lit(math.log(n / (1 + have[i])) + 1 if n else 0.0) for i, t in enumerate(terms)]
        best = hits.select("id", reduce(add, parts).alias("score")).orderBy(F.col("score").desc(), "id")
        return best.limit(limit) if limit else best

    def stats(self) -> DataFrame:
        """One row, from one pass over the texts or postings: summed up by term, then over all terms."""
        by_term = (self._words() if self.saved is None else self.saved).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
        document = F.col("term").isNull()
        whole = by_term.agg(F.count_if(~document).alias("vocabulary_size"), F.coalesce(F.sum(F.when(document, F.col("n"))), F.lit(0)).alias("num_documents"), F.sum(F.when(document, F.col("length"))).alias("length"))
        return whole.select("vocabulary_size", "num_documents", F.coalesce(F.try_divide(F.col("length").cast("double"), F.col("num_documents")), F.lit(0.0)).alias("avg_doc_length"))


def scan(df: DataFrame, query: str) -> DataFrame:
    """Without an index: rows where any top-level value, as text, contains the query as it is."""
    hit = F.lit(False)
    for c in df.columns:
        if not c.startswith("__"):
            hit = hit | F.coalesce(F.col(f"`{c}`").cast("string").contains(query), F.lit(False))
    return df.where(hit)


def contains_any(df: DataFrame, query: str) -> Column:
    """$text in a filter: any top-level string holds a token of the query."""
    hit = F.lit(False)
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            hit = hit | F.coalesce(F.arrays_overlap(tokens(F.col(f"`{f.name}`")), F.array(*map(F.lit, sorted(query_tokens(query)) or [""]))), F.lit(False))
    return hit
