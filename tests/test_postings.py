"""Saved postings: what they hold, and that none moves to be saved."""

import random
from collections import Counter

from docloom.functions.text import TextIndex, query_tokens
from pyspark.sql import functions as F

from .test_graph import moved


def test_postings_move_nowhere(spark, tmp_path):
    rng = random.Random(9)
    words = ["ash", "elm", "oak", "Yew", "don't", "été", "the", "x", "oak_tree"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)] + [(300, None), (301, "the of"), (302, "oak " * 5000), (5, "elm elm")]
    docs = spark.createDataFrame(texts, "_id int, body string").repartition(3).checkpoint()
    before = moved(spark)
    index = TextIndex(docs, ["body"]).save(str(tmp_path / "p"))
    assert moved(spark) == before
    want = Counter()
    for i, t in texts:
        found = query_tokens(t or "")
        n = sum(found.values())
        want.update([(i, n, None, 1)] * bool(n) + [(i, n, term, tf) for term, tf in found.items()])
    assert Counter(map(tuple, index.saved.select("id", "length", "term", "tf").collect())) == want
    # in each file, a term's postings lie together
    lying = index.saved.select(F.input_file_name().alias("file"), F.coalesce("term", F.lit("")).alias("term")).collect()
    files = {r.file for r in lying}
    assert 1 < len(files) <= 3 and all((terms := [r.term for r in lying if r.file == f]) == sorted(terms, key=str.encode) for f in files)
    assert index.stats().first().num_documents == sum(1 for k in want.elements() if k[2] is None)
