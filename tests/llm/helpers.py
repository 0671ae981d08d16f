"""Small inputs that hold the awkward cases, for all tests of this folder."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("row", T.StringType()), T.StructField("content", T.IntegerType()), T.StructField("n_words", T.StringType())])


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def awkward_texts(seed=5):
    """(doc_id, text) with nulls, empties, blanks, copies, near copies, shared passages, runs and a long text."""
    rng = random.Random(seed)
    shared, base = words(rng, 60), words(rng, 200)
    near = base.split()
    near[100] = "changed"
    texts = [None, "", "  \n\t ", "one", "a b c d", base, base, " ".join(near), base.upper(), words(rng, 50) + " " + shared,
             shared + "\n" + words(rng, 40), words(rng, 30) + " " + shared + " " + words(rng, 30), "run " * 120, "run " * 60 + words(rng, 10),
             "run " * 37, "ab ab ab cd " * 40, words(rng, 6000), "é ü <|im_end|> " + words(rng, 40) + "\x0bx\x1cy"]
    texts += [words(rng, rng.randrange(1, 120), 60) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, (None, base), (5, base), (7, None)]


def frame(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "r", 1, "n") for i, t in rows], DOCS)
