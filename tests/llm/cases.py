"""Small inputs with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("fp", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("u", T.IntegerType()),
])


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def texts(seed=0):
    """(doc_id, text): random texts, exact and near copies, shared passages and lines, and the odd cases."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(30, 200)) for _ in range(25)]
    passage = words(rng, 30)
    lines = "\n".join(words(rng, 8) for _ in range(5))
    out = list(base)
    out += [base[0], base[0], base[0] + " more", base[1].replace("w1", "W1"), base[2].upper()]
    out += [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(6)]
    out += [f"{words(rng, 9)}\n{lines}\n{words(rng, 9)}" for _ in range(5)]
    out += [None, "", "   \n\t ", "one", "one two three", "a b c d", "é漢字 ﬀ x #$% <p>", "same same same same same same same same same same same same same same same"]
    out += ["\n\n\n\n", "x\n" * 40, words(rng, 6000), "y" * 50_000]
    return list(enumerate(out))


def rows(seed=0):
    found = [(i, t, None if i % 7 == 0 else ("en" if i % 2 else "fr"), "clash", "clash", 1) for i, t in texts(seed)]
    return found + [found[3], found[3]]


def frame(spark, seed=0, null_id=True):
    data = rows(seed)
    if null_id:
        data = data + [(None, data[5][1], None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
