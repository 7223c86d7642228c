"""Rows that every corpus operator must survive."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("g", T.StringType())])

WORDS = "the shore was calm and the little boat went out over grey water before anyone in the house had woken up again".split()


def rows():
    texts = [None, "", " ", "\t\n", "a", "It's 12 o'clock  \n\n then", "é" * 40, "naïve 中文 text 🙂 \x1c\x85  x", "<|endoftext|> a <|endoftext|>", "x" * 5000, " ".join(WORDS), " ".join(WORDS), " ".join(WORDS * 40), " ".join(WORDS * 400), " " * 700 + "end", "!!! ??? 123 4567 --", "'ll 'LL don't 're'd"]
    out = [(i, t, None if i % 3 == 0 else "en", "s", len(t or ""), 7, "clash") for i, t in enumerate(texts)]
    return out + [out[10], out[10], (None, "null id", None, None, None, None, None)]


def frame(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
