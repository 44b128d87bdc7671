"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("size", "shard", "score", "spans", "fingerprint", "taken", "start", "kept", "law", "target", "offset")]
)
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank"), (2, "the quick brown fox jumps over the lazy dog near the river bank"),
    (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "one two"), (8, LONG), (9, LONG + " tail"),
    (None, "no id here at all, mail a.b@c.org or 10.0.0.1"), (None, None),
    (10, "call +44 (0)20 7946 0958 or pay 4111 1111 1111 1111 to x@y.co; 300.1.1.1 is none, 1.2.3.4.5 has one"), (11, "dup row"), (11, "dup row"), (11, "dup row"),
    (12, "Ünïcödé 日本語 🙂 text  with   runs \n of spaces \n\n"), (13, "<|endoftext|> is a word here"), (14, "A@@b.c a@b a@b.c@d.e.f"), (15, "IBAN GB82 WEST 1234 5698 7654 32 account"),
]
SOURCES = ["a", "b", None, "Z", "é"]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en", SOURCES[k % 5], len(t) if t is not None else None, *["x"] * 11) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
