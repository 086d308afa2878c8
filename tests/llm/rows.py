"""Fixtures shared by the tests of the training-data operators."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Extra columns whose names operators like to use.
        *(
            T.StructField(name, T.StringType())
            for name in ("kept", "node", "epoch", "bucket", "n_tokens", "text_verdict", "line_counts", "hash_of_text", "domain")
        ),
    ]
)


def words(n, stem="word", begin=0):
    return " ".join(f"{stem}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(begin, begin + n))


LONG = " ".join(f"long{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}" for k in range(30_000))

#: (doc_id, text): nulls, empty and blank texts, one word, a long text, copies, near copies, repeated rows.
ODD = [
    (1, words(120)),
    (2, words(120)),
    (3, words(118) + " changed here"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "Hello"),
    (8, LONG),
    (9, "alpha beta gamma"),
    (9, "alpha beta gamma"),
    (None, "a text without an id that has some more words in it"),
    (None, None),
    (10, "alpha\x0bBETA gamma"),
    (11, "x" * 5000),
    (12, "word " * 200),
    (13, "12 34 !! ?? --"),
]


def docs(spark, rows, lang="en", source="src1"):
    full = [(i, t, lang, source, None if t is None else len(t), *(["x"] * 9)) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
