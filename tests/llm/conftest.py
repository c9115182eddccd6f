import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside, in other letter case too.
        T.StructField("uid", T.StringType()),
        T.StructField("NAME", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("word.count", T.StringType()),
    ]
)

LONG = " ".join(f"word{i % 977} Äpfel{i % 31}" for i in range(6000))

EDGE_TEXTS = [
    None, "", " \n\t ", "a", "A  a\n", "one two", "One two three four five six seven eight nine ten",
    "one\ttwo three\x0bfour five six  seven eight nine ten", LONG, LONG, LONG + " end", "x" * 9000, "x" * 9001,
    "same line here\nsame line here\nsame line here", "naïve café — 你好 世界 🙂🙂  thin", "\x1c\x1d\x1e \x85", "#### $$$ %%%",
]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents table of (doc_id, text) pairs, with extra columns that are null or clash."""

    def make(pairs, parts=3):
        rows = [(i, t, None, "s" if k % 2 else None, None, "u", None, "no", "w") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def edge_pairs():
    """Edge texts with ids, a null id, and rows that come twice."""
    pairs = list(enumerate(EDGE_TEXTS, 10))
    return [*pairs, (None, "one two"), (None, None), (13, "a"), (3, "other text with the id of no one"), *pairs[4:8]]
