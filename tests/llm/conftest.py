import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (numbered from 0) or (doc_id, text) pairs, in a few partitions."""
    def make(rows, **extra):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 3}", None if t is None else len(t)) for d, t in rows], DOCS)
        return df.repartition(3) if rows else df
    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic sentences of invented words."""
    import random

    def make(seed, words=80, vocabulary=400):
        rng = random.Random(seed)
        names = ["".join(rng2.choice("aeioulnrstm") for _ in range(rng2.randint(2, 8))) for rng2 in [random.Random(99)] for _ in range(vocabulary)]
        out = [rng.choice(names) for _ in range(words)]
        return "\n".join(" ".join(out[i:i + 12]) for i in range(0, words, 12))
    return make


#: Cases every operator must take: null, empty, blank, ties, a repeated row, odd characters, one very long text.
AWKWARD = [(1, None), (2, ""), (3, " \n\t \n"), (4, "one"), (5, "one two"), (5, "one two"), (6, "a\nb\nc\na\nb\nc"), (None, "no id here\nx\ny\nz"),
           (7, "日本語 ÉÀ 𝄞\r\n\x00 tab\there"), (8, "word " * 40_000), (9, "x" * 50_000), (10, "1234 " * 3_000 + "+" * 500), (10, "same id, other text")]


@pytest.fixture(scope="session")
def awkward(docs_of):
    return docs_of(AWKWARD)


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make
