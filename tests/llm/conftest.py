import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use for columns of their own.
CLASHING = ["node", "w", "ids", "text_hash", "shard", "start", "rank", "words", "value", "anchor", "curve", "score", "features", "lang_pred", "row", "t", "__text", "own_hash", "span_id", "spans", "hit_id", "other_id", "text_column"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows, clashing=False, partitions=3):
        full = [(r + ("en", "s"))[:4] for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS).repartition(partitions)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
        return df

    return make


WORDS = "the of and to in river stone bright cloud seven garden paper window silver north market winter copper signal harbour field lantern bridge ocean needle orange planet quiet rabbit saddle timber useful velvet whisper yellow zebra".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words, the same for the same seed."""
    import random

    def words(seed, n):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(WORDS) + ("" if rnd.random() < 0.6 else str(rnd.randrange(1000))) for _ in range(n))

    return words


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Null and empty texts, a null id, repeated rows, ties, a very long text."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \t\n"), (None, prose(9, 80)), (4, prose(2, 120)), (4, prose(2, 120)), (5, prose(2, 120)), (6, long), (7, "one"), (8, "one"), (9, "aé中\U0001f600 b"), (10, "\x00\x01"), (None, None)]
