import pytest
from pyspark.sql import functions as F

WORDS = "river stone winter music garden table market signal paper lantern orchard copper harbor violet thunder meadow"


@pytest.fixture
def docs(spark):
    """Rows with nulls, empty, blank, repeated, long and odd texts, and columns whose names clash with operators' own."""
    long = " ".join(f"{WORDS} {k}" for k in range(3000))
    texts = [(1, WORDS), (2, None), (3, ""), (4, " \n\t "), (5, WORDS), (5, WORDS), (6, long), (None, "no id here"), (7, "don't STOP <|endoftext|> Straße 日本語 😀"), (8, "x" * 6000)]
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 1 else "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"score": F.lit("?"), "kept": F.lit(7), "length": F.lit("l"), "key": F.lit("k"), "n": F.lit(0), "id": F.lit("i"), "c": F.lit("c"), "rank": F.lit(None).cast("string"), "row": F.lit("r"), "m": F.lit(1), "_m": F.lit(1), "_lang": F.lit("l"), "_source": F.lit("s"), "_gone": F.lit(0), "_row": F.lit(0), "of": F.lit("o"), "stay": F.lit(0), "a.b": F.lit("dot")})


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (5, None, 1), (6, 0, 1), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture
def empty(docs):
    return docs.limit(0)
