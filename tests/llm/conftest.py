import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]), with columns whose names clash with
    names that the operators use inside."""

    def make(rows, clash=True):
        full = [
            (r[0], r[1], *(list(r[2:]) + ["en", "a"][len(r) - 2 :]), len(r[1] or "")) for r in rows
        ]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in ("key", "row", "size", "src", "fp", "ids", "score", "bucket", "tie", "target", "unit"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    prose = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf. "
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, "   \n\t ", None, "b"),
        (4, "123 456 !!!", "en", "b"),
        (5, prose * 3, "en", "a"),
        (5, prose * 3, "en", "a"),
        (6, prose * 3, "en", "c"),
        (None, prose + "x", "en", "a"),
        (None, None, None, None),
        (7, "Der schnelle braune Fuchs springt über den faulen Hund. " * 4, "de", "c"),
        (8, "wort " * 60_000, "de", "b"),
        (9, "a" * 5000, "en", "b"),
        (10, "é漢字😀 ñandú  x", "es", "c"),
        (11, "word", "en", "a"),
    ]
    return make_docs(rows)
