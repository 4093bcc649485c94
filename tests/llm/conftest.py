import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])
#: Columns whose names the operators use themselves.
CLASHING = ("n", "p", "fp", "score", "row", "rate", "copies", "kept", "n_words", "h", "pos", "row_k1x", "held_out", "row_k1", "Row_K2", "item_words")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=False):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit(7).alias(c) for c in CLASHING])
        return df
    return make


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty, blank, very long, repeated rows, ties."""
    long = " ".join(f"word{i % 977} of the text" for i in range(40_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "The same words of this text stand here twice."),
            (5, "The same words of this text stand here twice."), (6, "The same words of this text stand here twice."),
            (None, "A row without a number has this text."), (7, "| # * % & <>"), (8, "ünïcödé 漢字 😀 text")]
