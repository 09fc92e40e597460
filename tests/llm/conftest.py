import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) rows, with further columns of clashing names."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("clash") for c in ("n_words", "class_id", "score", "labels", "seeds", "ids", "fingerprint", "lang_pred", "grade")})
        return df

    return make


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: Nulls, empty and blank texts, signs only, ties, repeated rows, and a very long text.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "?!"), (5, "one two"), (6, "one two"), (6, "one two"), (7, LONG), (None, "one two three"), (8, " x y"), (9, "a" * 5000)]


@pytest.fixture(scope="session")
def edges(frame):
    return frame(EDGES)
