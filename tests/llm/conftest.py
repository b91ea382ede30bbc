import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, blanks, ties, repeated rows and a clashing column beside the usual ones."""
    long = " ".join(f"word{i % 700} and" for i in range(6000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.\nAgain it jumps, and again.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"),
        (5, long, "en", "a"), (6, long, "en", "b"), (7, long[:9000] + " tail", "fr", "a"), (8, "héllo wörld ßtraße ﬁn x y", "de", "a"),
        (9, "one two", None, "b"), (9, "one two", None, "b"), (None, "an orphan row", "en", "a"), (11, "一二三 \U0001F600 é", "zh", "a"), (12, "ONE two", "en", "b"), (13, "a\x1cb\x00c d", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "cast(length(text) as int) as n_chars", "'x' as key", "1 as slot")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (5, 1, 0), (6, 0, 0), (6, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
