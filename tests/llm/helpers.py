"""Small awkward tables: nulls in every column, empty and long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30000))
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "One two three four five six.", "en", "b", 27),
    (4, "One two three four five six.", "en", "b", 27), (5, "one Two three four five six.", "en", None, 27),
    (6, LONG, "en", "a", len(LONG)), (7, "é ü ñ 漢字 🙂 password", None, "b", None), (None, "text of a row without id", "en", "c", 24),
    (8, "12345 !!! ???", "en", "c", 13),
]


def odd(spark):
    """The awkward rows, with extra columns whose names the operators also use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("size", "shard", "h", "target", "_source", "n", "score", "words")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
