import pytest


def rows_with_edges():
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
    return [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, " \n\t ", "en", "s", 3), (4, long, "en", "s", 1),
        (5, "The same words stand here twice in this text", "en", "s", 1), (6, "The same words stand here twice in this text", "en", "s", 1),
        (6, "The same words stand here twice in this text", "en", "s", 1), (7, "éè ünïcode, straße 東京 \U0001f600 l'été", "fr", None, 1),
        (None, "no id at all in this row", "en", "s", 1), (8, "1234 5678", "de", "s", 1), (9, "x" * 5000, "de", "s", 1),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows_with_edges(), "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "n", "token", "score", "spans", "ids", "bits", "component", "label", "start"):
        df = df.withColumn(name, F.lit("clash"))
    return df
