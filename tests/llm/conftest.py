import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").persist()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat and then it went home again"), (2, None), (3, ""), (None, "no id here"), (None, None),
        (4, "twice twice twice"), (4, "twice twice twice"), (5, long), (6, " \t\n "), (7, "é à ü ß 日本   x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"fp": F.lit("x"), "uid": F.lit(None).cast("string"), "score": F.lit(9), "n": F.lit(1), "shard": F.lit("q")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
