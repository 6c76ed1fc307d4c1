import os
import tempfile

import pytest
from corpus_cases import CLASHES, DOC, SF, doc
from pyspark.sql import functions as F

@pytest.fixture(scope="session", autouse=True)
def workers_import(spark):
    from kpiframe.llm.common import prepare

    prepare(spark)


@pytest.fixture
def table(spark):
    """Write rows as a Parquet table with columns of clashing names, and read it."""

    def make(rows, schema, clash=True):
        df = spark.createDataFrame(rows, schema)
        if clash:
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])
        path = tempfile.mkdtemp(prefix="kpiframe-llm-") + "/t.parquet"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd_documents(table):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, ties."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        doc(1, "The cat sat on the mat and looked at me."), doc(1, "The cat sat on the mat and looked at me."),
        doc(2, None), doc(3, ""), doc(4, " \t\n"), doc(None, "null id, plain text here"), doc(5, long, "fr", "t"),
        doc(6, "Der Hund und die Katze", "de", None), doc(7, "1234 5678 !!", None, None), doc(8, "a", None, "t"),
        doc(9, "thecatsatonthematandlookedatme."), (10, None, None, None, None),
    ]
    return table(rows, DOC)
