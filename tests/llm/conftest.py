import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Real rows and the odd cases: nulls in any column, empty and long texts, repeated rows and ids."""
    long = "alpha beta gamma delta " * 20_000
    rows = [(None, None, None, None, None), (5001, "", "en", None, 0), (5002, None, None, "src0", None), (5003, " \n\t ", "en", "src1", 4),
            (5004, long, "en", "src2", len(long)), (5005, "one two", "en", "src2", 7), (5005, "one two", "en", "src2", 7),
            (5006, "two one", "fr", "src2", 7), (5007, "ONE Two", None, "src9", 7), (None, "a null id with its own few words here", "de", "z", 1),
            (5008, "x" * 5000, "en", "src3", 5000), (5009, "é ü 漢字 🙂 tail  double", "en", "src3", 9)]
    return docs.unionByName(spark.createDataFrame(rows, DOCS)).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with names that the operators add."""
    names = ["size", "target", "taken", "copies", "shard", "slot", "ids", "spans", "base", "mark", "kept", "_row", "rank", "digest", "score"]
    return docs.limit(40).selectExpr("*", *[f"'extra' AS `{n}`" for n in names])
