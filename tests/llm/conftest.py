import pytest
from pyspark.sql import functions as F

from causeway.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    yield local_session(8, "tests", spark__sql__shuffle__partitions="4")


def documents(spark, rows):
    """A table of documents with columns whose names the operators use inside."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("bucket", "fp", "n", "group", "size", "head", "shard", "text_sha256", "x", "words", "hits", "n_chars", "__row", "row_file", "file", "at"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


LONG = "".join(chr(97 + (i * i * 7 + i // 11) % 26) for i in range(40_000))

ODD = [
    (None, "a document without an id"),
    (7, None),
    (3, ""),
    (4, " \t\n "),
    (5, "The Apache License applies. The MIT license too.\nThe Apache License applies."),
    (6, "The  Apache License\tapplies. The MIT license too.\nThe Apache License applies."),
    (11, "the same text"),
    (11, "the same text"),
    (12, "the same text"),
    (12, "another text under the same id"),
    (20, LONG),
    (21, "Line one.\n" * 3000 + "é ñ <|endoftext|> tail"),
    (22, "a  b   c \n\n d   e ​ f 　"),
    (23, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
