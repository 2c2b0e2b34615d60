"""Lines are read once for their chunks, and a single search needs no stored vectors."""

import os

import pytest
from pyspark.sql import functions as F

from causeway.functions import embedding as em
from causeway.functions import text as tx
from causeway.operators import chunking, vector_search
from checks import queries

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_lines_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(i):
        read.add(1)
        return f"line {i}\tof  a log"

    lines = spark.range(40).select(F.lit("d").alias("document_id"), F.col("id").alias("at"), said.asNondeterministic()("id").alias("raw"))
    assert chunking.chunk_lines(lines, "document_id", order="at", size=10, overlap=2, block=8).count() == 25
    assert read.value == 40


def test_spaced_words_are_the_tokens(spark):
    texts = ["a b", " a\t\tb ", "", " ", "a  b", "\x1ca\x85b c", "é  ü", "a b c", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    said = tx.spaced(F.col("text"))
    words = tx.tokens(F.col("text"))
    for r in rows.select("text", said.alias("said"), tx.spaced_words(said).alias("n"), words.alias("words")).collect():
        assert r.text is None and r.said is None and r.n is None or (r.said, r.n) == (" ".join(r.words), len(r.words))


@needs_tables
@pytest.mark.parametrize("name", ["evidence", "preferred_timelines", "retrieved_document_chunks"])
def test_one_search_stores_no_vectors(spark, monkeypatch, name):
    written = []
    for module in (queries, queries.ingest, vector_search):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, real=real: (written.extend(df.columns), real(df))[1])
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
    assert written and "embedding" not in written


@pytest.mark.parametrize("few", [2048, 0])
def test_chunks_without_vectors_are_found_as_with_them(spark, monkeypatch, few):
    texts = ["redis timeout", "Api failed", "", "disk full api"]
    chunks = spark.createDataFrame(
        [(f"i{n % 2}", "d", 0, n, f"c{n}", t) for n, t in enumerate(texts * 3)],
        "investigation_id string, document_id string, doc_seq bigint, chunk_index bigint, chunk_id string, text string",
    )
    questions = spark.createDataFrame([("q", "i0", "redis"), ("r", "i1", "api")], "query_id string, investigation_id string, text string")
    real = vector_search.search
    monkeypatch.setattr(vector_search, "search", lambda *a, **k: real(*a, few=few, **k))
    embedder = em.hashed_embedder(16)
    found = [
        sorted(map(tuple, vector_search.retrieve(rows, questions, embedder, 2).select("query_id", "rank", "chunk_id", "score", "text").collect()))
        for rows in (chunks, em.embed_documents(chunks, embedder))
    ]
    assert found[0] == found[1] and len(found[0]) == 4
