"""Blocks of the search for many questions: how often rows are copied, and what is found."""

import numpy as np
from pyspark.sql import functions as F

from causeway.operators import vector_search


def _vectors(spark, n):
    rnd = np.random.default_rng(4)
    rows = [("i", f"c{x}", 0, x, rnd.normal(size=4).tolist()) for x in range(n)]
    return spark.createDataFrame(rows, "investigation_id string, chunk_id string, doc_seq long, chunk_index long, embedding array<double>")


def test_rows_are_copied_a_bounded_number_of_times(spark, monkeypatch):
    vectors = _vectors(spark, 600)
    questions = vectors.withColumn("query_id", F.col("chunk_id"))
    few = vector_search._layout(vectors, questions, 16, 8).first()
    assert (few.chunk_blocks, few.query_blocks) == (4, 4)
    monkeypatch.setattr(vector_search, "_BLOCK_BYTES", 60 * 32)  # 60 vectors
    full = vector_search._layout(vectors, questions, 16, 8).first()
    assert (full.chunk_blocks, full.query_blocks) == (10, 10)


def test_blocks_find_what_all_pairs_find(spark, monkeypatch):
    vectors = _vectors(spark, 300)
    questions = _vectors(spark, 300).select(F.col("chunk_id").alias("query_id"), "investigation_id", "embedding")
    m = np.array([r.embedding for r in vectors.orderBy("chunk_index").collect()])
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = {f"c{q}": [f"c{x}" for x in np.argsort(-(m[q] @ m.T), kind="stable")[:3]] for q in range(len(m))}
    monkeypatch.setattr(vector_search, "_SCORES", 1000)  # some slices of each block
    got = {}
    for r in vector_search.search(vectors, questions, 3, few=0, chunk_block=16, query_block=8).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want
