"""Embedding, search and causal phrases work on whole batches, with the results of row by row."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from causeway import fixed_values as fv
from causeway.functions import embedding as em
from causeway.operators import extraction, vector_search


def test_a_batch_hashes_each_distinct_word_once(monkeypatch):
    asked = []
    real = hashlib.md5
    monkeypatch.setattr(em.hashlib, "md5", lambda w: (asked.append(w), real(w))[1])
    monkeypatch.setattr(em, "_CELLS", 64)  # several steps
    lists = [["redis", "api", "redis"], [], None, ["api"] * 9, ["é", "503"]] * 7
    vectors = em._hashed(pa.array(lists, pa.list_(pa.string()))[1:], 16).to_pylist()
    assert len(asked) == len(set(asked)) == 4
    for words, vector in zip(lists[1:], vectors, strict=True):
        counts = np.zeros(16)
        for w in words or []:
            counts[int(real(w.encode()).hexdigest()[:8], 16) % 16] += 1
        assert vector == (counts / (np.linalg.norm(counts) or 1.0)).tolist()


def test_embedder_takes_empty_and_missing_texts(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "-- .")], "i int, text string")
    found = em.embed_documents(rows, em.hashed_embedder(8)).collect()
    assert [r.embedding for r in found] == [[0.0] * 8] * 3


def test_a_batch_of_vectors_is_one_matrix_without_a_copy():
    vectors = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    matrix = vector_search._matrix(vectors[1:])
    assert matrix.tolist() == [[3.0, 4.0], [5.0, 6.0]]
    assert np.shares_memory(matrix, vectors.values.to_numpy())


def test_search_reads_batches_as_arrays(spark, capsys):
    rows = [("i", "c1", 0, 0, [1.0, 0.0]), ("i", "c2", 0, 1, None), ("i", "c3", 0, 2, []), ("j", "c4", 0, 3, [0.0, 1.0, 2.0])]
    vectors = spark.createDataFrame(
        rows, "investigation_id string, chunk_id string, doc_seq bigint, chunk_index bigint, embedding array<double>"
    )
    questions = spark.createDataFrame(
        [("q", "i", [1.0, 1.0]), ("r", "j", [0.0, 1.0, 2.0]), ("s", "k", [1.0])],
        "query_id string, investigation_id string, embedding array<double>",
    )
    for few in (2048, 0):
        found = vector_search.search(vectors, questions, few=few)
        found.explain()
        assert "InPandas" not in capsys.readouterr().out
        assert sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in found.collect()) == [
            ("q", "c1", 0.707107), ("r", "c4", 1.0)
        ]


def test_causal_pairs_of_runs_are_those_of_the_whole_text(spark):
    words = ["redis", "api time-out", "caused", "leads to", "led  to", ".", ":", "\n", "\x1c", "ſ", "Triggered", "é", "10", "x" * 50, ", "]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 60)) for _ in range(200)]
    texts += ["", None, "caused", " a b caused c d", "abc led to def", "abc led to de", "a_b caused c-d!e_f led to g^h caused ijk", "...abc resulted in def...ghi caused jkl mno caused pqr"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    whole = F.transform(
        F.regexp_extract_all("text", F.lit(fv.CAUSAL), F.lit(0)),
        lambda m: F.struct(
            *[extraction.tx.title_case(extraction.tx.strip(F.regexp_extract(m, fv.CAUSAL, g))).alias(n)
              for g, n in ((1, "source"), (2, "target"))]
        ),
    )
    whole = F.filter(whole, lambda p: (F.length(p["source"]) >= 3) & (F.length(p["target"]) >= 3))
    own = extraction.causal_pairs(F.col("text"), F.col("text").rlike("(?iU)" + fv.CONNECTORS))
    found = rows.select("i", whole.alias("whole"), own.alias("own")).collect()
    assert sum(len(r.own or []) for r in found) > 100
    assert [r.own or [] for r in found] == [r.whole or [] for r in found]
    assert all(re.fullmatch(r"\S(.|\s)*", p.source) for r in found for p in r.own or [])
