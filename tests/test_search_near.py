"""The search of many chunks scores in full only what may be among the best."""

import numpy as np
import pandas as pd
import pytest

from causeway.operators import vector_search


def _rows(n):
    return pd.DataFrame({"investigation_id": "i", "chunk_id": [f"c{x}" for x in range(n)], "doc_seq": 0, "chunk_index": range(n)})


def _all_pairs(vectors, queries, k):
    lengths = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1))
    scores = np.round(queries @ vectors.T / np.where(lengths == 0, 1e-9, lengths), vector_search.DIGITS)
    return [np.lexsort((np.arange(len(vectors)), -s))[:k].tolist() for s in scores]


def _vectors(kind, n, rnd):
    vectors = rnd.normal(size=(n, 12))
    if kind == "words":  # counts, many equal scores
        vectors = rnd.integers(0, 3, (n, 12)).astype(float)
        vectors[:, 7] = 0.0
    elif kind == "close":  # apart by less than single precision tells
        vectors = np.ones((n, 12)) + rnd.normal(size=(n, 12)) * 1e-8
    elif kind == "equal":
        vectors = np.ones((n, 12))
    elif kind == "tiny":
        vectors *= 1e-170
    return vectors


@pytest.mark.parametrize("kind", ["any", "words", "close", "equal", "tiny"])
@pytest.mark.parametrize("n", [1000, 1007])
def test_the_best_are_those_of_all_pairs(monkeypatch, kind, n):
    monkeypatch.setattr(vector_search, "_SCORES", 9000)  # some steps
    rnd = np.random.default_rng(n)
    vectors, queries = _vectors(kind, n, rnd), rnd.normal(size=(40, 12))
    vectors[n // 2], queries[3] = 0.0, 0.0
    found = vector_search._best(_rows(n), vectors, np.arange(40), queries, 3)
    assert found.groupby("query_id")["chunk_index"].apply(list).tolist() == _all_pairs(vectors, queries, 3)


def test_few_pairs_are_scored_in_full(monkeypatch):
    rnd = np.random.default_rng(5)
    vectors, queries = rnd.normal(size=(8192, 64)), rnd.normal(size=(50, 64))
    scored = []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: (scored.append(len(a)), real(how, a, b))[1])
    vector_search._best(_rows(8192), vectors, np.arange(50), queries, 8)
    assert 50 * 8 <= sum(scored) < 50 * 100
