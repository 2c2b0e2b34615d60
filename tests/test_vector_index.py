"""The index of vectors: recall, scope, additions, and what is read."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import vector_index, vector_search

FORM = "investigation_id string, chunk_id string, doc_seq bigint, chunk_index bigint, embedding array<double>"


def _vectors(spark, folder="/root/testdata/sf0.1", scopes=1):
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.concat(F.lit("i"), (F.col("vec_id") % scopes).cast("string")).alias("investigation_id"),
        F.floor(F.col("vec_id") / scopes).cast("string").alias("chunk_id"),  # ids repeat over investigations
        F.lit(0).cast("bigint").alias("doc_seq"),
        F.col("vec_id").alias("chunk_index"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _questions(vectors, every=10):
    asked = vectors.filter(F.col("chunk_index") % every == 0)
    return asked.select(F.col("chunk_index").cast("string").alias("query_id"), "investigation_id", "embedding")


def _hits(found):
    return {(r.query_id, r.investigation_id, r.chunk_id, r.rank, round(r.score, 9)) for r in found.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "all")
    vector_index.write_index(_vectors(spark), path)
    return path


def test_recall_is_nine_tenths(spark, index):
    vectors = _vectors(spark)
    questions = _questions(vectors)
    exact = {h[:3] for h in _hits(vector_search.search(vectors, questions))}
    got = _hits(vector_index.search_index(spark, index, questions))
    assert len(got) == len(exact)
    assert len({h[:3] for h in got} & exact) >= 0.9 * len(exact)
    quantiser = vector_index.read_quantiser(spark, index)
    assert 1 <= quantiser.probes < len(quantiser.centroids) and len(quantiser.books) == 16


@pytest.mark.parametrize("sizes", [{}, {"question_block": 7, "list_block": 11}])
def test_exact_search_equals_the_plain_one(spark, index, sizes):
    vectors = _vectors(spark)
    questions = _questions(vectors, 50)
    expected = _hits(vector_search.search(vectors, questions, k=5))
    assert _hits(vector_index.search_index(spark, index, questions, k=5, probes=1, exact=True, **sizes)) == expected
    every = vector_index.search_index(spark, index, questions, k=5, probes=10**6, shortlist=10**6, **sizes)
    assert _hits(every) == expected


def test_only_the_probed_lists_are_read(spark, index, tmp_path):
    copy = shutil.copytree(index, tmp_path / "copy")
    questions = _questions(_vectors(spark)).limit(2)
    expected = _hits(vector_index.search_index(spark, index, questions, probes=3))
    quantiser = vector_index.read_quantiser(spark, index)
    unit = vector_index._unit([r.embedding for r in questions.collect()])
    probed = set(np.argsort(-(unit @ quantiser.centroids.T), axis=1, kind="stable")[:, :3].ravel().tolist())
    for number in range(len(quantiser.centroids)):
        if number not in probed:
            for file in (copy / "codes" / f"list={number}").glob("*.parquet"):
                file.write_bytes(b"not to be read")
    got = vector_index.search_index(spark, str(copy), questions, probes=3)
    assert _hits(got) == expected and len(expected) == 16


def test_scopes_additions_and_odd_rows(spark, tmp_path):
    path = str(tmp_path / "scoped")
    vectors = _vectors(spark, "/root/testdata/sf0.01", scopes=3)
    odd = spark.createDataFrame(
        [
            ("i0", "null", 0, 10_000, None), ("i0", "empty", 0, 10_001, []), ("i1", "part", 0, 10_002, [1.0] * 63 + [None]),
            ("i1", "zero", 0, 10_003, [0.0] * 64), ("i2", "twin", 0, 10_004, [0.5] * 64), ("i2", "twin2", 0, 10_005, [0.5] * 64),
        ],
        FORM,
    )
    vectors = vectors.unionByName(odd)
    vector_index.write_index(vectors.filter("chunk_index % 2 = 0"), path, lists=6, groups=5)
    vector_index.write_index(vectors, path)
    vector_index.write_index(vectors, path)
    stored = spark.read.parquet(f"{path}/codes")
    sound = vectors.filter("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    assert stored.count() == sound.count() == stored.select("investigation_id", "chunk_id").distinct().count()
    questions = _questions(vectors, 4).filter("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    expected = _hits(vector_search.search(sound, questions, k=4))
    assert _hits(vector_index.search_index(spark, path, questions, k=4, probes=2, exact=True)) == expected
    assert {h[1] for h in expected} == {"i0", "i1", "i2"}
    unknown = questions.withColumn("investigation_id", F.lit("nobody"))
    assert vector_index.search_index(spark, path, unknown, exact=True).count() == 0
    assert vector_index.search_index(spark, path, questions.limit(0)).count() == 0


def test_no_vectors_to_fit(spark, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.write_index(spark.createDataFrame([], FORM), str(tmp_path / "none"))
