"""The corpus pipeline against its stages written out."""

from collections import Counter

import corpus_pipeline
from causeway.llm import quality, simhash
from causeway.llm.queries import ORACLES, QUERIES

from .conftest import documents
from .test_documents import _exact, _near
from .test_resemblance import _first_ids

FOLDER = "/root/testdata/sf0.01"


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    first = {r[0] for r in _exact(rows) if r[3]}
    rows = [(d, t) for d, t in rows if d in first]
    stay = set(_first_ids(rows))
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in pieces} == stay and 0 < len(stay) < len(first) < len(good) < docs.count()
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in pieces)


def test_near_groups_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == Counter(_near([tuple(r) for r in docs.collect()]))


def test_stages_take_and_return_documents(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(None, None), (1, ""), (1, ""), (2, "word " * 50000), (None, "x")]):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == documents(spark, []).columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= (1 if rows else 0)


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] and set(ORACLES) <= set(QUERIES)
