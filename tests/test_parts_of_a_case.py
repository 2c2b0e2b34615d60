"""Queries build only what they read, and chunks are cut in runs of windows."""

import os
import random

import pytest

from causeway.operators import centrality, chunking, extraction
from causeway.plans import ingest
from causeway.sources import incident_log as il
from checks import queries

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def _never(*args, **kwargs):
    raise AssertionError("not needed for this query")


@needs_tables
@pytest.mark.parametrize("name", ["troubled_titles", "preferred_timelines", "evidence"])
def test_hits_need_no_graph(spark, monkeypatch, name):
    monkeypatch.setattr(extraction, "extraction", _never)
    monkeypatch.setattr(centrality, "pagerank", _never)
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


@needs_tables
@pytest.mark.parametrize("name", ["question_paths", "preferred_root_causes"])
def test_a_graph_needs_no_vectors(spark, monkeypatch, name):
    monkeypatch.setattr(ingest, "embed_documents", _never)
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


@needs_tables
def test_searched_words_come_from_distinct_lines(spark, monkeypatch):
    line = il.incident_lines(spark, FOLDER).limit(1)
    copies = line.crossJoin(spark.range(50).withColumnRenamed("id", "copy")).drop("copy")
    monkeypatch.setattr(il, "incident_lines", lambda *a: copies)
    plan = queries._searches(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Generate") :]  # below the words


@pytest.mark.parametrize("run", [1, 2, 5])
@pytest.mark.parametrize("size,overlap", [(4, 1), (5, 5), (3, 9), (10, 3)])
def test_lines_longer_than_a_run_of_chunks(spark, monkeypatch, run, size, overlap):
    monkeypatch.setattr(chunking, "_RUN", run)
    rnd = random.Random(run)
    lines = [(d, i, " \t".join(f"w{rnd.randrange(99)}" for _ in range(rnd.choice([0, 1, 3, 60])))) for d in "abc" for i in range(7)]
    got = chunking.chunk_lines(
        spark.createDataFrame(lines, "document_id string, line long, raw string"),
        "document_id", order="line", size=size, overlap=overlap, block=3,
    )
    texts = [(d, " ".join(t for e, _, t in lines if e == d)) for d in "abc"]
    whole = chunking.chunk_texts(
        spark.createDataFrame(texts, "document_id string, text string"), "document_id", size=size, overlap=overlap
    )
    fields = ["document_id", "chunk_index", "word_start", "word_end", "text"]
    assert sorted(map(tuple, got.select(fields).collect())) == sorted(map(tuple, whole.select(fields).collect()))


@needs_tables
def test_questions_are_read_from_the_events_once(spark, monkeypatch):
    monkeypatch.setattr(ingest, "incident_knowledge", lambda *a, **k: None)
    plan = queries.Case(spark, FOLDER, vectors=False).questions._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
