"""Investigations and chats read the folders of what they are asked about, and no others."""

from pathlib import Path

from pyspark.sql import functions as F

from causeway.functions.embedding import hashed_embedder
from causeway.operators import chunking
from causeway.plans import ingest, investigate

QUESTIONS = "query_id string, investigation_id string, text string"


def test_other_investigations_are_not_read(spark, tmp_path):
    texts = [
        ("a", "d1", 0, "2024-01-01 10:00:00 redis timeout caused checkout failure."),
        ("a", "d2", 1, "10:05:00 payment error after the redis outage"),
        ("b", "d1", 0, "kafka crash led to auth failure."),
        ("c", "d1", 0, "nginx timeout triggered gateway outage."),
    ]
    documents = spark.createDataFrame(texts, "investigation_id string, document_id string, doc_seq long, text string")
    chunks = chunking.with_chunk_id(chunking.chunk_texts(documents, "investigation_id", "document_id", "doc_seq"))
    embedder, store = hashed_embedder(32), tmp_path / "store"
    ingest.write_knowledge(ingest.build_knowledge(chunks, embedder=embedder), str(store))
    questions = spark.createDataFrame(
        [("q1", "a", "Why did the checkout fail?"), ("q2", "a", "unknown things"), ("q3", "b", None), ("q4", "nobody", "why")], QUESTIONS
    )
    messages = questions.filter("query_id = 'q1'")

    def results():
        knowledge = ingest.read_knowledge(spark, str(store))
        done = investigate.investigate(knowledge, questions, embedder)
        about = questions.select("query_id", F.col("investigation_id").alias("about"))
        causes = done.root_causes.join(about, "query_id").filter("query_id = 'q1'")
        own = causes.select(F.col("about").alias("investigation_id"), "root_cause", "cause_chain", F.col("confidence_score").alias("confidence"))
        answers = investigate.chat(knowledge, messages, embedder, own)
        tables = (done.hits, done.root_causes, done.timelines, done.refused, answers)
        return [sorted(map(repr, t.drop("generated_at").collect())) for t in tables]

    expected = results()
    assert all(expected) and "nobody" in repr(expected[3])
    spoiled = list(Path(store).glob("*/investigation_id=c/*.parquet"))
    assert {f.parent.parent.name for f in spoiled} >= {"chunks", "nodes", "edges", "ranks"}
    for file in spoiled:
        file.write_bytes(b"not to be read")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert results() == expected
