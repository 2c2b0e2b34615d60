"""Root causes, timelines, reports, answers, prompts, registry and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from causeway import schemas
from causeway.functions import embedding as em
from causeway.operators import extraction, graph, prompts, reasoning, registry
from causeway.operators.retrieval import GraphContext
from causeway.plans import ingest, investigate
from causeway.session import materialize
from causeway.streaming import ingest as streaming

ENTITIES = "query_id string, investigation_id string, name string, type string, node_seq long"
FOUND = "investigation_id string, start string, node string, hop int, reach array<long>"
RANKED = "investigation_id string, rank int, name string, score double"


def _causes(spark, entities, found, ranked):
    questions = spark.createDataFrame([("q", "i")], "query_id string, investigation_id string")
    context = GraphContext(
        spark.createDataFrame(entities, ENTITIES), None, spark.createDataFrame(found, FOUND)
    )
    return reasoning.root_causes(questions, context, spark.createDataFrame(ranked, RANKED)).first()


def test_longest_path_is_the_root_cause(spark):
    row = _causes(
        spark,
        [("q", "i", "Slow Writes", "SERVICE", 3), ("q", "i", "Api", "API", 1)],
        [
            ("i", "Slow Writes", "Busy Queue", 1, [2]),
            ("i", "Slow Writes", "Full Disk", 2, [2, 1]),
            ("i", "Api", "Gateway", 1, [9]),
        ],
        [("i", 1, "Other", 0.5)],
    )
    assert row["root_cause"] == "Full Disk"
    assert row["cause_chain"] == ["Full Disk", "Busy Queue", "Slow Writes"]
    assert row["confidence_score"] == 0.65
    assert row["affected_systems"] == ["Slow Writes"]


def test_first_entity_wins_among_equal_paths(spark):
    row = _causes(
        spark,
        [("q", "i", "A", "API", 5), ("q", "i", "B", "API", 2)],
        [("i", "A", "x", 1, [0]), ("i", "B", "y", 1, [1])],
        [("i", 1, "Other", 0.5)],
    )
    assert row["cause_chain"] == ["y", "B"]


def test_central_node_without_a_path(spark):
    row = _causes(spark, [], [], [("i", 1, "Redis", 0.5), ("i", 2, "Storage", 0.3)])
    assert (row["root_cause"], row["confidence_score"]) == ("Redis", 0.35)
    assert row["cause_chain"] == ["Redis", "Storage"]


def test_unknown_without_a_graph(spark):
    row = _causes(spark, [], [], [])
    assert (row["root_cause"], row["confidence_score"]) == (reasoning.UNKNOWN, 0.1)
    assert row["cause_chain"] == []


def test_root_cause_from_response(spark):
    good = {"root_cause": "Full disk", "cause_chain": ["Full disk", "Slow writes"],
            "confidence_score": 0.77, "affected_systems": ["Storage"]}
    responses = spark.createDataFrame(
        [("a", json.dumps(good)), ("b", '{"root_cause": ""}'), ("c", '{"root_cause": "X", "confidence_score": "high"}'),
         ("d", "[1]"), ("e", None), ("f", '{"root_cause": null}')],
        schemas.RESPONSES,
    )
    rows = {r["query_id"]: r for r in reasoning.root_causes_from_responses(responses).collect()}
    assert set(rows) == {"a", "c"}
    assert rows["a"]["root_cause"] == "Full disk" and rows["a"]["confidence_score"] == 0.77
    assert rows["a"]["affected_systems"] == ["Storage"]
    assert rows["c"]["confidence_score"] == 0.6 and rows["c"]["cause_chain"] == []


def _hits(spark, texts):
    rows = [("q", "i", "d", f"c{n}", t, 1.0 - n / 100, n + 1) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.HITS)


def test_timeline_order(spark):
    texts = ["2024-05-01 10:00:00 b", "untimed one", "12:03:11 clock", "2024-05-01 10:00:00 a",
             "23:00:00 late", "x" * 141 + " error", "2023-01-01T00:00:00 Timeout"] + ["more"] * 8
    rows = reasoning.timelines(_hits(spark, texts)).orderBy("order").collect()
    assert [r["order"] for r in rows] == list(range(12))
    assert [r["source_chunk_ids"][0] for r in rows][:7] == ["c2", "c6", "c0", "c3", "c4", "c1", "c5"]
    assert [r["severity"] for r in rows][:2] == ["info", "warning"]
    assert rows[6]["title"] == "x" * 60 + "..." and rows[6]["severity"] == "info"


def test_timeline_from_response(spark):
    responses = spark.createDataFrame(
        [("q", '{"events": [{"title": "A"}, {"timestamp": "1", "severity": "critical"}]}'), ("r", '{"events": []}')],
        schemas.RESPONSES,
    )
    given = reasoning.timelines_from_responses(responses)
    own = reasoning.timelines(_hits(spark, ["a"]).withColumn("query_id", F.lit("r")))
    rows = reasoning.prefer_timelines(given, own).orderBy("query_id", "order").collect()
    assert [(r["query_id"], r["order"], r["title"], r["severity"]) for r in rows] == [
        ("q", 0, "A", "info"), ("q", 1, "Event", "critical"), ("r", 0, "a", "info"),
    ]


CAUSES = "query_id string, investigation_id string, root_cause string, cause_chain array<string>, confidence_score double, affected_systems array<string>"


def test_report(spark):
    causes = spark.createDataFrame(
        [("q", "i", "Redis", ["Redis", "Api"], 0.29, []), ("r", "i", "X", [], 0.6, ["Payment"])], CAUSES
    )
    timeline = reasoning.timelines(_hits(spark, ["error one", "ok", "error one", "timeout two"]))
    rows = {r["query_id"]: r for r in reasoning.reports(causes, timeline).collect()}
    assert rows["q"]["executive_summary"] == (
        "4 events placed in time point to Redis, 28% sure. It touched no system by name and spread as Redis → Api"
    )
    assert rows["q"]["affected_systems"] == ["error one", "timeout two"]
    assert len(rows["q"]["recommendations"]) == 3 and len(rows["r"]["recommendations"]) == 2
    assert rows["r"]["affected_systems"] == ["Payment"] and rows["r"]["executive_summary"].startswith("0 events ")

    given = reasoning.narratives_from_responses(
        spark.createDataFrame(
            [("q", '{"executive_summary": "S", "recommendations": []}'), ("r", '{"recommendations": ["R"]}')],
            schemas.RESPONSES,
        )
    )
    rows = {r["query_id"]: r for r in reasoning.reports(causes, timeline, given).collect()}
    assert rows["q"]["executive_summary"] == "S" and len(rows["q"]["recommendations"]) == 3
    assert rows["r"]["executive_summary"].startswith("0 events ") and len(rows["r"]["recommendations"]) == 2


def test_answers(spark):
    questions = spark.createDataFrame(
        [("a", "i", "Why?"), ("b", "i", "what happened on failover"), ("c", "i", "tell me"), ("q", "i", "tell me more")],
        schemas.QUESTIONS,
    )
    entities = spark.createDataFrame([("q", "i", f"n{7 - n}", "API", n) for n in range(7)], ENTITIES)
    known = spark.createDataFrame(
        [("a", "Redis", ["Redis", "Api"], 0.65)],
        "query_id string, root_cause string, cause_chain array<string>, confidence double",
    )
    found = reasoning.evidence(_hits(spark, ["x" * 300] + ["y"] * 7))
    rows = {r["query_id"]: r for r in reasoning.answers(questions, found, entities, known).collect()}
    assert "'Redis'" in rows["a"]["answer"] and "65%" in rows["a"]["answer"]
    assert rows["b"]["answer"] == rows["c"]["answer"]  # no report, no evidence
    assert rows["q"]["answer"].endswith(": " + "x" * 200)
    assert len(rows["q"]["supporting_evidence"]) == 5
    assert rows["q"]["referenced_entities"] == ["n7", "n6", "n5", "n4", "n3"]

    given = reasoning.answers_from_responses(
        spark.createDataFrame([("a", '{"answer": "A"}'), ("c", '{"answer": ""}')], schemas.RESPONSES)
    )
    own = reasoning.answers(questions, found, entities, known)
    mixed = {r["query_id"]: r for r in reasoning.prefer(given, own).collect()}
    assert mixed["a"]["answer"] == "A" and mixed["a"]["referenced_entities"] == []
    assert mixed["c"]["answer"] == rows["c"]["answer"]


def test_evidence_source_falls_back_to_the_document_id(spark):
    rows = [("i", "other", "x.log"), ("j", "d", "another investigation's.log")]
    documents = spark.createDataFrame(rows, "investigation_id string, document_id string, filename string")
    (row,) = reasoning.evidence(_hits(spark, ["z" * 500]), documents).collect()
    assert row["source_document"] == "d" and len(row["text"]) == 400


def test_recent_history(spark):
    rows = [("a", n, "user", f"m{n}") for n in range(9)] + [("b", 0, "user", "only")]
    got = prompts.recent_history(spark.createDataFrame(rows, schemas.CHAT_HISTORY)).orderBy("conv_id", "turn").collect()
    assert [r["content"] for r in got] == ["m3", "m4", "m5", "m6", "m7", "m8", "only"]


def test_inference_retries_and_isolates_failures(spark):
    def load():
        tried = {}

        def call(prompt, system):
            tried[prompt] = tried.get(prompt, 0) + 1
            if prompt == "bad" or (prompt == "flaky" and tried[prompt] < 3):
                raise OSError("busy")
            return f"{prompt}:{tried[prompt]}"

        return call

    asked = spark.createDataFrame([("1", "good"), ("2", "flaky"), ("3", "bad")], "key string, prompt string").coalesce(1)
    rows = {r["prompt"]: (r["response"], r["error"]) for r in prompts.infer(asked, load, wait=lambda s: None).collect()}
    assert rows == {"good": ("good:1", None), "flaky": ("flaky:3", None), "bad": (None, "OSError: busy")}
    assert {r["response"] for r in prompts.infer(asked, None).collect()} == {""}


def test_embedders(spark):
    df = spark.createDataFrame([("Redis redis, timeout",), ("",), (None,)], "text string")
    vectors = [r[0] for r in em.embed_documents(df, em.hashed_embedder(32)).select("embedding").collect()]
    assert [round(sum(v * v for v in vec), 9) for vec in vectors] == [1.0, 0.0, 0.0]
    assert sorted(round(v * v, 6) for v in vectors[0] if v) == [0.2, 0.8]

    def load():
        import numpy as np

        return lambda texts: np.array([[3.0 * len(t), 4.0 * len(t)] for t in texts])

    rows = em.embed_documents(df.limit(1), em.model_embedder(load)).first()
    assert list(rows["embedding"]) == pytest.approx([0.6, 0.8])


def test_registry(spark):
    investigations = spark.createDataFrame([("a", "T"), ("b", None)], "investigation_id string, title string")
    chunks = spark.createDataFrame([("a", "d1"), ("a", "d1"), ("a", "d2")], "investigation_id string, document_id string")
    requests = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "zzz")], "query_id string, investigation_id string")
    states = {r["query_id"]: r["readiness"] for r in registry.readiness(requests, investigations, chunks).collect()}
    assert states == {"1": "ready", "2": "no documents ingested", "3": "unknown investigation"}
    assert tuple(registry.upload_counts(chunks).first()) == ("a", 2, 3)
    created = registry.create_investigations(investigations)
    listed = registry.investigation_list(created, chunks.distinct())
    assert {r["investigation_id"]: r["document_count"] for r in listed.collect()} == {"a": 2, "b": 0}
    assert tuple(registry.overview(listed).first()) == (2, 0, 2)
    events = registry.status_events((investigations, "PROCESSING", 1), (investigations.limit(1), "COMPLETED", 2))
    assert {r["status"] for r in registry.current_status(events).collect()} == {"PROCESSING", "COMPLETED"}
    reports = spark.createDataFrame([("a", "S")], "investigation_id string, summary string")
    found = {r["query_id"]: r["lookup"] for r in registry.report_lookup(requests, investigations, reports).collect()}
    assert found == {"1": "found", "2": "no report yet", "3": "unknown investigation"}


def _arriving(spark):
    texts = [
        ("i", "d0", 0, "redis timeout caused payment failure. nginx ok."),
        ("i", "d1", 1, "kafka queue leak. payment failure triggered checkout outage."),
        ("j", "d2", 0, "redis cache"),
        ("i", "d3", 2, "postgres deadlock led to api timeout."),
    ]
    return spark.createDataFrame(texts, streaming.ARRIVING)


def _graph_rows(extracted):
    nodes, edges = graph.merge(
        extraction.entity_mentions(extracted), extraction.relation_mentions(extracted)
    )
    return sorted(map(str, nodes.collect())), sorted(map(str, edges.collect()))


def test_stream_equals_batch_in_any_order_and_on_replay(spark, tmp_path):
    documents = _arriving(spark)
    batch = _graph_rows(materialize(streaming.extracted(documents, 6, 2)))
    landing, sink, checkpoint = (str(tmp_path / n) for n in ("landing", "sink", "checkpoint"))
    for name in ("d3", "d1", "d0", "d2", "d1"):  # late and repeated
        documents.filter(F.col("document_id") == name).coalesce(1).write.mode("append").parquet(landing)
        source = streaming.read_documents(spark, landing, files_per_trigger=1)
        streaming.start_ingest(source, sink, checkpoint, 6, 2, once=True).awaitTermination()
    assert _graph_rows(materialize(streaming.read_extracted(spark, sink))) == batch


def test_running_counts(spark, tmp_path):
    landing = str(tmp_path / "landing")
    _arriving(spark).write.parquet(landing)
    counts = streaming.running_graph_counts(streaming.read_documents(spark, landing))
    stream = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    rows = {(r["investigation_id"], r["name"]): r["mentions"] for r in spark.table("counts").collect()}
    assert rows["i", "Payment"] == 2 and rows["j", "Redis"] == 1


def test_investigation_from_documents_to_answer(spark):
    chunks = ingest.chunking.with_chunk_id(
        ingest.chunking.chunk_texts(_arriving(spark), "investigation_id", "document_id", "doc_seq", size=6, overlap=2)
    )
    embedder = em.hashed_embedder(64)
    knowledge = ingest.build_knowledge(chunks, embedder=embedder)
    questions = spark.createDataFrame(
        [("q1", "i", "Why did checkout fail?"), ("q2", "j", None), ("q3", "k", "anything")], schemas.QUESTIONS
    )
    outcome = investigate.investigate(knowledge, questions, embedder)
    causes = {r["query_id"]: r for r in outcome.root_causes.collect()}
    assert "Checkout" in causes["q1"]["affected_systems"]
    assert causes["q2"]["root_cause"] in ("Redis", "Cache")
    assert [tuple(r) for r in outcome.refused.collect()] == [("q3", "k", "unknown investigation")]
    assert set(causes) == {"q1", "q2"} and outcome.hits.filter("query_id = 'q3'").count() == 0
    status = {r["investigation_id"]: r["status"] for r in registry.current_status(outcome.status).collect()}
    assert status == {"i": "COMPLETED", "j": "COMPLETED"}
    reports = outcome.reports.drop("query_id")
    answers = investigate.chat(knowledge, questions.filter("text is not null"), embedder, reports)
    rows = {r["query_id"]: r["answer"] for r in answers.collect()}
    assert rows["q1"].startswith("The report names") and rows["q3"].startswith("The documents hold no evidence")


def test_model_runs_stage_by_stage(spark):
    """A stand-in model answers some stages, garbles one and fails for one question."""
    chunks = ingest.chunking.with_chunk_id(
        ingest.chunking.chunk_texts(_arriving(spark), "investigation_id", "document_id", "doc_seq", size=6, overlap=2)
    )
    embedder = em.hashed_embedder(64)
    knowledge = ingest.build_knowledge(chunks, embedder=embedder, rounds=5)

    def load():
        def call(prompt, system):
            if "Unanswerable" in prompt:
                raise OSError("busy")
            if "root_cause" in system:
                return '{"root_cause": "Worn disk", "cause_chain": ["Worn disk", "Redis"]}'
            if "events" in system:
                return "no JSON here"
            assert "Worn disk -> Redis" in prompt  # what the first stage found
            return '{"executive_summary": "By the model"}'

        return call

    questions = spark.createDataFrame([("a", "i", "Why slow?"), ("b", "j", "Unanswerable?")], schemas.QUESTIONS)
    outcome = investigate.investigate(knowledge, questions.filter("query_id = 'a'"), embedder, model=load)
    (report,) = outcome.reports.collect()
    assert (report["root_cause"], report["executive_summary"]) == ("Worn disk", "By the model")
    assert outcome.timelines.count() > 0 and outcome.errors.count() == 0
    (answer,) = investigate.chat(
        knowledge, questions.filter("query_id = 'a'"), embedder, outcome.reports.drop("query_id"),
        model=lambda: lambda prompt, system: '{"answer": "From the model"}' if "Worn disk" in prompt else "",
    ).collect()
    assert answer["answer"] == "From the model"
    failing = investigate.investigate(
        knowledge, questions.filter("query_id = 'b'"), embedder, responses={"timeline": spark.createDataFrame([], schemas.RESPONSES)},
        model=lambda: lambda prompt, system: (_ for _ in ()).throw(OSError("busy")),
    )
    assert {r["stage"] for r in failing.errors.collect()} == {"root_cause", "report"}
    assert [r["status"] for r in registry.current_status(failing.status).collect()] == ["FAILED"]
    assert failing.reports.first()["root_cause"] in ("Redis", "Cache")  # the heuristic fills in
