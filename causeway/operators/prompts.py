"""Prompts as a column, and inference over a column of prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway.functions import text as tx

_RULE = "\n---\n"

#: Called once per Python worker; returns what answers a prompt under a system instruction.
Model = Callable[[], Callable[[str, str | None], str]]

_JSON = "Answer with one JSON object and nothing else, of this form: "
#: System instruction of each stage: its task, and the form that its reader expects.
SYSTEM = {
    "extraction": "You list the parts of a system that a record names, and how they act on each other. "
    + _JSON
    + '{"entities": [{"name": "...", "type": "SERVICE|ERROR|COMPONENT|DATABASE|API|EVENT|SYSTEM"}], '
    '"relationships": [{"source": "...", "target": "...", '
    '"type": "CAUSES|DEPENDS_ON|RELATED_TO|CONTAINS|TRIGGERS", "confidence": 0.0}]}',
    "summary": "You sum up records of incidents. Answer with plain text.",
    "root_cause": "You judge what set off an incident, from the given material alone. "
    + _JSON
    + '{"root_cause": "...", "cause_chain": ["first cause", "...", "last effect"], '
    '"confidence_score": 0.0, "affected_systems": ["..."]}',
    "timeline": "You put what happened into order, from the given excerpts alone. "
    + _JSON
    + '{"events": [{"timestamp": "... or null", "title": "...", "description": "...", '
    '"severity": "info|warning|critical"}]}',
    "report": "You write for the people on call, briefly and without guesses. "
    + _JSON
    + '{"executive_summary": "...", "recommendations": ["..."]}',
    "answer": "You answer questions about one incident from the given material; say so if it has no answer. "
    + _JSON
    + '{"answer": "...", "referenced_entities": ["..."]}',
}


def _joined(rows: DataFrame, value: Column, separator: str, limit: int | None, *order: str) -> DataFrame:
    """The first rows of each question as one text: ``query_id, joined``."""
    if limit is not None:
        first = Window.partitionBy("query_id").orderBy(*order)
        rows = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= limit)
        order = ("nth",)
    ordered = F.array_sort(F.collect_list(F.struct(*order, value.alias("value"))))
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["value"]), separator).alias("joined")
    )


def _with(base: DataFrame, part: DataFrame, name: str, default: str = "") -> DataFrame:
    part = part.withColumnRenamed("joined", name)
    return base.join(part, "query_id", "left").withColumn(name, F.coalesce(name, F.lit(default)))


def _relation() -> Column:
    return F.concat_ws(" ", "source", "type", "target")


def extraction_prompts(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "investigation_id",
        F.col("chunk_id").alias("key"),
        F.concat(F.lit("Text of the incident record:\n"), F.col("text")).alias("prompt"),
    )


def summary_prompts(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "investigation_id",
        F.col("chunk_id").alias("key"),
        F.concat(
            F.lit("Sum up this excerpt in one or two sentences, naming errors and services:\n"),
            F.col("text"),
        ).alias("prompt"),
    )


def root_cause_prompts(
    questions: DataFrame, evidence: DataFrame, relations: DataFrame, paths: DataFrame,
    order: str = "node_seq", edge_order: tuple[str, ...] = ("edge_seq",),
) -> DataFrame:
    """Question, 8 pieces of evidence, all causal paths and 15 relations."""
    base = _with(
        questions.select("query_id", "text"),
        _joined(evidence, F.col("text"), _RULE, 8, "rank"),
        "excerpts",
    )
    base = _with(
        base, _joined(paths, F.array_join("path", " -> "), "; ", None, order), "paths", "none"
    )
    base = _with(base, _joined(relations, _relation(), "; ", 15, *edge_order), "relations")
    return base.select(
        F.col("query_id").alias("key"),
        F.concat(
            F.lit("Question: "), "text", F.lit("\nExcerpts:\n"), "excerpts",
            F.lit("\nCausal paths: "), "paths", F.lit("\nRelations: "), "relations",
        ).alias("prompt"),
    )


def timeline_prompts(hits: DataFrame) -> DataFrame:
    """The first ten hits, 300 characters each, tagged with their time."""
    tagged = F.concat(
        F.lit("["),
        F.coalesce(tx.event_timestamp(F.col("text")), F.lit("no time")),
        F.lit("] "),
        F.substring("text", 1, 300),
    )
    return _joined(hits, tagged, _RULE, 10, "rank").select(
        F.col("query_id").alias("key"), F.col("joined").alias("prompt")
    )


def report_prompts(causes: DataFrame, timeline: DataFrame) -> DataFrame:
    """Chain, confidence, the first ten events and the affected systems."""
    event = F.concat(F.coalesce("timestamp", F.lit("?")), F.lit(": "), F.col("title"))
    base = _with(causes, _joined(timeline, event, "; ", 10, "order"), "events")
    chain = F.when(F.size("cause_chain") > 0, F.array_join("cause_chain", " -> ")).otherwise(
        F.col("root_cause")
    )
    systems = F.when(
        F.size("affected_systems") > 0, F.array_join("affected_systems", ", ")
    ).otherwise(F.lit("unclear"))
    return base.select(
        F.col("query_id").alias("key"),
        F.concat(
            F.lit("What broke: "), systems,
            F.lit("\nIn this order: "), F.col("events"),
            F.lit("\nBecause of: "), chain,
            F.lit("\nHow sure (0 to 1): "), F.col("confidence_score").cast("string"),
        ).alias("prompt"),
    )


def recent_history(history: DataFrame, limit: int = 6) -> DataFrame:
    """The last messages of each conversation, oldest first by ``turn``."""
    latest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return (
        history.withColumn("back", F.row_number().over(latest))
        .filter(F.col("back") <= limit)
        .drop("back")
    )


def chat_prompts(
    questions: DataFrame, history: DataFrame, evidence: DataFrame, relations: DataFrame,
    known: DataFrame, edge_order: tuple[str, ...] = ("edge_seq",),
) -> DataFrame:
    """Six messages of history, the question, 6 pieces of evidence, 10 relations, the report.

    ``questions`` names the conversation of each question in ``conv_id``.
    """
    said = recent_history(history).join(questions.select("query_id", "conv_id"), "conv_id")
    base = _with(
        questions.select("query_id", "text"),
        _joined(said, F.concat_ws(": ", "role", "content"), "\n", None, "turn"),
        "said",
    )
    base = _with(base, _joined(evidence, F.col("text"), _RULE, 6, "rank"), "excerpts")
    base = _with(base, _joined(relations, _relation(), "; ", 10, *edge_order), "relations")
    report = known.select(
        "query_id",
        F.concat(
            F.lit("Our finding so far: "), F.array_join("cause_chain", " -> "),
            F.lit(", which began with "), F.col("root_cause"),
        ).alias("joined"),
    )
    base = _with(base, report, "report")
    return base.select(
        F.col("query_id").alias("key"),
        F.concat(
            F.lit("Asked now: "), "text", F.lit("\n"), "report",
            F.lit("\nLinks in the graph: "), "relations", F.lit("\nWhat the records say:\n"), "excerpts",
            F.lit("\nSaid before:\n"), "said",
        ).alias("prompt"),
    )


def infer(
    prompts: DataFrame,
    load: Model | None,
    tries: int = 3,
    wait: Callable[[float], None] = time.sleep,
    system: str | None = None,
) -> DataFrame:
    """Add ``response`` and ``error`` to a table of prompts.

    ``load`` runs once per Python worker and returns the call that answers one prompt under
    the ``system`` instruction (see ``SYSTEM``).
    A call is tried ``tries`` times with waits of 1 to 8 seconds; a prompt that still
    fails gets a null response and its error, the others are not affected. Without
    ``load`` every response is empty, which makes all readers fall back.
    """
    if load is None:
        return prompts.withColumns(
            {"response": F.lit(""), "error": F.lit(None).cast("string")}
        )

    def answer(call: Callable[[str, str | None], str], prompt: str) -> tuple[str | None, str | None]:
        for attempt in range(tries):
            try:
                return call(prompt, system) or "", None
            except Exception as failure:  # a provider may raise anything
                problem = f"{type(failure).__name__}: {failure}"
                if attempt + 1 < tries:
                    wait(min(max(2.0**attempt, 1.0), 8.0))
        return None, problem

    @F.pandas_udf("response string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = load()
        for batch in batches:
            yield pd.DataFrame([answer(call, p) for p in batch], columns=["response", "error"])

    # Not deterministic, so that no prompt is sent twice for a filter on its response.
    return prompts.withColumn("r", run.asNondeterministic()(F.col("prompt"))).select(
        *prompts.columns, "r.response", "r.error"
    )
