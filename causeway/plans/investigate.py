"""Questions to reports and answers, for all investigations in one run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from causeway import schemas
from causeway.functions.embedding import Embedder
from causeway.operators import prompts, reasoning, registry, retrieval, vector_search
from causeway.operators.answer_log import infer_logged
from causeway.operators.prompts import Model
from causeway.plans.ingest import Knowledge
from causeway.session import materialize

_STAGE_ERRORS = "query_id string, stage string, error string"


class Investigation(NamedTuple):
    """Tables keyed by ``query_id``. ``refused`` holds the questions that were not run and
    why; ``errors`` the model calls that failed for good."""

    hits: DataFrame
    context: retrieval.GraphContext
    evidence: DataFrame
    root_causes: DataFrame
    timelines: DataFrame
    reports: DataFrame
    status: DataFrame
    refused: DataFrame
    errors: DataFrame


def _usable(knowledge: Knowledge) -> None:
    if "embedding" not in knowledge.chunks.columns or knowledge.ranks is None:
        raise ValueError("build the knowledge with an embedder and ranks first")


class _Answers:
    """Where a stage's answers come from: recorded ones, a model, or nowhere."""

    def __init__(self, recorded: dict[str, DataFrame] | None, model: Model | None, tries: int, log: str | None):
        self.recorded, self.model, self.tries, self.log = recorded or {}, model, tries, log
        self.errors: list[DataFrame] = []

    def of(self, stage: str, asked) -> DataFrame | None:
        """``key, response`` of a stage; ``asked`` makes its prompts, for a model only."""
        if stage in self.recorded:
            return self.recorded[stage]
        if self.model is None:
            return None
        if self.log is None:
            given = materialize(prompts.infer(asked(), self.model, self.tries, system=prompts.SYSTEM[stage]))
        else:
            wanted = materialize(asked())
            given = infer_logged(wanted, self.model, self.log, self.tries, system=prompts.SYSTEM[stage])
            given = materialize(given)
        failed = given.filter(F.col("error").isNotNull())
        self.errors.append(failed.select(F.col("key").alias("query_id"), F.lit(stage).alias("stage"), "error"))
        return given.select("key", "response")


def _asked_about(knowledge: Knowledge, questions: DataFrame) -> Knowledge:
    """The knowledge of the investigations asked about; of a store only their folders are read."""
    near = vector_search.scope(questions)
    return Knowledge(*[None if table is None else near(table) for table in knowledge])


def investigate(
    knowledge: Knowledge,
    questions: DataFrame,
    embedder: Embedder,
    documents: DataFrame | None = None,
    responses: dict[str, DataFrame] | None = None,
    model: Model | None = None,
    investigations: DataFrame | None = None,
    tie_break: str = "insertion",
    tries: int = 3,
    log: str | None = None,
    index: str | None = None,
) -> Investigation:
    """Retrieve, find the root cause, order the events and write the report.

    Questions on an unknown investigation (not among ``investigations``, by default those
    with chunks), or on one without chunks, are refused. Vectors and ranks are read from
    the knowledge, only those of the investigations asked about.

    Answers of a model may be recorded in ``responses`` under ``root_cause``, ``timeline``
    and ``report``, or come from ``model``, which is asked stage by stage with what the
    stages before have found. What they lack or get wrong is filled by the heuristic
    results; a question for which the model failed ends as FAILED. With ``log``, a folder of
    answers by prompt, a run that was broken off asks no answered prompt again. ``index`` is the folder of a
    ``name_index`` of the knowledge's nodes.
    """
    _usable(knowledge)
    source = _Answers(responses, model, tries, log)
    knowledge = _asked_about(knowledge, questions)
    chunks = knowledge.chunks
    known = chunks.select("investigation_id") if investigations is None else investigations
    checked = materialize(registry.readiness(retrieval.asked(questions), known, chunks))
    refused = checked.filter("readiness <> 'ready'").select("query_id", "investigation_id", F.col("readiness").alias("reason"))
    questions = checked.filter("readiness = 'ready'").drop("readiness")

    found = retrieval.hybrid(
        questions, chunks, knowledge.nodes, knowledge.edges, knowledge.ranks, embedder, tie_break=tie_break, index=index
    )
    hits = materialize(found.hits)
    context = found.context._replace(found=materialize(found.context.found))
    evidence = reasoning.evidence(hits, documents)

    causes = reasoning.root_causes(questions, context, knowledge.ranks, tie_break)
    given = source.of(
        "root_cause",
        lambda: prompts.root_cause_prompts(questions, evidence, context.relations, retrieval.question_paths(context)),
    )
    if given is not None:
        causes = reasoning.prefer(reasoning.root_causes_from_responses(given), causes)
    causes = materialize(causes)
    events = reasoning.timelines(hits)
    given = source.of("timeline", lambda: prompts.timeline_prompts(hits))
    if given is not None:
        events = reasoning.prefer_timelines(reasoning.timelines_from_responses(given), events)
    given = source.of("report", lambda: prompts.report_prompts(causes, events))
    narratives = None if given is None else reasoning.narratives_from_responses(given)
    reports = materialize(reasoning.reports(causes, events, narratives))

    errors = questions.sparkSession.createDataFrame([], _STAGE_ERRORS)
    for part in source.errors:
        errors = errors.unionByName(part)
    failed = questions.join(errors.select("query_id").distinct(), "query_id", "left_semi")
    status = registry.status_events(
        (questions, "PROCESSING", 1), (reports, "COMPLETED", 2), (failed, "FAILED", 3)
    )
    return Investigation(hits, context, evidence, causes, events, reports, status, refused, errors)


def chat(
    knowledge: Knowledge,
    messages: DataFrame,
    embedder: Embedder,
    reports: DataFrame,
    responses: DataFrame | None = None,
    model: Model | None = None,
    history: DataFrame | None = None,
    tie_break: str = "insertion",
    tries: int = 3,
    log: str | None = None,
    index: str | None = None,
) -> DataFrame:
    """Answers to follow-up messages; ``reports(investigation_id, ...)`` has one report each.

    Answers of a model are recorded in ``responses`` or come from ``model``, which also
    gets the last messages of ``history`` if ``messages`` have a ``conv_id``; ``log`` and
    ``index`` as in ``investigate``.
    """
    _usable(knowledge)
    knowledge = _asked_about(knowledge, messages)
    found = retrieval.hybrid(
        messages, knowledge.chunks, knowledge.nodes, knowledge.edges, knowledge.ranks, embedder, tie_break=tie_break, index=index
    )
    known = messages.select("query_id", "investigation_id").join(
        reports.select("investigation_id", "root_cause", "cause_chain", "confidence"),
        "investigation_id",
    )
    evidence = reasoning.evidence(materialize(found.hits))
    answers = reasoning.answers(messages, evidence, found.context.entities, known, tie_break)
    source = _Answers(None if responses is None else {"answer": responses}, model, tries, log)

    def asked() -> DataFrame:
        talk = messages if "conv_id" in messages.columns else messages.withColumn("conv_id", F.col("query_id"))
        said = talk.sparkSession.createDataFrame([], schemas.CHAT_HISTORY) if history is None else history
        return prompts.chat_prompts(talk, said, evidence, found.context.relations, known)

    given = source.of("answer", asked)
    if given is not None:
        answers = reasoning.prefer(reasoning.answers_from_responses(given), answers)
    return answers
