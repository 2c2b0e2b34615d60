"""Root causes, timelines, reports and answers as tables keyed by ``query_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway import fixed_values as fv
from causeway.functions import responses as rs
from causeway.functions import scores as sc
from causeway.functions import text as tx
from causeway.operators import traversal
from causeway.operators.retrieval import GraphContext

UNKNOWN = "Unknown (not enough evidence)"
_NO_NAMES = "array<string>"


def evidence(hits: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Hits as evidence, strongest first, with the file name of their document.

    Without ``documents`` the source is the document id.
    """
    source = F.col("document_id")
    if documents is not None:
        names = documents.select("investigation_id", "document_id", "filename")
        hits = hits.join(names, ["investigation_id", "document_id"], "left")
        source = F.coalesce("filename", "document_id")
    strongest = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "rank")
    return hits.select(
        "query_id",
        F.row_number().over(strongest).alias("rank"),
        F.substring("text", 1, 400).alias("text"),
        source.alias("source_document"),
        "chunk_id",
        F.col("score").alias("relevance"),
    )


def _in_order(value: str, *order: str) -> Column:
    """Values of a group as an array in the given order."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]
    )


def best_paths(
    entities: DataFrame, found: DataFrame, tie_break: str = "insertion"
) -> DataFrame:
    """The longest causal path of each question, the first entity's on ties.

    Lengths are counted first; only the winning paths are put together.
    """
    tie = "node_seq" if tie_break == "insertion" else "name"
    heads = traversal.path_heads(found).withColumnRenamed("start", "name")
    best = (
        entities.join(heads, ["investigation_id", "name"])
        .groupBy("query_id", "investigation_id")
        .agg(F.min_by("name", F.struct(-F.col("length"), F.col(tie))).alias("start"))
    )
    wanted = best.select("investigation_id", "start").distinct()
    paths = traversal.causal_paths(found.join(wanted, ["investigation_id", "start"], "left_semi"))
    return best.join(paths, ["investigation_id", "start"]).select("query_id", "path")


def root_causes(
    questions: DataFrame,
    context: GraphContext,
    ranked: DataFrame,
    tie_break: str = "insertion",
) -> DataFrame:
    """Root cause of each question from the graph.

    The longest causal path gives its first node; without a path the most central node
    does, with the top three as chain; without a graph the cause is unknown.
    """
    paths = best_paths(context.entities, context.found, tie_break)
    tops = (
        ranked.filter(F.col("rank") <= 3)
        .groupBy("investigation_id")
        .agg(_in_order("name", "rank").alias("top"))
    )
    order = "node_seq" if tie_break == "insertion" else "name"
    services = (
        context.entities.filter(F.col("type") == "SERVICE")
        .groupBy("query_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("name").alias("n")))),
                lambda s: s["n"],
            ).alias("services")
        )
    )
    empty = F.array().cast(_NO_NAMES)
    chain = F.coalesce("path", "top", empty)
    return (
        questions.select("query_id", "investigation_id")
        .join(paths, "query_id", "left")
        .join(tops, "investigation_id", "left")
        .join(services, "query_id", "left")
        .select(
            "query_id",
            "investigation_id",
            F.coalesce(F.get(chain, F.lit(0)), F.lit(UNKNOWN)).alias("root_cause"),
            chain.alias("cause_chain"),
            sc.root_cause_confidence(
                F.coalesce(F.size("path"), F.lit(0)), F.col("top").isNotNull()
            ).alias("confidence_score"),
            F.coalesce("services", empty).alias("affected_systems"),
        )
    )


def _given(responses: DataFrame) -> DataFrame:
    """Responses as ``query_id, payload``."""
    return responses.select(
        F.col("key").alias("query_id"), rs.json_payload(F.col("response")).alias("payload")
    )


def root_causes_from_responses(responses: DataFrame) -> DataFrame:
    """Usable root causes in model responses; the others are left out."""
    empty = F.array().cast(_NO_NAMES)
    payload = F.col("payload")
    return (
        _given(responses)
        .select(
            "query_id",
            rs.text_field(payload, "root_cause").alias("root_cause"),
            F.coalesce(rs.text_list(payload, "cause_chain"), empty).alias("cause_chain"),
            F.coalesce(rs.number_field(payload, "confidence_score"), F.lit(0.6)).alias(
                "confidence_score"
            ),
            F.coalesce(rs.text_list(payload, "affected_systems"), empty).alias("affected_systems"),
        )
        .filter(F.col("root_cause") != "")
    )


def prefer(given: DataFrame, otherwise: DataFrame) -> DataFrame:
    """The given row of each question, else the other one."""
    fields = [c for c in given.columns if c != "query_id"]
    marked = given.select(
        "query_id", F.struct(*fields).alias("given")
    )
    columns = [
        F.when(F.col("given").isNotNull(), F.col(f"given.{c}")).otherwise(F.col(c)).alias(c)
        if c in fields
        else F.col(c)
        for c in otherwise.columns
    ]
    return otherwise.join(marked, "query_id", "left").select(*columns)


def timelines(hits: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Events of each question: timed ones by their time as text, then the others.

    Ties and untimed events keep the order of retrieval; the first twelve stay. With
    ``times(investigation_id, chunk_id, event_ts)``, see ``event_times``, events come in the
    order of their timestamps and carry them; those of an unknown day follow.
    """
    time = tx.event_timestamp(F.col("text"))
    order = [F.asc_nulls_last("timestamp"), F.col("hit_rank")]
    parsed = [] if times is None else ["event_ts"]
    if times is not None:
        hits = hits.join(times, ["investigation_id", "chunk_id"], "left")
        order.insert(0, F.asc_nulls_last("event_ts"))
    by_time = Window.partitionBy("query_id").orderBy(*order)
    snippet = F.col("description")
    return (
        hits.select(
            *parsed,
            "query_id",
            "chunk_id",
            F.col("rank").alias("hit_rank"),
            time.alias("timestamp"),
            tx.snippet(F.col("text")).alias("description"),
        )
        .withColumn("order", F.row_number().over(by_time) - 1)
        .filter(F.col("order") < 12)
        .select(
            "query_id",
            "order",
            "timestamp",
            tx.event_title(snippet).alias("title"),
            "description",
            tx.severity(snippet).alias("severity"),
            F.array("chunk_id").alias("source_chunk_ids"),
            *parsed,
        )
    )


def timelines_from_responses(responses: DataFrame) -> DataFrame:
    """Events in model responses, in the order given there."""
    event = F.col("e")
    return (
        _given(responses)
        .select("query_id", F.posexplode(rs.object_list(F.col("payload"), "events")).alias("order", "e"))
        .select(
            "query_id",
            "order",
            rs.text_field(event, "timestamp").alias("timestamp"),
            F.coalesce(rs.text_field(event, "title"), F.lit("Event")).alias("title"),
            F.coalesce(rs.text_field(event, "description"), F.lit("")).alias("description"),
            F.coalesce(rs.text_field(event, "severity"), F.lit("info")).alias("severity"),
            F.array().cast(_NO_NAMES).alias("source_chunk_ids"),
        )
    )


def prefer_timelines(given: DataFrame, otherwise: DataFrame) -> DataFrame:
    """The given timeline of each question; the other one where it has no events."""
    rest = otherwise.join(given.select("query_id").distinct(), "query_id", "left_anti")
    return given.unionByName(rest.select(given.columns))


def troubled_titles(timeline: DataFrame) -> DataFrame:
    """Up to five distinct titles of warning and critical events, in order of appearance."""
    first = (
        timeline.filter(F.col("severity").isin("warning", "critical"))
        .groupBy("query_id", "title")
        .agg(F.min("order").alias("order"))
    )
    top = Window.partitionBy("query_id").orderBy("order")
    return (
        first.withColumn("rank", F.row_number().over(top))
        .filter(F.col("rank") <= 5)
        .select("query_id", "rank", "title")
    )


def _names(names: Column, empty: str) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit(empty))


def recommendations(confidence: Column) -> Column:
    return F.array_compact(
        F.array(
            F.lit("Set a monitor on what broke first."),
            F.lit("Write down how this was recognised, for the next time."),
            F.when(confidence < 0.5, F.lit("Treat the finding as a guess until more records are in.")),
        )
    )


def reports(causes: DataFrame, timeline: DataFrame, narratives: DataFrame | None = None) -> DataFrame:
    """Report of each question.

    ``narratives(query_id, executive_summary, recommendations)`` replaces the written
    summary where it has one, and the recommendations where it has any.
    """
    events = timeline.groupBy("query_id").agg(F.count("*").alias("events"))
    titles = (
        troubled_titles(timeline).groupBy("query_id").agg(_in_order("title", "rank").alias("titles"))
    )
    chain = F.when(F.size("cause_chain") > 0, F.array_join("cause_chain", " → ")).otherwise(
        F.col("root_cause")
    )
    summary = F.concat(
        F.col("events").cast("string"),
        F.lit(" events placed in time point to "),
        F.col("root_cause"),
        F.lit(", "),
        sc.percent(F.col("confidence_score")).cast("string"),
        F.lit("% sure. It touched "),
        _names(F.col("affected_systems"), "no system by name"),
        F.lit(" and spread as "),
        chain,
    )
    systems = F.when(F.size("affected_systems") > 0, F.col("affected_systems")).otherwise(
        F.coalesce("titles", F.array().cast(_NO_NAMES))
    )
    own = (
        causes.join(events, "query_id", "left")
        .join(titles, "query_id", "left")
        .withColumn("events", F.coalesce("events", F.lit(0)))
        .select(
            "query_id",
            "investigation_id",
            "root_cause",
            "cause_chain",
            summary.alias("executive_summary"),
            systems.alias("affected_systems"),
            recommendations(F.col("confidence_score")).alias("recommendations"),
            F.col("confidence_score").alias("confidence"),
        )
    )
    if narratives is None:
        return own
    given = narratives.select(
        "query_id",
        F.col("executive_summary").alias("given_summary"),
        F.col("recommendations").alias("given_recommendations"),
    )
    use = F.coalesce("given_summary", F.lit("")) != ""
    return own.join(given, "query_id", "left").select(
        *[
            F.when(use, F.col("given_summary")).otherwise(F.col(c)).alias(c)
            if c == "executive_summary"
            else F.when(
                use & (F.coalesce(F.size("given_recommendations"), F.lit(0)) > 0),
                F.col("given_recommendations"),
            )
            .otherwise(F.col(c))
            .alias(c)
            if c == "recommendations"
            else F.col(c)
            for c in own.columns
        ]
    )


def narratives_from_responses(responses: DataFrame) -> DataFrame:
    payload = F.col("payload")
    return _given(responses).select(
        "query_id",
        rs.text_field(payload, "executive_summary").alias("executive_summary"),
        rs.text_list(payload, "recommendations").alias("recommendations"),
    )


def top_evidence(found: DataFrame, limit: int) -> DataFrame:
    """The strongest evidence of each question as one array."""
    item = F.struct("rank", "text", "source_document", "chunk_id", "relevance")
    return (
        found.filter(F.col("rank") <= limit)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(item)).alias("supporting_evidence"))
    )


def first_entities(entities: DataFrame, limit: int, tie_break: str = "insertion") -> DataFrame:
    """The first entities of each question, numbered from 1."""
    order = "node_seq" if tie_break == "insertion" else "name"
    first = Window.partitionBy("query_id").orderBy(order)
    return (
        entities.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", "name")
    )


def answers(
    questions: DataFrame,
    found: DataFrame,
    entities: DataFrame,
    known: DataFrame,
    tie_break: str = "insertion",
) -> DataFrame:
    """Answer of each question without a model.

    From the report if there is one and the question asks for the cause; else from the
    strongest evidence; else a hint. ``known(query_id, root_cause, cause_chain,
    confidence)`` holds the report to rely on.
    """
    about_cause = F.lower("text").rlike("|".join(fv.REPORT_WORDS))
    from_report = F.concat(
        F.lit("The report names '"),
        F.col("root_cause"),
        F.lit("' as the likely root cause ("),
        sc.percent(F.col("confidence")).cast("string"),
        F.lit("% confidence), through the chain "),
        F.array_join("cause_chain", " -> "),
        F.lit("."),
    )
    names = first_entities(entities, 5, tie_break).groupBy("query_id").agg(
        _in_order("name", "rank").alias("referenced_entities")
    )
    item = "array<struct<rank:int,text:string,source_document:string,chunk_id:string,relevance:double>>"
    return (
        questions.join(known.select("query_id", "root_cause", "cause_chain", "confidence"), "query_id", "left")
        .join(top_evidence(found, 5), "query_id", "left")
        .join(names, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("root_cause").isNotNull() & about_cause, from_report)
            .when(
                F.col("supporting_evidence").isNotNull(),
                F.concat(
                    F.lit("The strongest evidence for this question: "),
                    F.substring(F.get("supporting_evidence", F.lit(0))["text"], 1, 200),
                ),
            )
            .otherwise(
                F.lit("The documents hold no evidence for this; add logs or ask differently.")
            )
            .alias("answer"),
            F.coalesce("supporting_evidence", F.array().cast(item)).alias("supporting_evidence"),
            F.coalesce("referenced_entities", F.array().cast(_NO_NAMES)).alias(
                "referenced_entities"
            ),
        )
    )


def answers_from_responses(responses: DataFrame) -> DataFrame:
    payload = F.col("payload")
    return (
        _given(responses)
        .select(
            "query_id",
            rs.text_field(payload, "answer").alias("answer"),
            F.coalesce(
                rs.text_list(payload, "referenced_entities"), F.array().cast(_NO_NAMES)
            ).alias("referenced_entities"),
        )
        .filter(F.col("answer") != "")
    )
