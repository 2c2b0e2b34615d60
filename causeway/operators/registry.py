"""Investigations: states, readiness, lookups and overview numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from causeway.functions import text as tx
from causeway.operators.vector_search import scope


def create_investigations(requests: DataFrame) -> DataFrame:
    """New investigations with their default title, in state PROCESSING."""
    return requests.select(
        "investigation_id",
        tx.default_title(F.col("title"), F.col("investigation_id")).alias("title"),
        F.lit("PROCESSING").alias("status"),
    )


def status_events(*steps: tuple[DataFrame, str, int]) -> DataFrame:
    """Append-only state changes from ``(investigations, status, seq)`` steps."""
    rows = [
        ids.select("investigation_id").distinct().select(
            "investigation_id", F.lit(status).alias("status"), F.lit(seq).cast("bigint").alias("seq")
        )
        for ids, status, seq in steps
    ]
    events = rows[0]
    for more in rows[1:]:
        events = events.unionByName(more)
    return events


def current_status(events: DataFrame) -> DataFrame:
    """The latest state of each investigation."""
    return events.groupBy("investigation_id").agg(F.max_by("status", "seq").alias("status"))


def upload_counts(chunks: DataFrame) -> DataFrame:
    """Documents and chunks per investigation.

    Chunks are counted per document first, so a large investigation is summed from
    small partial counts.
    """
    per_document = chunks.groupBy("investigation_id", "document_id").agg(
        F.count("*").alias("chunks")
    )
    return per_document.groupBy("investigation_id").agg(
        F.count("*").alias("documents"), F.sum("chunks").alias("chunks")
    )


def investigation_list(investigations: DataFrame, documents: DataFrame) -> DataFrame:
    """Every investigation with its number of documents, zero included."""
    counts = documents.groupBy("investigation_id").agg(F.count("*").alias("document_count"))
    return investigations.join(counts, "investigation_id", "left").withColumn(
        "document_count", F.coalesce("document_count", F.lit(0))
    )


def overview(listed: DataFrame) -> DataFrame:
    return listed.agg(
        F.count("*").alias("investigations"),
        F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.sum("document_count").alias("documents"),
    )


def readiness(requests: DataFrame, investigations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether each request can run: unknown investigation, nothing ingested, or ready.

    Only what the requests name is looked for among investigations and chunks.
    """
    near = scope(requests)
    known = near(investigations).select("investigation_id", F.lit(True).alias("known")).distinct()
    filled = near(chunks).select("investigation_id", F.lit(True).alias("filled")).distinct()
    return (
        requests.join(known, "investigation_id", "left")
        .join(filled, "investigation_id", "left")
        .withColumn(
            "readiness",
            F.when(F.col("known").isNull(), "unknown investigation")
            .when(F.col("filled").isNull(), "no documents ingested")
            .otherwise("ready"),
        )
        .drop("known", "filled")
    )


def ready(requests: DataFrame, investigations: DataFrame, chunks: DataFrame) -> DataFrame:
    return (
        readiness(requests, investigations, chunks)
        .filter(F.col("readiness") == "ready")
        .drop("readiness")
    )


def report_lookup(requests: DataFrame, investigations: DataFrame, reports: DataFrame) -> DataFrame:
    """State of the report each request asks for, with the report where there is one.

    ``reports`` has one row per investigation.
    """
    known = investigations.select("investigation_id", F.lit(True).alias("known")).distinct()
    return (
        requests.join(known, "investigation_id", "left")
        .join(reports.withColumn("has_report", F.lit(True)), "investigation_id", "left")
        .withColumn(
            "lookup",
            F.when(F.col("known").isNull(), "unknown investigation")
            .when(F.col("has_report").isNull(), "no report yet")
            .otherwise("found"),
        )
        .drop("known", "has_report")
    )
