"""Incident corpus derived from the ``events`` table.

Each event becomes one log line of the investigation its user falls into. The phrases
give the lines the vocabulary that extraction looks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.sources.tables import spread

# The phrase of a line, by phrase number.
PHRASES = [
    "redis timeout caused connection pool exhaustion.",
    "connection pool exhaustion led to payment failure.",
    "payment failure triggered checkout error.",
    "checkout error resulted in retry storm.",
    "retry storm leads to redis timeout.",
    "nginx returned 503 for checkout.",
    "postgres deadlock caused api timeout.",
    "api timeout led to gateway crash.",
    "load balancer health check ok.",
    "user session opened.",
    "rabbitmq exception observed.",
    "mongodb replica synced.",
]
# Chunk size and overlap of this corpus, in words.
WORDS, OVERLAP = 40, 8
# Number of investigations.
INVESTIGATIONS = 16


def _phrase_number():
    return (F.col("event_id") % 4 + F.col("user_id") % INVESTIGATIONS) % len(PHRASES)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    return spread(events.select("event_id", "ts", "user_id", "event_type"), "event_id")


def incident_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(investigation_id, document_id, doc_seq, event_id, raw)``, one row per event."""
    events = _events(spark, folder)
    inv = F.concat(F.lit("inv-"), (F.col("user_id") % INVESTIGATIONS).cast("string"))
    part = F.floor((F.dayofmonth("ts") - 1) / 10)
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "WARN")
        .when(F.col("event_type") == "purchase", "INFO")
        .otherwise("DEBUG")
    )
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (_phrase_number() + 1).cast("int"))
    return events.select(
        inv.alias("investigation_id"),
        F.concat(inv, F.lit("-"), part.cast("string")).alias("document_id"),
        part.alias("doc_seq"),
        "event_id",
        F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(": "), phrase
        ).alias("raw"),
    )


def incident_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Registry of the corpus: one log file per ten days of an investigation."""
    return (
        incident_lines(spark, folder)
        .groupBy("investigation_id", "document_id", "doc_seq")
        .agg(
            (F.sum(F.length("raw").cast("bigint")) + F.count("*") - 1).alias("size_bytes"),
        )
        .withColumn("filename", F.concat(F.col("document_id"), F.lit(".log")))
    )


def incident_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions about the corpus: one per phrase seen at ERROR level, plus the default.

    The default question of an investigation is a row with a null text.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    inv = F.concat(F.lit("inv-"), (F.col("user_id") % INVESTIGATIONS).cast("string"))
    starts = F.array(*[F.lit(" ".join(p.rstrip(".").split()[:2])) for p in PHRASES])
    seen = (
        events.filter(F.col("event_type") == "error")
        .select(inv.alias("investigation_id"), _phrase_number().cast("int").alias("phrase"))
        .distinct()
    )
    asked = seen.select(
        F.concat("investigation_id", F.lit("-q"), F.col("phrase").cast("string")).alias("query_id"),
        "investigation_id",
        F.concat(
            F.lit("Why did the "),
            F.element_at(starts, F.col("phrase") + 1),
            F.lit(" fail?"),
        ).alias("text"),
    )
    default = events.select(inv.alias("investigation_id")).distinct().select(
        F.concat("investigation_id", F.lit("-q")).alias("query_id"),
        "investigation_id",
        F.lit(None).cast("string").alias("text"),
    )
    return asked.unionByName(default)
