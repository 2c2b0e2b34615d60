"""Incremental ingest: files arriving in a folder become chunks and mention facts.

All steps work within a row, so the stream needs no state, window or watermark. The graph
is merged when it is read: first and last are decided by position in the documents, not
by time of arrival, so late files give the same graph as one batch would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from causeway.operators import chunking, extraction

ARRIVING = (
    "investigation_id string, document_id string, doc_seq bigint, text string"
)


def read_documents(
    spark: SparkSession, path: str, files_per_trigger: int = 100, schema: str = ARRIVING
) -> DataFrame:
    """Documents from parquet files as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def extracted(
    documents: DataFrame, size: int | None = None, overlap: int | None = None
) -> DataFrame:
    """Chunks with their entities and relations; the same for a stream and a batch."""
    chunks = chunking.with_chunk_id(
        chunking.chunk_texts(
            documents, "investigation_id", "document_id", "doc_seq", size=size, overlap=overlap
        )
    )
    return extraction.heuristic_extraction(chunks)


def start_ingest(
    documents: DataFrame,
    sink: str,
    checkpoint: str,
    size: int | None = None,
    overlap: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Append extracted chunks to ``sink``.

    The file sink and the checkpoint make each batch appear once. A document sent twice
    in different files is caught when reading (``read_extracted``).
    """
    writer = (
        extracted(documents, size, overlap)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_extracted(spark: SparkSession, sink: str) -> DataFrame:
    """Stored chunks, each once: the newest version of each document (its largest
    ``doc_seq``), of whose chunks a replay brings the same ids again.

    Ids count within their investigation. Versions are compared on the keys alone.
    """
    stored = spark.read.parquet(sink)
    document = ["investigation_id", "document_id"]
    versions = stored.groupBy(*document).agg(F.max("doc_seq").alias("doc_seq"))
    return stored.join(versions, [*document, "doc_seq"], "left_semi").dropDuplicates(
        ["investigation_id", "chunk_id"]
    )


def running_graph_counts(documents: DataFrame, size: int | None = None, overlap: int | None = None):
    """Mentions per entity so far, as a streaming aggregate for a live view.

    State is one row per distinct (investigation, name, type).
    """
    return (
        extracted(documents, size, overlap)
        .select("investigation_id", F.explode_outer("entities").alias("e"))
        .filter(F.col("e").isNotNull())
        .groupBy("investigation_id", "e.name", "e.type")
        .agg(F.count("*").alias("mentions"))
    )
