"""From documents to the tables that investigations read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from causeway.functions.embedding import Embedder, embed_documents
from causeway.operators import centrality, chunking, extraction, graph
from causeway.operators.content_vectors import embed_by_content
from causeway.session import materialize
from causeway.sources import files, incident_log, tables


class Knowledge(NamedTuple):
    """Everything ingest derives from a set of documents."""

    chunks: DataFrame
    entity_mentions: DataFrame | None
    relation_mentions: DataFrame | None
    nodes: DataFrame | None
    edges: DataFrame | None
    ranks: DataFrame | None


def incident_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the incident corpus, cut from its lines."""
    chunks = chunking.chunk_lines(
        incident_log.incident_lines(spark, folder),
        "investigation_id",
        "document_id",
        "doc_seq",
        order="event_id",
        size=incident_log.WORDS,
        overlap=incident_log.OVERLAP,
    )
    return chunking.with_chunk_id(chunks)


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the ``documents`` table; its source takes the place of the investigation."""
    texts = tables.table(spark, folder, "documents", "doc_id").select(
        F.col("source").alias("investigation_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").alias("doc_seq"),
        "text",
    )
    chunks = chunking.chunk_texts(texts, "investigation_id", "document_id", "doc_seq")
    return chunking.with_chunk_id(chunks)


def build_knowledge(
    chunks: DataFrame,
    responses: DataFrame | None = None,
    merge_mode: str = "last_wins",
    embedder: Embedder | None = None,
    rounds: int | None = None,
    tie_break: str = "insertion",
    rank: bool = True,
    vectors: str | None = None,
) -> Knowledge:
    """Extract, embed and rank once, and merge the finds into one graph per investigation.

    Everything is a written table, so investigations and chats only read: chunks with
    their vectors (of ``embedder``, if given), and the rank of every node, converged
    unless ``rounds`` is given. Without ``rank`` there are no ranks, for uses of the graph
    alone. With ``vectors``, a store of vectors by text, only texts new to it are embedded.
    """
    found = extraction.extraction(chunks, responses)
    if embedder is not None and vectors is not None:
        found = embed_by_content(found, embedder, vectors)
    elif embedder is not None:
        found = embed_documents(found, embedder)
    extracted = materialize(found)
    entities = extraction.entity_mentions(extracted)
    relations = extraction.relation_mentions(extracted)
    nodes, edges = (materialize(t) for t in graph.merge(entities, relations, merge_mode))
    ranks = None
    if rank:
        scores = centrality.pagerank(nodes, edges, rounds)
        ranks = materialize(centrality.ranked_nodes(scores, nodes, tie_break))
    return Knowledge(extracted.drop("entities", "relations"), entities, relations, nodes, edges, ranks)


def vectors_only(chunks: DataFrame, embedder: Embedder) -> Knowledge:
    """Chunks with their vectors and no graph, for uses of the vector search alone."""
    return Knowledge(materialize(embed_documents(chunks, embedder)), None, None, None, None, None)


def chunks_only(chunks: DataFrame) -> Knowledge:
    """Chunks alone, for one search that embeds them as it reads them."""
    return Knowledge(materialize(chunks), None, None, None, None, None)


def write_knowledge(knowledge: Knowledge, path: str) -> None:
    """Store the tables, each laid out by investigation."""
    for name, rows in knowledge._asdict().items():
        if rows is None:
            raise ValueError(f"the knowledge has no {name}")
        rows.hint("rebalance", "investigation_id").write.mode("overwrite").partitionBy(
            "investigation_id"
        ).parquet(f"{path}/{name}")


def read_knowledge(spark: SparkSession, path: str) -> Knowledge:
    """The stored tables; a filter on ``investigation_id`` reads only its folders."""
    return Knowledge(**{name: spark.read.parquet(f"{path}/{name}") for name in Knowledge._fields})


def ingest_files(
    spark: SparkSession,
    path: str,
    pages: DataFrame,
    investigation_id: Column,
    embedder: Embedder | None = None,
    rounds: int | None = None,
) -> tuple[DataFrame, Knowledge]:
    """Files to knowledge in one run: the registry, and the tables of what was accepted.

    ``pages(document_id, page_no, text)`` holds the text of paged files. A document is
    named by its path; its position is that of the path among those of its investigation.
    """
    place = Window.partitionBy("investigation_id").orderBy("stored_path")
    registry = materialize(
        files.file_registry(spark, path, investigation_id)
        .withColumn("document_id", F.col("stored_path"))
        .withColumn("doc_seq", F.row_number().over(place).cast("bigint"))
    )
    texts = files.whole_texts(spark, path).filter("rejected is null").select("stored_path", "text")
    keys = ["investigation_id", "document_id", "doc_seq"]
    documents = registry.join(texts, "stored_path", "left")
    known = registry.select(*keys)
    paged = files.load_texts(documents, pages.join(known.select("document_id"), "document_id", "left_semi"), "document_id")
    chunks = chunking.with_chunk_id(
        chunking.chunk_texts(paged.join(known, "document_id"), "investigation_id", "document_id", "doc_seq")
    )
    return registry, build_knowledge(chunks, embedder=embedder, rounds=rounds)


def incident_knowledge(
    spark: SparkSession, folder: str, embedder: Embedder | None = None, rounds: int | None = None, rank: bool = False
) -> Knowledge:
    return build_knowledge(incident_chunks(spark, folder), embedder=embedder, rounds=rounds, rank=rank)
