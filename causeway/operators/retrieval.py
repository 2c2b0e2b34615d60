"""Graph context and vector hits of many questions at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from causeway import fixed_values as fv
from causeway.functions import text as tx
from causeway.functions.embedding import Embedder
from causeway.operators import graph, name_index, traversal, vector_search
from causeway.session import materialize

_MATCH = ["query_id", "investigation_id", "name", "type", "node_seq"]


class GraphContext(NamedTuple):
    """Tables keyed by ``query_id``; ``found`` holds the causes of all matched entities."""

    entities: DataFrame
    relations: DataFrame
    found: DataFrame


class Retrieval(NamedTuple):
    hits: DataFrame
    context: GraphContext


def asked(questions: DataFrame) -> DataFrame:
    """Questions with the default text where none is given."""
    return questions.withColumn("text", tx.default_question(F.col("text")))


def keyword_matches(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose name contains a keyword of the question, each once per question."""
    words = (
        questions.select(
            "query_id",
            "investigation_id",
            F.explode(tx.question_keywords(F.col("text"))).alias("keyword"),
        )
        .distinct()
    )
    keywords = words.select(
        "investigation_id", "keyword", F.substring("keyword", 1, 3).alias("gram")
    ).distinct()
    named = graph.nodes_with_keyword(
        nodes.select("investigation_id", "name", "type", "node_seq"), keywords, [3]
    )
    return named.join(words, ["investigation_id", "keyword"]).select(*_MATCH).distinct()


def matched_entities(
    questions: DataFrame, nodes: DataFrame, ranked: DataFrame, index: str | None = None
) -> DataFrame:
    """Entities of each question: by keyword, else the five most central nodes.

    Keywords are looked up in the ``name_index`` at ``index``, if there is one.
    """
    if index is None:
        matches = keyword_matches(questions, nodes)
    else:
        matches = materialize(name_index.keyword_matches(questions, index))
    unmatched = questions.join(
        matches.select("query_id").distinct(), "query_id", "left_anti"
    ).select("query_id", "investigation_id")
    central = ranked.filter(F.col("rank") <= 5).select("investigation_id", "name")
    fallback = unmatched.join(
        central.join(
            nodes.select("investigation_id", "name", "type", "node_seq"),
            ["investigation_id", "name"],
        ),
        "investigation_id",
    )
    return matches.unionByName(fallback.select(*_MATCH))


def touching_relations(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a matched entity at either end, each once per question."""
    names = entities.select("query_id", "investigation_id", "name")
    fields = [
        "query_id", "investigation_id", "source", "target", "type", "confidence", "edge_seq",
    ]
    ends = [
        names.withColumnRenamed("name", side).join(edges, ["investigation_id", side]).select(*fields)
        for side in ("source", "target")
    ]
    return ends[0].unionByName(ends[1]).distinct()


def graph_context(
    questions: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    ranked: DataFrame,
    hops: int = fv.HOPS,
    tie_break: str = "insertion",
    index: str | None = None,
) -> GraphContext:
    """Entities, relations and causes for ``questions(query_id, investigation_id, text)``.

    Causes are walked once per distinct entity, not once per question. Of the graph, only what
    belongs to the investigations asked about is read. ``index`` as in ``matched_entities``.
    """
    near = vector_search.scope(questions)
    nodes, edges, ranked = near(nodes), near(edges), near(ranked)
    entities = materialize(matched_entities(asked(questions), nodes, ranked, index))
    starts = entities.select("investigation_id", F.col("name").alias("start")).distinct()
    return GraphContext(
        entities,
        touching_relations(entities, edges),
        traversal.upstream(nodes, edges, starts, hops, tie_break=tie_break),
    )


def question_paths(context: GraphContext) -> DataFrame:
    """Causal paths per question, numbered in the order of their entities."""
    return context.entities.join(
        traversal.causal_paths(context.found).withColumnRenamed("start", "name"),
        ["investigation_id", "name"],
    ).select("query_id", "investigation_id", "name", "node_seq", "path")


def hybrid(
    questions: DataFrame,
    chunks: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    ranked: DataFrame,
    embedder: Embedder,
    k: int | None = None,
    tie_break: str = "insertion",
    index: str | None = None,
) -> Retrieval:
    """Vector hits and graph context side by side; their scores are not mixed."""
    hits = vector_search.retrieve(chunks, asked(questions), embedder, k)
    return Retrieval(
        hits, graph_context(questions, nodes, edges, ranked, tie_break=tie_break, index=index)
    )
