"""The knowledge graph: merge of mention facts into nodes and edges, and its reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_NODE = ["investigation_id", "name"]
_EDGE = ["investigation_id", "source", "target"]


def _end(side: str, offset: int) -> Column:
    """One end of a relation as a mention that follows the chunk's entities."""
    seq = F.struct(
        F.col("seq.doc_seq").alias("doc_seq"),
        F.col("seq.chunk_index").alias("chunk_index"),
        F.col("seq.kind").alias("kind"),
        (F.col("seq.pos") * 2 + offset).alias("pos"),
    )
    return F.struct(F.col(side).alias("name"), seq.alias("seq"))


def merge_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One node per name: the last mention decides the attributes, the first the position.

    A relation end that no entity names becomes an EVENT node without a source chunk.
    """
    ends = relations.select(
        "investigation_id", F.explode(F.array(_end("source", 0), _end("target", 1))).alias("e")
    ).select("investigation_id", "e.name", "e.seq")
    named = F.when(F.col("type").isNotNull(), F.col("seq"))
    return (
        entities.select(*_NODE, "type", "chunk_id", "seq")
        .unionByName(ends, allowMissingColumns=True)
        .groupBy(*_NODE)
        .agg(
            F.max_by(F.struct("type", "chunk_id"), named).alias("last"),
            F.min("seq").alias("node_seq"),
        )
        .select(
            *_NODE,
            F.coalesce("last.type", F.lit("EVENT")).alias("type"),
            F.col("last.chunk_id").alias("source_chunk_id"),
            "node_seq",
        )
    )


def merge_edges(relations: DataFrame) -> DataFrame:
    """One edge per (source, target) whatever its type; the last mention decides."""
    return (
        relations.groupBy(*_EDGE)
        .agg(
            F.max_by(F.struct("type", "confidence", "chunk_id"), "seq").alias("last"),
            F.min("seq").alias("edge_seq"),
        )
        .select(
            *_EDGE,
            "last.type",
            "last.confidence",
            F.col("last.chunk_id").alias("evidence_chunk_id"),
            "edge_seq",
        )
    )


def upsert_nodes(entities: DataFrame) -> DataFrame:
    """One node per name, accumulated: the first mention decides the type.

    Every type seen becomes a label. The chunks of a node can be a third of all chunks,
    so they stay rows (``node_sources``) and only their number is kept here.
    """
    return (
        entities.groupBy(*_NODE)
        .agg(
            F.min_by(F.struct("type", "chunk_id"), "seq").alias("first"),
            F.min("seq").alias("node_seq"),
            F.array_sort(F.collect_set("type")).alias("labels"),
            F.count("*").alias("source_chunks"),
        )
        .select(
            *_NODE,
            "first.type",
            F.col("first.chunk_id").alias("source_chunk_id"),
            "node_seq",
            "labels",
            "source_chunks",
        )
    )


def node_sources(entities: DataFrame) -> DataFrame:
    """Chunks that mention each node, in order of ``seq``."""
    return entities.select(*_NODE, "chunk_id", "seq")


def upsert_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per (source, target, type), first mention wins, both ends already known.

    A mention counts only after the first mention of both ends. Almost always the very
    first one does, so the facts are aggregated first and only keys whose first mention
    came too early are looked at mention by mention.
    """
    key = [*_EDGE, "type"]
    known = nodes.select("investigation_id", "name", "node_seq")
    ends = lambda side, seq: known.select(
        "investigation_id", F.col("name").alias(side), F.col("node_seq").alias(seq)
    )
    first = F.min_by(F.struct("confidence", "chunk_id"), "seq").alias("first")
    firsts = relations.groupBy(*key).agg(first, F.min("seq").alias("edge_seq"))
    placed = (
        firsts.join(ends("source", "source_seq"), ["investigation_id", "source"])
        .join(ends("target", "target_seq"), ["investigation_id", "target"])
        .withColumn("known_from", F.greatest("source_seq", "target_seq"))
    )
    on_time = placed.filter(F.col("edge_seq") > F.col("known_from")).select(
        *key, "first", "edge_seq"
    )
    early = placed.filter(~(F.col("edge_seq") > F.col("known_from"))).select(*key, "known_from")
    late = (
        relations.join(early, key)
        .filter(F.col("seq") > F.col("known_from"))
        .groupBy(*key)
        .agg(first, F.min("seq").alias("edge_seq"))
    )
    return on_time.unionByName(late).select(
        *key, "first.confidence", F.col("first.chunk_id").alias("evidence_chunk_id"), "edge_seq"
    )


def merge(
    entities: DataFrame, relations: DataFrame, mode: str = "last_wins"
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges in either merge mode; the caller chooses, nothing is guessed."""
    if mode == "last_wins":
        return merge_nodes(entities, relations), merge_edges(relations)
    if mode == "accumulate":
        nodes = upsert_nodes(entities)
        return nodes, upsert_edges(relations, nodes)
    raise ValueError(f"unknown merge mode: {mode}")


def placeholder_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relation ends that no entity mention names."""
    ends = relations.select(
        "investigation_id", F.explode(F.array("source", "target")).alias("name")
    ).distinct()
    return ends.join(entities.select(*_NODE).distinct(), _NODE, "left_anti")


def resolved_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose two ends are both nodes."""
    names = nodes.select("investigation_id", "name")
    for side in ("source", "target"):
        relations = relations.join(
            names.withColumnRenamed("name", side), ["investigation_id", side], "left_semi"
        )
    return relations


def export_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.concat_ws("/", "investigation_id", "name").alias("id"),
        "investigation_id",
        "name",
        F.coalesce("type", F.lit("EVENT")).alias("type"),
        "source_chunk_id",
    )


def export_edges(edges: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Edges with defaults; the persisted graph also replaces a confidence of zero.

    The id names the type too: an accumulated graph has an edge for each type of a pair.
    """
    confidence = F.col("confidence")
    if zero_is_missing:
        confidence = F.nullif(confidence, F.lit(0.0))
    kind = F.coalesce("type", F.lit("RELATED_TO"))
    return edges.select(
        F.concat(F.col("source"), F.lit("->"), F.col("target"), F.lit(":"), kind).alias("id"),
        *_EDGE,
        kind.alias("type"),
        F.coalesce(confidence, F.lit(0.5)).alias("confidence"),
        "evidence_chunk_id",
    )


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("investigation_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("investigation_id").agg(F.count("*").alias("edges"))
    return n.join(e, "investigation_id", "left").select(
        "investigation_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges")
    )


def scope(table: DataFrame, investigation_id: str) -> DataFrame:
    """Rows of one investigation; prunes partitions of a partitioned table."""
    return table.filter(F.col("investigation_id") == investigation_id)


def edges_of(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges that touch a selected node, each once.

    Two equi-joins; an OR in one join condition would force a nested loop. A self-loop
    is already found through its source.
    """
    by_source = edges.join(
        selected.select("investigation_id", F.col("name").alias("source")),
        ["investigation_id", "source"],
        "left_semi",
    )
    by_target = edges.join(
        selected.select("investigation_id", F.col("name").alias("target")),
        ["investigation_id", "target"],
        "left_semi",
    ).join(
        selected.select("investigation_id", F.col("name").alias("source")),
        ["investigation_id", "source"],
        "left_anti",
    )
    return by_source.select(edges.columns).unionByName(by_target.select(edges.columns))


def grams(lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths of the lower-cased name."""
    lower = F.lower("name")

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(lower) - (n - 1), F.lit(1)))
        return F.when(
            F.length(lower) >= n, F.transform(starts, lambda i: F.substring(lower, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    parts = [of_length(n) for n in lengths]
    return F.array_distinct(F.concat(*parts))


def nodes_with_keyword(nodes: DataFrame, keywords: DataFrame, lengths: list[int]) -> DataFrame:
    """Pairs of node and keyword where the name contains the keyword.

    ``keywords(investigation_id, keyword, gram)`` carries the first letters of each
    keyword. Joining them with the equally long substrings of the names is an equi-join
    that finds every candidate, so keywords are never paired with all nodes.
    """
    parts = nodes.select("*", F.explode(grams(lengths)).alias("gram"))
    return (
        parts.join(keywords, ["investigation_id", "gram"])
        .filter(F.contains(F.lower("name"), F.col("keyword")))
        .drop("gram")
    )


def search_nodes(nodes: DataFrame, searches: DataFrame) -> DataFrame:
    """Nodes whose name contains a searched text, whatever its case and length."""
    keyword = F.lower("text")
    keywords = searches.select(
        "investigation_id",
        "text",
        keyword.alias("keyword"),
        F.substring(keyword, 1, 3).alias("gram"),
    )
    names = nodes.select("investigation_id", "name", "type")
    short = nodes_with_keyword(names, keywords.filter(F.length("gram") < 3), [1, 2])
    long = nodes_with_keyword(names, keywords.filter(F.length("gram") == 3), [3])
    return short.unionByName(long).drop("keyword")
