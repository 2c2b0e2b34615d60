"""Bounded walks over the graph, for all starts of all investigations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway import fixed_values as fv
from causeway.session import materialize

_FEW = 100_000  # hubs that are broadcast


def _order_key(tie_break: str) -> Column:
    if tie_break not in ("insertion", "name"):
        raise ValueError(f"unknown tie break: {tie_break}")
    return F.col("node_seq") if tie_break == "insertion" else F.col("name")


def _hubs(steps: DataFrame, hub: int) -> DataFrame | None:
    """``parts`` of each node with over ``hub`` steps, none if there is no such node.

    There are at most a ``hub``-th as many as steps; up to 100,000 are broadcast, which is checked.
    """
    found = materialize(
        steps.groupBy("investigation_id", "node").count()
        .filter(F.col("count") > hub)
        .select("investigation_id", "node", F.ceil(F.col("count") / hub).cast("int").alias("parts"))
    )
    many = found.limit(_FEW + 1).count()
    if many == 0:
        return None
    return F.broadcast(found) if many <= _FEW else found


def _dealt(steps: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Steps with the ``part`` of their node that they fall into, 0 for all but hubs."""
    if hubs is None:
        return steps.withColumn("part", F.lit(0))
    part = F.pmod(F.xxhash64("cause"), F.coalesce("parts", F.lit(1))).cast("int")
    return steps.join(hubs, ["investigation_id", "node"], "left").withColumn("part", part).drop("parts")


def _stepped(level: DataFrame, steps: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """One step on from each row of ``level``; those at a hub meet each of its parts."""
    if hubs is None:
        level = level.withColumn("part", F.lit(0))
    else:
        last = F.coalesce("parts", F.lit(1)) - 1
        level = level.join(hubs, ["investigation_id", "node"], "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0), last))
        ).drop("parts")
    return level.join(steps, ["investigation_id", "node", "part"])


def upstream(
    nodes: DataFrame,
    edges: DataFrame,
    starts: DataFrame,
    hops: int = fv.HOPS,
    edge_types: list[str] | None = None,
    tie_break: str = "insertion",
    hub: int = 100_000,
) -> DataFrame:
    """Nodes that lead to each start within ``hops`` edges, without the start itself.

    ``starts(investigation_id, start)``. The result has ``hop``, the distance, and
    ``reach``, which sorts the nodes of a hop in breadth-first order: by the node they
    were reached from, then by their own position in the graph.

    Levels are joins, one row per (start, node), each written once. A node that is met
    again is dropped in the aggregation of the level that meets it, where what was reached
    before takes part as bare keys, and the walk does not go on from it. Nodes with over
    ``hub`` incoming edges are split: their edges fall into parts of about that size, and
    the frontier meets each part.
    """
    if edge_types is not None:
        edges = edges.filter(F.col("type").isin(edge_types))
    order = nodes.select(
        "investigation_id", F.col("name").alias("cause"), _order_key(tie_break).alias("cause_key")
    )
    steps = edges.select(
        "investigation_id", F.col("target").alias("node"), F.col("source").alias("cause")
    )
    hubs = _hubs(steps, hub)
    steps = _dealt(steps, hubs).join(order, ["investigation_id", "cause"])

    pair = ["investigation_id", "start", "node"]
    reached = order.limit(0).select(
        "investigation_id", F.col("cause").alias("start"), F.col("cause").alias("node"),
        F.lit(0).alias("hop"), F.array("cause_key").alias("reach"),
    )
    level = starts.select(
        "investigation_id", "start", F.col("start").alias("node"), F.array().alias("reach")
    )
    for hop in range(1, hops + 1):
        own = F.array("cause_key")
        reach = own if hop == 1 else F.concat("reach", own)
        met = (
            _stepped(level, steps, hubs)
            .select("investigation_id", "start", F.col("cause").alias("node"), reach.alias("reach"), F.lit(hop).alias("hop"))
            .filter(F.col("node") != F.col("start"))
        )
        if hop > 1:
            known = reached.withColumn("reach", F.lit(None).cast(reached.schema["reach"].dataType))
            met = met.unionByName(known)
        level = (
            met.groupBy(*pair)
            .agg(F.min(F.struct("hop", "reach")).alias("nearest"))
            .filter(F.col("nearest.hop") == hop)
            .select(*pair, "nearest.hop", "nearest.reach")
        )
        if hop < hops:
            level = materialize(level)
        reached = level if hop == 1 else reached.unionByName(level)
    return reached


def path_steps(found: DataFrame) -> DataFrame:
    """The path of each start as rows, numbered from its farthest cause; the start is last.

    However many causes a start has, no row holds them together.
    """
    far_first = Window.partitionBy("investigation_id", "start").orderBy(F.col("hop").desc(), F.col("reach").desc())
    causes = found.select(
        "investigation_id", "start", F.row_number().over(far_first).cast("bigint").alias("step"), F.col("node").alias("name")
    )
    ends = found.groupBy("investigation_id", "start").agg((F.count("*") + 1).alias("step"))
    return causes.unionByName(ends.withColumn("name", F.col("start")))


def causal_paths(found: DataFrame) -> DataFrame:
    """The path of each start as one array, for starts that were chosen for show.

    As ``path_steps``; the array holds everything upstream of its start.
    """
    far_first = F.sort_array(F.collect_list(F.struct("hop", "reach", "node")), asc=False)
    return found.groupBy("investigation_id", "start").agg(
        F.array_append(F.transform(far_first, lambda s: s["node"]), F.first("start")).alias("path")
    )


def path_heads(found: DataFrame) -> DataFrame:
    """Length and first node of each path, without building the path."""
    return found.groupBy("investigation_id", "start").agg(
        (F.count("*") + 1).alias("length"),
        F.max_by("node", F.struct("hop", "reach")).alias("head"),
    )


def paths_from(
    edges: DataFrame, starts: DataFrame, hops: int = fv.HOPS, limit: int = 25
) -> DataFrame:
    """The first ``limit`` forward paths of 1 to ``hops`` edges from each start.

    No edge occurs twice in a path. Paths are ordered by length, then by names and
    types, so only the first few edges of a node can matter (one more per hop, since an
    edge already used is passed over) and the enumeration stays small at a hub too.
    """
    first_edges = Window.partitionBy("investigation_id", "source").orderBy("target", "type")
    steps = (
        edges.select("investigation_id", "source", "target", "type")
        .withColumn("nth", F.row_number().over(first_edges))
        .filter(F.col("nth") <= limit + hops)
        .select(
            "investigation_id",
            F.col("source").alias("at"),
            F.col("target").alias("next"),
            F.col("type").alias("via"),
        )
    )
    level = starts.select(
        "investigation_id",
        "start",
        F.col("start").alias("at"),
        F.array("start").alias("names"),
        F.array().cast("array<string>").alias("types"),
        F.array().cast("array<string>").alias("used"),
    )
    levels = []
    for hop in range(1, hops + 1):
        edge = F.to_json(F.array("at", "next", "via"))
        level = (
            level.join(steps, ["investigation_id", "at"])
            .filter(~F.array_contains("used", edge))
            .select(
                "investigation_id",
                "start",
                F.col("next").alias("at"),
                F.array_append("names", F.col("next")).alias("names"),
                F.array_append("types", F.col("via")).alias("types"),
                F.array_append("used", edge).alias("used"),
            )
        )
        levels.append(level.withColumn("hops", F.lit(hop)))
    found = levels[0]
    for further in levels[1:]:
        found = found.unionByName(further)
    best = Window.partitionBy("investigation_id", "start").orderBy("hops", "names", "types")
    return (
        found.withColumn("path_seq", F.row_number().over(best))
        .filter(F.col("path_seq") <= limit)
        .select("investigation_id", "start", "path_seq", "hops", "names", "types")
    )
