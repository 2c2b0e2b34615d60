"""PageRank kept up to date: only what changed edges reach is worked out again.

The ranks x of ``centrality`` (mass flows from effect to cause) satisfy x = d * A * x + b * u,
where b gathers restarts and dangling mass. b is one number for each investigation, so x is a
multiple of the weights

    w = 1 + d * A * w,        x = w / (sum of w over the investigation)

which depend neither on the number of nodes nor on dangling ones: a new node or edge changes the
weights of what lies upstream of it and nothing else. Stored with every node are its weight and
its residual r = 1 + d * A * w - w. A change of the graph changes residuals at the causes of the
effects whose edges changed; pushing a residual (w += r, and d * r / degree to each cause) until
none is above ``tolerance`` gives the new weights. Each is then at most
tolerance * N / (1 - d) off in total.

A store is a folder with ``weights`` and ``links``, laid out by investigation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway import fixed_values as fv
from causeway.operators.centrality import _known
from causeway.session import materialize
from causeway.sources.tables import stored

_NODE = ["investigation_id", "name"]
_EDGE = ["investigation_id", "source", "target"]
_WEIGHTS = "name string, weight double, residual double, pushes int, investigation_id string"
_LINKS = "source string, target string, investigation_id string"
_NAMED = 4096  # investigations named in a filter; more are met by a join


def _of(table: DataFrame, touched: list[str] | DataFrame) -> DataFrame:
    if isinstance(touched, list):
        return table.filter(F.col("investigation_id").isin(touched))
    return table.join(touched, "investigation_id", "left_semi")


def update_ranks(
    nodes: DataFrame,
    edges: DataFrame,
    path: str,
    damping: float = fv.DAMPING,
    tolerance: float = 1e-9,
    small_bytes: int = 64 << 20,
    batch: int = 5,
    hub: int = 1_000_000,
    max_rounds: int = 1000,
) -> None:
    """Bring the store in ``path`` up to the graph of the investigations that ``nodes`` names.

    ``nodes(investigation_id, name)`` and ``edges(investigation_id, source, target)`` are these
    investigations' whole graph, as an ingest leaves it; edges to other names count for nothing.
    Investigations that ``nodes`` does not name keep what is stored, and none of it is read.
    Graphs of up to ``small_bytes`` are pushed within a task, one after another; larger ones in
    rounds of joins, in which the links of nodes with over ``hub`` of them are spread. Either
    way work is done for nodes with a residual alone. ``pushes`` of a node says how often it
    was, in the last update.
    """
    spark = nodes.sparkSession
    asked = nodes.select("investigation_id").distinct()
    names = [r.investigation_id for r in asked.limit(_NAMED + 1).collect()]
    if not names:
        return
    touched = names if len(names) <= _NAMED else materialize(asked)
    old_weights = stored(spark, f"{path}/weights", spark.createDataFrame([], _WEIGHTS).schema)
    old_links = stored(spark, f"{path}/links", spark.createDataFrame([], _LINKS).schema)
    if old_weights is None:
        old_weights, old_links = spark.createDataFrame([], _WEIGHTS), spark.createDataFrame([], _LINKS)
    links = materialize(_known(nodes, edges).select(*_EDGE))
    both = (
        links.withColumn("is_new", F.lit(True))
        .join(_of(old_links, touched).filter("source IS NOT NULL").withColumn("is_old", F.lit(True)), _EDGE, "full")
        .select(*_EDGE, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_old", "is_new")])
    )
    start = (
        nodes.select(*_NODE).distinct().withColumn("here", F.lit(True))
        .join(_of(old_weights, touched), _NODE, "full")
        .select(
            *_NODE, F.coalesce("here", F.lit(False)).alias("here"),
            F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("residual", F.lit(1.0)).alias("residual"),
        )
    )
    both, start = materialize(both), materialize(start)
    sizes = (
        start.select("investigation_id", (F.octet_length("name") + 32).alias("bytes"))
        .unionByName(both.select("investigation_id", (F.octet_length("source") + F.octet_length("target") + 32).alias("bytes")))
        .groupBy("investigation_id")
        .agg(F.sum("bytes").alias("bytes"))
    )
    large = materialize(sizes.filter(F.col("bytes") > small_bytes).select("investigation_id"))
    if large.isEmpty():
        solved = _pushed_small(start, both, damping, tolerance, max_rounds)
    else:
        parts = [t.join(large, "investigation_id", how) for how in ("left_semi", "left_anti") for t in (start, both)]
        solved = _pushed_large(*parts[:2], damping, tolerance, batch, hub, max_rounds).unionByName(
            _pushed_small(*parts[2:], damping, tolerance, max_rounds)
        )
    _replace(materialize(solved), f"{path}/weights")
    nothing = F.lit(None).cast("string")  # so that an investigation without links is written, too
    none = asked.select("investigation_id", nothing.alias("source"), nothing.alias("target"))
    _replace(links.unionByName(none), f"{path}/links")


def _replace(rows: DataFrame, path: str) -> None:
    """Write the folders of the investigations in ``rows`` anew, and no others."""
    rows.hint("rebalance", "investigation_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("investigation_id").parquet(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``(investigation_id, name, score)``; without edges all scores of an investigation are 0."""
    weights = spark.read.schema(_WEIGHTS).parquet(f"{path}/weights")
    total = weights.groupBy("investigation_id").agg(F.sum("weight").alias("total"))
    links = spark.read.schema(_LINKS).parquet(f"{path}/links").filter("source IS NOT NULL")
    linked = links.select("investigation_id").distinct().withColumn("linked", F.lit(True))
    share = F.when(F.col("linked"), F.col("weight") / F.col("total")).otherwise(F.lit(0.0))
    return weights.join(total, "investigation_id").join(linked, "investigation_id", "left").select(*_NODE, share.alias("score"))


def _pushed_small(start: DataFrame, both: DataFrame, damping: float, tolerance: float, max_rounds: int) -> DataFrame:
    def solve(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(nodes["name"])
        here, weight = nodes["here"].to_numpy(), nodes["weight"].to_numpy().copy()
        residual = nodes["residual"].to_numpy().copy()
        pushes = np.zeros(len(names), dtype=np.int32)
        cause, effect = names.get_indexer(pairs["source"]), names.get_indexer(pairs["target"])
        old, new = pairs["is_old"].to_numpy(bool), pairs["is_new"].to_numpy(bool)
        degrees = [np.bincount(effect[s], minlength=len(names)) for s in (old, new)]
        turned = np.zeros(len(names), dtype=bool)
        turned[effect[old != new]] = True
        at = turned[effect]
        shares = [s / np.maximum(n, 1)[effect] for s, n in zip((old, new), degrees)]
        shift = damping * weight[effect] * (shares[1] - shares[0])
        residual += np.bincount(cause[at], weights=shift[at], minlength=len(names))
        order = np.argsort(effect[new], kind="stable")
        cause, effect = cause[new][order], effect[new][order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(effect, minlength=len(names)))])
        for _ in range(max_rounds):
            active = np.flatnonzero(here & (np.abs(residual) > tolerance))
            if not len(active):
                break
            move = residual[active]
            weight[active] += move
            residual[active] = 0.0
            pushes[active] += 1
            n = np.diff(bounds)[active]
            links = np.repeat(bounds[active] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            np.add.at(residual, cause[links], np.repeat(damping * move / np.maximum(n, 1), n))
        else:
            raise RuntimeError(f"no convergence in {max_rounds} rounds")
        out = nodes[_NODE].assign(weight=weight, residual=residual, pushes=pushes)
        return out[here]

    return (
        start.groupBy("investigation_id")
        .cogroup(both.groupBy("investigation_id"))
        .applyInPandas(solve, "investigation_id string, name string, weight double, residual double, pushes int")
    )


def _pushed_large(
    start: DataFrame, both: DataFrame, damping: float, tolerance: float, batch: int, hub: int, max_rounds: int
) -> DataFrame:
    """Rounds of join and sum over the nodes with a residual; what has none takes no part."""
    key = ["investigation_id", "node"]

    def degree(flag: str) -> DataFrame:
        return both.filter(flag).groupBy("investigation_id", F.col("target").alias("node")).agg(F.count("*").alias(flag))

    degrees = materialize(
        degree("is_old").join(degree("is_new"), key, "full").select(
            *key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("is_old", "is_new")]
        )
    )
    turned = both.filter("is_old <> is_new").select("investigation_id", F.col("target").alias("node")).distinct()
    weights = start.select("investigation_id", F.col("name").alias("node"), "weight")
    told = turned.join(degrees, key).join(weights, key).select(
        *key, F.col("is_old").alias("n_old"), F.col("is_new").alias("n_new"), "weight"
    )
    share = [F.when(F.col(f), F.lit(damping) * F.col("weight") / F.col(n)).otherwise(F.lit(0.0)) for f, n in (("is_new", "n_new"), ("is_old", "n_old"))]
    shifts = both.withColumnRenamed("target", "node").join(told, key).select(
        "investigation_id", F.col("source").alias("node"), (share[0] - share[1]).alias("r")
    )
    residuals = start.filter("here").select("investigation_id", F.col("name").alias("node"), F.col("residual").alias("r"))
    salts = F.ceil(F.greatest("is_new", F.lit(1)) / hub).cast("int")
    fan = degrees.select(*key, F.col("is_new").alias("degree"), salts.alias("salts"))
    links = both.filter("is_new").select("investigation_id", F.col("target").alias("node"), F.col("source").alias("next"))
    links = materialize(links.join(fan, key).withColumn("salt", F.pmod(F.xxhash64("next"), "salts").cast("int")))

    def summed(rows: DataFrame, value: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.sum(value).alias(value))

    live = summed(residuals.unionByName(shifts), "r").join(
        start.filter("here").select("investigation_id", F.col("name").alias("node")), key, "left_semi"
    )
    live = materialize(live)
    fan = materialize(fan.select(*key, "salts"))
    pushed, rounds = [], 0
    active = F.abs("r") > tolerance
    while not live.filter(active).isEmpty():
        if rounds >= max_rounds:
            raise RuntimeError(f"no convergence in {max_rounds} rounds")
        layers = [live.filter(active)]
        for _ in range(batch):
            spread = layers[-1].join(fan, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            moved = links.join(spread.select(*key, "salt", "r"), [*key, "salt"]).select(
                "investigation_id", F.col("next").alias("node"), (F.lit(damping) * F.col("r") / F.col("degree")).alias("r")
            )
            layers.append(summed(moved, "r"))
        done = [layer.select(*key, F.col("r").alias("move"), F.lit(0.0).alias("r"), F.lit(1).alias("times")) for layer in layers[:-1]]
        rest = [
            t.select(*key, F.lit(0.0).alias("move"), "r", F.lit(0).alias("times"))
            for t in (layers[-1], live.filter(~active))
        ]
        every = done + rest
        total = every[0]
        for more in every[1:]:
            total = total.unionByName(more)
        step = materialize(total.groupBy(*key).agg(F.sum("move").alias("move"), F.sum("r").alias("r"), F.sum("times").alias("times")))
        pushed.append(step.filter("times > 0").select(*key, "move", "times"))
        live = step.select(*key, "r")
        rounds += batch
    moves = start.select("investigation_id", F.col("name").alias("node"), F.lit(0.0).alias("move"), F.lit(0).cast("long").alias("times")).limit(0)
    for step in pushed:
        moves = moves.unionByName(step)
    moves = moves.groupBy(*key).agg(F.sum("move").alias("move"), F.sum("times").alias("times"))
    return (
        start.filter("here").withColumnRenamed("name", "node").drop("residual")
        .join(moves, key, "left")
        .join(live, key, "left")
        .select(
            "investigation_id", F.col("node").alias("name"),
            (F.col("weight") + F.coalesce("move", F.lit(0.0))).alias("weight"),
            F.coalesce("r", F.lit(0.0)).alias("residual"),
            F.coalesce("times", F.lit(0)).cast("int").alias("pushes"),
        )
    )
