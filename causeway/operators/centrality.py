"""PageRank on the reversed graph: mass flows from effect to cause.

With damping d, N nodes and uniform restart, a round of the power iteration is

    x[t+1] = d * A * x[t] + b[t] * u,    u = 1/N,    b[t] = 1 - d + d * dangling(x[t])

where A spreads the rank of a node evenly over its links and ``dangling`` sums the rank
of nodes without any. Only A acts on single nodes; the rest adds the same amount to every
node of an investigation. From the ranks x[s] at the start of a batch of rounds, with
y[0] = x[s] and y[k+1] = d * A * y[k], and with w[0] = u and w[k+1] = d * A * w[k],

    x[s+k] = y[k] + sum over j < k of b[s+k-1-j] * w[j]

So the rounds of a batch need only one join and one sum over the links each, no total over
an investigation; the amounts b are worked out once for each batch, from one row per
investigation. The w of the first batch serve all others, so that what a batch carries and
the size of its plan do not depend on how many batches there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway import fixed_values as fv
from causeway.session import materialize

_KEY = ["investigation_id", "node"]
_RESULT = "investigation_id string, name string, score double, rounds int"


def _known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between nodes of the graph; an edge to any other name has no part in it."""
    names = nodes.select("investigation_id", "name")
    pairs = edges.select("investigation_id", "source", "target").distinct()
    for side in ("source", "target"):
        pairs = pairs.join(names.withColumnRenamed("name", side), ["investigation_id", side], "left_semi")
    return pairs


def _start(nodes: DataFrame, edges: DataFrame, damping: float) -> DataFrame:
    """Per node: number of links, damping share per link, nodes in the graph, and u = 1/N."""
    links = edges.groupBy("investigation_id", F.col("target").alias("name")).agg(F.count("*").alias("degree"))
    size = nodes.groupBy("investigation_id").agg(F.count("*").alias("n"))
    return (
        nodes.select("investigation_id", "name")
        .join(links, ["investigation_id", "name"], "left")
        .join(size, "investigation_id")
        .select(
            "investigation_id",
            F.col("name").alias("node"),
            F.coalesce("degree", F.lit(0)).alias("degree"),
            (F.lit(damping) / F.col("degree")).alias("share"),
            (F.lit(1.0) / F.col("n")).alias("u"),
        )
    )


def _links(edges: DataFrame, start: DataFrame, hub: int) -> DataFrame:
    """Links effect -> cause, plus one row per node that carries its own values on.

    Every link has a salt; only the links of nodes with over ``hub`` of them get several.
    """
    parts = start.select(*_KEY, F.ceil(F.greatest("degree", F.lit(1)) / hub).cast("int").alias("parts"))
    reverse = edges.select(
        "investigation_id", F.col("target").alias("node"), F.col("source").alias("next")
    ).join(parts, _KEY)
    salted = reverse.select(
        *_KEY, "next", F.pmod(F.xxhash64("next"), "parts").cast("int").alias("salt"), F.lit(False).alias("own")
    )
    own = start.select(*_KEY, F.col("node").alias("next"), F.lit(0).alias("salt"), F.lit(True).alias("own"))
    return salted.unionByName(own)


def _propagate(links: DataFrame, state: DataFrame, first: str, name: str, rounds: int, hub: int) -> DataFrame:
    """Columns ``name``0 (= ``first``) to ``name``rounds per node, as one job without a barrier.

    The shuffle of ``links`` is the same in every round and is reused; a round shuffles
    only partial sums.
    """
    salts = F.explode(F.sequence(F.lit(0), F.ceil(F.greatest("degree", F.lit(1)) / hub).cast("int") - 1))
    links = links.filter(F.col("next").isNotNull())
    state = state.select(*_KEY, "share", "degree", F.col(first).alias(f"{name}0"))
    for t in range(rounds):
        carried = ["share", "degree", *[f"{name}{k}" for k in range(t + 1)]]
        moved = links.join(state.select("*", salts.alias("salt")), [*_KEY, "salt"]).select(
            "investigation_id",
            F.col("next").alias("node"),
            F.when(~F.col("own"), F.col("share") * F.col(f"{name}{t}")).alias("mass"),
            *[F.when(F.col("own"), F.col(c)).alias(c) for c in carried],
        )
        state = moved.groupBy(*_KEY).agg(
            *[F.max(c).alias(c) for c in carried],
            F.coalesce(F.sum("mass"), F.lit(0.0)).alias(f"{name}{t + 1}"),
        )
    return state


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _restarts(terms: DataFrame, rounds: int, damping: float) -> DataFrame:
    """Per investigation: nodes, links, and the restart amounts of each round of a batch."""

    def dangling(name: str) -> Column:
        lost = [F.sum(F.when(F.col("degree") == 0, F.col(f"{name}{t}"))) for t in range(rounds)]
        return F.array(*[F.coalesce(x, F.lit(0.0)) for x in lost])

    totals = terms.groupBy("investigation_id").agg(
        F.count("*").alias("n"), F.sum("degree").alias("links"), dangling("y").alias("q"), dangling("w").alias("p")
    )
    amounts = F.aggregate(
        F.sequence(F.lit(0), F.lit(rounds - 1)),
        F.array().cast("array<double>"),
        lambda b, t: F.array_append(
            b,
            F.lit(1.0 - damping)
            + F.lit(damping)
            * (F.get(F.col("q"), t) + _dot(F.reverse(b), F.slice(F.col("p"), F.lit(1), t))),
        ),
    )
    return totals.select("investigation_id", "n", "links", amounts.alias("b"))


def _large(
    nodes: DataFrame,
    edges: DataFrame,
    rounds: int | None,
    damping: float,
    tolerance: float,
    max_rounds: int,
    batch: int,
    hub: int,
) -> DataFrame:
    """Rounds in batches, each written once; investigations that have settled leave."""
    start = materialize(_start(nodes, edges, damping))
    links = materialize(_links(edges, start, hub))
    linked = links.filter(~F.col("own")).select("investigation_id").distinct()
    state = start.join(linked, "investigation_id", "left_semi")
    idle = start.join(linked, "investigation_id", "left_anti").select(
        "investigation_id", F.col("node").alias("name"), F.lit(0.0).alias("score"), F.lit(0).alias("rounds")
    )
    limit = max_rounds if rounds is None else rounds
    if limit == 0:
        return idle.unionByName(_scores(state, F.col("u"), F.lit(0)))
    size = min(batch, limit)
    terms = materialize(_propagate(links, state, "u", "w", size, hub))
    names = [f"w{t}" for t in range(size + 1)]
    powers = terms.select(*_KEY, *names[:-1])
    terms = terms.select("*", *[F.col(w).alias(w.replace("w", "y")) for w in names])
    results, done = idle, 0
    while True:
        size = min(size, limit - done)
        restarts = materialize(_restarts(terms, size, damping))
        ys = F.array(*[F.col(f"y{t}") for t in range(size + 1)])
        ws = F.array(*[F.col(f"w{t}") for t in range(size)])
        ranks = F.transform(
            F.sequence(F.lit(0), F.lit(size)),
            lambda t: F.get(F.col("ys"), t) + _dot(F.reverse(F.slice("b", F.lit(1), t)), F.slice("ws", F.lit(1), t)),
        )
        scored = materialize(
            terms.select(*_KEY, "share", "degree", ys.alias("ys"), ws.alias("ws"))
            .join(restarts, "investigation_id")
            .select(*_KEY, "share", "degree", ranks.alias("x"))
        )
        done += size
        if rounds is None:
            changes = [
                F.sum(F.abs(F.get("x", F.lit(t)) - F.get("x", F.lit(t - 1)))) for t in range(1, size + 1)
            ]
            settled = F.transform("changes", lambda c: c < F.col("n") * F.lit(tolerance))
            stops = materialize(
                scored.groupBy("investigation_id")
                .agg(F.count("*").alias("n"), F.array(*changes).alias("changes"))
                .select("investigation_id", F.array_position(settled, True).cast("int").alias("stop"))
            )
            at = stops.filter("stop > 0")
            found = scored.join(at, "investigation_id")
            results = results.unionByName(
                _scores(found, F.get("x", F.col("stop")), F.col("stop") + F.lit(done - size))
            )
            open_ = stops.filter("stop = 0").select("investigation_id")
            left = open_.count()
            if not left:
                return results
            if done >= limit:
                raise RuntimeError(f"{left} investigations did not converge in {done} rounds")
            scored = scored.join(open_, "investigation_id", "left_semi")
        elif done == limit:
            return results.unionByName(_scores(scored, F.get("x", F.lit(size)), F.lit(limit)))
        last = scored.select(*_KEY, "share", "degree", F.get("x", F.lit(size)).alias("x"))
        moved = _propagate(links, last, "x", "y", min(size, limit - done), hub)
        terms = materialize(moved.join(powers, _KEY))


def _scores(rows: DataFrame, score: Column, rounds: Column) -> DataFrame:
    return rows.select(
        "investigation_id", F.col("node").alias("name"), score.alias("score"), rounds.cast("int").alias("rounds")
    )


def _small(
    nodes: DataFrame,
    edges: DataFrame,
    rounds: int | None,
    damping: float,
    tolerance: float,
    max_rounds: int,
) -> DataFrame:
    """One task step per investigation, for graphs whose size was checked."""

    def scores(names: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        size = len(names)
        if not len(pairs):
            return names[["investigation_id", "name"]].assign(score=0.0, rounds=0)
        place = pd.Index(names["name"])
        cause, effect = place.get_indexer(pairs["source"]), place.get_indexer(pairs["target"])
        degree = np.bincount(effect, minlength=size)
        share = damping / np.maximum(degree, 1)
        x, done = np.full(size, 1.0 / size), 0
        for done in range(1, (max_rounds if rounds is None else rounds) + 1):
            mass = np.bincount(cause, weights=(x * share)[effect], minlength=size)
            restart = (1.0 - damping + damping * x[degree == 0].sum()) / size
            change = np.abs(mass + restart - x).sum()
            x = mass + restart
            if rounds is None and change < size * tolerance:
                break
        else:
            if rounds is None:
                raise RuntimeError(f"no convergence in {max_rounds} rounds")
        return names[["investigation_id", "name"]].assign(score=x, rounds=done)

    return (
        nodes.select("investigation_id", "name")
        .groupBy("investigation_id")
        .cogroup(edges.groupBy("investigation_id"))
        .applyInPandas(scores, _RESULT)
    )


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    rounds: int | None = None,
    damping: float = fv.DAMPING,
    tolerance: float = fv.TOLERANCE,
    max_rounds: int = fv.MAX_ROUNDS,
    small_bytes: int = 64 << 20,
    batch: int = 5,
    hub: int = 1_000_000,
) -> DataFrame:
    """``(investigation_id, name, score, rounds)`` for all investigations.

    Each investigation stops at the first round that changes its scores by less than
    ``N * tolerance`` in total, or after a fixed number of ``rounds``; after none, every
    score is 1/N. Without edges all its scores are 0. Edges to names that are not among
    the nodes are left out.

    Graphs of up to ``small_bytes`` are solved whole, all after one shuffle. Larger ones,
    if the sizes show any, go through rounds of joins, where no task holds a whole graph.
    Both follow these rules and compute the same numbers.
    """
    edges = _known(nodes, edges)
    weights = nodes.select("investigation_id", (F.octet_length("name") + 16).alias("bytes")).unionByName(
        edges.select("investigation_id", (F.octet_length("source") + F.octet_length("target") + 32).alias("bytes"))
    )
    sizes = weights.groupBy("investigation_id").agg(F.sum("bytes").alias("bytes"))
    large = materialize(sizes.filter(F.col("bytes") > small_bytes).select("investigation_id"))
    if large.isEmpty():
        return _small(nodes, edges, rounds, damping, tolerance, max_rounds)

    def only(table: DataFrame, how: str) -> DataFrame:
        return table.join(large, "investigation_id", how)

    big = only(nodes, "left_semi"), only(edges, "left_semi")
    result = _large(*big, rounds, damping, tolerance, max_rounds, batch, hub)
    rest = only(nodes, "left_anti"), only(edges, "left_anti")
    return result.unionByName(_small(*rest, rounds, damping, tolerance, max_rounds))


def ranked_nodes(scores: DataFrame, nodes: DataFrame, tie_break: str = "insertion") -> DataFrame:
    """Every node with its rank in its investigation: by score, then by position in the graph.

    Scores are compared to nine digits, since the order of a distributed sum varies. The
    nodes are sorted over all tasks in ranges; a rank is the place in its range after the
    number of nodes in earlier ranges, so that no task holds a whole investigation.
    """
    tie = "node_seq" if tie_break == "insertion" else "name"
    order = [F.col("investigation_id"), F.col("compared").desc(), F.col(tie)]
    ranges = materialize(
        scores.join(nodes.select("investigation_id", "name", "node_seq"), ["investigation_id", "name"])
        .withColumn("compared", F.round("score", 9))
        .repartitionByRange(*order)
        .withColumn("range", F.spark_partition_id())
    )
    counts = ranges.groupBy("investigation_id", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("investigation_id").orderBy("range")
    before = counts.select(
        "investigation_id", "range", (F.sum("n").over(earlier) - F.col("n")).alias("before")
    )
    within = Window.partitionBy("investigation_id", "range").orderBy(*order[1:])
    return (
        ranges.withColumn("place", F.row_number().over(within))
        .join(before, ["investigation_id", "range"])
        .select("investigation_id", (F.col("before") + F.col("place")).cast("int").alias("rank"), "name", "score")
    )
