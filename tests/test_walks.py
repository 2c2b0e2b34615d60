"""Walks through hubs: the same results, and no task with most of the rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from causeway.operators import traversal

EDGES = "investigation_id string, source string, target string, type string"
NODES = "investigation_id string, name string, node_seq long"


def _tables(spark, pairs):
    names = sorted({n for p in pairs for n in p})
    nodes = spark.createDataFrame([("g", n, i) for i, n in enumerate(names)], NODES)
    edges = spark.createDataFrame([("g", a, b, "CAUSES") for a, b in pairs], EDGES)
    return nodes, edges


def _hub_graph(n=3000, seed=5):
    """A third of all edges end in one node, another third begin there."""
    rnd = random.Random(seed)
    pairs = {(f"n{i}", "hub") for i in range(n)} | {("hub", f"n{i}") for i in range(0, n, 3)}
    return sorted(pairs | {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(2 * n)})


def _brute(pairs, starts, hops):
    into, found = {}, []
    for a, b in pairs:
        into.setdefault(b, []).append(a)
    for start in starts:
        seen, level = {start}, [start]
        for hop in range(1, hops + 1):
            level = sorted({a for v in level for a in into.get(v, [])} - seen)
            seen.update(level)
            found += [(start, v, hop) for v in level]
    return sorted(found)


@pytest.mark.parametrize("hub", [50, 100_000])
@pytest.mark.parametrize("hops", [1, 3])
def test_walks_through_a_hub(spark, hub, hops):
    pairs = _hub_graph(600)
    nodes, edges = _tables(spark, pairs)
    chosen = ["hub", "n0", "n3", "n7", "n100"]
    starts = spark.createDataFrame([("g", n) for n in chosen], "investigation_id string, start string")
    found = traversal.upstream(nodes, edges, starts, hops, hub=hub)
    assert sorted((r.start, r.node, r.hop) for r in found.collect()) == _brute(pairs, chosen, hops)


def test_order_within_a_hop_does_not_depend_on_the_split(spark):
    nodes, edges = _tables(spark, _hub_graph(300))
    starts = nodes.select("investigation_id", F.col("name").alias("start"))
    split, whole = (
        sorted(map(repr, traversal.upstream(nodes, edges, starts, 2, hub=h).collect())) for h in (20, 100_000)
    )
    assert split == whole and len(split) > 1000


def test_no_task_has_most_of_the_rows(spark):
    _, edges = _tables(spark, _hub_graph())
    steps = edges.select("investigation_id", F.col("target").alias("node"), F.col("source").alias("cause"))
    level = edges.select("investigation_id", F.col("source").alias("start"), F.col("target").alias("node"))
    level = level.filter("node <> 'hub' or start = 'n1'").distinct()
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}

    def rows(hub):
        hubs = traversal._hubs(steps, hub)
        met = traversal._stepped(level, traversal._dealt(steps, hubs), hubs)
        counts = met.groupBy(F.spark_partition_id().alias("task")).count().collect()
        return sum(r["count"] for r in counts), sorted(r["count"] for r in counts)

    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        total, whole = rows(1_000_000)
        same, split = rows(50)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert total == same and len(split) == 16
    assert max(whole) > 2.5 * statistics.median(whole)
    assert max(split) < 2.5 * statistics.median(split)


def test_no_starts_no_edges_and_self_loops(spark):
    nodes, edges = _tables(spark, [("a", "a"), ("a", "b"), ("b", "a")])
    starts = spark.createDataFrame([("g", "a"), ("g", "nobody"), ("h", "a")], "investigation_id string, start string")
    found = traversal.upstream(nodes, edges, starts, 3)
    assert [(r.start, r.node, r.hop) for r in found.collect()] == [("a", "b", 1)]
    assert traversal.upstream(nodes, edges, starts.limit(0), 3).count() == 0
    assert traversal.upstream(nodes, edges.limit(0), starts, 3).columns == found.columns
    assert traversal.upstream(nodes, edges.limit(0), starts, 3).count() == 0
    assert traversal.upstream(nodes, edges, starts, 0).columns == found.columns
