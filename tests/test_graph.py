"""Walks, PageRank, vector search and retrieval against plain Python."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import centrality, graph, retrieval, traversal, vector_search

NODES = "investigation_id string, name string, type string, node_seq long"
EDGES = "investigation_id string, source string, target string, type string, confidence double, edge_seq long"


def _random_graphs(count, seed):
    """Investigations as (names in insertion order, set of edges)."""
    pick = random.Random(seed)
    graphs = {}
    for g in range(count):
        names = [f"n{i}" for i in range(pick.randint(1, 9))]
        pick.shuffle(names)
        pairs = {(pick.choice(names), pick.choice(names)) for _ in range(pick.randint(0, 14))}
        graphs[f"g{g}"] = (names, sorted(pairs))
    return graphs


def _tables(spark, graphs):
    nodes = [(g, n, "API", i) for g, (names, _) in graphs.items() for i, n in enumerate(names)]
    edges = [(g, a, b, "CAUSES", 0.5, i) for g, (_, pairs) in graphs.items() for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def _power(names, pairs, rounds=None):
    """Power iteration on the reversed graph, written out."""
    n = len(names)
    if not pairs:
        return dict.fromkeys(names, 0.0), 0
    out = {v: [a for a, b in pairs if b == v] for v in names}
    x, done = dict.fromkeys(names, 1 / n), 0
    for done in range(1, (100 if rounds is None else rounds) + 1):
        new = dict.fromkeys(names, 0.0)
        for v in names:
            for u in out[v]:
                new[u] += 0.85 * x[v] / len(out[v])
        spare = 0.85 * sum(x[v] for v in names if not out[v]) / n + 0.15 / n
        new = {v: m + spare for v, m in new.items()}
        change = sum(abs(new[v] - x[v]) for v in names)
        x = new
        if rounds is None and change < n * 1e-6:
            break
    return x, done


@pytest.mark.parametrize("small", [1 << 20, 0, 150])
@pytest.mark.parametrize("rounds,hub,batch", [(None, 1000, 4), (7, 2, 3), (0, 1000, 5), (5, 3, 5)])
def test_pagerank(spark, rounds, small, hub, batch):
    """All paths give the same numbers; edges to unknown names have no part in them."""
    graphs = _random_graphs(12, 3)
    nodes, edges = _tables(spark, graphs)
    stray = [("g0", graphs["g0"][0][0], "nobody", "CAUSES", 0.5, 99), ("g3", "nobody", graphs["g3"][0][0], "CAUSES", 0.5, 99)]
    edges = edges.unionByName(spark.createDataFrame(stray, EDGES))
    scores = centrality.pagerank(nodes, edges, rounds, small_bytes=small, hub=hub, batch=batch)
    got = {(r["investigation_id"], r["name"]): r for r in scores.collect()}
    assert len(got) == sum(len(names) for names, _ in graphs.values())
    for g, (names, pairs) in graphs.items():
        expected, done = _power(names, pairs, rounds)
        for v in names:
            assert got[g, v]["score"] == pytest.approx(expected[v], abs=1e-12)
            assert got[g, v]["rounds"] == done


def test_every_node_is_ranked(spark):
    nodes, edges = _tables(spark, {"g": (["c", "b", "a"], []), "h": (["x", "y", "z"], [("x", "y"), ("x", "z")])})
    ranked = centrality.ranked_nodes(centrality.pagerank(nodes, edges), nodes)
    got = [(r["investigation_id"], r["rank"], r["name"]) for r in ranked.orderBy("investigation_id", "rank").collect()]
    assert got == [("g", 1, "c"), ("g", 2, "b"), ("g", 3, "a"), ("h", 1, "x"), ("h", 2, "y"), ("h", 3, "z")]


def _breadth_first(names, pairs, start, hops):
    """Upstream nodes in queue order; parents are visited in insertion order."""
    before = {v: [u for u in names if (u, v) in pairs] for v in names}
    seen, queue, order = {start}, deque([(start, 0)]), []
    while queue:
        v, d = queue.popleft()
        if d == hops:
            continue
        for u in before[v]:
            if u not in seen:
                seen.add(u)
                order.append((u, d + 1))
                queue.append((u, d + 1))
    return order


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_upstream_is_breadth_first(spark, hops):
    graphs = _random_graphs(15, hops)
    nodes, edges = _tables(spark, graphs)
    starts = nodes.select("investigation_id", F.col("name").alias("start"))
    starts = starts.unionByName(spark.createDataFrame([("g0", "unknown")], "investigation_id string, start string"))
    found = traversal.upstream(nodes, edges, starts, hops)
    rows = found.orderBy("investigation_id", "start", "hop", "reach").collect()
    got = {}
    for r in rows:
        got.setdefault((r["investigation_id"], r["start"]), []).append((r["node"], r["hop"]))
    paths = {(r["investigation_id"], r["start"]): r["path"] for r in traversal.causal_paths(found).collect()}
    heads = {(r["investigation_id"], r["start"]): r for r in traversal.path_heads(found).collect()}
    for g, (names, pairs) in graphs.items():
        for v in names:
            expected = _breadth_first(names, pairs, v, hops)
            assert got.pop((g, v), []) == expected
            if expected:
                path = [u for u, _ in reversed(expected)] + [v]
                assert paths[g, v] == path
                assert (heads[g, v]["length"], heads[g, v]["head"]) == (len(path), path[0])
    assert not got


@pytest.mark.parametrize("limit", [3, 25])
def test_forward_paths(spark, limit):
    graphs = _random_graphs(10, 11)
    nodes, edges = _tables(spark, graphs)
    starts = nodes.select("investigation_id", F.col("name").alias("start"))
    got = {}
    for r in traversal.paths_from(edges, starts, 3, limit).orderBy("path_seq").collect():
        got.setdefault((r["investigation_id"], r["start"]), []).append(list(r["names"]))
    for g, (names, pairs) in graphs.items():
        for v in names:
            walks, level = [], [([v], [])]
            for _ in range(3):
                level = [(p + [b], used + [(a, b)]) for p, used in level for a, b in pairs if a == p[-1] and (a, b) not in used]
                walks += [p for p, _ in sorted(level)]
            assert got.get((g, v), []) == walks[:limit]


@pytest.mark.parametrize("few", [2048, 0])
def test_search_equals_brute_force(spark, few):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-1, 2, (120, 4)).astype(float)  # many ties and zero vectors
    chunks = [(f"i{n % 3}", f"c{n}", n // 10, n % 10, v.tolist()) for n, v in enumerate(vectors)]
    chunks.append(("i0", "none", 0, 0, None))
    queries = [(f"q{n}", f"i{n % 4}", rng.integers(-1, 2, 4).astype(float).tolist()) for n in range(20)]
    c = spark.createDataFrame(chunks, "investigation_id string, chunk_id string, doc_seq long, chunk_index long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id string, investigation_id string, embedding array<double>")
    rows = vector_search.search(c, q, 5, few=few, chunk_block=7, query_block=3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    for name, scope, query in queries:
        scored = []
        for s, cid, d, i, v in chunks:
            if s == scope and v:
                lengths = np.linalg.norm(query) * np.linalg.norm(v) or 1e-9
                scored.append((-round(float(np.dot(query, v) / lengths), 9), d, i, cid))
        assert got.get(name, []) == [(cid, -s) for s, _, _, cid in sorted(scored)[:5]]


def _questions(spark, rows):
    return spark.createDataFrame(rows, "query_id string, investigation_id string, text string")


def test_entities_by_keyword_or_centrality(spark):
    names = ["Redis", "Redis Timeout", "Command", "Api", "X", "Y", "Z"]
    nodes, edges = _tables(spark, {"g": (names, [("Redis", "Api"), ("Api", "Command"), ("X", "X")])})
    ranked = centrality.ranked_nodes(centrality.pagerank(nodes, edges), nodes)
    questions = retrieval.asked(
        _questions(spark, [
            ("hit", "g", "why did REDIS fail redis?"),
            ("default", "g", None),
            ("stop", "g", "why did the service fail"),
            ("other", "nowhere", "redis"),
        ])
    )
    context = retrieval.graph_context(questions, nodes, edges, ranked)
    got = {}
    for r in context.entities.collect():
        got.setdefault(r["query_id"], set()).add(r["name"])
    assert got["hit"] == {"Redis", "Redis Timeout"}
    assert got["default"] == {"Command"}  # "and" is a keyword
    assert len(got["stop"]) == 5
    assert "other" not in got
    relations = {(r["query_id"], r["source"], r["target"]) for r in context.relations.collect()}
    assert {r[1:] for r in relations if r[0] == "hit"} == {("Redis", "Api")}
    paths = {(r["query_id"], tuple(r["path"])) for r in retrieval.question_paths(context).collect()}
    assert ("default", ("Redis", "Api", "Command")) in paths


def test_unresolved_relations_are_dropped(spark):
    nodes, edges = _tables(spark, {"g": (["a", "b"], [("a", "b"), ("a", "z"), ("z", "b")])})
    kept = graph.resolved_relations(edges, nodes).collect()
    assert [(r["source"], r["target"]) for r in kept] == [("a", "b")]


def test_task_functions_travel_with_the_job():
    from pyspark import cloudpickle

    payload = cloudpickle.dumps(vector_search._best)
    assert b"_make_function" in payload  # the code itself, not a module to import
