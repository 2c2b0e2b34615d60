"""Ranks kept up to date against power iterations from the start."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causeway.operators import rank_updates

from .test_graph import _power, _random_graphs

NODES, EDGES = "investigation_id string, name string", "investigation_id string, source string, target string"


def _frames(spark, graphs, names=None):
    chosen = {g: graphs[g] for g in (graphs if names is None else names)}
    nodes = [(g, v) for g, (vs, _) in chosen.items() for v in vs]
    edges = [(g, u, v) for g, (_, pairs) in chosen.items() for u, v in pairs]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def _check(spark, path, graphs, abs=1e-8):
    got = {(r.investigation_id, r.name): r.score for r in rank_updates.read_ranks(spark, path).collect()}
    assert len(got) == sum(len(vs) for vs, _ in graphs.values())
    for g, (vs, pairs) in graphs.items():
        expected = _power(vs, pairs, 200)[0] if pairs else dict.fromkeys(vs, 0.0)
        for v in vs:
            assert got[g, v] == pytest.approx(expected[v], abs=abs)


def _changed(graphs, seed):
    """New nodes and edges, lost edges, and a node that goes with its edges."""
    rnd, out = random.Random(seed), {}
    for g, (vs, pairs) in graphs.items():
        names = list(vs) + [f"new{seed}-{i}" for i in range(rnd.randrange(3))]
        gone = rnd.choice(names) if len(names) > 3 else None
        names = [v for v in names if v != gone]
        kept = [p for p in pairs if gone not in p and rnd.random() < 0.8]
        more = [(rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randrange(5))]
        out[g] = (names, list(dict.fromkeys(kept + [p for p in more if p[0] != p[1]])))
    return out


@pytest.mark.parametrize("small,hub,steps", [(1 << 20, 1000, 2), (0, 2, 1), (400, 1000, 1)])
def test_changes_give_the_ranks_of_the_new_graph(spark, tmp_path, small, hub, steps):
    path, how = str(tmp_path / "ranks"), dict(small_bytes=small, hub=hub, batch=12, tolerance=1e-6)
    graphs = {g: (list(vs), list(pairs)) for g, (vs, pairs) in _random_graphs(6, 5).items()}
    rank_updates.update_ranks(*_frames(spark, graphs), path, **how)
    _check(spark, path, graphs, 1e-5)
    for step in range(steps):
        some = [g for i, g in enumerate(graphs) if i % 2 == step]
        new = _changed({g: graphs[g] for g in some}, step)
        nodes, edges = _frames(spark, new)
        stray = edges.limit(2).withColumn("source", F.lit("nobody"))  # an edge to a name that is no node
        rank_updates.update_ranks(nodes, edges.unionByName(stray), path, **how)
        graphs.update(new)
        _check(spark, path, graphs, 1e-5)


def test_edges_may_all_go(spark, tmp_path):
    path = str(tmp_path / "ranks")
    graphs = {"a": (["x", "y", "z"], [("x", "y"), ("y", "z")]), "b": (["x", "y"], [("x", "y")])}
    rank_updates.update_ranks(*_frames(spark, graphs), path)
    graphs["a"] = (["x", "y"], [])
    rank_updates.update_ranks(*_frames(spark, graphs, ["a"]), path)
    _check(spark, path, graphs)
    graphs["a"] = (["x", "y"], [("y", "x")])
    rank_updates.update_ranks(*_frames(spark, graphs, ["a"]), path)
    _check(spark, path, graphs)
    rank_updates.update_ranks(*_frames(spark, {}), path)
    _check(spark, path, graphs)


def _files(path, investigation):
    return {f: f.read_bytes() for f in Path(path).glob(f"*/investigation_id={investigation}/*.parquet")}


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_what_is_untouched_is_neither_read_nor_pushed(spark, tmp_path, small):
    path = str(tmp_path / "ranks")
    chain = [f"n{i}" for i in range(30)]
    graphs = {
        "a": (chain + ["p", "q", "r"], list(zip(chain, chain[1:])) + [("p", "q"), ("q", "r")]),
        "b": (["x", "y"], [("x", "y")]),
    }
    rank_updates.update_ranks(*_frames(spark, graphs), path, small_bytes=small, batch=12)
    before = _files(path, "b")
    assert before
    for f in before:
        f.write_bytes(b"not to be read")
    graphs["a"] = (graphs["a"][0] + ["s"], graphs["a"][1] + [("r", "s")])
    rank_updates.update_ranks(*_frames(spark, graphs, ["a"]), path, small_bytes=small)
    assert all(f.read_bytes() == b"not to be read" for f in before) and _files(path, "b").keys() == before.keys()
    for f, content in before.items():
        f.write_bytes(content)
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    _check(spark, path, graphs)
    pushes = {r.name: r.pushes for r in spark.read.parquet(f"{path}/weights").filter("investigation_id = 'a'").collect()}
    assert {v for v, n in pushes.items() if n} == {"p", "q", "r", "s"}  # the chain has settled
