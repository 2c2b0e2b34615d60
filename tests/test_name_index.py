"""The stored index of node names against substring tests of all pairs."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from causeway.operators import graph, name_index, retrieval

NODES = "investigation_id string, name string, type string, node_seq long"
SEARCHES = "investigation_id string, text string"


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 4095)))
def test_gaps_come_back(ids):
    ids = np.array(sorted(ids), dtype=np.int32)
    code = name_index._packed(ids)
    assert name_index._unpacked(code).tolist() == ids.tolist() and len(code) <= 2 * len(ids)


def _brute(nodes, searches):
    return sorted(
        (i, n, s) for i, n, _, _ in nodes for j, s in searches
        if i is not None and i == j and n is not None and s and s.lower() in n.lower()
    )


def _got(df):
    return sorted((r["investigation_id"], r["name"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcDé ") for _ in range(n))
    nodes = [(rnd.choice(["hot"] * 8 + ["b", "c"]), word(rnd.randrange(12)), "T", n) for n in range(9000)]
    nodes += [("b", None, "T", 1), (None, "abc", "T", 2), ("b", "", "T", 3), ("b", "Redis", "T", 4), ("b", "Redis", "T", 4)]
    searches = sorted({(rnd.choice(["hot", "b", "c", "nobody"]), word(rnd.randrange(1, 7))) for _ in range(60)})
    return nodes, searches + [("b", ""), ("b", None), (None, "abc"), ("b", "redis"), ("b", "REDIS"), ("b", "rediss")]


def test_index_equals_substring_tests(spark, rows, tmp_path):
    nodes, searches = rows
    table, asked = spark.createDataFrame(nodes, NODES), spark.createDataFrame(searches, SEARCHES)
    name_index.write_index(table, str(tmp_path), lists=8)
    found = name_index.search_nodes(spark, str(tmp_path), asked)
    expected = _brute(nodes, searches)
    assert _got(found) == expected and len(expected) > 1000
    assert _got(graph.search_nodes(table, asked)) == expected


def test_blocks_are_bounded_and_a_large_investigation_has_several(spark, rows, tmp_path):
    name_index.write_index(spark.createDataFrame(rows[0], NODES).repartition(4), str(tmp_path), lists=8)
    postings = spark.read.parquet(f"{tmp_path}/postings")
    assert postings.agg({"nodes": "max"}).first()[0] <= 4096
    assert postings.filter("investigation_id = 'hot' and gram = 'a'").count() > 1
    assert all(len(r.code) <= 2 * r.nodes for r in postings.collect())


def test_only_the_lists_named_are_read(spark, rows, tmp_path):
    nodes, _ = rows
    name_index.write_index(spark.createDataFrame(nodes, NODES), str(tmp_path), lists=64)
    searches = [("b", "redis"), ("c", "ab")]
    asked = spark.createDataFrame(searches, SEARCHES)
    named = {("b", "red"), ("b", "edi"), ("b", "dis"), ("c", "ab")}
    grams = spark.createDataFrame(sorted(named), "investigation_id string, gram string")
    kept = {r.list for r in grams.select(name_index._list(64)).collect()}
    spoiled = [f for f in Path(tmp_path).glob("postings/list=*/*.parquet") if int(f.parent.name[5:]) not in kept]
    assert len(spoiled) >= 50
    for file in spoiled:
        file.write_bytes(b"not to be read")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert _got(name_index.search_nodes(spark, str(tmp_path), asked)) == _brute(nodes, searches)


def test_questions_find_the_same_entities(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Redis", "SERVICE", 1), ("a", "Timeout", "ERROR", 2), ("b", "Redis", "SERVICE", 1)], NODES)
    questions = spark.createDataFrame(
        [("1", "a", "why did redis and the timeout happen"), ("2", "b", "timeout?"), ("3", "a", None), ("4", "c", "redis")],
        "query_id string, investigation_id string, text string",
    )
    name_index.write_index(nodes, str(tmp_path))
    found = name_index.keyword_matches(questions, str(tmp_path))
    expected = retrieval.keyword_matches(questions, nodes)
    assert found.columns == expected.columns and found.count() == 2  # both of question 1
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    ranked = nodes.selectExpr("investigation_id", "name", "1 as rank")
    plain, stored = (retrieval.matched_entities(questions, nodes, ranked, i) for i in (None, str(tmp_path)))
    assert sorted(map(str, plain.collect())) == sorted(map(str, stored.collect()))


def test_no_nodes_and_no_keywords(spark, tmp_path):
    none, asked = spark.createDataFrame([], NODES), spark.createDataFrame([("a", "x")], SEARCHES)
    name_index.write_index(none, str(tmp_path / "a"))
    assert name_index.search_nodes(spark, str(tmp_path / "a"), asked).count() == 0
    name_index.write_index(spark.createDataFrame([("a", "x", "T", 1)], NODES), str(tmp_path / "b"))
    assert name_index.search_nodes(spark, str(tmp_path / "b"), asked.limit(0)).count() == 0
    assert name_index.search_nodes(spark, str(tmp_path / "b"), asked).count() == 1
