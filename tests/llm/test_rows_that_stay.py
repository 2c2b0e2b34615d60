"""Which physical rows the stages keep where ids are missing or repeated."""

from collections import Counter

import corpus_pipeline
from causeway.llm import exact_dedup, simhash

from .conftest import documents

BASE = [f"word{i}" for i in range(400)]


def _near_copy(n):
    return " ".join(BASE[:n] + ["changed"] + BASE[n + 1 :])


def _kept(docs):
    return Counter((r.doc_id, r.text) for r in docs.collect())


def test_one_row_of_each_text_stays(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (2, "a b"), (3, "c"), (3, "d"), (3, "d"), (None, "d")]
    rows += [(None, "only without ids")] * 5 + [(None, None), (None, ""), (None, "x")]
    got = _kept(exact_dedup.drop_duplicates(documents(spark, rows)))
    assert sum(got.values()) == 6
    assert Counter((d, " ".join((t or "").split())) for d, t in got) == Counter(
        [(1, "a b"), (3, "c"), (3, "d"), (None, "only without ids"), (None, ""), (None, "x")]
    )


def test_a_third_of_the_rows_may_lack_ids_and_share_a_text(spark):
    rows = [(None, "copy") if i % 3 == 0 else (i, f"text {i}") for i in range(3000)]
    assert exact_dedup.drop_duplicates(documents(spark, rows)).count() == 2001


def _near_cases(drop, spark):
    text, copy, other, far = " ".join(BASE), _near_copy(10), _near_copy(300), " ".join(f"far{i}" for i in range(400))
    # only null ids in one component, a null id next to an id in another
    rows = [(None, far), (None, far + " end"), (5, text), (None, copy), (None, other)]
    got = drop(documents(spark, rows))
    assert got[(5, text)] == 1 and sum(got.values()) == 2
    # near copies without any id
    assert sum(drop(documents(spark, [(None, text), (None, copy), (None, other)])).values()) == 1
    # an id of two texts, one of them in a component named by a smaller id
    got = drop(documents(spark, [(2, text), (7, copy), (7, far), (7, far)]))
    assert got == Counter([(2, text), (7, far)])
    # repeated rows
    assert drop(documents(spark, [(1, text)] * 4 + [(1, copy)])).total() == 1


def test_one_row_of_each_simhash_component_stays(spark):
    _near_cases(lambda docs: _kept(simhash.drop_near_duplicates(docs)), spark)


def test_one_row_of_each_component_of_the_stage_stays(spark):
    _near_cases(lambda docs: _kept(corpus_pipeline.near_duplicates(spark, docs, "")), spark)
