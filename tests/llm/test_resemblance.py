"""The near-duplicate stage of the pipeline against brute-force Jaccard similarity."""

from collections import Counter

import numpy as np

import corpus_pipeline
from causeway.llm import resemblance

from .conftest import documents

FOLDER = "/root/testdata/sf0.01"


def _shingles(text):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def _similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def _first_ids(rows):
    """The ids that stay, by comparing all pairs."""
    sets = list({_shingles(t) for _, t in rows})
    name = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if name[i] != name[j] and _similar(sets[i], sets[j]):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    of = dict(zip(sets, name))
    ids = {}
    for d, t in rows:
        ids.setdefault(of[_shingles(t)], []).append(d)
    return Counter(min((d for d in x if d is not None), default=None) for x in ids.values())


def _edited(seed=5):
    """Texts of many lengths with edits at random places, on either side of 0.8."""
    rnd, rows = np.random.default_rng(seed), []
    for i in range(60):
        words = [f"w{x}" for x in rnd.integers(0, 5000, int(rnd.integers(1, 150)))]
        for _ in range(4):
            own = list(words)
            for at in rnd.integers(0, len(own), int(rnd.integers(0, 1 + len(own) // 20 + 1))):
                own[at] = f"x{rnd.integers(0, 99999)}"
            rows.append((len(rows), " ".join(own + [f"end{j}" for j in range(int(rnd.integers(0, 3)))])))
    line = "one line that stands in very many of the texts of this table"
    return rows + [(len(rows) + i, f"{line} {' '.join(f'{i}u{j}' for j in range(i % 30))}") for i in range(120)]


def _stay(spark, docs):
    return Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect())


def test_stage_keeps_one_of_each_component(spark, odd, none):
    real = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    for docs in (odd, documents(spark, _edited()), real, none):
        assert _stay(spark, docs) == _first_ids([(r.doc_id, r.text) for r in docs.collect()])


def test_similarity_of_four_fifths_is_found_where_fingerprints_differ(spark):
    text = [f"word{i}" for i in range(49)]  # 45 shingles
    same, less = text[:], text[:]
    same[22] = "x"  # 40 of 50 are common
    less[5], less[14], less[33], less[42] = "a", "b", "c", "d"
    rows = [(1, " ".join(text)), (2, " ".join(same)), (3, " ".join(less))]
    a, b = (_shingles(t) for _, t in rows[:2])
    assert 5 * len(a & b) == 4 * len(a | b)
    assert _stay(spark, documents(spark, rows)) == Counter([1, 3])


def test_clusters_cut_into_blocks_find_the_same(spark, monkeypatch):
    rows = _edited(seed=6)
    monkeypatch.setattr(resemblance, "_BLOCK", 2000)
    assert _stay(spark, documents(spark, rows)) == _first_ids(rows)


def test_links_of_sets_connect_what_is_similar():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 30, int(rnd.integers(1, 40)))).astype(np.uint64) for _ in range(300)]
    sets.sort(key=len)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    name = list(range(len(sets)))
    for found in resemblance.similar_links(np.concatenate(sets), bounds):
        for a, b in zip(*found):
            assert _similar(set(sets[a].tolist()), set(sets[b].tolist()))
            old, new = name[b], name[a]
            name = [new if x == old else x for x in name]
    for i in range(len(sets)):
        assert all(name[i] == name[j] for j in range(i) if _similar(set(sets[i].tolist()), set(sets[j].tolist())))
