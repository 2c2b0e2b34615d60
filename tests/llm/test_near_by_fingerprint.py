"""The SimHash step of the pipeline's near-duplicate stage."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from causeway.llm import resemblance, simhash

from .conftest import documents


def test_fingerprints_of_sets_have_the_bits_of_over_half():
    rnd = np.random.default_rng(2)
    sets = [rnd.integers(0, 2**63, int(n), dtype=np.uint64) for n in (0, 1, 2, 5, 40_000, 0, 3, 70_000, 8)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = simhash.set_fingerprints(np.concatenate(sets), bounds)
    for own, fp in zip(sets, got.tolist()):
        assert fp == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > len(own))


def test_stage_takes_its_candidates_from_fingerprints(spark, monkeypatch):
    text = [f"word{i}" for i in range(2000)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "end"])), (3, " ".join(f"x{i}" for i in range(2000))), (4, None)]
    hashes, bounds = resemblance.shingle_sets(pa.array([t or "" for _, t in rows]))
    fps = simhash.set_fingerprints(hashes, bounds).view(np.int64)
    points = list(zip(resemblance._points(hashes, bounds).tolist(), fps.tolist(), np.diff(bounds).tolist()))
    near = resemblance.near_by_fingerprint(spark.createDataFrame(points, "point long, fp long, n long")).collect()
    assert [{r.a, r.b} for r in near] == [{points[0][0], points[1][0]}]
    # Without prefixes the stage lives on its fingerprints alone.
    empty = spark.createDataFrame([], ", ".join(f"{c} long" for c in resemblance._SHARED))
    monkeypatch.setattr(resemblance, "shared_prefixes", lambda *_: empty)
    stay = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3, 4]
