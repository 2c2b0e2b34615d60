"""The quality classifier's fit against the formulas written out, and labels that hardly differ."""

import zlib

import numpy as np
import pytest

from causeway.llm import quality

from .conftest import FOLDER, documents


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def _brute(texts, labelled, pooled=0.1, ridge=0.002):
    """Probabilities of class 1 for all texts, by densities with determinants and solves."""
    x = {d: np.array(quality.statistics(t)) for d, t in texts.items()}
    own = [np.array([x[d] for d, q in labelled if q == k]) for k in (0, 1)]
    n = np.array([len(o) for o in own])
    means = [o.mean(axis=0) for o in own]
    spread = [(o - m).T @ (o - m) / len(o) for o, m in zip(own, means)]
    together = (n[0] * spread[0] + n[1] * spread[1]) / n.sum()
    scale = np.diag(np.sqrt(np.maximum(np.diag(together), 1e-9)))
    flat, size = np.linalg.inv(scale), len(scale)
    covariance = []
    for s in spread:
        c = (1 - pooled) * flat @ s @ flat + pooled * flat @ together @ flat
        covariance.append((1 - ridge) * c + ridge * max(np.trace(c) / size, 0.01) * np.eye(size))
    out = {}
    for d, row in x.items():
        logs = []
        for k in (0, 1):
            z = flat @ (row - means[k])
            logs.append(np.log(n[k] / n.sum()) - 0.5 * np.linalg.slogdet(covariance[k])[1] - 0.5 * z @ np.linalg.solve(covariance[k], z))
        out[d] = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    return out


def test_fit_equals_the_formulas(spark, real):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in real.collect()}
    labelled = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    expected = _brute(texts, labelled)
    got = {r.doc_id: r for r in quality.score_quality(real, labels).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[d].score - p) < 1e-6 and got[d].predicted == int(got[d].score >= 0.3) for d, p in expected.items())
    kept = {r.doc_id for r in quality.keep_good(real, labels).collect()}
    assert kept == {d for d, r in got.items() if r.predicted}


@pytest.mark.parametrize(
    "rows, labels",
    [
        ([(1, "same text"), (2, "same text"), (3, "same text")], [(1, 0), (2, 1), (3, 1)]),
        ([(1, "One good text, plainly."), (2, "#### $$$$ !!!!"), (4, "x")], [(1, 1), (2, 0)]),
        ([(1, "equal"), (2, "equal"), (3, "### !!"), (4, "### !!"), (6, "equal")], [(1, 1), (2, 1), (3, 0), (4, 0)]),
        ([(1, ""), (2, None), (3, "words")], [(1, 1), (2, 0), (3, 1)]),
    ],
)
def test_labels_that_hardly_differ(spark, rows, labels):
    learned = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5]
    assert {q for _, q in learned} == {0, 1}
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in quality.score_quality(docs, _labels(spark, labels)).collect()}
    assert got.keys() == {d for d, _ in rows} and all(0 <= r.score <= 1 for r in got.values())
    if len({t for _, t in rows}) == 1:
        share = sum(q for _, q in learned) / len(learned)
        assert all(abs(r.score - share) < 1e-9 for r in got.values())
    else:
        own = {d: got[d].score for d, _ in learned}
        same = {dict(rows)[d] or "" for d, q in learned if q} & {dict(rows)[d] or "" for d, q in learned if not q}
        assert all((own[d] > 0.5) == bool(q) for d, q in learned if (dict(rows)[d] or "") not in same)
    assert quality.keep_good(docs, _labels(spark, labels)).count() == sum(r.predicted for r in got.values())
