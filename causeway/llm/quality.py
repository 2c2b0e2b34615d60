"""Quality scores by a regularised quadratic discriminant over statistics of a document."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import ids_and_texts, keyed_rows
from causeway.session import materialize

FEATURES = [
    "log_chars", "log_words", "word_length", "letters", "capitals", "digits", "symbols", "exclamations",
    "distinct_words", "commonest_word", "repeated_neighbours", "distinct_lines", "bars", "short_words",
    "compressed", "line_words",
]
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(range(128, 256))
_TABLES = {
    "letters": bytes(b for b in range(256) if b not in _LETTERS),
    "capitals": bytes(b for b in range(256) if not 65 <= b <= 90),
    "digits": bytes(b for b in range(256) if not 48 <= b <= 57),
    "symbols": bytes(b for b in range(256) if chr(b) not in "#$%&*@^~<>=+_{}[]\\/|"),
}


def _logit(part: float, whole: float) -> float:
    """A share as log odds, with half an observation added on either side."""
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``, shares as log odds."""
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    n, total = len(raw), max(1, len(words))
    kinds = {k: len(raw.translate(None, t)) for k, t in _TABLES.items()}
    counts = Counter(words)
    most = max(counts.values(), default=0)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    packed = min(n, sum(len(zlib.compress(raw[i : i + (1 << 20)], 1)) for i in range(0, n, 1 << 20)))
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log((n + 1) / total),
        _logit(kinds["letters"], n),
        _logit(kinds["capitals"], max(kinds["letters"], kinds["capitals"])),
        _logit(kinds["digits"], n),
        _logit(kinds["symbols"], n),
        _logit(raw.count(b"!"), n),
        _logit(len(counts), max(len(words), len(counts))),
        _logit(most, len(words)),
        _logit(repeated, len(words)),
        _logit(len(set(lines)), len(lines)),
        _logit(counts.get(b"|", 0), len(words)),
        _logit(sum(len(w) <= 3 for w in words), len(words)),
        _logit(packed, n),
        math.log1p(len(words) / len(lines)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id`` and ``x``, the transformed statistics of every row's whole text, and the long
    columns named in ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column("text")]
            kept = [batch.column(c) for c in more]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(found, type=pa.list_(pa.float64())), *kept], ["doc_id", "x", *more]
            )

    schema = "doc_id long, x array<double>" + "".join(f", {c} long" for c in more)
    return ids_and_texts(docs, id_col, text_col, *more).mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Two Gaussians; ``whiten[k]`` is the inverse of the Cholesky factor of class k's covariance."""

    means: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray
    only: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 from the difference of the two log densities."""
        if self.only is not None:
            return np.full(len(x), self.only)
        logs = [
            c - 0.5 * np.square((x - m) @ w.T).sum(axis=1)
            for m, w, c in zip(self.means, self.whiten, self.constant)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: one in five, by the checksum of the id's digits."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    found: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = 0.1, ridge: float = 0.002
) -> Discriminant:
    """Fit on the labelled rows of ``found(doc_id, x)`` that are not held out.

    Counts, sums and products of each class are added up by Spark over all such rows; the
    driver gets one row for each class. A class covariance is drawn towards the pooled one
    by the share ``pooled`` and towards a multiple of the identity by ``ridge``, after the
    statistics are scaled to unit variance; that multiple is the mean variance, 0.01 at least,
    so that classes of one row or of equal rows have a density, too. Rows without a label of 0
    or 1 do not count. With one class alone every score is that class; with none every score
    is 0.5; where all labelled rows of both classes are alike, scores of such rows are the
    share of class 1.
    """
    d = len(FEATURES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = found.filter(~held_out(F.col("doc_id"))).join(known.filter("label in (0, 1)"), "doc_id")
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    flat = rows.select("label", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in upper]
    got = {r.label: r for r in flat.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect()}
    if len(got) < 2:
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), float(next(iter(got), 0.5)))
    n = np.array([got[k].n for k in (0, 1)], dtype=float)
    means = np.array([[got[k][f"s{i}"] for i in range(d)] for k in (0, 1)]) / n[:, None]
    spread = np.zeros((2, d, d))
    for k in (0, 1):
        for i, j in upper:
            spread[k, i, j] = spread[k, j, i] = got[k][f"p{i}_{j}"] / n[k] - means[k, i] * means[k, j]
    together = np.tensordot(n / n.sum(), spread, axes=1)
    scale = np.sqrt(np.maximum(np.diag(together), 1e-9))
    together = together / np.outer(scale, scale)
    whiten, constant = [], []
    for k in (0, 1):
        own = (1 - pooled) * spread[k] / np.outer(scale, scale) + pooled * together
        own = (1 - ridge) * own + ridge * max(np.trace(own) / d, 0.01) * np.eye(d)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor) / scale[None, :])
        constant.append(math.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(constant))


def score(found: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` for every row of ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            scores = model.scores(x)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return found.mapInArrow(run, "doc_id long, score double, predicted int")


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row.

    Texts are read once; what is shuffled are the statistics of labelled rows. Scores see
    nothing but the text. A null or empty text is scored by its statistics, which are those
    of no words; null ids are scored and never learned from; repeated rows count as often
    as they come. An empty table gives no rows.
    """
    found = materialize(features(docs, id_col, text_col))
    scored = score(found, fit(found, labels), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs``, all columns, without the rows that are predicted 0.

    Statistics are worked out once, for the fit and for the scores. Rows that go are marked
    and left out where the rest is read; no text moves.
    """
    docs = keyed_rows(docs)
    found = materialize(features(docs.df, id_col, text_col, docs.file, docs.at))
    model = fit(found, labels)

    def poor(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(x.tolist()).reshape(-1, len(FEATURES))) < threshold)

    return docs.without(found.filter(F.pandas_udf(poor, "boolean")(F.col("x"))).select(*docs.keys()))
