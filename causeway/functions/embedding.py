"""Embedders: functions ``Column -> Column`` that a caller can replace.

A model is marked as not deterministic, which keeps the optimizer from running it a second
time for a filter on its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from causeway import fixed_values as fv
from causeway.functions import text as tx

Embedder = Callable[[Column], Column]
_CELLS = 1 << 19  # counts summed at once


def hashed_embedder(dim: int = fv.EMBEDDING_DIM) -> Embedder:
    """Word counts hashed into ``dim`` buckets, scaled to length 1.

    The deterministic default, for use without a model. A word is a run of letters and
    digits; its bucket is the first eight hex digits of its MD5, modulo ``dim``. The words
    cross to Python as one text, with a space between them; a batch's distinct words are hashed once and its counts
    summed in one array.
    """

    @F.arrow_udf("array<double>")
    def vectors(said: pa.Array) -> pa.Array:
        return _hashed(pc.split_pattern(said, " "), dim)

    once = vectors.asNondeterministic()

    def embed(text: Column) -> Column:
        words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
        return once(F.nullif(words, F.lit("")))

    return embed


def _hashed(words: pa.Array, dim: int) -> pa.Array:
    """Vectors of a batch of word lists."""
    rows = len(words)
    of_row = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    spelled = words.flatten().dictionary_encode()
    distinct = spelled.dictionary.cast(pa.binary()).to_pylist()
    bucket = np.array([int.from_bytes(hashlib.md5(w).digest()[:4], "big") % dim for w in distinct], "int64")
    hits = bucket[spelled.indices.to_numpy(zero_copy_only=False)]
    ends = np.concatenate([[0], np.cumsum(of_row)]).astype("int64")
    weights = np.empty((rows, dim))
    step = max(1, _CELLS // dim)
    for at in range(0, rows, step):
        to = min(at + step, rows)
        row = np.repeat(np.arange(to - at), of_row[at:to])
        counts = np.bincount(row * dim + hits[ends[at] : ends[to]], minlength=(to - at) * dim)
        counts = counts.reshape(to - at, dim).astype("float64")
        lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        np.divide(counts, np.where(lengths == 0, 1.0, lengths), out=weights[at:to])
    offsets = pa.array(np.arange(rows + 1, dtype="int64") * dim, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(weights.reshape(-1)))


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Embedder:
    """Embedder from a model: ``load`` runs once per Python worker, then encodes batches.

    Vectors are scaled to length 1.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = None
        for texts in batches:
            if len(texts) == 0:
                yield pd.Series([], dtype=object)
                continue
            encode = encode or load()
            vectors = np.asarray(encode(texts.fillna("").tolist()), dtype="float64")
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(vectors / np.where(lengths == 0, 1.0, lengths)))

    return embed.asNondeterministic()


def embed_documents(df, embedder: Embedder, text: str = "text"):
    return df.withColumn("embedding", embedder(F.col(text)))


def embed_questions(questions, embedder: Embedder, text: str = "text"):
    """Questions get the retrieval instruction in front, documents do not."""
    return questions.withColumn("embedding", embedder(tx.query_text(F.col(text))))
