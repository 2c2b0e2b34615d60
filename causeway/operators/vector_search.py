"""Exact cosine top-k, scoped to the investigation of each question."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway import fixed_values as fv
from causeway.functions.embedding import Embedder, embed_documents, embed_questions
from causeway.session import materialize

#: Scores are compared to this many digits, so equal texts tie and position decides.
DIGITS = 9
_FOUND = (
    "query_id string, investigation_id string, chunk_id string, doc_seq bigint, chunk_index bigint, score double"
)
_FOUND_ARROW = pa.schema(
    [(n, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split() for c in _FOUND.split(", "))]
)
_BLOCKS = 4  # blocks of either side of an investigation, as long as they are small enough
_BLOCK_BYTES = 1 << 25  # of the vectors in a larger block, at most
_SCORES = 1 << 19  # scores in memory at once
_GROUP = 16  # rows whose best score stands for them
_DENSE = 0.25  # of all groups; beyond it scoring all pairs is cheaper than picking some
_BROADCAST = 100_000  # hits that go to the chunks for their text; more of them meet by a shuffle
_ANY = 4096  # investigations named in a filter; more are met by a join


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero product of lengths counts as 1e-9."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(lengths == 0, F.lit(1e-9)).otherwise(lengths)


def _matrix(embedded: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as the rows of a matrix, from their values side by side."""
    if isinstance(embedded, pa.ChunkedArray):
        embedded = embedded.combine_chunks()
    values = embedded.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return values.reshape(len(embedded), -1)


def _near(
    rows: np.ndarray, asked: np.ndarray, k: int, error: float
) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs ``(query, row)`` that hold the best ``k`` rows of each query and few others.

    ``rows`` and ``asked`` are of length 1 (or 0) in single precision, which errs by less than half of
    ``error``. The best of each group of rows are known from one pass; the ``k``-th best of
    them is no better than the ``k``-th best row, so groups below it need no second look. None
    if there are too many pairs, as rows are equal.
    """
    scores = asked @ rows.T
    groups = len(rows) // _GROUP
    grouped = scores[:, : groups * _GROUP].reshape(len(scores), _GROUP, groups)
    best = grouped.max(axis=1)
    limit = np.partition(best, groups - k, axis=1)[:, groups - k] - np.float32(error)
    query, group = np.nonzero(best >= limit[:, None])
    if len(query) > _DENSE * scores.size / _GROUP:
        return None
    pair, place = np.nonzero(grouped[query, :, group] >= limit[query, None])
    rest, left = np.nonzero(scores[:, groups * _GROUP :] >= limit[:, None])
    return (
        np.concatenate([query[pair], rest]),
        np.concatenate([place * groups + group[pair], left + groups * _GROUP]),
    )


def _units(vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return (vectors / np.where(lengths == 0, 1.0, lengths)[:, None]).astype("float32")


def _best(chunks: pd.DataFrame, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Best ``k`` chunks of one investigation for each query; position settles ties.

    Many queries are ranked at once. Of many chunks, a pass in single precision leaves those that
    may be among the best, which alone are scored in full; else one partition of the score
    matrix finds each query's limit. One sort orders what reaches it.
    """
    doc_seq, chunk_index = chunks["doc_seq"].to_numpy(), chunks["chunk_index"].to_numpy()
    of_row, of_query = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    n, lengths = len(vectors), np.concatenate([of_row, of_query])
    usual = np.isfinite(lengths).all() and not ((lengths > 0) & (lengths < 1e-100)).any()
    many = usual and n // _GROUP >= 16 * k
    if many:
        used = vectors.any(axis=0)  # a component that no chunk has adds nothing to a product
        vectors, queries = vectors[:, used], queries[:, used]
        rows, asked = _units(vectors, of_row), _units(queries, of_query)
        error = (vectors.shape[1] + 8) * 2.0**-22 + 10.0**-DIGITS
    step = max(1, _SCORES // n)
    found = []
    for at in range(0, len(ids), step):
        part, to = queries[at : at + step], of_query[at : at + step]
        near = _near(rows, asked[at : at + step], k, error) if many else None
        if near is None:
            lengths = np.outer(to, of_row)
            scores = (part @ vectors.T) / np.where(lengths == 0, 1e-9, lengths)
            compared = np.round(scores, DIGITS)
            limit = np.partition(compared, n - k, axis=1)[:, n - k] if n > k else np.full(len(to), -np.inf)
            query, row = np.nonzero(compared >= limit[:, None])
            scores, compared = scores[query, row], compared[query, row]
        else:
            query, row = near
            lengths = to[query] * of_row[row]
            scores = np.einsum("ij,ij->i", part[query], vectors[row]) / np.where(lengths == 0, 1e-9, lengths)
            compared = np.round(scores, DIGITS)
        order = np.lexsort((chunk_index[row], doc_seq[row], -compared, query))
        query, row, scores = query[order], row[order], scores[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < k
        found.append((query[first] + at, row[first], scores[first]))
    query, row, scores = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame(
        {
            "query_id": np.asarray(ids, dtype=object)[query],
            "investigation_id": chunks["investigation_id"].to_numpy()[row],
            "chunk_id": chunks["chunk_id"].to_numpy()[row],
            "doc_seq": doc_seq[row],
            "chunk_index": chunk_index[row],
            "score": scores,
        }
    )


def _search_few(vectors: DataFrame, questions: list, k: int) -> DataFrame:
    """The questions travel to the chunks: each partition keeps its best, no shuffle."""
    grouped: dict[str, tuple[list, list]] = {}
    for q in questions:
        ids, rows = grouped.setdefault(q["investigation_id"], ([], []))
        ids.append(q["query_id"])
        rows.append(q["embedding"])
    shared = vectors.sparkSession.sparkContext.broadcast(
        {i: (np.array(ids), np.array(rows, "float64")) for i, (ids, rows) in grouped.items()}
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            rows = batch.drop_columns(["embedding"]).to_pandas()
            for investigation, places in rows.groupby("investigation_id", sort=False).indices.items():
                if investigation in shared.value:
                    vectors = _matrix(batch.column("embedding").take(pa.array(places)))
                    found = _best(rows.iloc[places], vectors, *shared.value[investigation], k)
                    best = found if best is None else pd.concat([best, found])
            if best is not None:
                best = (
                    best.assign(compared=-best["score"].round(DIGITS))
                    .sort_values(["compared", "doc_seq", "chunk_index"])
                    .groupby("query_id", sort=False)
                    .head(k)
                    .drop(columns="compared")
                )
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, _FOUND_ARROW, preserve_index=False)

    return vectors.mapInArrow(search, _FOUND)


def _layout(vectors: DataFrame, questions: DataFrame, chunk_block: int, query_block: int) -> DataFrame:
    """``chunk_blocks`` and ``query_blocks`` of each investigation.

    A row is copied to all blocks of the other side. So blocks grow with the investigation, to
    ``_BLOCKS`` of each side, as long as they stay within ``_BLOCK_BYTES`` of vectors.
    """

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        rows, dim = F.count("*"), F.max(F.size("embedding"))
        most = F.greatest(F.lit(size), F.least(F.ceil(rows / _BLOCKS), F.floor(F.lit(_BLOCK_BYTES) / (8 * dim))))
        return df.groupBy("investigation_id").agg(F.ceil(rows / most).alias(name))

    return blocks(vectors, chunk_block, "chunk_blocks").join(
        blocks(questions, query_block, "query_blocks"), "investigation_id"
    )


def _search_many(
    vectors: DataFrame, questions: DataFrame, k: int, chunk_block: int, query_block: int
) -> DataFrame:
    """Questions and chunks meet in blocks of bounded size, however large either side is."""
    layout = _layout(vectors, questions, chunk_block, query_block)

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    left = (
        questions.join(layout, "investigation_id")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")))
        .withColumn("cb", every("chunk_blocks"))
    )
    right = (
        vectors.join(layout, "investigation_id")
        .withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.col("chunk_blocks")))
        .withColumn("qb", every("query_blocks"))
    )

    def search(q: pa.Table, chunks: pa.Table) -> pa.Table:
        if not len(q) or not len(chunks):
            return _FOUND_ARROW.empty_table()
        ids, queries = q.column("query_id").to_numpy(), _matrix(q.column("embedding"))
        rows, vectors = chunks.drop_columns(["embedding"]).to_pandas(), _matrix(chunks.column("embedding"))
        return pa.Table.from_pandas(_best(rows, vectors, ids, queries, k), _FOUND_ARROW, preserve_index=False)

    cell = ["investigation_id", "qb", "cb"]
    return (
        left.select(*cell, "query_id", "embedding")
        .groupBy(*cell)
        .cogroup(
            right.select(
                *cell, "chunk_id", "doc_seq", "chunk_index", "embedding"
            ).groupBy(*cell)
        )
        .applyInArrow(search, _FOUND)
    )


def scope(questions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A filter for tables with ``investigation_id``: the investigations that are asked about.

    A few thousand names become a filter that reaches the scan, where it picks folders; more
    are met by a semi-join. What comes behind sees only what is asked for. The names are
    looked up once, however many tables are filtered.
    """
    asked = questions.select("investigation_id").distinct()
    names = [r.investigation_id for r in asked.limit(_ANY + 1).collect()]
    if len(names) > _ANY:
        return lambda table: table.join(asked, "investigation_id", "left_semi")
    return lambda table: table.filter(F.col("investigation_id").isin([n for n in names if n is not None]))


def in_scope(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Chunks of the investigations that are asked about, and no others."""
    return scope(questions)(chunks)


def search(
    vectors: DataFrame,
    questions: DataFrame,
    k: int | None = None,
    few: int = 2048,
    chunk_block: int = 8192,
    query_block: int = 1024,
    stored: bool = True,
) -> DataFrame:
    """Best ``k`` chunks of its own investigation for each question.

    ``vectors(investigation_id, chunk_id, doc_seq, chunk_index, embedding)``,
    ``questions(query_id, investigation_id, embedding)``. Result: ``query_id,
    investigation_id, chunk_id, score, rank``; a chunk id is unique only within its
    investigation. Rows without a vector are ignored. Up to ``few`` questions are
    broadcast, which is checked; more of them meet the chunks in blocks, of ``chunk_block`` and
    ``query_block`` rows at least. Either way only
    the best ``k`` of a partition or block leave it. Vectors that are not ``stored``, but made as
    they are read, are written once before they meet in blocks.
    """
    k = fv.TOP_K if k is None else k
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    vectors = in_scope(vectors, questions).select(
        "investigation_id", "chunk_id", "doc_seq", "chunk_index", "embedding"
    ).filter(usable)
    questions = questions.select("query_id", "investigation_id", "embedding").filter(usable)
    first = questions.limit(few + 1).collect()
    is_few = len(first) <= few
    if is_few:
        found = _search_few(vectors, first, k)
    else:
        vectors = vectors if stored else materialize(vectors)
        found = _search_many(vectors, questions, k, chunk_block, query_block)
    best = Window.partitionBy("query_id").orderBy(
        F.round("score", DIGITS).desc(), "doc_seq", "chunk_index"
    )
    ranked = (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "investigation_id", "chunk_id", "score", "rank")
    )
    return F.broadcast(ranked) if is_few and len(first) * k <= _BROADCAST else ranked


def with_text(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the text of their chunks. The search itself never moves text."""
    key = ["investigation_id", "chunk_id"]
    return found.join(chunks.select(*key, "document_id", "chunk_index", "text"), key)


def retrieve(
    chunks: DataFrame, questions: DataFrame, embedder: Embedder, k: int | None = None
) -> DataFrame:
    """Embed the questions and return the hits of each with their text.

    Chunks without vectors are embedded on their way into the search; what is searched more
    than once had better be stored with them.
    """
    chunks = in_scope(chunks, questions)
    stored = "embedding" in chunks.columns
    vectors = chunks if stored else embed_documents(chunks, embedder)
    found = search(vectors, embed_questions(questions, embedder), k, stored=stored)
    return with_text(found, chunks)
