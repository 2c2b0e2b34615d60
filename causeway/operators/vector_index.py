"""An index of vectors: inverted lists of product-quantised codes, re-ranked by the vectors.

Vectors are scaled to length 1, so that a cosine is an inner product. A coarse quantiser
assigns each to the list of its nearest centroid; what it differs from the centroid is kept as
one byte for each group of components, the number of the nearest word of that group's
codebook. With the query q, the centroid c and the words w of a vector x,

    cosine(q, x) ~ q . c + sum over groups of q_g . w_g

so that a list is searched with one table of 256 numbers a group, by the codes alone. The
shortlist is then ranked by the exact cosine of its stored vectors.

A vector of a list whose furthest member lies r from the centroid has a cosine of at most
q . c + r. An exact search goes on to the lists that this leaves open after the first ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from causeway import fixed_values as fv
from causeway.operators.vector_search import DIGITS, cosine
from causeway.session import materialize
from causeway.sources.tables import stored

_KEY = ["investigation_id", "chunk_id"]
_PAIR_BYTES = 1 << 25  # of vectors of questions, one for each list they read, in memory at once
_CODES = (
    "investigation_id string, chunk_id string, doc_seq bigint, chunk_index bigint, embedding array<double>, "
    "code binary, radius float, list int"
)
_CANDIDATES = "query_id string, list int, investigation_id string, chunk_id string, score double"
_WORDS = 256
_SLACK = 1e-6


@dataclass
class Quantiser:
    """Centroids of the lists, and the words of each group of components.

    The number of words is that of a byte, at most."""

    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int = 1  # lists that a question needs for the share of hits it was fitted to

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([book.shape[1] for book in self.books])[:-1].tolist()

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and distance from the centroid of each vector of length 1."""
        lists = _nearest(vectors, self.centroids)
        rest = vectors - self.centroids[lists]
        parts = np.split(rest, self.cuts, axis=1)
        codes = np.stack([_nearest(p, book) for p, book in zip(parts, self.books)], axis=1)
        return lists, codes.astype(np.uint8), np.linalg.norm(rest, axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's groups with all words: queries x groups x words."""
        parts = np.split(queries, self.cuts, axis=1)
        out = np.zeros((len(queries), len(self.books), _WORDS))
        for g, (part, book) in enumerate(zip(parts, self.books)):
            out[:, g, : len(book)] = part @ book.T
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = 0.5 * np.square(centres).sum(axis=1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ centres.T - half).argmax(axis=1)
    return out


def _means(x: np.ndarray, k: int, rounds: int, rnd: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's rounds from ``k`` distinct rows, fewer if there are fewer."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rnd.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype="float64") for r in rows])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1.0, length)


def train(
    vectors: DataFrame,
    lists: int | None = None,
    groups: int = 16,
    sample: int = 65_536,
    rounds: int = 8,
    recall: float = 0.96,
    tried: int = 256,
    seed: int = 7,
) -> Quantiser:
    """A quantiser fitted to at most ``sample`` of the vectors, those whose keys hash lowest.

    ``lists`` is the square root of the number of vectors by default, 4,096 at most. How many
    of them a question has to probe depends on the data; ``tried`` vectors of the sample are
    asked for their nearest in the sample, and ``probes`` is the number of lists that hold the
    share ``recall`` of these.
    """
    total = vectors.count()
    drawn = vectors.orderBy(F.xxhash64(F.lit(seed), *_KEY)).select("embedding").limit(sample).collect()
    if not drawn:
        raise ValueError("no vectors to fit an index to")
    x, rnd = _unit([r.embedding for r in drawn]), np.random.default_rng(seed)
    centroids = _means(x, lists or max(1, min(4096, int(total**0.5))), rounds, rnd)
    rest = x - centroids[_nearest(x, centroids)]
    parts = np.array_split(rest, min(groups, x.shape[1]), axis=1)
    own = _nearest(x, centroids)
    held = np.zeros(len(centroids))
    for q in rnd.permutation(len(x))[:tried]:
        products = x @ x[q]
        n = min(len(x), fv.TOP_K)
        place = np.empty(len(centroids), dtype=np.int64)
        place[np.argsort(-(centroids @ x[q]), kind="stable")] = np.arange(len(centroids))
        np.add.at(held, place[own[np.argpartition(-products, n - 1)[:n]]], 1)
    probes = 1 + int(np.searchsorted(np.cumsum(held) / held.sum(), recall))
    return Quantiser(centroids, [_means(p, _WORDS, rounds, rnd) for p in parts], min(probes, len(centroids)))


def _usable(vectors: DataFrame) -> DataFrame:
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return vectors.filter(sound & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def write_index(vectors: DataFrame, path: str, quantiser: Quantiser | None = None, **training) -> None:
    """Index ``vectors(investigation_id, chunk_id, doc_seq, chunk_index, embedding)`` in ``path``.

    Into an empty path goes a quantiser fitted to these vectors (``train``); later calls use
    the stored one and add what is new, so that an ingest writes its own vectors alone. Rows
    without a vector are ignored, and so is a chunk that is already there. One folder holds a list; a large
    list is several files, in order of investigation, so that the rows of others are skipped.
    """
    spark = vectors.sparkSession
    vectors = _usable(vectors).dropDuplicates(_KEY)
    before = stored(spark, f"{path}/codes", spark.createDataFrame([], _CODES).schema)
    if before is not None:
        vectors = vectors.join(before.select(*_KEY), _KEY, "left_anti")
        quantiser = read_quantiser(spark, path)
    vectors = materialize(vectors.select(*_KEY, "doc_seq", "chunk_index", F.col("embedding").cast("array<double>").alias("embedding")))
    if before is None:
        quantiser = quantiser or train(vectors, **training)
        rows = [(-2, 0, [float(quantiser.probes)])]
        rows += [(-1, i, c.tolist()) for i, c in enumerate(quantiser.centroids)]
        rows += [(g, i, w.tolist()) for g, book in enumerate(quantiser.books) for i, w in enumerate(book)]
        model = spark.createDataFrame(rows, "book int, word int, numbers array<double>")
        model.coalesce(1).write.parquet(f"{path}/quantiser")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists, codes, radius = quantiser.encode(_unit(batch["embedding"]))
            yield batch.assign(code=[c.tobytes() for c in codes], radius=radius.astype("float32"), list=lists.astype("int32"))

    coded = vectors.mapInPandas(encode, _CODES).hint("rebalance", "list").sortWithinPartitions("list", "investigation_id")
    coded.write.mode("append").partitionBy("list").parquet(f"{path}/codes")


def read_quantiser(spark: SparkSession, path: str) -> Quantiser:
    """The stored quantiser: at most 4,096 centroids and 256 words a group."""
    books: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/quantiser").orderBy("book", "word").collect():
        books.setdefault(r.book, []).append(r.numbers)
    probes, centroids = int(books.pop(-2)[0][0]), np.array(books.pop(-1))
    return Quantiser(centroids, [np.array(books[g]) for g in sorted(books)], probes)


def search_index(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int | None = None,
    probes: int | None = None,
    shortlist: int | None = None,
    exact: bool = False,
    question_block: int = 1024,
    list_block: int = 65_536,
) -> DataFrame:
    """Best ``k`` chunks of its own investigation for each question, from the index in ``path``.

    ``questions(query_id, investigation_id, embedding)``; the result is that of
    ``vector_search.search``: ``query_id, investigation_id, chunk_id, score, rank``. Read are
    the lists that are nearest to some question, ``probes`` for each (by default as many as the
    quantiser was fitted to need): the codes first, then the vectors of each question's
    ``shortlist`` (16 times ``k`` by default). Questions are rows
    throughout; those of a list meet its codes in blocks of bounded size on both sides.

    With ``exact``, whatever these lists give, every list that may hold a better chunk is read,
    too, and vectors are compared in place of codes; the result equals the exact search.
    """
    k = fv.TOP_K if k is None else k
    shortlist = 16 * k if shortlist is None else max(k, shortlist)
    quantiser = read_quantiser(spark, path)
    probes = quantiser.probes if probes is None else probes
    asked = materialize(_usable(questions).select("query_id", "investigation_id", F.col("embedding").cast("array<double>").alias("embedding")))
    codes = spark.read.schema(_CODES).parquet(f"{path}/codes")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _steps(batches, quantiser):
            products = _unit(batch["embedding"]) @ quantiser.centroids.T
            n = min(probes, products.shape[1])
            lists = np.argsort(-products, axis=1, kind="stable")[:, :n]
            rows = np.repeat(np.arange(len(batch)), n)
            yield batch.iloc[rows].assign(list=lists.ravel().astype("int32"))

    form = "query_id string, investigation_id string, embedding array<double>, list int"
    first = materialize(asked.mapInPandas(near, form))
    found = _scanned(codes, first, quantiser, k if exact else shortlist, exact, question_block, list_block)
    if not exact:
        found = _reranked(codes, materialize(found), asked, first)
        return _ranked(found, k)
    found = materialize(found)
    best = _ranked(found, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    reach = codes.groupBy("list").agg(F.max("radius").alias("radius")).collect()
    radius = np.full(len(quantiser.centroids), -2.0)  # of a list without vectors
    for r in reach:
        radius[r.list] = r.radius

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _steps(batches, quantiser):
            products = _unit(batch["embedding"]) @ quantiser.centroids.T
            n = min(probes, products.shape[1])
            seen = np.zeros(products.shape, dtype=bool)
            np.put_along_axis(seen, np.argsort(-products, axis=1, kind="stable")[:, :n], True, axis=1)
            least = np.where(batch["n"].to_numpy() >= k, batch["least"].to_numpy(), -2.0)
            row, lists = np.nonzero(~seen & (radius > -2) & (products + radius + _SLACK >= least[:, None]))
            yield batch.iloc[row].drop(columns=["least", "n"]).assign(list=lists.astype("int32"))

    left = asked.join(best, "query_id", "left").fillna({"least": -2.0, "n": 0})
    rest = materialize(left.mapInPandas(open_, form))
    return _ranked(found.unionByName(_scanned(codes, rest, quantiser, k, exact, question_block, list_block)), k)


def _steps(batches: Iterator[pd.DataFrame], quantiser: Quantiser) -> Iterator[pd.DataFrame]:
    """Questions in steps so small that their rows for all lists stay within ``_PAIR_BYTES``."""
    lists, dim = quantiser.centroids.shape
    step = max(1, _PAIR_BYTES // (8 * dim * lists))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.iloc[at : at + step]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "doc_seq", "chunk_index")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "investigation_id", "chunk_id", "score", "rank")
    )


def _probed(codes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lists that are named in ``pairs``; the filter picks their folders."""
    names = [r.list for r in pairs.select("list").distinct().collect()]  # 4,096 at most
    return codes.filter(F.col("list").isin(names))


def _scanned(
    codes: DataFrame, pairs: DataFrame, quantiser: Quantiser, keep: int, exact: bool, question_block: int, list_block: int
) -> DataFrame:
    """The ``keep`` best of each block of a list for each of its questions.

    Scores are estimates from the codes, or cosines of the vectors if ``exact``. A list and the
    questions on it are cut into blocks by their keys; each pair of blocks is one group.
    """
    here = _probed(codes, pairs)
    what = ["embedding", "doc_seq", "chunk_index"] if exact else ["code"]
    layout = (
        here.groupBy("list").agg(F.ceil(F.count("*") / list_block).alias("list_blocks"))
        .join(pairs.groupBy("list").agg(F.ceil(F.count("*") / question_block).alias("question_blocks")), "list")
    )  # one row a list

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    left = (
        pairs.join(F.broadcast(layout), "list")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("question_blocks")))
        .withColumn("lb", every("list_blocks"))
        .select("list", "qb", "lb", "query_id", "investigation_id", "embedding")
    )
    right = (
        here.join(F.broadcast(layout), "list")
        .withColumn("lb", F.pmod(F.xxhash64(*_KEY), F.col("list_blocks")))
        .withColumn("qb", every("question_blocks"))
        .select("list", "qb", "lb", *_KEY, *what)
    )
    names = ["query_id", "list", *_KEY, "score"] + (["doc_seq", "chunk_index"] if exact else [])

    def meet(q: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(chunks):
            scopes = {i: rows for i, rows in chunks.groupby("investigation_id", sort=False)}
            for scope, own in q.groupby("investigation_id", sort=False):
                if scope in scopes:
                    out.append(_best_of(own, scopes[scope], quantiser, keep, exact))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    form = _CANDIDATES + (", doc_seq bigint, chunk_index bigint" if exact else "")
    cell = ["list", "qb", "lb"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, form)
    if exact:
        return found
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= keep).drop("place")


def _best_of(q: pd.DataFrame, chunks: pd.DataFrame, quantiser: Quantiser, keep: int, exact: bool) -> pd.DataFrame:
    """The ``keep`` best of ``chunks``, all of one list, for each question; ties at the end stay."""
    out = []
    if not exact:
        codes = np.frombuffer(b"".join(chunks["code"]), dtype=np.uint8).reshape(len(chunks), -1)
    else:
        vectors = np.stack(chunks["embedding"].to_numpy())
        lengths = np.linalg.norm(vectors, axis=1)
    step = max(1, (1 << 22) // len(chunks))  # questions at a time
    for at in range(0, len(q), step):
        some = q.iloc[at : at + step]
        if exact:
            queries = np.stack(some["embedding"].to_numpy())
            scale = np.outer(np.linalg.norm(queries, axis=1), lengths)
            scores = (queries @ vectors.T) / np.where(scale == 0, 1e-9, scale)
        else:
            queries = _unit(some["embedding"])
            tables = quantiser.tables(queries)
            scores = np.repeat((queries @ quantiser.centroids[int(chunks["list"].iloc[0])])[:, None], len(chunks), axis=1)
            for g in range(codes.shape[1]):
                scores += tables[:, g][:, codes[:, g]]
        compared = np.round(scores, DIGITS)
        n = len(chunks)
        limit = np.partition(compared, n - keep, axis=1)[:, n - keep] if n > keep else np.full(len(some), -np.inf)
        row, col = np.nonzero(compared >= limit[:, None])
        hits = chunks.iloc[col].drop(columns=["code", "embedding"], errors="ignore").reset_index(drop=True)
        out.append(hits.assign(query_id=some["query_id"].to_numpy()[row], score=scores[row, col]))
    return pd.concat(out)


def _reranked(codes: DataFrame, found: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact cosines of the shortlists; vectors are read of the probed lists alone."""
    vectors = _probed(codes, pairs).select("list", *_KEY, "doc_seq", "chunk_index", F.col("embedding").alias("vector"))
    questions = asked.select("query_id", "embedding")
    return (
        found.drop("score").join(vectors, ["list", *_KEY]).join(questions, "query_id")
        .withColumn("score", cosine(F.col("embedding"), F.col("vector")))
    )
