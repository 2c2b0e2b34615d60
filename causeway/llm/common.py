"""What several operators share: their input form, order-preserving buckets, worker state."""

from __future__ import annotations

import re
import sys
import types
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.session import materialize

WORD_GAP = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


MOST_MARKS = 500_000  # words of 64 marked rows that are broadcast at most, about 32 MB


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has it; Spark's names do not tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass
class KeyedRows:
    """Rows that are known by where they lie: the digest of their file's path, and their place in it.

    ``df`` has two more columns for these, under names that clash with no other.
    """

    df: DataFrame
    file: str
    at: str

    def keys(self) -> list[Column]:
        return [F.col(self.file).alias("file"), F.col(self.at).alias("at")]

    def without(self, gone: DataFrame) -> DataFrame:
        """The rows, in their own columns, but for those of ``gone(file, at)``.

        Rows stay where they are: the keys become bits, 64 rows a word, which are broadcast as
        long as there are at most ``MOST_MARKS`` words; beyond that rows are shuffled.
        """
        return self._met(gone, "left_anti").drop(self.file, self.at)

    def only(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted(file, at)``, with their keys; moved no more than by ``without``."""
        return self._met(wanted, "left_semi")

    def _met(self, keys: DataFrame, how: str) -> DataFrame:
        def bit(at: Column) -> Column:
            return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

        marks = materialize(
            keys.groupBy("file", F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("bits"))
        )
        own, at = F.broadcast(marks) if marks.count() <= MOST_MARKS else marks, self.df[self.at]
        here = (self.df[self.file] == marks["file"]) & (F.shiftright(at, 6) == marks["word"])
        return self.df.join(own, here & (marks["bits"].bitwiseAND(bit(at)) != 0), how)


def keyed_rows(docs: DataFrame) -> KeyedRows:
    """``docs`` with its rows' keys.

    Rows that come straight from files, at most filtered and projected, are read where they
    lie. Others, of which one may stand for several or which another read may see otherwise,
    are written first.
    """
    if not _scanned(docs):
        docs = materialize(docs)
    file, at = free_name(docs, "row_file"), free_name(docs, "row_at")
    place = docs.metadataColumn("_metadata")
    path, index = F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(at)
    return KeyedRows(docs.select("*", path, index), file, at)


def _scanned(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a Parquet file, the same in every read."""
    plan = docs._jdf.queryExecution().analyzed() if hasattr(docs, "_jdf") else None
    if plan is None or not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id`` and ``text``, and the columns named in ``more``; a null text is an empty one.

    Other columns go at once, so that no name of theirs can clash with one made later.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )


def bounded_batches(spark: SparkSession, most: int = 4 << 20, rows: int = 2048) -> None:
    """Have the session hand texts to Python in batches of a few megabytes.

    The defaults, 64 MB and 10,000 rows, are held several times over on both sides of each
    task. Smaller settings of the session stay. Results do not depend on it.
    """
    for name, limit in (("maxBytesPerBatch", most), ("maxRecordsPerBatch", rows)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < now <= limit:
            spark.conf.set(key, str(limit))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, _UPPER, _UPPER.lower())


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def worker_state() -> dict:
    """One dict for each Python worker, shared by the tasks that it runs one after another."""
    name = "causeway_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def ordered_buckets(df: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """``df`` with ``bucket``: ranges of ``key`` in ascending order, about equal in rows.

    Bounds are quantiles read from the key column alone, at most ``n`` numbers. Equal keys
    share a bucket; null keys are in bucket 0. Returns the frame and the number of buckets.
    """
    n = max(1, n)
    shares = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, shares, max(10_000, 4 * n)).alias("q")).first().q if shares else None
    bounds = np.unique(np.array(got or [], dtype=np.int64))

    def bucket(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), dtype=np.int32)
        out[known] = np.searchsorted(bounds, keys[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    if not len(bounds):
        return df.withColumn("bucket", F.lit(0)), 1
    return df.withColumn("bucket", F.pandas_udf(bucket, T.IntegerType())(F.col(key))), len(bounds) + 1
