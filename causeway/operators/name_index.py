"""A stored keyword index of node names: postings of the substrings of one to three letters.

Nodes are laid out in order of investigation and name and numbered in blocks. A posting
names the nodes of one block and investigation whose name holds a gram, as gaps of one or
two bytes. A keyword is looked up by its grams: within a block the shortest list first, each
further list leaves fewer nodes, and what stays is confirmed on the name itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from causeway.functions import text as tx
from causeway.operators.graph import grams

_BITS = 12  # a block has up to 4096 nodes, so a gap has at most two bytes of seven bits
_NAMES, _POSTINGS = "names", "postings"
_MANY = 4096  # blocks whose numbers are given to the scan of the names


def _packed(ids: np.ndarray) -> bytes:
    """Ascending ids as gaps; the first byte of a long gap has its highest bit set."""
    gaps = np.diff(ids, prepend=0)
    long = gaps >= 128
    ends = np.cumsum(1 + long)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    out[ends - 1] = gaps & 127
    out[ends[long] - 2] = 128 | (gaps[long] >> 7)
    return out.tobytes()


def _unpacked(code: bytes) -> np.ndarray:
    raw = np.frombuffer(code, dtype=np.uint8).astype(np.int32)
    first = raw >= 128
    high = np.concatenate([[0], np.where(first, (raw & 127) << 7, 0)[:-1]]) if len(raw) else raw
    return np.cumsum((raw + high)[~first])


@F.pandas_udf(BinaryType())
def _pack(lists: pd.Series) -> pd.Series:
    return pd.Series([_packed(np.sort(np.asarray(ids, dtype=np.int32))) for ids in lists], dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def _common(lists: pd.Series) -> pd.Series:
    """Ids that stand in all of a row's lists, which come shortest first."""

    def common(codes) -> np.ndarray:
        left = _unpacked(codes[0])
        for code in codes[1:]:
            if len(left) == 0:
                break
            left = np.intersect1d(left, _unpacked(code), assume_unique=True)
        return left.astype(np.int32)

    return pd.Series([common(codes) for codes in lists], dtype=object)


def _list(lists: int) -> Column:
    return F.pmod(F.xxhash64("investigation_id", "gram"), F.lit(lists)).cast("int").alias("list")


def write_index(nodes: DataFrame, path: str, lists: int = 64) -> None:
    """Index ``nodes(investigation_id, name, type, node_seq)`` at ``path``, in place of what is there.

    Postings lie in ``lists`` folders by investigation and gram, sorted within. Nodes are
    dealt by sorted ranges, so a large investigation is spread over tasks, and no group
    has more than a block of nodes. Nodes without a name or investigation are found by
    nothing and left out; repeated rows are found as often as they stand there.
    """
    spark = nodes.sparkSession
    number = F.monotonically_increasing_id()
    (
        nodes.select("investigation_id", "name", "type", "node_seq")
        .filter("investigation_id is not null and name is not null")
        .orderBy("investigation_id", "name")
        .withColumn("number", number)
        .select(
            F.shiftright("number", _BITS).alias("block"),
            F.col("number").bitwiseAND((1 << _BITS) - 1).cast("int").alias("place"),
            "investigation_id", "name", "type", "node_seq",
        )
        .write.mode("overwrite").parquet(f"{path}/{_NAMES}")
    )
    parts = spark.read.parquet(f"{path}/{_NAMES}").select(
        "investigation_id", "block", "place", F.explode(grams([1, 2, 3])).alias("gram")
    )
    (
        parts.groupBy("investigation_id", "gram", "block")
        .agg(F.collect_list("place").alias("places"))
        .select(
            "investigation_id", "gram", "block", F.size("places").alias("nodes"), _pack("places").alias("code"),
            _list(lists),
        )
        .hint("rebalance", "list")
        .sortWithinPartitions("list", "investigation_id", "gram")
        .write.mode("overwrite").partitionBy("list").parquet(f"{path}/{_POSTINGS}")
    )
    spark.createDataFrame([(lists,)], "lists int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def nodes_with_keyword(spark: SparkSession, path: str, keywords: DataFrame) -> DataFrame:
    """Pairs of node and keyword where the lower-cased name contains the keyword.

    ``keywords(investigation_id, keyword)``, lower-case, of any length but empty. Only the
    folders of the lists that the keywords' grams name are read, and of the names only the
    row groups that may hold a block with a node left.
    """
    lists = spark.read.schema("lists int").parquet(f"{path}/lists").first().lists
    size = F.length("keyword")
    starts = F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1)))
    wanted = (
        keywords.select("investigation_id", "keyword").distinct()
        .filter(size > 0)
        .withColumn("grams", F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("keyword"), i, F.lit(3)))))
        .select("investigation_id", "keyword", F.size("grams").alias("needed"), F.explode("grams").alias("gram"))
        .withColumn("list", _list(lists))
    )
    named = [r.list for r in wanted.select("list").distinct().collect()]  # at most ``lists`` numbers
    postings = spark.read.schema(
        "investigation_id string, gram string, block bigint, nodes int, code binary, list int"
    ).parquet(f"{path}/{_POSTINGS}")
    left = (
        postings.filter(F.col("list").isin(named))
        .join(wanted, ["list", "investigation_id", "gram"])
        .groupBy("investigation_id", "keyword", "block", "needed")
        .agg(F.array_sort(F.collect_list(F.struct("nodes", "code"))).alias("found"))
        .filter(F.size("found") == F.col("needed"))
        .select(
            F.col("investigation_id").alias("about"), "keyword", "block",
            F.explode(_common(F.col("found.code"))).alias("place"),
        )
    )
    names = spark.read.parquet(f"{path}/{_NAMES}")
    blocks = [r.block for r in left.select("block").distinct().limit(_MANY + 1).collect()]
    if len(blocks) <= _MANY:
        names = names.filter(F.col("block").isin(blocks))
    return (
        names.join(left, ["block", "place"])
        .filter((F.col("about") == F.col("investigation_id")) & F.contains(F.lower("name"), F.col("keyword")))
        .select("investigation_id", "name", "type", "node_seq", "keyword")
    )


def search_nodes(spark: SparkSession, path: str, searches: DataFrame) -> DataFrame:
    """As ``graph.search_nodes``, from the index at ``path``."""
    texts = searches.select("investigation_id", "text", F.lower("text").alias("keyword"))
    found = nodes_with_keyword(spark, path, texts)
    return found.join(texts, ["investigation_id", "keyword"]).select("investigation_id", "name", "type", "text")


def keyword_matches(questions: DataFrame, path: str) -> DataFrame:
    """As ``retrieval.keyword_matches``, from the index at ``path``."""
    words = questions.select(
        "query_id", "investigation_id", F.explode(tx.question_keywords(F.col("text"))).alias("keyword")
    ).distinct()
    found = nodes_with_keyword(questions.sparkSession, path, words)
    return (
        found.join(words, ["investigation_id", "keyword"])
        .select("query_id", "investigation_id", "name", "type", "node_seq")
        .distinct()
    )
