"""Shards near equal in bytes: a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.llm.common import ids_and_texts, partitions
from causeway.session import materialize

ROW_BYTES = 16  # what a row counts beside its text
_MOST = 1 << 17  # blocks that the driver holds


@dataclass
class Blocks:
    """Consecutive ranges of the group order: first key, bits of the range, bytes, one group?"""

    low: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    single: np.ndarray

    def take(self, at: np.ndarray) -> Blocks:
        return Blocks(self.low[at], self.bits[at], self.size[at], self.single[at])


def greedy(ends: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """The last place (a number of blocks) that each shard reaches if filled up to ``capacity``."""
    places, at, done = [], 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, done + capacity, side="right"))
        done = int(ends[at - 1]) if at else 0
        places.append(at)
    return np.array(places)


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which contiguous shards, filled greedily, hold everything."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    low, high = max(int(sizes.max()), -(-total // shards)), int(sizes.max()) + -(-total // shards)
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards)[-1] == len(sizes):
            high = middle
        else:
            low = middle + 1
    return low


def open_blocks(blocks: Blocks, shards: int) -> np.ndarray:
    """Blocks of several groups in which a cut of the best partition may lie.

    The best capacity is at most what blocks need if none is cut, and at least what is
    needed if those of several groups could be cut anywhere. The n-th cut lies between
    the places that greedy filling reaches under these two bounds.
    """
    if not len(blocks.size):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(blocks.size)
    begins, total = ends - blocks.size, int(ends[-1])
    high = smallest_capacity(blocks.size, shards)
    single = blocks.size[blocks.single]
    low = max(-(-total // shards), int(single.max()) if len(single) else 0)
    several = np.zeros(len(ends), dtype=bool)
    least, most = 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, least + low, side="right"))  # whole blocks only
        least = int(ends[at - 1]) if at else 0
        most = min(total, most + high)  # cut anywhere
        several |= (ends > least) & (begins < most)
    return np.flatnonzero(several & ~blocks.single & (blocks.bits > 0))


def group_blocks(sizes: DataFrame, shards: int, bits: int = 16) -> Blocks:
    """Blocks of the groups in ``sizes(group long, size long)``, fine wherever a cut may lie.

    Groups are ordered by their key. Blocks begin as equal ranges of keys; those in which a
    cut may lie are split until each is one group, which takes two or three passes over
    the keys. The driver holds one row for each block.
    """
    order = F.col("group").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # unsigned order of the bits

    def summed(frame: DataFrame, width: int) -> list:
        shift = 64 - width
        block = F.shiftrightunsigned(order, shift) if shift else order
        out = frame.groupBy(block.alias("block")).agg(
            F.sum("size").alias("size"), (F.min("group") == F.max("group")).alias("single")
        )
        return out.collect()

    def made(rows: list, width: int) -> Blocks:
        shift = 64 - width
        low = np.array([(r.block % (1 << 64)) << shift & (1 << 64) - 1 for r in rows], dtype=np.uint64)
        return Blocks(
            low,
            np.full(len(rows), shift),
            np.array([r["size"] for r in rows], dtype=np.int64),
            np.array([r.single for r in rows], dtype=bool),
        )

    width = bits
    blocks = made(summed(sizes, width), width)
    blocks = blocks.take(np.argsort(blocks.low))
    while True:
        cut = open_blocks(blocks, shards)
        if not len(cut):
            return blocks
        spark, widths = sizes.sparkSession, blocks.bits[cut]
        cut = cut[widths == widths.max()]  # the coarsest first
        old = 64 - int(blocks.bits[cut[0]])
        # groups are at least ROW_BYTES, so the number of new blocks has two bounds
        width = min(64, old + max(1, int(np.log2(max(2, _MOST // len(cut))))))
        wanted = spark.createDataFrame([(_signed(int(v) >> (64 - old)),) for v in blocks.low[cut]], "wanted long")
        own = F.shiftrightunsigned(order, 64 - old)
        finer = made(summed(sizes.join(F.broadcast(wanted), own == F.col("wanted"), "left_semi"), width), width)
        rest = blocks.take(np.setdiff1d(np.arange(len(blocks.low)), cut))
        blocks = Blocks(*(np.concatenate([getattr(rest, k), getattr(finer, k)]) for k in ("low", "bits", "size", "single")))
        blocks = blocks.take(np.argsort(blocks.low))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def cut_places(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Where shards end (a number of blocks each): none above the smallest capacity, and
    each end as near to an even share as that allows."""
    capacity = smallest_capacity(sizes, shards)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    latest_begin = [len(sizes)]  # from behind: the first block from which the rest still fits
    for _ in range(shards - 1):
        done = int(ends[latest_begin[-1] - 1]) if latest_begin[-1] else 0
        latest_begin.append(int(np.searchsorted(ends - sizes, done - capacity, side="left")))
    earliest_end = latest_begin[:shards][::-1]
    places, at, done = [], 0, 0
    for shard in range(shards):
        most = int(np.searchsorted(ends, done + capacity, side="right"))
        goal = done + (total - done) / (shards - shard)
        near = int(np.searchsorted(ends, goal, side="left"))
        before = int(ends[near - 1]) if near else 0
        near += near < len(ends) and ends[near] - goal <= goal - before
        at = max(at, min(max(near, earliest_end[shard]), most))
        done = int(ends[at - 1]) if at else 0
        places.append(at)
    return np.array(places)


def assign_shards(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's shard and its slot there, so that shards are near equal in bytes.

    Equal texts are one atomic group; a group's key is the 64-bit hash of its text. The
    largest shard is as small as any contiguous partition of the groups in key order
    allows. Texts are read once and never shuffled; slots come from counts for each shard
    and salt, so that no task orders a whole shard.

    A null text is an empty one, of 16 bytes with its row. Null ids come first within their
    salt; repeated rows have a slot each. An empty table gives no rows.
    """
    rows = materialize(
        ids_and_texts(docs, id_col, text_col).select(
            "doc_id",
            F.xxhash64("text").alias("group"),
            (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        )
    )
    blocks = group_blocks(rows.select("group", "size"), shards)
    places = cut_places(blocks.size, shards)
    numbered = rows.withColumn("shard", _shard(F.col("group"), blocks, places))
    salts = partitions(docs)
    salted = numbered.withColumn("salt", F.pmod(F.xxhash64("doc_id", "group"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("shard", "salt").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("salt")) - F.col("count")
    base = counts.select("shard", "salt", before.alias("base"))
    own = W.partitionBy("shard", "salt").orderBy("doc_id", "group")
    return (
        salted.withColumn("rank", F.row_number().over(own) - 1)
        .join(base, ["shard", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _shard(group: Column, blocks: Blocks, places: np.ndarray) -> Column:
    """The number of shards that end at or before the group's place in the order."""
    firsts = [int(blocks.low[p]) for p in places[:-1] if p < len(blocks.low)]
    keys = [_signed(v ^ (1 << 63)) for v in firsts]  # as the groups' own signed order
    out = F.lit(0)
    for key in keys:
        out = out + (group >= F.lit(key).cast("long")).cast("int")
    return out.cast("int")


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows themselves, written to one folder for each shard."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sizes = docs.select(
        key.alias("group"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long").alias("size")
    )
    blocks = group_blocks(materialize(sizes), shards)
    docs.withColumn("shard", _shard(key, blocks, cut_places(blocks.size, shards))).write.partitionBy("shard").parquet(path)
