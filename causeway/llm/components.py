"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.session import materialize


_HUBS = 500  # a hub has more than this part of all links


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for each node of ``links(a, b)``.

    Alternating star contraction: every node is linked to the smallest of its neighbours,
    first for larger neighbours, then for smaller ones, until nothing changes, which takes a
    number of rounds near the logarithm of the nodes. Each round is written to the shared
    folder. No task gathers the neighbours of a node: what they need to know of hubs, of which
    there are at most a thousand, is broadcast, so that a hub's links stay spread. Nothing
    reaches the driver but sums.
    """
    links = materialize(_ordered(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    before, now = None, _sums(links)
    while now != before:
        hub = max(1000, now[0] // _HUBS)
        large = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = large.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("degree"))
        stars = _told(large.filter("b > a"), least, "a", hub, now[0])
        stars = _ordered(stars.select(F.col("least").alias("a"), "b"))
        smaller = stars.groupBy("b").agg(F.min("a").alias("least"), F.count("*").alias("degree"))
        links = materialize(
            _ordered(
                _told(stars, smaller, "b", hub, now[0])
                .select(F.explode(F.array("a", "b")).alias("b"), F.col("least").alias("a"))
            )
        )
        before, now = now, _sums(links)
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def _sums(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _told(links: DataFrame, least: DataFrame, key: str, hub: int, total: int) -> DataFrame:
    """``links`` with the ``least`` of their node ``key``; what hubs have is broadcast."""
    if total <= hub:  # no node has so many links
        return links.join(least.drop("degree"), key)
    hubs = F.broadcast(least.filter(F.col("degree") > hub).drop("degree"))
    others = links.join(hubs.select(key), key, "left_anti").join(least.filter(F.col("degree") <= hub).drop("degree"), key)
    return links.join(hubs, key).unionByName(others)


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, the smaller end first, none to itself."""
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
