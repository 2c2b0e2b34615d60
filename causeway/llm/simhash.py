"""SimHash fingerprints linked within a Hamming distance, found by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import ids_and_texts, keyed_rows, partitions
from causeway.llm.components import components
from causeway.session import materialize

_BLOCK = 1 << 22  # fingerprint pairs compared at once
_SPLIT = 8  # sample points in a shard of the tree, at least
_FEW = 32  # with no more on one side, comparing beats cutting


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of ``text`` over its shingles of ``words`` words, repeats included.

    A-Z count as a-z. A text of fewer words is one shingle; a text without words has 0. A bit
    is 1 if it is set in over half of the shingles' XXH64 (UTF-8, seed 42).
    """
    found = text.encode().lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    n = max(1, len(found) - words + 1)
    digest, seed = xxhash.xxh64_intdigest, 42
    last = ends[min(words, len(found)) - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins[:n].tolist(), last)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def set_fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each of many sets of hashes, ``bounds`` apart; that of an empty set is 0."""
    ones = np.zeros((len(bounds) - 1, 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for at in range(0, len(hashes), 1 << 15):
        part, of = hashes[at : at + (1 << 15)].astype("<u8"), owner[at : at + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(bounds)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(
    docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", *more: str
) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's 64 bits as a signed number, and the long columns
    named in ``more``, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
            kept = [batch.column(c) for c in more]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64)), *kept], ["doc_id", "fp", *more])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *more))
    return ids_and_texts(docs, id_col, text_col, *more).mapInArrow(run, schema)


def distances(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    """A ball around ``vantage`` (distances up to ``radius``) and what lies outside it."""

    vantage: np.uint64
    radius: int
    inside: Node | int
    outside: Node | int


def build_tree(sample: np.ndarray, leaves: int) -> tuple[Node | int, int]:
    """A tree whose leaves number the shards, of about equal shares of the sample."""
    count = 0

    def grow(points: np.ndarray, leaves: int) -> Node | int:
        nonlocal count
        if leaves > 1 and len(points) >= 2 * _SPLIT:
            vantage = points[len(points) // 2]
            far = distances(points, vantage).astype(np.int64)
            radius = int(np.median(far))
            inside = far <= radius
            if inside.any() and not inside.all():
                return Node(vantage, radius, grow(points[inside], leaves // 2), grow(points[~inside], leaves - leaves // 2))
        count += 1
        return count - 1

    return grow(np.unique(sample), leaves), count


def shards_of(tree: Node | int, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the point, shard, is it at home there) for all shards that a point must meet.

    A point lives in one shard. Pairs within ``bits`` of two shards are seen in the shard
    inside the ball: who lives outside visits it if ``radius + bits`` does not exclude it.
    """
    out = []

    def walk(node: Node | int, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            out.append((at, np.full(len(at), node, dtype=np.int32), home))
            return
        far = distances(points[at], node.vantage).astype(np.int64)
        inside = far <= node.radius
        near = far <= node.radius + bits
        # Visitors go wherever an inhabitant may be within reach; inhabitants of the
        # outside also visit the inside.
        walk(node.inside, at[near], (home & inside)[near])
        stay = np.where(home, ~inside, far > node.radius - bits)
        walk(node.outside, at[stay], home[stay])

    walk(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
    return tuple(np.concatenate(x) for x in zip(*out))


class Forest:
    """Sets of linked points: a link is noted only if it joins two sets, so links stay fewer
    than points however many pairs there are."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(self, at: np.ndarray) -> np.ndarray:
        out = self.parent[at]
        while True:
            up = self.parent[out]
            if np.array_equal(up, out):
                self.parent[at] = out
                return out
            out = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p, q = self.roots(a), self.roots(b)
            apart = p != q
            if not apart.any():
                return
            a, b, high, low = a[apart], b[apart], np.maximum(p, q)[apart], np.minimum(p, q)[apart]
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], np.diff(high[order]) != 0])]
            self.parent[high[first]] = low[first]
            self.links.append((a[first], b[first]))


class Matcher:
    """Links among points within ``bits``, by recursive vantage points.

    A vantage point's ball cuts the sets at hand; points whose distances to it differ by
    more than ``bits`` never meet. What lies within ``bits`` of the vantage point itself is
    linked to it at once. Cutting goes on until few pairs are left, or until a cut prunes
    next to none, as within one dense cluster.
    """

    def __init__(self, points: np.ndarray, bits: int):
        self.points, self.bits, self.forest = points, bits, Forest(len(points))

    def pairs(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """All links within ``a``, or between ``a`` and ``b`` if that is given."""
        work = [(a, b)]
        while work:
            a, b = work.pop()
            other = a if b is None else b
            if not len(a) or not len(other):
                continue
            weight = len(a) * len(other) / (2 if b is None else 1)
            if weight <= _BLOCK / 4 or min(len(a), len(other)) <= _FEW:
                self._compare(a, other)
                continue
            vantage = a[len(a) // 2]
            far = distances(self.points[a], self.points[vantage]).astype(np.int64)
            radius = int(np.median(far))
            near = a[far <= self.bits]
            self.forest.link(near, np.full(len(near), vantage))
            within, beyond = far <= radius, far > radius
            if b is None:
                rim = a[within & (far > radius - self.bits)], a[beyond & (far <= radius + self.bits)]
                parts = [(a[within], None), (a[beyond], None), rim]
            else:
                off = distances(self.points[b], self.points[vantage]).astype(np.int64)
                parts = [(a[within], b[off <= radius + self.bits]), (a[beyond], b[off > radius - self.bits])]
            left = sum(len(x) * (len(x) / 2 if y is None else len(y)) for x, y in parts)
            if left > 0.98 * weight:
                self._compare(a, other)
            else:
                work += parts

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs, a bounded number at a time."""
        if len(a) > len(b):
            a, b = b, a
        step = max(1, _BLOCK // len(b))
        for at in range(0, len(a), step):
            rows = a[at : at + step]
            x, y = np.nonzero(distances(self.points[rows][:, None], self.points[b][None, :]) <= self.bits)
            x, y = rows[x], b[y]
            apart = x != y
            if apart.any():
                self.forest.link(x[apart], y[apart])


def links_within(points: DataFrame, bits: int = 4, share: int = 16, sample: int = 1 << 17) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the points ``fp`` (distinct) within ``bits``.

    A tree is grown from a sample of 32 points for each shard, at most ``sample``; it
    decides only which shard a point lives in. Every point goes to its shard and visits
    those whose ball it may reach, so each close pair meets in a shard; there a tree of its
    own finds the pairs. Of the pairs in a shard a spanning forest is handed on, never all.

    More shards mean more visits, fewer mean more work in each: their number is the square
    root of the points divided by ``share``.
    """
    total = points.count()
    n = max(1, min(sample // 32, round(total**0.5 / share)))
    part = min(1.0, 32 * n / max(1, total))
    picked = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).limit(2 * sample)
    known = np.array([r.fp for r in picked.collect()], dtype=np.int64).view(np.uint64)
    tree, shards = build_tree(known, n)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            at, shard, home = shards_of(tree, own, bits)
            yield pa.record_batch([pa.array(shard), pa.array(own[at].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.table({k: b.column(k) for k in ("shard", "fp", "home")}) for b in batches]
        table = pa.concat_tables(held) if held else None
        if table is None or not table.num_rows:
            return
        shard = table["shard"].to_numpy()
        own = table["fp"].to_numpy().view(np.uint64)
        home = table["home"].to_numpy()
        for each in np.unique(shard):
            here = shard == each
            matcher = Matcher(own[here], bits)
            mine, others = np.flatnonzero(home[here]), np.flatnonzero(~home[here])
            matcher.pairs(mine)
            matcher.pairs(mine, others)
            if matcher.forest.links:
                a, b = (np.concatenate(x) for x in zip(*matcher.forest.links))
                found = matcher.points.view(np.int64)
                yield pa.record_batch([pa.array(found[a]), pa.array(found[b])], ["a", "b"])

    met = points.mapInArrow(visits, "shard int, fp long, home boolean")
    return met.repartitionById(max(1, shards), F.col("shard")).mapInArrow(match, "a long, b long")


def near_groups(
    docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` for every row.

    Fingerprints that differ in at most ``bits`` bits are linked; a component is everything
    reachable, named by its smallest id. Texts are read once; only distinct fingerprints
    are compared, so copies cost nothing more.

    A null or empty text, or one of white space, has fingerprint zero and is linked like any
    other. Null ids are grouped but never name a component unless it has no other ids (then
    null). Repeated rows give a row each; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, words, id_col, text_col))
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links_within(points.select("fp"), bits))
    linked = points.join(roots.withColumnRenamed("node", "fp"), "fp")
    names = linked.groupBy("root").agg(F.min("least").alias("named"))
    named = linked.join(names, "root").select("fp", "named")
    all_named = points.join(named, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"))
    return rows.join(all_named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs``, all columns, with one row of each component of ``near_groups``.

    The row with the smallest id stays; a row without an id stays only where no row of the
    component has one, and of several rows with that id the one that lies first. Components
    are known by their smallest fingerprint.
    """
    docs = keyed_rows(docs)
    found = fingerprints(docs.df, words, id_col, text_col, docs.file, docs.at)
    rows = materialize(found.select("doc_id", "fp", *docs.keys()))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "at")).alias("first")
    points = materialize(rows.groupBy("fp").agg(first))
    roots = components(links_within(points.select("fp"), bits))
    named = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    stay = named.groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    return docs.without(rows.join(stay.select("first.file", "first.at"), ["file", "at"], "left_anti").select("file", "at"))
