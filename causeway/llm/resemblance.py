"""Near duplicates by the exact Jaccard similarity of word shingles, found by SimHash.

Sets whose fingerprints lie within a few bits are candidates; prefix filtering adds the similar
ones whose fingerprints lie farther apart. An exact check of all candidates follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.llm.common import KeyedRows, ids_and_texts, keyed_rows, partitions
from causeway.llm.components import components
from causeway.llm.simhash import Forest, links_within, set_fingerprints
from causeway.session import materialize

_BLOCK = 1 << 21  # shingles in a block of a cluster, about
_FEW = 16  # sets that share a hash and are taken in pairs, at most
_SLICE = 1 << 18  # prefix hashes that are taken in pairs together, about
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, ascending within each, and the texts' bounds.

    Words lie between ASCII white space; A-Z count as a-z. A text of fewer words is one
    shingle, a text without words has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    owner = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    owner, coded = owner[full.to_numpy(zero_copy_only=False)], flat.filter(full).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    each = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else known
    lengths = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(lengths) - lengths
    n = max(0, len(each) - words + 1)
    hashes = np.full(n, words, dtype=np.uint64)
    for k in range(words):
        hashes = _mixed(hashes * _MIX[0] + each[k : k + n])
    whole = owner[:n] == owner[words - 1 : words - 1 + n]  # shingles that do not reach into the next text
    hashes, of = hashes[whole], owner[:n][whole]
    short = np.flatnonzero((lengths > 0) & (lengths < words))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64) + lengths[short].astype(np.uint64)
        for k in range(words - 1):
            has = lengths[short] > k
            own[has] = _mixed(own[has] * _MIX[0] + each[starts[short][has] + k])
        hashes, of = np.concatenate([hashes, own]), np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    fresh = np.ones(len(of), dtype=bool)
    fresh[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of[fresh], minlength=len(texts)))])
    return hashes[fresh], bounds


def _points(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have equal numbers."""
    spans = zip(bounds[:-1].tolist(), bounds[1:].tolist())
    return np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in spans], dtype=np.uint64).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        yield batch, *shingle_sets(batch.column("text"), words)


def near_by_fingerprint(points: DataFrame, bits: int = 4) -> DataFrame:
    """Pairs ``a, b, n, m`` of sets, with their sizes, whose SimHash fingerprints lie within ``bits``.

    ``points(point, fp, n)``. The pairs connect all sets of such fingerprints: the least of a
    fingerprint's sets stands for it. Pairs whose sizes rule out a similarity of 0.8 are left out.
    """
    sets = points.filter("n > 0")
    heads = materialize(sets.groupBy("fp").agg(F.min(F.struct("point", "n")).alias("head")).select("fp", "head.point", "head.n"))
    least = [heads.select(F.col("fp").alias(f"{x}fp"), F.col("point").alias(x), F.col("n").alias(y)) for x, y in (("a", "n"), ("b", "m"))]
    apart = links_within(heads.select("fp"), bits).select(F.col("a").alias("afp"), F.col("b").alias("bfp"))
    apart = apart.join(least[0], "afp").join(least[1], "bfp")
    same = sets.select(F.col("fp").alias("afp"), F.col("point").alias("b"), F.col("n").alias("m")).join(least[0], "afp").filter("a <> b")
    pairs = apart.select("a", "b", "n", "m").unionByName(same.select("a", "b", "n", "m"))
    return pairs.filter("4 * greatest(n, m) <= 5 * least(n, m)")


def shared_prefixes(rows: DataFrame, words: int = 5) -> DataFrame:
    """What sets share in their prefixes: pairs ``a, b, n, m, shared``, and ``a, n, df, least``
    (with null ``b``) for hashes in the prefixes of more than ``_FEW`` sets.

    The prefix of a set of n hashes are its n / 5 + l smallest, l = n / 10 + 1. Two sets of
    similarity 0.8 or more have at most n / 5 hashes each that the other lacks, so both
    prefixes hold their first min(l) common hashes. ``shared`` counts common hashes that stand in
    at most ``_FEW`` prefixes, some in each row of a pair; pairs whose sizes rule out a
    similarity of 0.8 are left out. ``df`` is the number of prefixes with a hash, ``least`` the smallest
    of their sets. Prefixes are shuffled in blocks by hash.
    """
    parts = partitions(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, bounds in _texts(batches, words):
            n = np.diff(bounds)
            most = np.where(n > 0, n // 5 + n // 10 + 1, 0)
            place = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
            head = place < np.repeat(most, n)
            found, of = hashes[head], np.repeat(np.arange(len(n), dtype=np.uint16), most)
            part = (found % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            points = _points(hashes, bounds)
            blocks = []
            for p in np.flatnonzero(np.diff(ends)).tolist():
                at = order[ends[p] : ends[p + 1]]
                held, local = np.unique(of[at], return_inverse=True)
                blocks.append(
                    (p, found[at].tobytes(), local.astype(np.uint16).tobytes(), points[held].tobytes(), n[held].astype(np.int64).tobytes())
                )
            columns = list(zip(*blocks)) if blocks else [()] * 5
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, type=k) for c, k in zip(columns, kinds)], ["part", "hashes", "own", "points", "sizes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list] = {}
        for batch in batches:
            for part, *block in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "own", "points", "sizes"))):
                own = np.frombuffer(block[1], dtype=np.uint16)
                point, n = np.frombuffer(block[2], dtype=np.int64), np.frombuffer(block[3], dtype=np.int64)
                met.setdefault(part, []).append((np.frombuffer(block[0], dtype=np.uint64), point[own], n[own]))
        while met:
            hashes, point, n = (np.concatenate(x) for x in zip(*met.popitem()[1]))
            order = np.lexsort((point, hashes))
            hashes, point, n = hashes[order], point[order], n[order]
            fresh = np.ones(len(hashes), dtype=bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (point[1:] != point[:-1])  # copies count once
            hashes, point, n = hashes[fresh], point[fresh], n[fresh]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            df = np.diff(np.append(first, len(hashes)))
            several = np.flatnonzero((df > 1) & (df <= _FEW))
            for some in np.array_split(several, 1 + int(df[several].sum()) // _SLICE):
                yield _shared([*pairs_of_groups(point, n, first[some], df[some]), None, None])
            least, df = np.repeat(point[first], df), np.repeat(df, df)
            often = np.flatnonzero(df > _FEW)
            for at in np.array_split(often, 1 + len(often) // _SLICE):
                yield _shared([point[at], None, n[at], None, None, df[at], least[at]])

    blocks = rows.select("text").mapInArrow(cut, "part int, hashes binary, own binary, points binary, sizes binary")
    return blocks.repartitionById(parts, F.col("part")).mapInArrow(meet, ", ".join(f"{c} long" for c in _SHARED))


_SHARED = ["a", "b", "n", "m", "shared", "df", "least"]


def _shared(columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.nulls(len(columns[0]), pa.int64()) if c is None else pa.array(c, type=pa.int64()) for c in columns], _SHARED)


def pairs_of_groups(point: np.ndarray, n: np.ndarray, first: np.ndarray, df: np.ndarray) -> list[np.ndarray]:
    """Pairs of ``point`` within groups of ``df`` rows from ``first`` on, of sizes at most 5 / 4
    apart, and the number of groups with both."""
    found = []
    for apart in range(1, int(df.max(initial=0))):
        some, more = first[df > apart], df[df > apart] - apart
        left = np.repeat(some, more) + np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        near = 4 * np.maximum(n[left], n[left + apart]) <= 5 * np.minimum(n[left], n[left + apart])
        found.append((left[near], left[near] + apart))
    if not found:
        return [np.zeros(0, dtype=np.int64)] * 5
    left, right = (np.concatenate(x) for x in zip(*found))
    a, b, n, m = point[left], point[right], n[left], n[right]
    order = np.lexsort((b, a))
    a, b, n, m = a[order], b[order], n[order], m[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
    return [a[start], b[start], n[start], m[start], np.diff(np.append(start, len(a)))]


def clusters(near: DataFrame, shared: DataFrame) -> DataFrame:
    """``point, n, cluster``: sets that may be similar to another share a cluster with it.

    Pairs in ``near`` are candidates. So that none is lost whose fingerprints lie far apart, those
    of ``shared_prefixes`` are added. Similar sets share at least the smaller of their l (see ``shared_prefixes``) prefix hashes.
    A pair is a candidate if those that it shares, with the frequent ones that both have, are
    as many. Two sets that share frequent hashes alone have that many of them; such sets are
    linked by each frequent hash. If each lays aside the most frequent of these, less than half
    of what it needs, two similar sets still have one in common, while a line that stands in
    many texts connects few of them.
    """
    often = shared.filter("b IS NULL").select(F.col("a").alias("point"), "n", "df", "least")
    counts = materialize(often.groupBy("point").agg(F.count("*").alias("held")))
    pairs = shared.filter("b IS NOT NULL").groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum("shared").alias("shared"))
    for end in ("a", "b"):
        held = counts.select(F.col("point").alias(end), F.col("held").alias(f"held_{end}"))
        pairs = pairs.join(held, end, "left")
    enough = F.floor(F.least("n", "m") / 10) + 1
    both = F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
    pairs = materialize(near.unionByName(pairs.filter(F.col("shared") + both >= enough).select("a", "b", "n", "m")))
    need = F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10) + 1
    own = W.partitionBy("point")
    alive = (
        often.withColumn("held", F.count("*").over(own))
        .withColumn("nth", F.row_number().over(own.orderBy(F.desc("df"), "least")))
        .filter((F.col("held") >= need) & (F.col("nth") > F.floor((need - 1) / 2)))
    )
    alive = materialize(alive.select("point", "n", "least").distinct())
    stars = alive.select(F.col("least").alias("a"), F.col("point").alias("b"))
    roots = components(pairs.select("a", "b").unionByName(stars))
    sets = pairs.select(F.col("a").alias("point"), "n").unionByName(pairs.select(F.col("b").alias("point"), F.col("m").alias("n")))
    sets = sets.unionByName(alive.select("point", "n")).distinct()
    return sets.join(roots.select(F.col("node").alias("point"), F.col("root").alias("cluster")), "point")


def similar_links(flat: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect exactly the sets (in ascending order of size) of similarity 0.8 or more.

    Each set is compared with all larger ones of at most 5 / 4 its size, but for those that
    are connected with it already.
    """
    sizes, codes = np.diff(bounds), np.unique(flat, return_inverse=True)[1]
    forest, mark = Forest(len(sizes)), np.zeros(len(flat), dtype=bool)
    ends = np.searchsorted(4 * sizes, 5 * sizes, side="right")
    for a in range(len(sizes)):
        others = np.arange(a + 1, ends[a])
        others = others[forest.roots(others) != forest.roots(np.array([a]))[0]] if len(others) else others
        if not len(others):
            continue
        own = codes[bounds[a] : bounds[a + 1]]
        mark[own] = True
        for some in np.array_split(others, 1 + int(sizes[others].sum()) // _BLOCK):
            if not len(some):
                continue
            first = np.cumsum(sizes[some]) - sizes[some]
            at = np.arange(int(sizes[some].sum())) + np.repeat(bounds[:-1][some] - first, sizes[some])
            common = np.add.reduceat(mark[codes[at]], first, dtype=np.int64)
            near = some[5 * common >= 4 * (sizes[a] + sizes[some] - common)]
            forest.link(np.full(len(near), a), near)
        mark[own] = False
    return forest.links


def links(docs: KeyedRows, points: DataFrame, text_col: str, words: int = 5) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the sets of similarity 0.8 or more.

    ``points(point, fp, n, file, at)`` names one row of ``docs`` for each set; only those in a cluster
    meet again. A cluster is cut into blocks of about 2 million shingles, and each pair of
    blocks meets in one task.
    """
    texts = ids_and_texts(docs.df, docs.at, text_col)
    near = near_by_fingerprint(points.select("point", "fp", "n"))
    members = materialize(clusters(near, materialize(shared_prefixes(texts, words))))
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("n") / _BLOCK).alias("blocks")).filter("blocks > 1")
    blocks = members.join(blocks, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    asked = materialize(points.select("point", "file", "at").join(blocks, "point"))
    found = docs.only(asked.select("file", "at")).select(*docs.keys(), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = found.join(asked, ["file", "at"]).withColumn("other", other).filter("blocks = 1 OR block <> other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(F.xxhash64("cluster", low, high).alias("meeting"), "point", "text")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch, hashes, bounds in _texts(batches, words):
            meetings, points = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("meeting", "point"))
            for i in range(len(points)):
                if meetings[i] != now:
                    yield from found(held)
                    now, held = meetings[i], []
                held.append((points[i], hashes[bounds[i] : bounds[i + 1]].copy()))
        yield from found(held)

    def found(held: list) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        held.sort(key=lambda x: len(x[1]))
        points = np.array([p for p, _ in held], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(s) for _, s in held])])
        near = similar_links(np.concatenate([s for _, s in held]), bounds)
        if near:
            a, b = (np.concatenate(x) for x in zip(*near))
            yield pa.record_batch([pa.array(points[a]), pa.array(points[b])], ["a", "b"])

    met = dealt.repartition(partitions(docs.df), "meeting").sortWithinPartitions("meeting")
    return met.mapInArrow(match, "a long, b long")


def drop_near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each component of similar texts.

    SimHash fingerprints of the sets of ``words``-word shingles give candidates, prefixes those
    that fingerprints miss. Texts are linked if the Jaccard similarity of their sets is 0.8 or more; a component is everything reachable. The row with the smallest id stays; a row
    without an id stays only where no row of the component has one, and of several rows with
    that id the one that lies first. A null text is an empty one; texts without words are
    alike. An empty table gives no rows. Rows that go are marked and left out where the rest is
    read; only texts that may be similar to another move.
    """
    docs = keyed_rows(docs)
    texts = ids_and_texts(docs.df, id_col, text_col, *docs.keys())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "file", "at"]
        for batch, hashes, bounds in _texts(batches, words):
            fps, sizes = set_fingerprints(hashes, bounds).view(np.int64), np.diff(bounds)
            found = (_points(hashes, bounds), fps, sizes)
            yield pa.record_batch([*(batch.column(c) for c in names), *map(pa.array, found)], [*names, "point", "fp", "n"])

    rows = materialize(texts.mapInArrow(number, "doc_id long, file long, at long, point long, fp long, n long"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "at")).alias("first")
    points = materialize(rows.groupBy("point").agg(first, F.min("fp").alias("fp"), F.min("n").alias("n")))
    roots = materialize(components(links(docs, points.select("point", "fp", "n", "first.file", "first.at"), text_col, words)))
    named = points.join(roots.withColumnRenamed("node", "point"), "point", "left")
    stay = named.groupBy(F.coalesce("root", "point")).agg(F.min("first").alias("first"))
    return docs.without(rows.join(stay.select("first.file", "first.at"), ["file", "at"], "left_anti").select("file", "at"))
