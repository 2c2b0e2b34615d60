"""Document fingerprints: invertible Bloom lookup tables over digests of paragraph parts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import ids_and_texts, ordered_buckets, partitions

_HASHES = 3
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # of a common bit mixer
_CELLS_AT_ONCE = 1 << 17
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_cells int, next_cells int"
)


def paragraph_digests(text: str, words: int = 8) -> np.ndarray:
    """64-bit digests of the parts of a text's paragraphs, all different.

    A paragraph (a line) falls into sentences and these into parts of at most ``words``
    words. The n-th occurrence of a part is hashed with its number, so that repeats count.
    """
    seen: dict[bytes, int] = {}
    out, digest = [], xxhash.xxh3_64_intdigest
    for sentence in text.replace("\n", ". ").replace("! ", ". ").replace("? ", ". ").split(". "):
        own = sentence.split()
        for at in range(0, len(own), words):
            part = " ".join(own[at : at + words]).encode()
            n = seen.get(part, 0)
            seen[part] = n + 1
            out.append(digest(b"%s\0%d" % (part, n) if n else part))
    return np.unique(np.array(out, dtype=np.uint64))


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64(salt * _MIX[0] & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 99) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Tables:
    """One table of ``cells`` cells for each of several key sets."""

    count: np.ndarray
    keys: np.ndarray
    checks: np.ndarray
    salt: int

    @property
    def cells(self) -> int:
        return self.count.shape[1]

    def places(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The cells of each key, one in each third of its owner's table."""
        part = self.cells // _HASHES
        rows = [
            owner * self.cells + j * part + (_mixed(keys, self.salt * _HASHES + j + 1) % np.uint64(part)).astype(np.int64)
            for j in range(_HASHES)
        ]
        return np.concatenate(rows)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        at = self.places(keys, owner)
        np.add.at(self.count.reshape(-1), at, np.tile(sign.astype(np.int32), _HASHES))
        np.bitwise_xor.at(self.keys.reshape(-1), at, np.tile(keys, _HASHES))
        np.bitwise_xor.at(self.checks.reshape(-1), at, np.tile(_check(keys), _HASHES))

    def minus(self, a: np.ndarray, b: np.ndarray) -> Tables:
        """The differences of the tables numbered ``a`` and ``b``, pair by pair."""
        return Tables(
            self.count[a] - self.count[b], self.keys[a] ^ self.keys[b], self.checks[a] ^ self.checks[b], self.salt
        )

    def text(self, i: int) -> str:
        raw = self.count[i].astype("<i4").tobytes() + self.keys[i].astype("<u8").tobytes()
        return base64.b64encode(raw + self.checks[i].astype("<u4").tobytes()).decode()


def tables(sets: list[np.ndarray], cells: int, salt: int = 0) -> Tables:
    n = len(sets)
    out = Tables(
        np.zeros((n, cells), dtype=np.int32), np.zeros((n, cells), dtype=np.uint64), np.zeros((n, cells), np.uint32), salt
    )
    if n:
        keys = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(n), [len(s) for s in sets])
        out.add(keys, owner, np.ones(len(keys)))
    return out


def peel(difference: Tables) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Recover the keys of differences: (was all recovered, keys of a alone, keys of b alone)."""
    n, cells = difference.count.shape
    left: list[np.ndarray] = []
    for _ in range(2 * cells):  # a key that only seems alone in its cell could come back for ever
        owner, cell = np.nonzero(np.abs(difference.count) == 1)
        keys = difference.keys[owner, cell]
        pure = difference.checks[owner, cell] == _check(keys)
        owner, keys, sign = owner[pure], keys[pure], difference.count[owner, cell][pure]
        if not len(keys):
            break
        order = np.lexsort((keys, owner))
        owner, keys, sign = owner[order], keys[order], sign[order]
        first = np.concatenate([[True], (np.diff(owner) != 0) | (keys[1:] != keys[:-1])])
        owner, keys, sign = owner[first], keys[first], sign[first]
        difference.add(keys, owner, -sign)
        left.append(np.stack([owner.astype(np.uint64), keys, (sign > 0).astype(np.uint64)]))
    done = ~(difference.count.any(axis=1) | difference.keys.any(axis=1) | difference.checks.any(axis=1))
    owner, keys, sign = np.concatenate(left, axis=1) if left else np.zeros((3, 0), dtype=np.uint64)
    sides = []
    for side in (1, 0):
        mine = sign == side
        order = np.argsort(owner[mine], kind="stable")
        cuts = np.searchsorted(owner[mine][order], np.arange(1, n))
        sides.append(np.split(keys[mine][order], cuts))
    return done, sides[0], sides[1]


def differences(
    sets: list[np.ndarray], pairs: list[tuple[int, int]], cells: int = 24
) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, Tables]:
    """For each pair of key sets the keys of one alone, by subtracting and peeling tables.

    Pairs that do not peel are tried again with larger tables and other hashes, until all
    have peeled. How much larger follows from the table that failed: each differing key adds
    about one to the sum of the squared deviations of the counts, for each of its cells; and
    there are at least as many as the sets differ in size. Returns both sides, the
    table size that each pair took, and the first tables.
    """
    base = tables(sets, cells)
    left: list = [None] * len(pairs)
    right: list = [None] * len(pairs)
    took = np.zeros(len(pairs), dtype=np.int32)
    waiting = {cells: list(range(len(pairs)))}
    while waiting:
        size = min(waiting)
        todo = waiting.pop(size)
        step = max(1, _CELLS_AT_ONCE // size)
        for at in range(0, len(todo), step):
            part = todo[at : at + step]
            a, b = (np.array([pairs[i][k] for i in part]) for k in (0, 1))
            if size > cells:
                used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                own = tables([sets[i] for i in used], size, size)
                difference = own.minus(place[: len(a)], place[len(a) :])
            else:
                difference = base.minus(a, b)
            expected = np.maximum(
                difference.count.var(axis=1) * size, np.abs(difference.count.sum(axis=1))
            ) / _HASHES
            done, only_a, only_b = peel(difference)
            for i, ok, x, y, d in zip(part, done, only_a, only_b, expected):
                if ok:
                    left[i], right[i], took[i] = x, y, size
                else:
                    larger = size
                    while larger <= size or larger < 1.5 * d:
                        larger *= 2
                    waiting.setdefault(larger, []).append(i)
    return left, right, took, base


def likeness(n_a: int, n_b: int, only_a: int, only_b: int) -> float:
    """Twice the common parts over all parts of both; 1 if neither has any."""
    return (n_a - only_a + n_b - only_b) / (n_a + n_b) if n_a + n_b else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many first ones of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(
    docs: DataFrame, cells: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every text and its edited text, and likenesses found by peeling.

    The next document is that of the next id; ties follow the text; after the last comes the
    first. Texts are shuffled once, into ranges of ids; each range also gets the first row
    of the next one. What a task holds is a batch of rows, not its range.

    A null or empty text has no parts; two such texts are alike by 1. Null ids come first.
    Repeated rows give a row each; a table of one row is its own next; an empty table gives
    no rows.
    """
    ranged, n = ordered_buckets(ids_and_texts(docs, id_col, text_col), "doc_id", partitions(docs))
    firsts = ranged.groupBy("bucket").agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null_first")
    )
    present = sorted(firsts.collect(), key=lambda r: r.bucket)  # one row for each range
    before = {r.bucket: present[i - 1].bucket for i, r in enumerate(present)}
    known = [r.first for r in present if not r.null_first]
    is_first = F.col("doc_id").isin(known) if known else F.lit(False)
    if any(r.null_first for r in present):
        is_first = is_first | F.col("doc_id").isNull()
    heads = ranged.filter(is_first).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    # Within a bucket with null ids the null one is first, and others can't be.
    turned = F.element_at(F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]), F.col("bucket")) if before else F.lit(0)
    heads = heads.select(turned.cast("int").alias("bucket"), "doc_id", "text", F.lit(True).alias("head"))
    rows = ranged.select("bucket", "doc_id", "text", F.lit(False).alias("head")).unionByName(heads)
    ordered = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "head", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for doc, text, head in zip(*(batch.column(c) for c in ("doc_id", "text", "head"))):
                text, last = text.as_py(), head.as_py()
                held.append((doc.as_py(), text))
                weight += len(text)
                if last or len(held) > 256 or weight > 1 << 21:
                    yield _rows(held, cells)
                    held, weight = ([] if last else held[-1:]), 0

    return ordered.mapInArrow(run, SCHEMA)


def _rows(held: list[tuple], cells: int) -> pa.RecordBatch:
    """Result rows for all but the last of ``held``, which is the next of the one before."""
    texts = [t for _, t in held]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    sets = [paragraph_digests(t) for t in texts + changed]
    n = len(changed)
    pairs = [(i, len(texts) + i) for i in range(n)] + [(i, i + 1) for i in range(n)]
    left, right, took, base = differences(sets, pairs, cells)
    near = [
        likeness(len(sets[a]), len(sets[b]), len(x), len(y)) for (a, b), x, y in zip(pairs, left, right)
    ]
    columns = [
        pa.array([d for d, _ in held[:-1]], type=pa.int64()),
        pa.array([len(t) for t in texts[:-1]], type=pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], type=pa.string()),
        pa.array([base.text(i) for i in range(n)], type=pa.string()),
        pa.array([base.text(len(texts) + i) for i in range(n)], type=pa.string()),
        pa.array(near[:n], type=pa.float64()),
        pa.array(near[n:], type=pa.float64()),
        pa.array(took[:n], type=pa.int32()),
        pa.array(took[n:], type=pa.int32()),
    ]
    return pa.record_batch(columns, [part.split()[0] for part in SCHEMA.split(", ")])
