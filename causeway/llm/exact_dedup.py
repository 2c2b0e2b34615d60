"""Exact duplicates by an index of cuckoo filters over the digests of normalised texts."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import WORD_GAP, ids_and_texts, keyed_rows, partitions
from causeway.session import materialize

_SLOTS = 4
_KICKS = 200
_SUMS = 100_000  # digests that a task adds up before it hands them on
BUCKET_ROWS = 250_000  # rows for each bucket of the index, at most about
INDEX = "bucket int, digest string, keep_id long, keep_file long, keep_at long, group_size long"


def normalised(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space."""
    return F.regexp_replace(text, WORD_GAP, " ")


class CuckooIndex:
    """Live digests of one bucket in a cuckoo table whose slots hold their entries.

    A digest has a 16-bit tag and two rows of four slots; the second row follows from the
    first and the tag, so that a tag can move without its digest. Only where a tag is equal
    is the slot's content looked at, which alone decides; a table without an equal tag in
    both rows does not hold the digest. An insertion into full rows moves others to their
    second rows; where that does not end, the table is made twice as large and filled again
    from the stored digests.
    """

    def __init__(self, rows: int = 64):
        self.resized = 0
        self._empty(rows)

    def _empty(self, rows: int) -> None:
        self.rows = rows  # a power of two
        self.tags = array("H", bytes(2 * _SLOTS * rows))
        self.held: list[tuple[str, list] | None] = [None] * (_SLOTS * rows)

    def _places(self, digest: str) -> tuple[int, int, int]:
        h = xxhash.xxh3_64_intdigest(digest)
        tag = (h >> 48) or 1
        first = h & (self.rows - 1)
        return tag, first, self._other(first, tag)

    def _other(self, row: int, tag: int) -> int:
        return (row ^ (tag * 0x5BD1E995)) & (self.rows - 1)

    def _slot(self, digest: str) -> int:
        """Where a live digest lies, or -1."""
        tag, a, b = self._places(digest)
        for row in (a, b):
            for slot in range(_SLOTS * row, _SLOTS * row + _SLOTS):
                if self.tags[slot] == tag and self.held[slot][0] == digest:
                    return slot
        return -1

    @property
    def stored(self) -> dict[str, list]:
        return dict(x for x in self.held if x is not None)

    def find(self, digest: str) -> list | None:
        """The entry of a live digest, or None."""
        slot = self._slot(digest)
        return None if slot < 0 else self.held[slot][1]

    def insert(self, digest: str, entry: list) -> None:
        """Take in a digest that is not live."""
        left = self._put(digest, entry)
        while left is not None:
            self.resized += 1
            everything = [x for x in self.held if x is not None] + [left]
            self._empty(self.rows * 2)
            left = None
            for i, (key, value) in enumerate(everything):
                left = self._put(key, value)
                if left is not None:  # larger still, with all that have no slot yet
                    self.held += everything[i + 1 :]
                    break

    def _put(self, digest: str, entry: list) -> tuple[str, list] | None:
        """Find a slot; what is left without one, if any, goes back to the caller."""
        tag, a, b = self._places(digest)
        content = (digest, entry)
        for row in (a, b):
            for slot in range(_SLOTS * row, _SLOTS * row + _SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.held[slot] = tag, content
                    return None
        row = b
        for kick in range(_KICKS):
            slot = _SLOTS * row + (tag + kick) % _SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            content, self.held[slot] = self.held[slot], content
            row = self._other(row, tag)
            for slot in range(_SLOTS * row, _SLOTS * row + _SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.held[slot] = tag, content
                    return None
        return content

    def delete(self, digest: str) -> bool:
        """Take a live digest out; False if it is not there."""
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.tags[slot], self.held[slot] = 0, None
        return True


def _bucket(digest: Column, buckets: int) -> Column:
    """The bucket of a digest, from its first 32 bits."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _earlier(one: tuple, other: tuple) -> tuple:
    """The smaller of two keepers (id, file, place): ids before none, then by where they lie."""
    return min(one, other, key=lambda k: (k[0] is None, k[0] or 0, k[1], k[2]))


def added_up(rows: DataFrame) -> DataFrame:
    """``rows(digest, doc_id, file, at)`` as changes, each task's rows of a text added up.

    A task holds a bounded number of sums, so a text with very many copies leaves it as few
    rows, and other texts as they come; the index merges what tasks hand on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for digest, *key in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc_id", "file", "at"))):
                known = sums.get(digest)
                if known is None:
                    sums[digest] = [tuple(key), 1]
                else:
                    known[0] = _earlier(known[0], tuple(key))
                    known[1] += 1
            if len(sums) >= _SUMS:
                yield handed(sums)
                sums = {}
        yield handed(sums)

    def handed(sums: dict[str, list]) -> pa.RecordBatch:
        keys = list(zip(*(k for k, _ in sums.values()))) if sums else [()] * 3
        columns = [pa.array(list(sums), type=pa.string()), *(pa.array(k, type=pa.int64()) for k in keys)]
        return pa.record_batch([*columns, pa.array([n for _, n in sums.values()], type=pa.int64())], CHANGES)

    form = ", ".join(f"{name} {'string' if name == 'digest' else 'long'}" for name in CHANGES)
    return rows.select("digest", "doc_id", "file", "at").mapInArrow(run, form)


CHANGES = ["digest", "doc_id", "file", "at", "n"]


def apply_changes(changes: DataFrame, buckets: int) -> DataFrame:
    """The live entries after all changes, bucket by bucket, each in a cuckoo index of its own.

    ``changes(digest, doc_id, file, at, n)``: rows of a text (``n`` copies, the first of which
    has this id and lies there) that come with ``n`` > 0 or go with ``n`` < 0; ``file`` and
    ``at`` may be absent. A digest may come in any number of changes. Additions are applied
    before removals; a digest of which no copy is left is deleted. After removals, the keeper
    is the first row that was ever added, unless the text went altogether. Earlier results can
    be passed in again as additions.
    """
    place = [F.col(c).cast("long").alias(c) if c in changes.columns else F.lit(0).cast("long").alias(c) for c in ("file", "at")]
    dealt = (
        changes.select(_bucket(F.col("digest"), buckets).alias("bucket"), "digest", "doc_id", *place, "n")
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", F.col("n") < 0)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, index = None, CuckooIndex()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", *CHANGES))
            for at, digest, *key, n in zip(*columns):
                if at != bucket:
                    yield _entries(bucket, index)
                    bucket, index = at, CuckooIndex()
                entry = index.find(digest)
                if entry is None:
                    if n > 0:
                        index.insert(digest, [tuple(key), n])
                    continue
                entry[1] += n
                if n > 0:
                    entry[0] = _earlier(entry[0], tuple(key))
                if entry[1] <= 0:
                    index.delete(digest)
        yield _entries(bucket, index)

    return dealt.mapInArrow(run, INDEX)


def _entries(bucket: int | None, index: CuckooIndex) -> pa.RecordBatch:
    live = index.stored
    keys = list(zip(*(key for key, _ in live.values()))) if live else [()] * 3
    columns = [pa.array([bucket] * len(live), type=pa.int32()), pa.array(list(live), type=pa.string())]
    columns += [pa.array(k, type=pa.int64()) for k in keys]
    columns.append(pa.array([n for _, n in live.values()], type=pa.int64()))
    return pa.record_batch(columns, ["bucket", "digest", "keep_id", "keep_file", "keep_at", "group_size"])


def _with_groups(rows: DataFrame) -> DataFrame:
    """``rows(digest, doc_id, file, at)``, written once, with ``keep_id``, ``group_size`` and
    ``kept``; only groups of several rows are joined back."""
    buckets = max(partitions(rows), -(-rows.count() // BUCKET_ROWS))
    entries = apply_changes(added_up(rows), buckets).filter("group_size > 1").drop("bucket")
    alone = F.col("group_size").isNull()
    first = (F.col("file") == F.col("keep_file")) & (F.col("at") == F.col("keep_at"))
    return rows.join(entries, "digest", "left").select(
        "digest", "doc_id", "file", "at",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | first).alias("kept"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group of equal texts; the row with the smallest id is kept.

    Texts are equal if they are after white space is normalised (see ``normalised``). Only
    digests are shuffled, first added up where they are read, so that a text with very many
    copies reaches the index in a few rows from each task; the index finds and merges what
    different tasks have of it.

    A null text is an empty one. Of repeated rows (equal id and text) one is kept. Null ids
    are kept only in a group without others, whose ``keep_id`` is null. An empty table gives
    no rows.
    """
    digest = F.sha2(normalised(F.col("text")), 256).alias("digest")
    rows = keyed_rows(materialize(ids_and_texts(docs, id_col, text_col).select("doc_id", digest)))
    found = _with_groups(rows.df.select("doc_id", "digest", *rows.keys()))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without rows whose text an earlier row has.

    As ``exact_groups``: one row stays for each text, of repeated rows (equal id and text, or
    none with an id) the one that lies first. Rows that go are marked and left out where the
    rest is read; no text moves.
    """
    docs = keyed_rows(docs)
    digest = F.sha2(normalised(F.col("text")), 256).alias("digest")
    rows = materialize(ids_and_texts(docs.df, id_col, text_col, *docs.keys()).select("doc_id", "file", "at", digest))
    return docs.without(_with_groups(rows).filter(~F.col("kept")).select("file", "at"))
