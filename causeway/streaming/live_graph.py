"""A knowledge graph kept up to date while documents stream in.

Two queries with keyed state. The first lets each document's versions through once: a repeat
is dropped, a newer version is passed on with a row that says what the older one mentioned. The
second keeps, for every node and edge, what each document says of it, and hands on the
node or edge whenever that changes.

A group of state costs several messages and a batch of its own, and one that many documents share is
the work of one task. So documents are dealt to parts by their hash: those of a part share a group of the
first query, and a node or edge has a group for each part of the documents that mention it. What
parts say of it is put together when the graph is read, from a row for each part.

What a document says is its version with its first and last mention. Of two reports on a
document the higher version counts, and of equal ones that with mentions, so that reports may
come in any order and any number of times. First and last over all documents are kept beside
them and only worked out again where a report is replaced that was one of them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from causeway import schemas
from causeway.functions import text as tx
from causeway.operators import chunking, extraction
from causeway.streaming.ingest import extracted

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DOCUMENT = ["investigation_id", "document_id"]
_KEY = ["investigation_id", "kind", "a", "b"]
_UPDATES = "investigation_id string, kind string, a string, b string, part int, turn bigint, first array<bigint>, last array<bigint>, payload string"
_PAYLOAD = "type string, confidence double, chunk_id string"
_FOUND = "entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,type:string,confidence:double>>"
_VERSION_PARTS = 1024  # groups of documents; the rows of one in a batch are held at once
_MENTION_PARTS = 16  # groups that the documents of one node or edge are dealt to
_PER_SLOT = 64


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State of these queries lives in RocksDB, off the heap."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _part(parts: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


class Entries:
    """Entries by name of one group, about ``_PER_SLOT`` of them in a row of its state.

    State is asked for by messages, so that rows of many entries cost less than one for each. Names are
    dealt to slots by their hash. A group starts with one slot and has four times as many
    whenever they are full, so a look at an entry stays as cheap however many there are.
    """

    def __init__(self, rows, size):
        self.rows, self.size = rows, size
        self.kept = size.get() or (1, 0)
        self.slots, self.count = self.kept
        self.read: dict[int, dict] = {}
        self.changed: set[int] = set()

    def _slot(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.slots

    def _entries(self, slot: int) -> dict:
        if slot not in self.read:
            row = self.rows.getValue((slot,)) if self.kept[1] else None
            self.read[slot] = {} if row is None else json.loads(row[0])
        return self.read[slot]

    def get(self, name: str):
        return self._entries(self._slot(name)).get(name)

    def put(self, name: str, value) -> None:
        slot = self._slot(name)
        entries = self._entries(slot)
        self.count += name not in entries
        entries[name] = value
        self.changed.add(slot)

    def values(self) -> Iterator:
        """All values, as they are after what was put."""
        if self.kept[1]:
            for (slot,), (entries,) in self.rows.iterator():
                if slot not in self.read:
                    yield from json.loads(entries).values()
        for entries in self.read.values():
            yield from entries.values()

    def write(self) -> None:
        """Store what was put."""
        if self.count > _PER_SLOT * self.slots:
            for slot in range(self.kept[0]):
                self._entries(slot)
            everything, self.read = self.read, {}
            while self.count > _PER_SLOT * self.slots:
                self.slots *= 4
            for entries in everything.values():
                for name, value in entries.items():
                    self.read.setdefault(self._slot(name), {})[name] = value
            self.changed = set(self.read)
            for slot in set(everything) - self.changed:
                self.rows.removeKey((slot,))
        for slot in self.changed:
            self.rows.updateValue((slot,), (json.dumps(self.read[slot], separators=(",", ":")),))
        if self.kept != (self.slots, self.count):
            self.size.update((self.slots, self.count))


def newer(known: tuple | None, rows) -> tuple[tuple | None, list]:
    """What is known of a document after ``rows`` (null if nothing new), and the rows to pass on."""
    newest, chunks = (known[0] if known else None), {}
    for row in rows:
        if newest is None or row.doc_seq > newest:
            newest, chunks = row.doc_seq, {row.chunk_id: row}
        elif row.doc_seq == newest and chunks:  # else what is there already
            chunks.setdefault(row.chunk_id, row)
    if not chunks:
        return None, []
    names = sorted({e["name"] for chunk in chunks.values() for e in chunk.entities or []})
    pairs = sorted({(r["source"], r["target"]) for chunk in chunks.values() for r in chunk.relations or []})
    return (newest, names, [p[0] for p in pairs], [p[1] for p in pairs]), list(chunks.values())


def taken_back(known: tuple) -> dict[str, list]:
    """What the version before mentioned."""
    return {
        "entities": [{"name": n, "type": None} for n in known[1]],
        "relations": [{"source": s, "target": t, "type": None, "confidence": None} for s, t in zip(known[2], known[3])],
    }


class Versions(StatefulProcessor):
    """For each document the newest version seen, and the names and pairs it mentions.

    A group is a document, so that it can go when its time is over. Groups are small, so rows come one by
    one: a frame for each group costs ten times what is done with it.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState(
            "seen", "version bigint, names array<string>, sources array<string>, targets array<string>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.seen.get()
        now, passed = newer(known, rows)
        if now is None:
            return
        self.seen.update(now)
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield from passed
        if known:
            document = {"investigation_id": key[0], "document_id": key[1], "doc_seq": now[0]}
            yield Row(**dict.fromkeys(passed[0].asDict()) | document | taken_back(known))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Sent(NamedTuple):
    """A row for ``newer``: a chunk, or a whole text, which mentions nothing."""

    place: int
    doc_seq: int | None
    at: str | None
    found: str | None

    @property
    def chunk_id(self) -> str:
        return self.at.split(",")[0] if self.at else "whole"

    @property
    def entities(self) -> list[dict]:
        return json.loads(self.found)["entities"] if self.found else []

    @property
    def relations(self) -> list[dict]:
        return json.loads(self.found)["relations"] if self.found else []


class VersionsOfParts(StatefulProcessor):
    """``Versions`` of documents that stay, many in a group.

    Rows come in frames: chunks with their place as text and what they mention as JSON, and texts that
    mention nothing as they are, without a place. ``doc_seq`` is text, as numbers next to nulls lose digits.
    Of texts of one version that differ, one not yet cut follows on the chunks of the others.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("seen", "slot int", "entries string")
        self.size = handle.getValueState("seen_size", "slots int, entries bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows, ignore_index=True)
        documents: dict[tuple, list[_Sent]] = {}
        columns = ["investigation_id", "document_id", "doc_seq", "at", "found"]
        for place, (scope, document, version, at, found) in enumerate(zip(*(frame[c] for c in columns))):
            sent = _Sent(place, None if version is None else int(version), at, found)
            documents.setdefault((scope, document), []).append(sent)
        seen = Entries(self.rows, self.size)
        places, starts, gone = [], [], []
        for document, its in documents.items():
            name = json.dumps(document)
            known = seen.get(name)
            if len(its) > 1:  # texts not yet cut come last, the longest first
                its.sort(key=lambda sent: (0, 0) if sent.at else (1, -len(frame["text"][sent.place].split())))
            now, passed = newer(known, its)
            if now is None:
                continue
            seen.put(name, now)
            cut = [int(sent.at.split(",")[0]) + 1 for sent in passed if sent.at]
            places += [sent.place for sent in passed]
            starts += [max(cut, default=0)] * len(passed)
            if known:
                gone.append((*document, None if now[0] is None else str(now[0]), json.dumps(taken_back(known))))
        seen.write()
        if places:
            yield frame.iloc[places].drop(columns="part").assign(start=starts)
        if gone:
            taken = pd.DataFrame(gone, columns=["investigation_id", "document_id", "doc_seq", "found"], dtype=object)
            none = pd.Series([None] * len(gone), dtype=object)
            yield taken.assign(text=none, at=none, start=0)

    def close(self) -> None:
        pass


def _versions_of_parts(documents: DataFrame, size: int | None, overlap: int | None) -> DataFrame:
    """The chunks that ``VersionsOfParts`` passes, with what they mention.

    What documents mentioned before must be known where versions meet, so those that may mention
    something are cut and searched before, the others only cut, after a repeat of them was dropped.
    """
    texts = documents.select(*_DOCUMENT, "doc_seq", "text").filter(tx.has_words(F.col("text")))
    speaks = F.coalesce(extraction.may_mention(F.col("text")), F.lit(False))
    own = texts.withColumn("speaks", speaks).withColumn("words", F.when(F.col("speaks"), tx.tokens(F.col("text"))))
    none = F.lit(None).cast("bigint")
    whole = F.struct(none.alias("chunk_index"), none.alias("word_start"), none.alias("word_end"), F.lit(None).cast("string").alias("text"))
    cut = own.select(
        *_DOCUMENT, "doc_seq", F.when(~F.col("speaks"), F.col("text")).alias("whole"),
        F.explode(F.when(F.col("speaks"), chunking.windows(F.col("words"), size, overlap)).otherwise(F.array(whole))).alias("c"),
    ).select(*_DOCUMENT, "doc_seq", "whole", "c.*").withColumn("speaks", speaks)
    searched = cut.withColumns({"silent": F.when(~F.col("speaks"), F.col("text")), "text": F.when(F.col("speaks"), F.col("text"))})
    found = extraction.heuristic_extraction(searched)
    mentions = (F.size("entities") > 0) | (F.size("relations") > 0)
    sent = found.select(
        _part(_VERSION_PARTS, *_DOCUMENT).alias("part"), *_DOCUMENT, F.col("doc_seq").cast("string").alias("doc_seq"),
        F.coalesce("text", "silent", "whole").alias("text"),
        F.when(F.col("whole").isNull(), F.concat_ws(",", "chunk_index", "word_start", "word_end")).alias("at"),
        F.when(mentions, F.to_json(F.struct("entities", "relations"))).alias("found"),
    )
    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sent.schema if f.name != "part")  # any of it may be null
    passed = sent.groupBy("part").transformWithStateInPandas(VersionsOfParts(), f"{form}, start bigint", "append", "none")

    split = passed.withColumns(
        {
            "words": F.when(F.col("at").isNull(), tx.tokens(F.col("text"))),
            "place": F.transform(F.split("at", ","), lambda x: x.cast("bigint")),
            "said": F.from_json("found", _FOUND),
        }
    )
    place = [F.get("place", F.lit(i)).alias(c) for i, c in enumerate(("chunk_index", "word_start", "word_end"))]
    own = F.array(F.struct(*place, F.col("text").alias("text")))
    uncut = F.col("at").isNull() & F.col("text").isNotNull()
    chunks = split.select(
        *_DOCUMENT, F.col("doc_seq").cast(documents.schema["doc_seq"].dataType).alias("doc_seq"), "said",
        F.explode(F.when(uncut, chunking.windows(F.col("words"), size, overlap, F.col("start"))).otherwise(own)).alias("c"),
    ).select(*_DOCUMENT, "doc_seq", "c.*", "said")
    types = found.schema
    return chunks.select(
        *_DOCUMENT, "doc_seq", "chunk_index", "word_start", "word_end", "text",
        F.when(F.col("text").isNotNull(), F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"))).alias("chunk_id"),
        *[F.coalesce(f"said.{c}", F.array().cast(types[c].dataType)).alias(c) for c in ("entities", "relations")],
    )


def start_versions(
    documents: DataFrame,
    sink: str,
    checkpoint: str,
    size: int | None = None,
    overlap: int | None = None,
    keep_ms: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Append the extracted chunks of each document version to ``sink``, once.

    ``documents`` as in ``ingest.start_ingest``; the version is ``doc_seq``. A document whose
    version was seen, or an older one, adds nothing. With a newer version comes a row without
    ``chunk_id`` whose entities and relations are those of the version before. The state is an
    entry for each document with its names; ``keep_ms`` after a document's last new version it
    goes, and a later repeat would be taken for new.
    """
    spark = documents.sparkSession
    if keep_ms is None:
        passed = _versions_of_parts(documents, size, overlap)
    else:
        chunks = extracted(documents, size, overlap)
        form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)  # any of it may be null
        passed = chunks.groupBy(*_DOCUMENT).transformWithState(Versions(keep_ms), form, "append", "processingTime")
    with _rocks(spark):
        writer = (
            passed.writeStream.format("parquet")
            .outputMode("append")
            .option("path", sink)
            .option("checkpointLocation", checkpoint)
        )
        if once and keep_ms is not None:  # with timers there is always another batch to run
            return writer.trigger(once=True).start()
        return (writer.trigger(availableNow=True) if once else writer).start()


def read_versions(spark: SparkSession, sink: str) -> DataFrame:
    """The chunks of each document's newest version. Only documents that had several versions
    are looked for; the others are read as they lie."""
    rows = spark.read.parquet(sink)
    newest = rows.filter("chunk_id IS NULL").groupBy(*_DOCUMENT).agg(F.max("doc_seq").alias("newest"))
    replaced = F.col("newest").isNotNull() & (F.col("doc_seq") < F.col("newest"))
    return rows.filter("chunk_id IS NOT NULL").join(newest, _DOCUMENT, "left").filter(~replaced).drop("newest")


def reports(chunks: DataFrame) -> DataFrame:
    """What rows of ``start_versions`` say of nodes and edges, one row for each mention.

    ``seq`` is null where a version before mentioned it; ``payload`` holds what the mention
    says, and is null for the end of a relation. Ends that an entity of the chunk names come after
    it and say no more, so they are left out.
    """
    now = F.col("chunk_id").isNotNull()
    names = F.transform("entities", lambda m: m["name"])

    def report(kind: str, a: Column, b: Column, place: int, pos: Column, payload: Column) -> Column:
        seq = F.array(F.col("doc_seq").cast("bigint"), F.col("chunk_index").cast("bigint"), F.lit(place).cast("bigint"), pos.cast("bigint"))
        return F.struct(
            F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), F.when(now, seq).alias("seq"), F.when(now, payload).alias("payload")
        )

    def said(m: Column, *fields: str) -> Column:
        return F.to_json(F.struct(*[m[f].alias(f) for f in fields], F.col("chunk_id")))

    def ends(side: str, offset: int) -> Column:
        def end(m: Column, i: Column) -> Column:
            unnamed = m.isNotNull() & ~F.coalesce(F.array_contains(names, m[side]), F.lit(False))
            return F.when(unnamed, report("n", m[side], F.lit(""), 1, i * 2 + offset, F.lit(None).cast("string")))

        return F.transform("relations", end)

    nodes = F.transform(
        "entities", lambda m, i: F.when(m.isNotNull(), report("n", m["name"], F.lit(""), 0, i, said(m, "type")))
    )
    edges = F.transform(
        "relations",
        lambda m, i: F.when(m.isNotNull(), report("e", m["source"], m["target"], 1, i, said(m, "type", "confidence"))),
    )
    each = [F.coalesce(x, F.array()) for x in (nodes, edges, ends("source", 0), ends("target", 1))]
    return (
        chunks.filter("size(entities) > 0 OR size(relations) > 0")
        .select("investigation_id", "document_id", F.col("doc_seq").alias("version"), F.explode(F.concat(*each)).alias("m"))
        .filter(F.col("m").isNotNull())
        .select("investigation_id", "document_id", "version", "m.*")
    )


class FirstAndLast(StatefulProcessor):
    """For a part of the documents of a node or edge what each says, and the first and last of all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("documents", "slot int", "entries string")
        self.size = handle.getValueState("documents_size", "slots int, entries bigint")
        self.whole = handle.getValueState("whole", "turn bigint, first array<bigint>, last array<bigint>, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[str, tuple] = {}
        for row in rows:
            document = json.dumps(row.document_id)
            last = row.seq if row.payload is not None else None
            new[document] = merged(new.get(document), (row.version, row.seq, last, row.payload))
        documents = Entries(self.rows, self.size)
        before = self.whole.get()
        turn, first, last, payload = before or (0, None, None, None)
        before = (first, last, payload)
        again = changed = False
        for document, report in new.items():
            old = documents.get(document)
            old = None if old is None else tuple(old)
            now = merged(old, report)
            if now == old:
                continue
            changed = True
            documents.put(document, now)
            again = again or (old is not None and old[1] is not None and (old[1] == first or old[2] == last) and now[0] > old[0])
            if now[1] is not None and (first is None or now[1] < first):
                first = now[1]
            if now[2] is not None and (last is None or now[2] > last):
                last, payload = now[2], now[3]
        if not changed:
            return
        if again:
            first, last, payload = None, None, None
            for _, own, end, said in documents.values():
                first = own if own is not None and (first is None or own < first) else first
                if end is not None and (last is None or end > last):
                    last, payload = end, said
        documents.write()
        if before == (first, last, payload):
            return
        self.whole.update((turn + 1, first, last, payload))
        yield Row(**dict(zip([*_KEY, "part"], key)), turn=turn + 1, first=first, last=last, payload=payload)

    def close(self) -> None:
        pass


def merged(one: tuple | None, other: tuple) -> tuple:
    """What counts of two reports ``(version, first, last, payload)`` on the same document."""
    if one is None or other[0] > one[0]:
        return other
    if other[0] < one[0]:
        return one
    firsts = [r[1] for r in (one, other) if r[1] is not None]
    lasts = [(r[2], r[3]) for r in (one, other) if r[2] is not None]
    last, payload = max(lasts) if lasts else (None, None)
    return one[0], min(firsts, default=None), last, payload


def start_graph(chunks: DataFrame, sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append what changes of nodes and edges to ``sink``.

    ``chunks``: a stream of the rows that ``start_versions`` writes, in any order, also
    repeatedly. The state of a node or edge is an entry for each document that mentions it.
    """
    spark = chunks.sparkSession
    with _rocks(spark):
        writer = (
            reports(chunks).withColumn("part", _part(_MENTION_PARTS, "document_id")).groupBy(*_KEY, "part")
            .transformWithState(FirstAndLast(), _UPDATES, "append", "none")
            .writeStream.format("parquet")
            .outputMode("append")
            .option("path", sink)
            .option("checkpointLocation", checkpoint)
        )
        return (writer.trigger(availableNow=True) if once else writer).start()


def read_live_graph(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as ``graph.merge`` gives them, from the newest state of each part of them."""
    rows = spark.read.schema(_UPDATES).parquet(sink)
    parts = rows.groupBy(*_KEY, "part").agg(F.max_by(F.struct("first", "last", "payload"), "turn").alias("s"))
    now = (
        parts.select(*_KEY, "s.*").filter("first IS NOT NULL").groupBy(*_KEY)
        .agg(F.min("first").alias("first"), F.from_json(F.max_by("payload", "last"), _PAYLOAD).alias("said"))
    )
    seq = F.struct(
        *[F.get("first", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.MENTION_SEQ.fields)]
    )
    nodes = now.filter("kind = 'n'").select(
        "investigation_id", F.col("a").alias("name"), F.coalesce("said.type", F.lit("EVENT")).alias("type"),
        F.col("said.chunk_id").alias("source_chunk_id"), seq.alias("node_seq"),
    )
    edges = now.filter("kind = 'e'").select(
        "investigation_id", F.col("a").alias("source"), F.col("b").alias("target"), "said.type", "said.confidence",
        F.col("said.chunk_id").alias("evidence_chunk_id"), seq.alias("edge_seq"),
    )
    return nodes, edges

