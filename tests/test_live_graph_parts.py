"""State of the live graph in parts: many documents share a group, a node's documents have several."""

import itertools
import json
import random

import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from causeway import fixed_values as fv
from causeway.operators import chunking, extraction
from causeway.streaming import ingest, live_graph
from tests.test_live_graph import _graph


class Map(dict):
    messages = 0

    def getValue(self, key):
        self.messages += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.messages += 1
        self[key] = value

    def removeKey(self, key):
        self.messages += 1
        del self[key]

    def iterator(self):
        return iter(sorted(self.items()))


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_entries_of_a_group_share_state_rows_and_none_is_lost():
    rows, size, kept, rnd = Map(), Value(), {}, random.Random(4)
    for turn, n in enumerate([1, 40, 1, 200, 3000, 1, 40, 5000, 1]):
        entries = live_graph.Entries(rows, size)
        for _ in range(n):
            name = json.dumps(["i", f"d{rnd.randrange(6000)}"])
            assert entries.get(name) == kept.get(name)
            kept[name] = [turn, ["ä", None]]
            entries.put(name, kept[name])
        assert sorted(map(repr, entries.values())) == sorted(map(repr, kept.values()))
        entries.write()
    assert size.value[1] == len(kept) > 3000 and len(rows) == size.value[0]
    stored = [x for (said,) in rows.values() for x in json.loads(said).items()]
    assert dict(stored) == kept and len(stored) == len(kept)
    assert all(len(json.loads(said)) < 2 * live_graph._PER_SLOT for (said,) in rows.values())
    before = rows.messages
    entries = live_graph.Entries(rows, size)
    for name in kept:
        entries.get(name)
    assert rows.messages - before == len(rows) < len(kept) / 8


def test_a_part_follows_its_documents_through_any_versions():
    rnd = random.Random(5)
    part = live_graph.FirstAndLast()
    part.rows, part.size, part.whole = Map(), Value(), Value()
    newest: dict[str, tuple] = {}
    turn = 0
    for _ in range(30):
        rows = []
        for _ in range(rnd.choice([1, 200])):
            document, version = f"d{rnd.randrange(300)}", rnd.randrange(12)
            says = random.Random(f"{document} {version}").random() < 0.6  # what a version says does not change
            seq = [version * 1000 + int(document[1:]), 0, 0, 0] if says else None
            rows.append(Row(document_id=document, version=version, seq=seq, payload=f"p{seq}" if says else None))
            if version >= newest.get(document, (-1,))[0]:
                newest[document] = (version, seq)
        out = list(part.handleInputRows(("i", "n", "a", "", 3), iter(rows), None))
        said = [seq for _, seq in newest.values() if seq is not None]
        first, last = min(said, default=None), max(said, default=None)
        turn += len(out)
        whole = part.whole.get() or (0, None, None, None)
        assert tuple(whole) == (turn, first, last, f"p{last}" if last else None)
        assert not out or out[0].asDict() == {
            "investigation_id": "i", "kind": "n", "a": "a", "b": "", "part": 3,
            "turn": turn, "first": first, "last": last, "payload": whole[3],
        }
    assert turn > 5


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_node_of_many_documents_is_many_groups(few, tmp_path):
    root = str(tmp_path)
    rows = [("i", f"d{i}", i, f"redis timeout {i}") for i in range(300)]
    newer = [("i", f"d{i}", 1000 + i, "payment" if i % 2 else "redis") for i in range(0, 300, 3)]
    sent = []
    for part in (rows, rows, newer):
        few.createDataFrame(part, ingest.ARRIVING).coalesce(1).write.mode("append").parquet(f"{root}/in")
        sent += part
        documents = ingest.read_documents(few, f"{root}/in")
        live_graph.start_versions(documents, f"{root}/chunks", f"{root}/c1", once=True).awaitTermination()
        form = few.read.parquet(f"{root}/chunks").schema
        chunks = few.readStream.schema(form).parquet(f"{root}/chunks")
        live_graph.start_graph(chunks, f"{root}/graph", f"{root}/c2", once=True).awaitTermination()
        live = live_graph.read_live_graph(few, f"{root}/graph")
        assert [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in live] == _graph(few, sent)
    state = few.read.format("statestore").option("stateVarName", "documents").load(f"{root}/c2")
    redis = state.filter("key.kind = 'n' AND key.a = 'Redis'")
    assert redis.select("key.part").distinct().count() == live_graph._MENTION_PARTS
    assert redis.count() < 300 / 4  # rows of state for 300 documents
    seen = few.read.format("statestore").option("stateVarName", "seen").load(f"{root}/c1")
    assert seen.selectExpr("sum(size(from_json(user_map_value.entries, 'map<string,string>')))").head()[0] == 300


def test_texts_of_one_version_that_differ_give_each_chunk_once(few, tmp_path):
    words = ["calm", "still", "redis"]
    texts = [" ".join(words[: 2 + speaks] * n) for n in (1, 5, 9) for speaks in (0, 1)]
    rows = [("i", f"d{a}-{b}", 1, texts[x]) for a, b in itertools.product(range(6), repeat=2) for x in (a, b)]
    rows += [(None, "e", 2, "calm"), (None, "e", 2, "calm"), ("i", "blank", 1, " \n"), ("i", "null", 1, None)]
    few.createDataFrame(rows, ingest.ARRIVING).repartition(3).write.parquet(f"{tmp_path}/in")
    documents = ingest.read_documents(few, f"{tmp_path}/in")
    live_graph.start_versions(documents, f"{tmp_path}/chunks", f"{tmp_path}/c", 6, 2, once=True).awaitTermination()
    got = few.read.parquet(f"{tmp_path}/chunks")
    one = ingest.extracted(few.createDataFrame(rows, ingest.ARRIVING), 6, 2)
    assert got.schema.simpleString() == one.schema.simpleString()
    chunks = [repr(r) for r in got.collect()]
    assert set(chunks) <= {repr(r) for r in one.collect()}
    ids = ["investigation_id", "chunk_id"]
    assert sorted(map(repr, got.select(*ids).collect())) == sorted(map(repr, one.select(*ids).distinct().collect()))


def test_texts_that_may_connect_hold_all_that_do(spark):
    words = ["caused", "LEADS TO", "Lead to", "led to", "reſulted in", "RESULTED İN", "resulted ın", "TRİGGERED", "calm", "lead  to"]
    texts = [(f"redis down {w} payment failure",) for w in words] + [(None,), ("",), ("This is his ship.",)]
    found = spark.createDataFrame(texts, "text string").withColumn("lower", F.lower("text")).select(
        "text", F.col("text").rlike("(?iU)" + fv.CONNECTORS).alias("does"), extraction.may_connect(F.col("lower")).alias("may"),
        extraction.may_mention(F.col("text")).alias("mentions"),
    ).collect()
    assert all(r.may for r in found if r.does) and sum(bool(r.does) for r in found) == 8
    assert [r.text for r in found if r.may and not r.does] == []
    assert [r.text for r in found if not r.mentions] == [None, "", "This is his ship."]


def test_texts_whose_chunks_mention_something_may(spark):
    rnd = random.Random(6)
    words = [w for w, _ in extraction.DICTIONARY] + ["Redis", "TİMEOUT", "APİ", "caused", "LED TO", "reſulted in"] + ["calm"] * 60
    gaps = [" ", "  ", "\n", "\u2028", "\x1c", "\u3000", "\x85 "]
    rows = []
    for i in range(400):
        said = " ".join(rnd.choice(words) for _ in range(3 if i % 2 else 12))
        rows.append((str(i), "".join(rnd.choice(gaps) if c == " " else c for c in said) if i else None))
    texts = spark.createDataFrame(rows, "id string, text string").withColumn("mentions", extraction.may_mention(F.col("text")))
    chunks = chunking.with_chunk_id(chunking.chunk_texts(texts, "id", "mentions", size=400).withColumn("document_id", F.col("id")))
    found = extraction.heuristic_extraction(chunks).select("mentions", F.size("entities").alias("n")).collect()
    assert all(r.mentions for r in found if r.n) and sum(r.n > 0 for r in found) > 300
    assert sum(not r.mentions for r in found) == sum(r.n == 0 and not r.mentions for r in found) > 10


def test_rows_of_a_part_may_come_in_several_frames():
    versions = live_graph.VersionsOfParts()
    versions.rows, versions.size = Map(), Value()
    columns = ["part", "investigation_id", "document_id", "doc_seq", "text", "at", "found"]

    def send(*frames):
        made = [pd.DataFrame([(0, "i", *row) for row in rows], columns=columns, dtype=object) for rows in frames]
        return [row for out in versions.handleInputRows((0,), iter(made), None) for row in out.to_dict("records")]

    said = json.dumps({"entities": [{"name": "Redis", "type": "DATABASE"}], "relations": []})
    first = send([("a", "1", "calm", None, None)], [("a", "2", "redis", "0,0,1", said), ("b", "1", "calm", None, None)])
    assert [(r["document_id"], r["doc_seq"], r["text"], r["start"]) for r in first] == [("a", "2", "redis", 1), ("b", "1", "calm", 0)]
    assert send([("a", "2", "redis", "0,0,1", said)], [("a", "1", "calm", None, None)]) == []
    new, gone = send([("a", "3", "calm", None, None)])
    assert (new["text"], new["at"], new["found"]) == ("calm", None, None)
    assert (gone["doc_seq"], gone["text"], gone["at"]) == ("3", None, None)
    assert json.loads(gone["found"])["entities"] == [{"name": "Redis", "type": None}]
