"""The graph kept up to date in a stream against one batch over the newest versions."""

import itertools
import random
import time

import pytest
from pyspark.sql import Row

from causeway.operators import extraction, graph
from causeway.streaming import ingest, live_graph

WORDS = ["redis", "timeout", "payment", "kafka", "auth", "calm", "error", "nothing", "checkout"]


def _texts(n, seed=3):
    rnd = random.Random(seed)
    made = []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(3, 12))]
        if i % 3 == 0:
            words += [rnd.choice(WORDS), "caused", rnd.choice(WORDS) + "."]
        made.append(" ".join(words))
    return made


def _graph(spark, rows):
    """Nodes and edges of one batch over the newest version of each document."""
    newest = {}
    for r in rows:
        if newest.get(r[:2], r)[2] <= r[2]:
            newest[r[:2]] = r
    found = ingest.extracted(spark.createDataFrame(list(newest.values()), ingest.ARRIVING), 6, 2)
    merged = graph.merge(extraction.entity_mentions(found), extraction.relation_mentions(found))
    return [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in merged]


class Stream:
    def __init__(self, spark, root, keep_ms=None):
        self.spark, self.root, self.keep_ms, self.n = spark, str(root), keep_ms, itertools.count()

    def send(self, rows):
        """Write each list of rows as files of their own, then let both queries go on."""
        frame = self.spark.createDataFrame(rows, ingest.ARRIVING).coalesce(1)
        frame.write.mode("append").parquet(f"{self.root}/in")
        documents = ingest.read_documents(self.spark, f"{self.root}/in", files_per_trigger=1)
        live_graph.start_versions(documents, f"{self.root}/chunks", f"{self.root}/c1", 6, 2, self.keep_ms, once=True).awaitTermination()

    def follow(self):
        form = self.spark.read.parquet(f"{self.root}/chunks").schema
        chunks = self.spark.readStream.schema(form).parquet(f"{self.root}/chunks")
        live_graph.start_graph(chunks, f"{self.root}/graph", f"{self.root}/c2", once=True).awaitTermination()
        live = live_graph.read_live_graph(self.spark, f"{self.root}/graph")
        return [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in live]


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_any_order_and_replay_give_the_graph_of_one_batch(few, tmp_path):
    texts = _texts(14)
    rows = [(f"i{i % 2}", f"d{i % 9}", i, t) for i, t in enumerate(texts)]  # some are newer versions
    rnd = random.Random(1)
    late = rows[:]
    rnd.shuffle(late)
    stream = Stream(few, tmp_path)
    sent = []
    for part in (late[:6], late[6:] + late[:2], rows):
        stream.send(part)
        sent += part
        assert stream.follow() == _graph(few, sent)
    stored = few.read.parquet(f"{tmp_path}/chunks").filter("chunk_id is not null")
    assert stored.count() == stored.select("investigation_id", "document_id", "doc_seq", "chunk_id").distinct().count()
    newest = live_graph.read_versions(few, f"{tmp_path}/chunks")
    assert newest.select("investigation_id", "document_id", "doc_seq").distinct().count() == len({r[:2] for r in rows})


def test_a_newer_version_takes_back_what_it_no_longer_says(few, tmp_path):
    stream = Stream(few, tmp_path)
    rows = [("i", "a", 1, "redis timeout"), ("i", "b", 2, "kafka caused outage of payment."), ("i", "c", 3, "redis only")]
    stream.send(rows)
    assert stream.follow() == _graph(few, rows)
    more = [("i", "a", 4, "payment"), ("i", "b", 5, "calm")]
    stream.send(more)
    live = stream.follow()
    assert live == _graph(few, rows + more) and "Kafka" not in repr(live) and "Timeout" not in repr(live)


def test_state_goes_when_its_time_is_over(few, tmp_path):
    stream = Stream(few, tmp_path, keep_ms=1500)
    for turn in range(3):
        stream.send([("i", f"t{turn}-{i}", i, "redis timeout") for i in range(10)])
        time.sleep(2)
    seen = few.read.format("statestore").option("stateVarName", "seen").load(f"{tmp_path}/c1")
    assert seen.count() == 10  # those of the last turn alone
    stored = few.read.parquet(f"{tmp_path}/chunks").filter("chunk_id is not null")
    assert stored.count() == 30


def test_reports_merge_in_any_order():
    rnd = random.Random(2)

    def report():
        seq = None if rnd.random() < 0.3 else [rnd.randrange(3), rnd.randrange(9)]
        said = None if seq is None or rnd.random() < 0.3 else f"p{seq}"
        return (rnd.randrange(3), seq, seq if said else None, said)

    for _ in range(300):
        some = [report() for _ in range(4)]
        results = set()
        for order in itertools.permutations(some + some[:1]):
            state = None
            for r in order:
                state = live_graph.merged(state, r)
            results.add(repr(state))
        assert len(results) == 1


def test_a_document_costs_rows_and_one_look_at_its_state():
    class Seen:
        kept, looks = {}, 0

        def get(self):
            self.looks += 1
            return self.kept.get("d")

        def update(self, value):
            self.kept["d"] = value

    def chunk(version, name, chunk_id="d:0"):
        found = [{"name": name, "type": "API"}]
        return Row(investigation_id="i", document_id="d", doc_seq=version, chunk_id=chunk_id, entities=found, relations=[])

    versions = live_graph.Versions(None)
    versions.seen = Seen()

    def send(*rows):
        return list(versions.handleInputRows(("i", "d"), iter(rows), None))

    assert send(chunk(1, "Old"), chunk(2, "Redis"), chunk(2, "Redis"), chunk(1, "Old")) == [chunk(2, "Redis")]
    assert send(chunk(2, "Redis"), chunk(1, "Old")) == []
    new, gone = send(chunk(3, "Kafka"))
    assert new == chunk(3, "Kafka") and gone.chunk_id is None and gone.doc_seq == 3
    assert gone.entities == [{"name": "Redis", "type": None}] and versions.seen.looks == 3
