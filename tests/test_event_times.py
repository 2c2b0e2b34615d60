"""Dates carried to times of day, against one pass over the lines of each document."""

import random
import re
from datetime import datetime

import pytest

from causeway.operators import reasoning
from causeway.operators.event_times import chunk_times, event_times

ROWS = "investigation_id string, document_id string, at long, text string"


def _parse(day, clock):
    try:
        return datetime.strptime(f"{day} {clock}", "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None


def _brute(rows):
    day, out = {}, []
    for i, d, at, text in sorted(rows, key=lambda r: (str(r[:2]), r[2])):
        time = re.search(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\b\d{2}:\d{2}:\d{2}\b", text or "")
        time = time and time.group()
        last = day.get((i, d))
        if time is None:
            out.append((str(i), d, at, None, None))
        elif len(time) > 8:
            out.append((str(i), d, at, time, _parse(time[:10], time[11:])))
        else:
            out.append((str(i), d, at, time, _parse(last, time)))
        for named in re.findall(r"\d{4}-\d{2}-\d{2}(?=[T ]\d{2}:\d{2}:\d{2})", text or ""):
            if _parse(named, "00:00:00"):
                day[i, d] = named
    return out


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_dates_are_carried_as_in_one_pass(spark, block):
    rnd = random.Random(block)
    texts = ["10:00:00 a", "23:59:59 late", "no time", "", None, "2024-02-30 10:00:00 no such day", "99:00:00",
             "x 08:30:00 then 2024-03-01T09:00:00 and 2024-03-02 10:00:00"]
    texts += [f"2024-01-{n:02} 12:00:{n:02} day" for n in range(1, 5)]
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice("xy"), n, rnd.choice(texts)) for n in range(900)]
    got = event_times(spark.createDataFrame(rows, ROWS).repartition(5), ["investigation_id", "document_id"], "at", block=block)
    assert got.columns == ["investigation_id", "document_id", "at", "timestamp", "event_ts"]
    found = sorted((str(r[0]), r[1], r[2], r[3], r[4]) for r in got.collect())
    assert [tuple(map(str, r)) for r in found] == [tuple(map(str, r)) for r in sorted(_brute(rows), key=lambda r: r[:3])]


def test_timelines_in_the_order_of_days(spark):
    chunks = spark.createDataFrame(
        [("i", "d", 0, "c0", "2024-01-02 23:00:00 start"), ("i", "d", 1, "c1", "01:00:00 same day"),
         ("i", "e", 0, "c2", "2024-01-01 05:00:00 before"), ("i", "f", 0, "c3", "00:00:01 unknown day"), ("i", "f", 1, "c4", "never")],
        "investigation_id string, document_id string, chunk_index long, chunk_id string, text string",
    )
    hits = chunks.selectExpr("'q' as query_id", "investigation_id", "chunk_id", "text", "cast(substr(chunk_id, 2) as int) as rank")
    plain = [r["source_chunk_ids"][0] for r in reasoning.timelines(hits).orderBy("order").collect()]
    assert plain == ["c3", "c1", "c2", "c0", "c4"]
    dated = reasoning.timelines(hits, chunk_times(chunks)).orderBy("order").collect()
    assert [r["source_chunk_ids"][0] for r in dated] == ["c2", "c1", "c0", "c3", "c4"]
    assert [r["event_ts"] and str(r["event_ts"]) for r in dated] == [
        "2024-01-01 05:00:00", "2024-01-02 01:00:00", "2024-01-02 23:00:00", None, None
    ]
    assert reasoning.timelines(hits).columns == [c for c in reasoning.timelines(hits, chunk_times(chunks)).columns if c != "event_ts"]


def test_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert event_times(none, ["investigation_id", "document_id"], "at").count() == 0
