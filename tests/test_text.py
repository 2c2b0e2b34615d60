"""Text expressions against their plain Python counterparts."""

import random

from pyspark.sql import functions as F

from causeway.functions import responses as rs, scores as sc, text as tx

SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　"


def _column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


def _random_texts(alphabet, n, length, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, length))) for _ in range(n)]


def test_tokens_equal_python_split(spark):
    texts = _random_texts("ab-é" + SPACES, 500, 20, 1)
    assert _column(spark, texts, tx.tokens) == [t.split() for t in texts]


def test_strip_equals_python_strip(spark):
    texts = _random_texts("ab" + SPACES, 300, 8, 2)
    assert _column(spark, texts, tx.strip) == [t.strip() for t in texts]


def test_title_case_equals_python_title(spark):
    texts = _random_texts("abcXYZ 5_-éßÉñ中ǆʰ\t ωΣσ'", 2000, 12, 3) + ["5xx", "load-balancer", "they're"]
    assert _column(spark, texts, tx.title_case) == [t.title() for t in texts]


def test_line_timestamp_prefers_patterns_over_position(spark):
    lines = ["07:45:59 copy of 1999-12-31 23:59:58.125Z", "(21:00:07)", "Nov  3 08:09:10 db7 up", "9:8:7 is no time"]
    assert _column(spark, lines, tx.line_timestamp) == ["1999-12-31 23:59:58.125Z", "21:00:07", "08:09:10", None]
    host = _column(spark, lines[2:3], lambda c: tx.line_timestamp(c, syslog_first=True))
    assert host == ["Nov  3 08:09:10"]


def test_log_level(spark):
    lines = ["WARNING: x", "WARN y", "error", "xERROR", "a CRITICAL b ERROR"]
    assert _column(spark, lines, tx.log_level) == ["WARNING", "WARN", None, None, "CRITICAL"]


def test_document_type(spark):
    names = ["a.LOG", "b.pdf", "My-Runbook.md", "postmortem.txt", "incident.log", "search.txt", "x.txt", "Design.doc"]
    assert _column(spark, names, tx.document_type) == [
        "LOG", "PDF", "RUNBOOK", "INCIDENT_REPORT", "LOG", "ARCHITECTURE_DOC", "TEXT", "ARCHITECTURE_DOC",
    ]


def test_summary_and_snippet(spark):
    texts = [" a\nb ", "x" * 180, "x" * 181]
    assert _column(spark, texts, tx.summary) == ["a b", "x" * 180, "x" * 180 + "..."]
    assert _column(spark, ["y" * 150], tx.snippet) == ["y" * 140]
    late = "a" * 141 + " error"
    assert _column(spark, [late, "Failover"], lambda c: tx.severity(tx.snippet(c))) == ["info", "warning"]


def test_question_keywords(spark):
    expected = {
        "Which node-pool lost quorum after 02:15?": ["node-pool", "lost", "quorum", "after"],
        "SHOW the disk latency of db-17": ["disk", "latency", "db-17"],
        "is it an ok go": [],
        "429 and 429, naïve": ["429", "and", "429"],
        "": [],
    }
    assert _column(spark, list(expected), tx.question_keywords) == list(expected.values())


def test_confidence(spark):
    row = spark.range(1).select(
        sc.root_cause_confidence(F.lit(3), F.lit(True)),
        sc.root_cause_confidence(F.lit(20), F.lit(True)),
        sc.root_cause_confidence(F.lit(0), F.lit(True)),
        sc.root_cause_confidence(F.lit(0), F.lit(False)),
        sc.percent(F.lit(0.29)),
        sc.confidence_band(F.lit(0.695)),
        sc.confidence_band(F.lit(0.4)),
        sc.confidence_band(F.lit(0.1)),
    ).first()
    assert tuple(row) == (0.65, 0.85, 0.35, 0.1, 28, "high", "medium", "low")


def test_json_payload(spark):
    cases = {
        '{"a": 1}': (1.0, None),
        '```json\n{"a": 2}\n```': (2.0, None),
        'Sure! {"a": 3} done': (3.0, None),
        '[{"a": 4}]': (None, "not an object"),
        "nothing": (None, "not json"),
        '{"a": 5': (None, "not json"),
        "  ": (None, "empty"),
        None: (None, "empty"),
        '{"a": "x"}': (None, None),
        '{"a": null}': (None, None),
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, s string").orderBy("i")
    got = df.select(
        rs.number_field(rs.json_payload(F.col("s")), "a"), rs.parse_error(F.col("s"))
    ).collect()
    assert [tuple(r) for r in got] == list(cases.values())


def test_small_defaults(spark):
    assert _column(spark, ["t", "", None], lambda c: tx.default_title(c, F.lit("0123456789"))) == [
        "t", "Investigation 01234567", "Investigation 01234567",
    ]
    assert _column(spark, ["12:01", "", None], lambda c: tx.event_time_label(c, F.lit(2))) == ["12:01", "#3", "#3"]
    assert _column(spark, [None, "q"], tx.default_question)[1] == "q"
