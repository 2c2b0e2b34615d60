"""Declared schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: Position of a mention in ingest order; every "first" and "last" compares it.
MENTION_SEQ = _struct(doc_seq=_l, chunk_index=_l, kind=_i, pos=_i)

INVESTIGATIONS = _struct(
    investigation_id=_s, title=_s, status=_s, created_at=T.TimestampType()
)
STATUS_EVENTS = _struct(investigation_id=_s, status=_s, seq=_l)
INCIDENT_DOCUMENTS = _struct(
    document_id=_s, investigation_id=_s, filename=_s, doc_type=_s, stored_path=_s,
    size_bytes=_l, uploaded_at=T.TimestampType(), doc_seq=_l,
)
LOG_LINES = _struct(document_id=_s, line_number=_i, raw=_s, timestamp=_s, level=_s)
PAGE_TEXT = _struct(document_id=_s, page_no=_i, text=_s)
CHUNKS = _struct(
    investigation_id=_s, document_id=_s, doc_seq=_l, chunk_id=_s, chunk_index=_l,
    word_start=_l, word_end=_l, text=_s,
)
QUESTIONS = _struct(query_id=_s, investigation_id=_s, text=_s)
RESPONSES = _struct(key=_s, response=_s)
#: Answers about chunks, whose ids are unique within their investigation only.
CHUNK_RESPONSES = _struct(investigation_id=_s, key=_s, response=_s)
CHAT_HISTORY = _struct(conv_id=_s, turn=_l, role=_s, content=_s)

ENTITY = _struct(name=_s, type=_s)
RELATION = _struct(source=_s, target=_s, type=_s, confidence=_d)
ENTITY_MENTIONS = _struct(
    investigation_id=_s, name=_s, type=_s, chunk_id=_s, seq=MENTION_SEQ
)
RELATION_MENTIONS = _struct(
    investigation_id=_s, source=_s, target=_s, type=_s, confidence=_d, chunk_id=_s,
    seq=MENTION_SEQ,
)
GRAPH_NODES = _struct(
    investigation_id=_s, name=_s, type=_s, source_chunk_id=_s, node_seq=MENTION_SEQ
)
GRAPH_EDGES = _struct(
    investigation_id=_s, source=_s, target=_s, type=_s, confidence=_d,
    evidence_chunk_id=_s, edge_seq=MENTION_SEQ,
)
HITS = _struct(
    query_id=_s, investigation_id=_s, document_id=_s, chunk_id=_s, text=_s, score=_d, rank=_i
)
