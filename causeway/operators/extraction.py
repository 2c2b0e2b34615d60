"""Entities and relations of a chunk, found within the row: no shuffle, no window."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from causeway import fixed_values as fv
from causeway.functions import responses as rs
from causeway.functions import text as tx

_ENTITIES = "array<struct<name:string,type:string>>"
_RELATIONS = "array<struct<source:string,target:string,type:string,confidence:double>>"
_PAIRS = "array<struct<source:string,target:string>>"

# Lower case of letters outside ASCII that count as ``i`` or ``s`` where case is ignored.
_ODD_LETTERS = ["\u0131", "i\u0307", "\u017f"]

DICTIONARY = [*fv.COMPONENTS, *[(word, "ERROR") for word in fv.ERRORS]]


def dictionary_slots(lower: Column, word_boundary: bool = False) -> Column:
    """One slot per keyword, in dictionary order: its entity if found anywhere, else null.

    ``lower`` must be a column of the row, not an expression: it is read once per keyword.
    """

    def found(word: str) -> Column:
        return lower.rlike(rf"(?U)\b{word}\b") if word_boundary else F.contains(lower, F.lit(word))

    return F.array(
        *[
            F.when(
                found(word),
                F.struct(F.lit(word.title()).alias("name"), F.lit(kind).alias("type")),
            )
            for word, kind in DICTIONARY
        ]
    ).cast(_ENTITIES)


def dictionary_hits(chunks: DataFrame, word_boundary: bool = False) -> DataFrame:
    """One row per chunk and keyword found in it."""
    slots = chunks.withColumn("lower", F.lower("text")).withColumn(
        "slots", dictionary_slots(F.col("lower"), word_boundary)
    )
    return (
        slots.select("investigation_id", "chunk_id", F.posexplode_outer("slots").alias("pos", "hit"))
        .filter(F.col("hit").isNotNull())
        .select("investigation_id", "chunk_id", "pos", "hit.name", "hit.type")
    )


def may_connect(lower: Column) -> Column:
    """Whether a text in lower case may hold a connector, without a pattern."""
    return reduce(or_, [F.contains(lower, F.lit(word)) for word in [*fv.CONNECTOR_WORDS, *_ODD_LETTERS]])


def may_mention(text: Column) -> Column:
    """Whether chunks of a text may hold a word of the dictionary or a connector.

    One automaton reads batches of texts once, where each word costs a pass over them. Words
    of a chunk have one space between them, those of a text any white space. Texts with a letter outside
    ASCII that may count as ``i`` or ``s`` may.
    """
    space = r"[\t-\r\x1c-\x1f\x{85}\pZ]+"
    words = [space.join(map(re.escape, w.split(" "))) for w in [*[word for word, _ in DICTIONARY], *fv.CONNECTOR_WORDS]]
    pattern = f"(?i:{'|'.join(words)})|[\u0130\u0131\u017f]"

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return found(text)


def causal_pairs(text: Column, connected: Column) -> Column:
    """``cause - connector - effect`` phrases, left to right without overlap.

    A match holds a connector and no punctuation but hyphens and underscores. So, of a chunk
    that may have a connector word (``connected``), the costly pattern scans only the runs between
    punctuation that hold one. Cause and effect are then read from each short match.
    """
    runs = F.filter(
        F.split(text, fv.CAUSAL_BREAK),
        lambda run: (F.length(run) >= fv.CAUSAL_LENGTH) & run.rlike("(?iU)" + fv.CONNECTORS),
    )
    matches = F.when(
        connected,
        F.flatten(F.transform(runs, lambda run: F.regexp_extract_all(run, F.lit(fv.CAUSAL), F.lit(0)))),
    ).otherwise(F.array().cast("array<string>"))

    def phrase(match: Column, group: int) -> Column:
        return tx.title_case(tx.strip(F.regexp_extract(match, fv.CAUSAL, group)))

    pairs = F.transform(
        matches,
        lambda m: F.struct(phrase(m, 1).alias("source"), phrase(m, 2).alias("target")),
    )
    return F.filter(
        pairs, lambda p: (F.length(p["source"]) >= 3) & (F.length(p["target"]) >= 3)
    ).cast(_PAIRS)


def heuristic_extraction(chunks: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Add ``entities`` and ``relations`` to each chunk.

    Entities are distinct by name, the first type wins, in order of finding: dictionary
    words, then both ends of every causal phrase. One causal phrase in a chunk replaces
    the links between neighbouring entities.
    """
    found = chunks.withColumn("lower", F.lower("text")).withColumns(
        {
            "connected": may_connect(F.col("lower")),
            "slots": dictionary_slots(F.col("lower"), word_boundary),
        }
    )
    found = found.withColumns(
        {
            "hits": F.array_compact("slots"),
            "pairs": causal_pairs(F.col("text"), F.col("connected")),
        }
    )
    event = lambda name: F.struct(name.alias("name"), F.lit("EVENT").alias("type"))
    ends = F.flatten(
        F.transform("pairs", lambda p: F.array(event(p["source"]), event(p["target"])))
    )
    found = found.withColumn("mentions", F.concat("hits", ends.cast(_ENTITIES)))
    found = found.withColumn("all_names", F.transform("mentions", lambda e: e["name"]))
    found = found.withColumn("names", F.array_distinct("all_names"))

    entities = F.transform(
        "names",
        lambda name: F.struct(
            name.alias("name"),
            F.get(
                F.col("mentions"), F.array_position("all_names", name).cast("int") - 1
            )["type"].alias("type"),
        ),
    )
    causes = F.transform(
        "pairs",
        lambda p: F.struct(
            p["source"].alias("source"),
            p["target"].alias("target"),
            F.lit("CAUSES").alias("type"),
            F.lit(fv.CAUSAL_CONFIDENCE).alias("confidence"),
        ),
    )
    neighbours = F.transform(
        F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))),
        lambda name, i: F.struct(
            F.get(F.col("names"), i).alias("source"),
            name.alias("target"),
            F.lit("RELATED_TO").alias("type"),
            F.lit(fv.ADJACENT_CONFIDENCE).alias("confidence"),
        ),
    )
    return found.select(
        *chunks.columns,
        entities.cast(_ENTITIES).alias("entities"),
        F.when(F.size("pairs") > 0, causes.cast(_RELATIONS))
        .otherwise(neighbours.cast(_RELATIONS))
        .alias("relations"),
    )


def response_extraction(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add validated ``entities`` and ``relations`` read from a model response.

    Unusable items are left out; a response that cannot be read gives empty lists and a
    reason in ``parse_error``.
    """
    read = responses.withColumn("payload", rs.json_payload(F.col(response)))
    raw_entities = F.coalesce(rs.object_list(F.col("payload"), "entities"), F.array())
    raw_relations = F.coalesce(rs.object_list(F.col("payload"), "relationships"), F.array())

    def word(item: Column, name: str) -> Column:
        return tx.strip(F.coalesce(rs.text_field(item, name), F.lit("")))

    def kind(item: Column) -> Column:
        return F.upper(F.coalesce(rs.text_field(item, "type"), F.lit("")))

    entities = F.filter(
        F.transform(
            raw_entities,
            lambda e: F.struct(word(e, "name").alias("name"), kind(e).alias("type")),
        ),
        lambda e: (e["name"] != "") & e["type"].isin(fv.ENTITY_TYPES),
    )
    relations = F.filter(
        F.transform(
            raw_relations,
            lambda r: F.struct(
                word(r, "source").alias("source"),
                word(r, "target").alias("target"),
                kind(r).alias("type"),
                F.coalesce(
                    rs.number_field(r, "confidence"), F.lit(fv.RESPONSE_CONFIDENCE)
                ).alias("confidence"),
            ),
        ),
        lambda r: (r["source"] != "") & (r["target"] != "") & r["type"].isin(fv.RELATION_TYPES),
    )
    return read.withColumns(
        {
            "entities": entities.cast(_ENTITIES),
            "relations": relations.cast(_RELATIONS),
            "parse_error": rs.parse_error(F.col(response)),
        }
    ).drop("payload")


def extraction(chunks: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Extraction of each chunk: the response if it has an entity, else the heuristic.

    ``responses(investigation_id, key, response)``, where the key is a chunk id. The
    relations of a response without entities are not used.
    """
    own = heuristic_extraction(chunks)
    if responses is None:
        return own
    given = response_extraction(responses).select(
        "investigation_id",
        F.col("key").alias("chunk_id"),
        F.col("entities").alias("given_entities"),
        F.col("relations").alias("given_relations"),
    )
    use = F.coalesce(F.size("given_entities"), F.lit(0)) > 0
    return own.join(given, ["investigation_id", "chunk_id"], "left").select(
        *chunks.columns,
        F.when(use, F.col("given_entities")).otherwise(F.col("entities")).alias("entities"),
        F.when(use, F.col("given_relations")).otherwise(F.col("relations")).alias("relations"),
    )


def _mentions(extracted: DataFrame, column: str, kind: int, fields: list[str]) -> DataFrame:
    # The outer form, because for the inner one the optimizer adds a filter on the array's
    # size below the projections and so computes the whole extraction several times.
    rows = extracted.select(
        "investigation_id",
        "doc_seq",
        "chunk_index",
        "chunk_id",
        F.posexplode_outer(column).alias("pos", "m"),
    ).filter(F.col("m").isNotNull())
    seq = F.struct(
        F.col("doc_seq").cast("bigint").alias("doc_seq"),
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.lit(kind).alias("kind"),
        F.col("pos").alias("pos"),
    )
    return rows.select(
        "investigation_id", *[F.col(f"m.{f}").alias(f) for f in fields], "chunk_id", seq.alias("seq")
    )


def entity_mentions(extracted: DataFrame) -> DataFrame:
    return _mentions(extracted, "entities", 0, ["name", "type"])


def relation_mentions(extracted: DataFrame) -> DataFrame:
    """A chunk's relations come after its entities in ingest order."""
    return _mentions(extracted, "relations", 1, ["source", "target", "type", "confidence"])
