"""Licence scans by a positional index of rare licence words, in DataFrame functions alone."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import ids_and_texts, lower_ascii

# A word is a run of a-z, 0-9 and characters beyond ASCII, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Templates: label, whole wording, and the key phrase in it that must stand at its place.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", "gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", "gnu lesser general public license version 3"),
    ("lgpl", "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc", "gnu lesser general public license version 2 1"),
    ("lgpl", "modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license as published"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("isc", "spdx license identifier isc", "spdx license identifier isc"),
    ("bsd", "spdx license identifier bsd", "spdx license identifier bsd"),
    ("apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("gpl-2.0", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("gpl-3.0", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    ("lgpl", "spdx license identifier lgpl", "spdx license identifier lgpl"),
    ("mpl-2.0", "spdx license identifier mpl 2 0", "spdx license identifier mpl 2 0"),
    ("unlicense", "spdx license identifier unlicense", "spdx license identifier unlicense"),
]


# Every phrase that is looked up: label, words, and where its key phrase begins and ends.
# Those of ``BASE`` come first.
def _phrases() -> list[tuple[str, list[str], int, int]]:
    out = [(label, phrase.split(), 0, len(phrase.split())) for phrase, label in BASE.items()]
    for label, text, key in TEMPLATES:
        words, own = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        out.append((label, words, at, at + len(own)))
    return out


def vocabulary() -> list[str]:
    return sorted({w for _, words, _, _ in _phrases() for w in words})


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    return ids_and_texts(docs, id_col, text_col).select("doc_id", words.alias("words"))


def rarities(words: DataFrame) -> dict[str, float]:
    """The inverse document frequency of each licence word over all rows: a table as large as
    the vocabulary of the templates."""
    known = vocabulary()
    own = F.array_distinct(F.filter("words", lambda w: w.isin(known)))
    seen = words.select(F.explode(F.array_append(own, F.lit(""))).alias("word"))  # "" counts rows
    found = {r.word: r["count"] for r in seen.groupBy("word").count().collect()}
    return {w: math.log((found.get("", 0) + 1) / (found.get(w, 0) + 1)) + 1 for w in known}


def _index(idf: dict[str, float]) -> tuple[Column, list[str]]:
    """The templates with the weights of their words, and the postings of their key words.

    The key word of a template is the rarest of its key phrase. Both are constants, whose size
    is that of the templates; the plan does not grow with their number.
    """
    templates, postings = [], {}
    for number, (label, words, low, high) in enumerate(_phrases()):
        total = sum(idf[w] for w in words)
        weights = [idf[w] / total for w in words]
        templates.append({"label": label, "words": words, "weights": weights, "low": low, "high": high})
        rare = max(range(low, high), key=lambda i: (idf[words[i]], -i))
        postings.setdefault(words[rare], []).append({"t": number, "at": rare})
    form = (
        "templates array<struct<label: string, words: array<string>, weights: array<double>, low: int, high: int>>, "
        "postings map<string, array<struct<t: int, at: int>>>"
    )
    return F.from_json(F.lit(json.dumps({"templates": templates, "postings": postings})), form), sorted(postings)


_PLACE = 1 << 40  # numbers of templates lie above those of places
_BEFORE = 1 << 10  # words that a template may begin before its row does


def scan_licenses(
    docs: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's licence phrases and labels.

    A row's words that are key words of templates, the rarest of their key phrases by document
    frequency over all rows, are looked up in the postings, which gives the places where a
    template would begin. Each is confirmed word by word: the key phrase must stand there,
    and the rarity of the template's other words that stand at their places counts. What a
    row costs is its words, and a template's words for each place where it may begin.

    ``n_base``, ``first_word`` and ``last_word`` count and place the base phrases; a
    template adds its label if its key phrase stands somewhere and there, by rarity, at
    least the share ``least`` of its words do; ``score`` is the largest such share, 0
    without a key phrase. Texts are read twice, once for the frequencies; rows never move, and
    every place is looked at.

    A null or empty text has no words. Null ids and repeated rows give a row each; an empty
    table gives no rows.
    """
    rows = _words(docs, id_col, text_col)
    index, keys = _index(rarities(rows))

    def begins(hit: Column) -> Column:
        posted = F.element_at(index["postings"], hit["word"])
        return F.transform(posted, lambda p: p["t"] * F.lit(_PLACE) + hit["at"] - p["at"] + _BEFORE)

    def match(begin: Column) -> Column:
        number = F.floor(begin / F.lit(_PLACE)).cast("int")
        start = (F.pmod(begin, F.lit(_PLACE)) - _BEFORE).cast("int")
        template = F.get(index["templates"], number)
        return F.struct(
            number.alias("t"), start.alias("start"), template["label"].alias("label"),
            F.forall(
                F.sequence(template["low"], template["high"] - 1),
                lambda i: F.coalesce(F.get("words", start + i) == F.get(template["words"], i), F.lit(False)),
            ).alias("key"),
            F.aggregate(
                F.sequence(F.lit(0), F.size(template["words"]) - 1), F.lit(0.0),
                lambda s, i: s + F.when(F.get("words", start + i) == F.get(template["words"], i), F.get(template["weights"], i)).otherwise(F.lit(0.0)),
            ).alias("cover"),
        )

    placed = F.transform("words", lambda w, i: F.when(w.isin(keys), F.struct(i.alias("at"), w.alias("word"))))
    hits = rows.select("doc_id", "words", F.filter(placed, lambda h: h.isNotNull()).alias("hits"))
    found = hits.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform(F.array_distinct(F.flatten(F.transform("hits", begins))), match), lambda m: m["key"]).alias("found"),
    )
    base = F.filter("found", lambda m: m["t"] < len(BASE))
    more = F.filter("found", lambda m: (m["t"] >= len(BASE)) & (m["cover"] >= least))
    covers = F.transform(F.filter("found", lambda m: m["t"] >= len(BASE)), lambda m: m["cover"])
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        _listed(F.transform(base, lambda m: m["label"])).alias("base_labels"),
        _listed(F.transform(F.concat(base, more), lambda m: m["label"])).alias("labels"),
        F.least(F.lit(1.0), F.round(F.coalesce(F.array_max(covers), F.lit(0.0)), 9)).alias("score"),
    )


def _listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
