"""Licence texts as they are distributed, and what a row may cost."""

import time

import pytest

from causeway.llm import licenses

from .conftest import documents

TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\n"
    'associated documentation files (the "Software"), to deal in the Software without restriction, including ...',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is "
    "hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "bsd": "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or "
    "promote products derived from\n   this software without specific prior written permission.",
    "apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n"
    "                        http://www.apache.org/licenses/",
    "gpl-2.0": "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "gpl-3.0": "it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either "
    "version 3 of the License, or\n (at your option) any later version. you can redistribute it and/or modify",
    "lgpl": "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n Copyright (C) 2007 Free Software Foundation, Inc.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was "
    "not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
SPDX = {"mit": "MIT", "isc": "ISC", "bsd": "BSD-3-Clause", "apache-2.0": "Apache-2.0", "gpl-2.0": "GPL-2.0-only",
        "gpl-3.0": "GPL-3.0-or-later", "lgpl": "LGPL-2.1-only", "mpl-2.0": "MPL-2.0"}


def test_texts_and_identifiers_are_labelled(spark):
    rows = [(label, f"/* header */ {text} and more") for label, text in TEXTS.items()]
    rows += [(label, f"# SPDX-License-Identifier: {name}\nimport os") for label, name in SPDX.items()]
    docs = documents(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, (label, text) in enumerate(rows):
        assert label in got[i].labels.split(","), (label, got[i])
        assert got[i].score >= 0.7
        others = {x for x in got[i].labels.split(",") if x not in (label, *got[i].base_labels.split(","))}
        assert others <= {"bsd", "lgpl", "apache-2.0"} - {label} or not others, (label, others)


def test_half_a_licence_is_none(spark):
    rows = [(1, "to any person obtaining a copy"), (2, "permission is hereby granted free of charge"), (3, "gnu general public licence")]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert all(r.labels == "" for r in got.values()) and 0 < got[1].score < 0.7 and got[2].score == 0


@pytest.mark.parametrize("phrase, words", [("the MIT license ", 3), ("endorse or promote products derived ", 5), ("license ", 1)])
def test_a_phrase_may_be_repeated_very_often(spark, phrase, words):
    docs = documents(spark, [(1, phrase * 50_000)])
    began = time.time()
    (row,) = licenses.scan_licenses(docs).collect()
    assert time.time() - began < 40
    assert row.n_words == 50_000 * words and row.n_base == (50_000 if "MIT" in phrase else 0)


def test_no_rows(spark, none):
    assert licenses.scan_licenses(none).count() == 0
