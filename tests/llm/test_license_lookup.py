"""Licence texts and notices in their many spellings."""

import os
import re

import pytest

from quire.llm import license_lookup as ll
from quire.llm.license_texts import NOTICES, TEXTS


def test_known_texts_in_other_spellings(spark):
    rows, want = [], {}
    for k, (name, text) in enumerate(TEXTS):
        changed = "Copyright (c) 2020 Some Body\n\n" + re.sub(r"\s+", "\n  ", text).upper().replace("LICENSE", "LICENCE").replace('"', "“")
        rows += [(2 * k, changed), (2 * k + 1, text.replace("without", "with"))]
        want |= {2 * k: name, 2 * k + 1: None}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    assert {r.doc_id: r.license for r in ll.licenses(docs).collect()} == want


def test_notices(spark):
    body = "\n".join(["words", *[n.upper() for _, n in NOTICES], "  licensed under the apache licence version 2.0  ", "not licensed under anything", "words"])
    r = ll.licenses(spark.createDataFrame([(1, body)], "doc_id long, text string")).first()
    assert r.notices == sorted({n for n, _ in NOTICES}) and r.n_notices == len(NOTICES) + 1 and r.license is None
    canonical = spark.createDataFrame(NOTICES, "license string, text string").select(ll.canonical("text").alias("c")).collect()
    assert all(any(m in r.c for m in ll.MARKERS) for r in canonical)


def test_edge_rows(spark):
    mit = TEXTS[0][1]
    rows = [(1, None), (2, ""), (None, mit), (4, mit), (4, mit), (5, mit + " word" * 100_000)]
    got = sorted(((r.doc_id, r.license, r.n_notices) for r in ll.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, None, 0), (2, None, 0), (None, "MIT", 0), (4, "MIT", 0), (4, "MIT", 0), (5, None, 0)], key=repr)
    assert ll.licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


FOLDER = "/usr/share/common-licenses"
#: Names of the files there.
FILES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no folder of licence texts")
def test_published_texts(spark):
    rows, want = [], []
    for file, name in FILES.items():
        text = open(f"{FOLDER}/{file}").read()
        commented = "# Copyright (c) 2020 X\n" + "".join(f"# {line}\n" for line in text.split("\n"))
        for changed, found in ((text, name), (commented, name), (text.upper(), name), (text.replace(" any ", " some "), None)):
            rows.append((len(rows), changed))
            want.append(found)
    got = {r.doc_id: r.license for r in ll.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_copyright_lines(spark):
    name, text = TEXTS[0]
    dropped = ["Copyright (c) 2020 X", "# Copyright (c) 2020 X", " * Copyright 2019 Y", "// Copyright The X Authors", "Copyright the Foo project contributors.", "Copyright Some Body Inc.", "REM Copyright 2001 Z", "; (c) 2004 W", "Copyright [yyyy] [name of copyright owner]", "SPDX-FileCopyrightText: 2020 X", "Portions Copyright 1999 V", "/* Copyright © V", "All rights reserved."]
    held = ["copyright holders and contributors", "copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE", "the copyright of the authors"]
    rows = [(i, f"{line}\n\n{text}") for i, line in enumerate([*dropped, *held])]
    got = {r.doc_id: r.license for r in ll.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [name] * len(dropped) + [None] * len(held)
