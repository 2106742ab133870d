"""Licence scans: wordings that no template has, lines that only speak of licences, and the search against a scan without it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelore.llm import licenses

#: None of these stands in a template.
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Distributed under the terms of the MIT license"), ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "You may redistribute this under the GNU General Public License v3 or later."), ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("LGPL", "Distributed under the GNU Lesser General Public License"), ("AGPL", "Released under the GNU Affero General Public License v3"), ("MPL", "This file is covered by the Mozilla Public License 2.0"),
    ("CC-BY", "Available under a Creative Commons Attribution 4.0 licence"), ("CC0", "Placed in the public domain with CC0 1.0 Universal"), ("ISC", "Provided under the ISC license"),
    ("BSD", "Licensed under the 3-clause BSD license"),
    # Further ones, most of which were missed when this was written.
    ("MIT", "MIT License applies to all files in this folder."), ("Apache", "The code is available under the Apache 2.0 license."), ("Apache", "SPDX: Apache License 2.0"),
    ("GPL", "Released under GNU GPL, the General Public License."), ("CC-BY-SA", "Shared under CC BY-SA 4.0"),
]
OTHERS = [
    "The license plate of the red car was lost in the snow.", "Her fishing license expired in June, and the office was closed.", "The public library on Apache Street is free for any person.",
    "The software was released under great pressure.", "General public opinion was that version 3 of the law was worse.", "A copy of the MIT yearbook was found in the file.",
    "He was granted permission to use the hall without charge.", "All rights to the film were sold to the foundation.",
]
SCHEMA = "doc_id long, text string, family string, gram string, w double, row long"


def table(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", 0.5, 1) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return licenses.train(spark, docs)


def test_unseen_wordings_are_found_and_others_left_alone(spark, model):
    templates = {t for texts in licenses.TEMPLATES.values() for t in texts}
    assert not templates & {t for _, t in NOTICES}
    rows = licenses.scan(table(spark, [t for _, t in NOTICES] + OTHERS + [None, ""]), model).collect()
    found = {r.doc_id: r.family for r in rows if r.confirmed}
    right = sum(found.get(k) == family for k, (family, _) in enumerate(NOTICES))
    print(f"{right} of {len(NOTICES)} unseen notices confirmed")
    assert right >= 12
    assert not [k for k in found if k >= len(NOTICES)]


def test_the_search_changes_no_result(spark, model, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(table(spark, [t for _, t in NOTICES] + OTHERS).select("doc_id", "text"), allowMissingColumns=True)
    want = {tuple(r) for r in licenses.scan(docs, model).collect()}
    monkeypatch.setattr(licenses, "_may_win", lambda model: lambda text: F.lit(True))
    assert want and {tuple(r) for r in licenses.scan(docs, model).collect()} == want


def test_no_line_without_telling_words_can_win():
    rng = np.random.default_rng(3)
    for seed in range(30):
        words = [f"w{k}" for k in range(12)]
        grams = sorted({" ".join(rng.choice(words, rng.integers(1, 3))) for _ in range(30)})
        margins, start = rng.normal(0.2, 0.6, (len(grams), 3)), rng.uniform(0.5, 3, 3)
        chosen = licenses.telling_words(grams, margins, start)
        left = [k for k, g in enumerate(grams) if not set(g.split(" ")) & set(chosen)]
        assert (np.maximum(margins[left], 0).sum(axis=0) < start).all()
        assert licenses.telling_words(grams, margins, np.array([1, -1, 1])) is None


def test_empty_table(spark):
    empty = table(spark, []).where("false")
    assert licenses.scan(empty, licenses.train(spark, empty)).count() == 0
