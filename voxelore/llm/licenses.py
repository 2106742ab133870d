"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

Paragraphs (lines) become the distinct word n-grams that occur in the templates below. A multinomial logistic regression over
these sparse features, trained on windows of the templates and on paragraphs of the corpus as the class "unknown", gives
each paragraph its family. A temperature calibrates the probabilities; it is fitted on templates held out whole, by a model
that has not seen them, and on held-out paragraphs. A prediction counts as confirmed if enough of the paragraph's n-grams
stand in the templates of its family.

The unknown class learns from UNKNOWN_ROWS distinct lines at most, chosen by a hash of the line over all documents; left
out are lines half of whose n-grams are those of one family, as they may be notices. Lines that merely speak of licences
are in, so they are the hard negatives.

Only DataFrame functions and Spark's own ML estimators run on the main path. A family can only win if its weights of a
line's n-grams outweigh the unknown class's head start. From the model follows a list of telling words such that a
line without any of them can't get there: texts, then lines, are first searched for those by one pattern, and only
lines that hold one are cut into n-grams, which changes no result. The weights are a table of as many rows as the templates
have n-grams (MAX_GRAMS at most), hence the broadcast; scores are sums over a paragraph's own n-grams, which combine before
they are shuffled.

Defined cases: a null text has no paragraphs; a paragraph without any n-gram of the templates is unknown and not reported.
Repeated rows and null ids are reported row by row. Further columns are ignored, whatever their names. Empty tables give
empty results (the unknown class then learns from the plain sentences below alone).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelore.llm.store import written

#: Bounds: n-grams of the model, paragraphs of the corpus that the unknown class learns from.
MAX_GRAMS, UNKNOWN_ROWS = 20_000, 4_000
UNKNOWN, MIN_PROBABILITY, MIN_OVERLAP = "unknown", 0.5, 0.5

#: Customary notices of licence families.
TEMPLATES = {
    "MIT": [
        "The MIT License (MIT)",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "This project is released under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Distributed under the BSD 3-Clause License.",
        "This software is licensed under the terms of the BSD license.",
    ],
    "GPL": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This file is licensed under the GNU General Public License, version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Mozilla Public License Version 2.0",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "The text is available under CC BY 4.0.", "Published under the Creative Commons Attribution licence (CC BY 4.0)."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "The text is available under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike licence (CC BY-SA 4.0)."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "The text is available under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial licence (CC BY-NC 4.0)."],
    "CC0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "Licensed under the ISC license."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Sentences that share words with licences and are none.
PLAIN = [
    "He renewed his driving license at the office in town.",
    "The software version 2.0 was released under great pressure.",
    "All members of the public are granted free entry, without charge, to the garden.",
    "You can find a copy of the general terms in the file.",
    "The creative director of the foundation published a work on common law.",
    "A permission slip is required for any person under the age of ten.",
    "See the source for more details about the conditions of this file.",
    "This program is shown at ten and will be useful for the whole family.",
    "The following conditions are met with in the use of binary stars.",
    "The license plate of the car was found in the water.",
]
#: Words that any prose holds.
COMMON = "a an and any all are as at be been but by can do for from had has have he her his if in into is it its may more must no not of on one or other our out she so some such than that the their them then there these they this to was we were what when which who will with would you your".split()
FAMILIES = [UNKNOWN, *sorted(TEMPLATES)]


def with_grams(rows: DataFrame) -> DataFrame:
    """Adds grams, the distinct words of six or more characters and pairs of neighbouring words, not both COMMON, of the column line."""
    rows = rows.withColumn("words", F.split(F.trim(F.regexp_replace(F.lower("line"), r"[^a-z0-9.\-]+|[.\-]+(?![a-z0-9])", " ")), " +"))
    heads, tails = F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words"))
    pairs = F.zip_with(heads, tails, lambda a, b: F.when(~(a.isin(COMMON) & b.isin(COMMON)), F.concat_ws(" ", a, b)))
    return rows.withColumn("grams", F.array_compact(F.array_distinct(F.concat(F.filter("words", lambda w: F.length(w) >= 6), pairs)))).drop("words")


def _windows() -> list[tuple[int, int, str]]:
    """(label, template number, text): each template whole, and its runs of 5, 8, 12 and 20 words at steps of 2."""
    found, number = [], 0
    for k, family in enumerate(FAMILIES):
        for text in PLAIN if family == UNKNOWN else TEMPLATES[family]:
            words = text.split()
            found += [(k, number, text)] * 3
            found += [(k, number, " ".join(words[a : a + n])) for n in (5, 8, 12, 20) if n < len(words) for a in range(0, len(words) - n + 1, 2)]
            number += 1
    return found


def _held_templates() -> list[int]:
    """The second template of each family; the first and the further ones teach the model that is calibrated on it."""
    sizes = [len(PLAIN) if f == UNKNOWN else len(TEMPLATES[f]) for f in FAMILIES]
    return [sum(sizes[:k]) + 1 for k, n in enumerate(sizes) if n > 1]


def _paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("paragraph", "line"))
    return rows.where(F.col("line") != "")


def _log_loss(heat: float) -> Column:
    """Of a row's label under the softmax of z / heat."""
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp((z - top) / heat))
    return F.log(total) - (F.get("z", F.col("label")) - top) / heat


def _unknown_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """About UNKNOWN_ROWS distinct lines (line), chosen by hash over all lines: as many as that of any text, whatever the table's size."""
    n = docs.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("long")), F.lit(0))).first()[0]
    share = min(1.0, 2 * UNKNOWN_ROWS / max(n, 1))
    lines = _paragraphs(docs, id_col, text_col).select("line", F.xxhash64("line").alias("h"))
    lines = lines.where(F.shiftrightunsigned("h", 32) < int(share * 2**32)).distinct()
    # Twice the bound is expected here, with repeats; the bound itself is kept by order of hash.
    return lines.orderBy("h", "line").limit(UNKNOWN_ROWS).select("line")


def _like_a_notice(grams: Column, known: list[tuple[int, list[str]]]) -> Column:
    """Half of the n-grams are those of one family."""
    shares = [F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in own]))) >= MIN_OVERLAP * F.size(grams) for _, own in known]
    return reduce(Column.__or__, shares) & (F.size(grams) > 0)


def telling_words(grams: list[str], margins: np.ndarray, head_start: np.ndarray, cost: dict[str, float] | None = None) -> list[str] | None:
    """Words, one of which every line holds that can win a family: the n-grams without them can't make up its head start. Each n-gram has a word that isn't COMMON.

    margins: by n-gram and family, how much it speaks for the family rather than for the unknown class. None: no words do,
    as some family needs nothing.
    """
    if (head_start <= 0).any():
        return None
    left, chosen = np.maximum(margins, 0), []
    of_word: dict[str, list[int]] = {}
    for k, gram in enumerate(grams):
        for word in set(gram.split(" ")).difference(COMMON):
            of_word.setdefault(word, []).append(k)
    while (short := left.sum(axis=0) - head_start).max(initial=-1) >= 0:
        open_ = short >= 0
        gain = {w: left[at][:, open_].sum() / (1 + (cost or {}).get(w, 0)) for w, at in of_word.items()}
        best = max(gain, key=lambda w: (gain[w], w))
        left[of_word.pop(best)] = 0
        chosen.append(best)
    return sorted(chosen)


def words_pattern(words: list[str]) -> str:
    """A pattern for texts that hold one of the words, branching on their first letters."""
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[0], []).append(re.escape(word[1:]))
    branches = "|".join(re.escape(h) + "(?:" + "|".join(sorted(rest)) + ")" for h, rest in sorted(heads.items()))
    return f"(?<![a-z0-9])(?:{branches})(?![a-z0-9])"


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The model as a table: gram (the empty one for the intercepts), w (a weight for each family), own (1 where the family's templates have it), n (unknown lines that hold its words)."""
    known = written(with_grams(spark.createDataFrame(_windows(), "label int, template int, line string")), "licence-known")
    by_family = known.where("label > 0").select("label", F.explode("grams").alias("gram")).groupBy("label").agg(F.collect_set("gram").alias("own")).orderBy("label").collect()
    unknown = with_grams(_unknown_lines(docs, id_col, text_col)).select(F.lit(0).alias("label"), F.lit(-1).alias("template"), "line", "grams")
    unknown = written(unknown.where(~_like_a_notice(F.col("grams"), [(r.label, r.own) for r in by_family])), "licence-unknown")
    held = F.col("template").isin(_held_templates()) | ((F.col("template") < 0) & (F.pmod(F.xxhash64("line"), F.lit(5)) == 0))
    rows = known.unionByName(unknown).withColumn("label", F.col("label").cast("double")).withColumn("held", held)
    counts = CountVectorizer(inputCol="grams", outputCol="x", vocabSize=MAX_GRAMS, binary=True).fit(rows.where("label > 0"))
    rows = written(counts.transform(rows).select("label", "x", "held").coalesce(2), "licence-rows")
    fit = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=0.001, maxIter=60).fit
    scored = fit(rows.where("not held")).transform(rows.where("held")).select(F.col("label").cast("int").alias("label"), vector_to_array("rawPrediction").alias("z"))
    heat = [0.4, 0.5, 0.65, 0.8, 1.0, 1.25, 1.6, 2.0, 3.0]
    losses = scored.agg(*[F.avg(_log_loss(t)).alias(f"t{k}") for k, t in enumerate(heat)]).first()
    best = min(((v, heat[k]) for k, v in enumerate(losses) if v is not None), default=(0, 1.0))[1]
    fitted = fit(rows)
    matrix = fitted.coefficientMatrix.toArray() / best
    lines = [(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(counts.vocabulary)]
    lines.append(("", [float(x) / best for x in fitted.interceptVector.toArray()]))
    own = known.where("label > 0").select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.collect_set("label").alias("labels"))
    seen = unknown.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    weights = spark.createDataFrame(lines, "gram string, w array<double>").join(own, "gram", "left").join(seen, "gram", "left")
    flags = F.transform(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1)), lambda k: F.coalesce(F.array_contains("labels", k), F.lit(False)).cast("double"))
    return written(weights.select("gram", "w", flags.alias("own"), F.coalesce("n", F.lit(0)).alias("n")), "licence-model")


def _may_win(model: DataFrame) -> Callable[[Column], Column]:
    """Whether a lower-cased text holds a telling word of the model. The model has MAX_GRAMS rows at most."""
    rows = model.orderBy("gram").collect()
    base = np.array(next(r.w for r in rows if r.gram == ""))
    w = np.array([r.w for r in rows if r.gram != ""]).reshape(-1, len(base))
    cost: dict[str, float] = {}  # short words are frequent ones, so that a search for them spares little
    for r in rows:
        for word in set(r.gram.split(" ")):
            cost[word] = cost.get(word, 64 * 1000 * 4.0 ** -len(word)) + r.n / 4
    words = telling_words([r.gram for r in rows if r.gram != ""], w[:, 1:] - w[:, :1], base[0] - base[1:], cost)
    if words is None:
        return lambda text: F.lit(True)
    return lambda text: text.rlike(words_pattern(words)) if words else F.lit(False)


def scan(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(doc_id, paragraph, family, probability, overlap, confirmed) for each paragraph that isn't of the unknown class.

    A paragraph is reported if a family leads and all families together have min_probability at least; probability is the
    leading family's own.
    """
    n, may_win = len(FAMILIES), _may_win(model)
    base = model.where("gram = ''").first()["w"]
    flat = model.where("gram <> ''").select("gram", *[F.get("w", k).alias(f"w{k}") for k in range(n)], *[F.get("own", k).alias(f"o{k}") for k in range(n)])
    lines = _paragraphs(docs.where(may_win(F.lower(F.col(text_col)))), id_col, text_col).where(may_win(F.lower("line")))
    rows = with_grams(lines.withColumn("row", F.monotonically_increasing_id()))
    rows = rows.select("row", "doc_id", "paragraph", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    hits = rows.join(F.broadcast(flat), "gram")  # MAX_GRAMS rows at most
    sums = hits.groupBy("row", "doc_id", "paragraph", "n_grams").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(n)], *[F.sum(f"o{k}").alias(f"o{k}") for k in range(n)])
    z = F.array(*[F.col(f"w{k}") + F.lit(float(base[k])) for k in range(n)])
    out = sums.select("doc_id", "paragraph", "n_grams", z.alias("z"), F.array(*[F.col(f"o{k}") for k in range(n)]).alias("o"))
    out = out.withColumn("top", F.array_max("z")).withColumn("k", (F.array_position("z", F.col("top")) - 1).cast("int"))
    probability = 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    family = F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.col("k"))
    overlap = F.get("o", F.col("k")) / F.col("n_grams")
    known = 1 - probability * F.exp(F.get("z", F.lit(0)) - F.col("top"))
    out = out.select("doc_id", "paragraph", family.alias("family"), probability.alias("probability"), overlap.alias("overlap"), known.alias("known"))
    out = out.where((F.col("family") != UNKNOWN) & (F.col("known") >= min_probability)).drop("known")
    return out.withColumn("confirmed", F.col("overlap") >= min_overlap)
