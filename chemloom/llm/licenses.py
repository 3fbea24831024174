"""Licence scans: a trained classifier of paragraphs over sparse word n-grams, in DataFrame functions only."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UNKNOWN = "unknown"
# Notices by licence family, the training templates.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the Apache License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is distributed under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under CC BY-SA 4.0.",
    ],
    "Public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Proprietary": [
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "This software is proprietary and confidential. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission. All rights reserved.",
        "All rights reserved.",
    ],
}
# Sentences with the same words that grant nothing.
LOOKALIKES = [
    "The driver showed a valid license to the officer.",
    "She renewed her fishing license last year under the new rules.",
    "The version released under pressure was not the final one.",
    "This work is about the general public and free software.",
    "The clause is subject to the terms of the contract.",
    "Apache helicopters and Mozilla browsers have nothing in common.",
    "A software license can be hard to read.",
    "The public domain of the function is the set of all reals.",
    "All conditions were met, and the copy was permitted.",
    "The university MIT released a report on the version 2.0 model.",
    "See the MIT License for an example of a short license text.",
    "The Mozilla Public License was drafted by a lawyer.",
    "They discussed the Apache License at the meeting.",
    "Unlike the BSD License, the agreement says nothing about patents.",
    "An essay on the GNU General Public License and its history.",
    "He reserved all rights to the seat.",
]
# Words whose negation turns a notice into a statement that grants nothing.
NEGATED = r"(?i)\b(licensed|released|granted|dedicated|distributed|permitted|subject|free|proprietary)\b"
# Words that make a sentence about a licence no notice, unless the notice's own text has them.
CUES = ["not", "nothing", "never", "none", "no", "neither", "nor", "cannot", "if", "whether", "unless", "unlike", "would", "were", "had", "example"]
# Versions of the families that have one; how a text names a version.
VERSIONS = {"Apache-2.0": "2", "GPL-3.0": "3", "AGPL-3.0": "3", "MPL-2.0": "2"}
VERSION = r"(?i)(?:version|\bv\.?|licen[cs]e,?|[a-z]-)\s*(\d+(?:\.\d+)*)"
SEEDS = r"(?i)licen[cs]e|copyright|spdx|warrant|permission|public domain|rights reserved"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def ngrams(w: Column) -> Column:
    """Distinct runs of one to three words."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.array_distinct(F.concat(w, runs(2), runs(3)))


#: A line break inside a paragraph: the line before ends without a stop, and neither line is blank.
WRAP = r"(?<=\S)(?<![.!?:;][\"')\]]{0,2})[ \t]*\r?\n[ \t]*(?=\S)"


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, place, paragraph): lines, wrapped ones joined; row tells repeated ids apart by their texts' hash."""
    joined = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WRAP, " ")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.posexplode(F.split(joined, r"[\r\n]+")).alias("place", "paragraph"))


def training(docs: DataFrame, id_col: str, text_col: str, max_negatives: int, variants: int = 8) -> DataFrame:
    """(label, w, held, corpus): templates, each with words left out in several ways; negated templates, lookalikes and
    paragraphs of the corpus as unknown.

    Every fourth template, with all its variants, is held out. A paragraph of the corpus is taken for unknown only if it has no
    word like licence or copyright and is unlike every template; at most ``max_negatives``, of as many documents of least hash."""
    spark = docs.sparkSession
    notices = [(family, t, i % 4 == 1) for family, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    negated = [(UNKNOWN, re.sub(NEGATED, r"not \1", t, count=1), h) for _, t, h in notices if re.search(NEGATED, t)]
    fixed = [*notices, *negated, *((UNKNOWN, t, i % 4 == 1) for i, t in enumerate(LOOKALIKES))]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("text"), F.lit(h).alias("held")) for a, b, h in fixed]))
    base = spark.range(1).select(rows.alias("r")).select("r.label", "r.held", words(F.col("r.text")).alias("w"))
    base = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    base = base.select("label", F.filter("w", lambda x: (F.col("k") == 0) | (x == "not") | (F.pmod(F.xxhash64(x, F.col("k")), F.lit(10)) > 0)).alias("w"), "held")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_negatives)  # bounded
    chosen = rows.alias("d").join(F.broadcast(ids.alias("i")), F.expr("d.id <=> i.id"), "left_semi")
    lines = paragraphs(chosen, "id", "text").filter(~F.rlike("paragraph", F.lit(SEEDS)))
    lines = lines.orderBy(F.xxhash64("paragraph"), "paragraph").limit(max_negatives).select(words(F.col("paragraph")).alias("w"), (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 1).alias("held"))
    shapes = F.array(*[F.array(*[F.lit(x) for x in sorted(set(re.findall(WORD, t.lower())))]) for ts in TEMPLATES.values() for t in ts])
    lines = lines.filter(~F.exists(shapes, lambda own: 2 * F.size(F.array_intersect(own, "w")) >= F.size(own)))
    both = base.withColumn("corpus", F.lit(False)).unionByName(lines.select(F.lit(UNKNOWN).alias("label"), "w", "held", F.lit(True).alias("corpus")))
    return both.select("label", "w", "held", "corpus")


def common_words(docs: DataFrame, text_col: str, of: list[str], share: float) -> list[str]:
    """Those of the given words that ``share`` of all documents have, lines that look like notices left aside."""
    plain = F.array_join(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\r\n]+"), lambda x: ~F.rlike(x, F.lit(SEEDS))), " ")
    own = docs.select(F.explode(F.array_intersect(words(plain), F.array(*[F.lit(x) for x in of]))).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    return sorted(r["x"] for r in own.filter(F.col("n") >= max(2.0, share * docs.count())).collect())  # some of the given words


def fit(docs: DataFrame, id_col: str, text_col: str, max_negatives: int, common_share: float = 0.1) -> dict:
    """Weights of the families and of the unknown class, the temperature that calibrates them, and the common words.

    The temperature is fitted on held-out templates with a model that hasn't seen them; the weights then on all rows."""
    # A bounded number of rows; in one order, so that reruns fit the same weights.
    rows, _ = cut(training(docs, id_col, text_col, max_negatives).repartition(1).sortWithinPartitions("label", "w"))
    rows, _ = cut(rows.withColumn("grams", ngrams(F.col("w"))))  # apart, else the words are found anew for every run
    grams = [r["g"] for r in rows.filter("not corpus").select(F.explode("grams").alias("g")).distinct().collect()]  # bounded by the templates
    # Terms made of common words alone tell nothing; without them plain prose has no term at all.
    common = common_words(docs, text_col, sorted({x for g in grams for x in g.split()}), common_share)
    vocabulary = sorted(g for g in grams if not set(g.split()) <= set(common))
    names = [*TEMPLATES, UNKNOWN]
    number = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))]), F.col("label"))
    ready = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True).transform(rows.withColumn("y", number)).cache()  # bounded rows
    # Every class has the same say, whatever the number of its rows.
    n = {r["y"]: r["n"] for r in ready.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = F.element_at(F.create_map(*[x for y, c in n.items() for x in (F.lit(y), F.lit(100.0 / c * (4 if names[int(y)] == UNKNOWN else 1)))]), F.col("y"))
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", family="multinomial", regParam=0.002, elasticNetParam=0.0, maxIter=40, standardization=False)
    ready = ready.withColumn("weight", weight)
    held = model.fit(ready.filter("not held")).transform(ready.filter("held")).select("y", "rawPrediction").collect()  # bounded by the training rows
    raw, y = np.array([r["rawPrediction"].toArray() for r in held]), np.array([int(r["y"]) for r in held])

    def loss(t: float) -> float:
        z = raw / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    heat = min(np.arange(0.25, 4.01, 0.25), key=loss) if len(held) else 1.0
    whole = model.fit(ready)
    ready.unpersist()
    return {"terms": vocabulary, "names": names, "w": whole.coefficientMatrix.toArray() / heat, "b": whole.interceptVector.toArray() / heat, "common": common}


def anchors(model: dict, floor: float) -> list[str]:
    """Words without which no paragraph can reach the probability ``floor`` for a family.

    What a paragraph lacks of these words, and of the n-grams that hold them, bounds its margin over the unknown class by the
    positive weights that are left; words other than common ones are added until the bound is below the floor for every family."""
    w, b, terms = model["w"], model["b"], model["terms"]
    gain = np.maximum(w[:-1] - w[-1], 0.0)
    need = np.log(floor / (1 - floor)) - (b[:-1] - b[-1])
    vocabulary = sorted({x for t in terms for x in t.split()} - set(model["common"]))
    holds = np.array([[x in t for t in map(str.split, terms)] for x in vocabulary], bool).reshape(len(vocabulary), len(terms))
    out: list[str] = []
    left = np.ones(len(terms), bool)
    while (short := (gain[:, left].sum(axis=1) - need)).max() >= 0:
        worth = holds @ (gain[int(short.argmax())] * left)
        if worth.max(initial=0.0) <= 0:
            return []  # the intercept alone is enough: no word can be asked for
        best = int(worth.argmax())
        out.append(vocabulary[best])
        left &= ~holds[best]
    return sorted(out)


def one_of(strings: list[str]) -> str:
    """A pattern for any of the strings that tests each common beginning once."""
    by_first: dict[str, list[str]] = {}
    for x in strings:
        by_first.setdefault(x[:1], []).append(x[1:])
    tails = [c.replace(".", r"\.") + one_of(rest) for c, rest in sorted(by_first.items()) if c]
    return f"(?:{'|'.join(tails)})" + ("?" if "" in by_first else "") if tails else ""


def cued(good: DataFrame, shapes: DataFrame) -> DataFrame:
    """good(id, row, place, family, paragraph) and shapes(family, template, own) -> (id, row, place, template, cue): whether a sentence of
    the paragraph that shares three of a template's runs asks something or has a cue that the template hasn't."""
    said = good.select("id", "row", "place", "family", F.explode(F.split("paragraph", r"(?<=[.!?])\s+")).alias("sentence"))
    said, _ = cut(said.withColumn("w", words(F.col("sentence"))))  # apart, else the words are found anew for every run
    said, _ = cut(said.select("id", "row", "place", "family", "w", F.contains("sentence", F.lit("?")).alias("asks"), ngrams(F.col("w")).alias("runs")))
    near = said.join(shapes, "family").filter(F.size(F.array_intersect("runs", "own")) >= 3)
    other = F.col("asks") | F.arrays_overlap("w", F.array_except(F.array(*map(F.lit, CUES)), "own"))
    return near.groupBy("id", "row", "place", "template").agg(F.bool_or(other).alias("cue"))


def same_version() -> Column:
    """Whether a paragraph names no version, or its family's, if that has one."""
    named = F.transform(F.regexp_extract_all("paragraph", F.lit(VERSION), F.lit(1)), lambda x: F.regexp_replace(x, r"(\.0)+$", ""))
    version = F.element_at(F.create_map(*[F.lit(x) for v in VERSIONS.items() for x in v]), F.col("family"))
    return version.isNull() | (F.size(named) == 0) | F.array_contains(named, version)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: float = 0.5, least_match: float = 0.6, max_negatives: int = 4000, model: dict | None = None) -> DataFrame:
    """(id, family, probability, confirmed, n_licence, found) of every row of docs.

    Lines are paragraphs; a line that ends without a stop goes on in the next one. A paragraph's features are its distinct runs of one to three words that occur in the
    templates; a multinomial logistic regression, its temperature fitted on held-out rows, gives the families and an unknown
    class. A family of probability ``floor`` or more is a finding; it is confirmed if ``least_match`` of some template's
    one- to three-word runs occur in the paragraph, no sentence that shares them has a cue against it (cued()) and a version that is named
    is the family's. ``family`` is the finding with the highest probability (earliest on ties).

    ``model`` is what fit() returns, here or for other documents. The negatives are a bounded sample (``max_negatives``); everything else covers every paragraph, common words all documents. Paragraphs without any anchor
    word are unknown by proof, see anchors(), and aren't scored. Null and empty texts have no findings; repeated rows each come
    back; ids may be null; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    model = model or fit(docs, id_col, text_col, max_negatives)
    names, terms, needed = model["names"], model["terms"], anchors(model, floor)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"))
    near = F.lit("(?i)(?<![a-z0-9])" + one_of(needed))
    lines = paragraphs(docs.filter(F.rlike(F.coalesce(F.col(text_col), F.lit("")), near)) if needed else docs, id_col, text_col)
    if needed:
        lines = lines.filter(F.rlike("paragraph", near))
    lines, _ = cut(lines.distinct().withColumn("w", words(F.col("paragraph"))))  # apart, else the words are found anew for every run
    lines, _ = cut(lines.select("id", "row", "place", "paragraph", ngrams(F.col("w")).alias("grams")))
    deltas = [(t, [float(x) for x in model["w"][:, i]]) for i, t in enumerate(terms)]
    weights = F.broadcast(spark.createDataFrame(deltas, "term string, w array<double>"))  # bounded by the templates
    hits = lines.select("id", "row", "place", F.explode("grams").alias("term")).join(weights, "term")
    sums = hits.groupBy("id", "row", "place").agg(F.array(*[F.sum(F.col("w")[i]) for i in range(len(names))]).alias("z"))
    z = F.transform(F.arrays_zip("z", F.array(*[F.lit(float(x)) for x in model["b"]]).alias("b")), lambda x: x["z"] + x["b"])
    soft = sums.withColumn("z", z).withColumn("z", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    soft = soft.withColumn("z", F.transform("z", lambda x: x / F.aggregate("z", F.lit(0.0), lambda s, v: s + v)))
    known = F.slice("z", 1, len(names) - 1)
    named = soft.select("id", "row", "place", F.array_max(known).alias("probability"), F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(known, F.array_max(known)).cast("int")).alias("family"))
    good = named.filter(F.col("probability") >= floor).alias("g").join(lines.alias("l"), F.expr("g.id <=> l.id and g.row = l.row and g.place = l.place")).select("g.*", "l.grams", "l.paragraph")
    shapes = spark.createDataFrame([(a, t) for a, ts in TEMPLATES.items() for t in ts], "family string, template string")
    shapes, _ = cut(shapes.withColumn("own", ngrams(words(F.col("template")))))
    good, _ = cut(good)
    cues = cued(good, F.broadcast(shapes))
    match = F.size(F.array_intersect("own", "grams")) / F.size("own")
    good = good.join(F.broadcast(shapes), "family").select("id", "row", "place", "family", "probability", "template", match.alias("match"), same_version().alias("agrees")).alias("g")
    good = good.join(cues.alias("c"), F.expr("g.id <=> c.id and g.row = c.row and g.place = c.place and g.template = c.template"), "left").select("g.*", "c.cue")
    sure = (F.col("match") >= least_match) & F.col("agrees") & ~F.coalesce("cue", F.lit(False))
    good = good.groupBy("id", "row", "place", "family", "probability").agg(F.max("match").alias("match"), F.bool_or(sure).alias("confirmed"))
    good = good.select("id", "row", F.struct(F.col("place").alias("line"), "family", F.round("probability", 9).alias("probability"), F.round("match", 9).alias("match"), "confirmed").alias("f"))
    per_row = good.groupBy("id", "row").agg(F.array_sort(F.collect_list("f")).alias("found"), F.max(F.struct(F.col("f.probability"), (-F.col("f.line")).alias("line"), F.col("f.family"), F.col("f.confirmed"))).alias("best"))
    both = base.alias("b").join(per_row.alias("p"), F.expr("b.id <=> p.id and b.row = p.row"), "left")
    return both.select("b.id", F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"), "best.probability", F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"), F.coalesce(F.size("found"), F.lit(0)).alias("n_licence"), "found")
