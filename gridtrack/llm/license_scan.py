"""Licence scan: a trained paragraph classifier with template comparison.

Paragraphs (lines with a word) are cut into words; their 1- to 3-grams that hold at least one
word of a licence template other than a function word are features.  A multinomial logistic
regression over the licence families and "unknown" is trained on the templates, their sentences
and counter-examples below; its probabilities are calibrated by one temperature, the best for texts
held out of the fit, each third in turn.  The least probability at which a family is believed is
one that no counter-example and no paragraph of the corpus without any template trigram reaches,
but no more than the templates themselves reach.  A believed prediction is confirmed by comparison:
it counts if the paragraph shares enough trigrams with a template of the predicted family.

A paragraph without any licence word has no feature, hence is unknown; that is decided before any
n-gram is made.  Spark ML and DataFrame functions only; what is broadcast is the feature table of
the templates, which no corpus can enlarge.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridtrack.llm.common import scratch

UNKNOWN = "unknown"

# Wording of public licence notices, by family.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Distributed under the BSD license."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "Licensed under the GNU GPL, version 2."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc", "Released under the ISC License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Released under the Unlicense."),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the FSF; either version 2 of the License, or (at your option) any later version."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Released under the zlib License."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0."),
    ("epl-2.0", "Licensed under the Eclipse Public License 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
    ("proprietary", "This software is proprietary and confidential; unauthorized copying is strictly prohibited."),
]

# SPDX identifiers, by family.
IDENTIFIERS = {
    "apache-2.0": ["Apache-2.0"],
    "mit": ["MIT"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "mpl-2.0": ["MPL-2.0"],
    "isc": ["ISC"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc0": ["CC0-1.0"],
    "unlicense": ["Unlicense"],
    "zlib": ["Zlib"],
    "bsl-1.0": ["BSL-1.0"],
    "epl-2.0": ["EPL-2.0"],
}
TEMPLATES += [(family, f"SPDX-License-Identifier: {name}") for family, names in IDENTIFIERS.items() for name in names]

# Sentences that use the words of licences and are none.
OTHERS = [
    "He renewed his driver's license in April.",
    "The restaurant lost its license to sell alcohol.",
    "Copyright law differs between countries.",
    "The software was released in version 2.0 last year.",
    "She asked for permission to leave the room.",
    "Free software is a matter of liberty, not price.",
    "The public may use the library without charge.",
    "The above conditions were met by the source.",
    "All seats are reserved for the staff.",
    "The Apache helicopter flew over the work site.",
    "MIT researchers published the program this week.",
    "The warranty covers parts and labour for two years.",
    "Creative work is common in the foundation.",
    "Rights of the public are reserved by law.",
    "The notice was distributed on paper in all forms.",
    "General conditions apply to every purpose.",
    "This file has a copy of the list.",
    "All rights reserved to the estate were disputed in court.",
    "The rights reserved by the treaty passed to the heirs.",
    "The software of the boost pump was provided by the authors.",
    "The eclipse was public and the program had a version for children.",
    "No warranty was implied and no damages arose from the use of the road.",
    "An identifier was printed on the license plate.",
]

# Words too common to make a feature by themselves (one is a frequent German word).
FUNCTION_WORDS = "0 1 2 3 4 a all along an and any are as at be by can either for form free has have if in into is it later may mit no not of on one only or part published should that the this to under use v was with without work you your".split()


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once.

    Named in a lambda as it is, or put there by the optimizer, it would be worked out for each element.
    """
    return F.transform(F.array(value), use)[0]


def _at(words: Column, n: int) -> Column:
    """Where an n-gram begins, from 1."""
    last = F.size(words) - (n - 1)
    return F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))


def _grams(words: Column, n: int) -> Column:
    return _let(words, lambda w: F.transform(_at(w, n), lambda i: F.array_join(F.slice(w, i, n), " ")))


def features_of(words: Column) -> Column:
    """Distinct 1- to 3-grams that hold an anchor word."""
    known = anchors()

    def held(w: Column, hit: Column, n: int) -> Column:
        some = F.filter(_at(w, n), lambda i: reduce(or_, [F.element_at(hit, i + k) for k in range(n)]))
        return F.transform(some, lambda i: F.array_join(F.slice(w, i, n), " "))

    def found(w: Column) -> Column:
        return _let(F.transform(w, lambda x: x.isin(known)), lambda hit: F.array_distinct(F.concat(*(held(w, hit, n) for n in (1, 2, 3)))))

    return _let(words, found)


def resembles(words: Column, known: list[str]) -> Column:
    """Whether one of the words' trigrams is among ``known``."""
    first = sorted({g.split(" ")[0] for g in known})
    return _let(words, lambda w: F.exists(_at(w, 3), lambda i: F.element_at(w, i).isin(first) & F.array_join(F.slice(w, i, 3), " ").isin(known)))


def anchors() -> list[str]:
    import re

    found = {w for _, t in TEMPLATES for w in re.split("[^a-z0-9]+", t.lower()) if w}
    return sorted(found - set(FUNCTION_WORDS))


class Model:
    """Feature weights, intercepts, templates and thresholds; all of template size."""

    def __init__(self, classes: list[str], weights: DataFrame, intercepts: list[float], trigrams: DataFrame, temperature: float, least: float):
        self.classes, self.weights, self.intercepts, self.trigrams, self.temperature, self.least = classes, weights, intercepts, trigrams, temperature, least


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _probabilities(paragraphs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``paragraphs(*keys, f)``, f the feature array: adds ``p``, a probability for each class."""
    n = len(model.classes)
    met = paragraphs.select(*keys, F.explode("f").alias("gram")).join(F.broadcast(model.weights), "gram")
    sums = met.groupBy(*keys).agg(F.count("*").alias("known"), *[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)])
    z = F.array(*[(F.col(f"z{i}") / F.sqrt("known") + model.intercepts[i]) / model.temperature for i in range(n)])
    even = lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total))
    p = _let(z, lambda z: _let(F.array_max(z), lambda top: _let(F.transform(z, lambda x: F.exp(x - top)), even)))
    return sums.select(*keys, p.alias("p"))


FOLDS = 3
TEMPERATURES = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8]


def _learn(rows: DataFrame, classes: list[str], reg: float) -> tuple[DataFrame, list[float]]:
    """Weights ``(gram, w)`` and intercepts of ``rows(label, f)``, a few hundred at most."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, Normalizer

    counter = CountVectorizer(inputCol="f", outputCol="c", binary=True, minDF=1.0).fit(rows)
    unit = Normalizer(inputCol="c", outputCol="x", p=2.0)
    # families have unlike numbers of examples: each class weighs the same
    weighed = unit.transform(counter.transform(rows)).withColumn("weight", 1 / F.count("*").over(Window.partitionBy("label")))
    learned = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=reg, maxIter=60).fit(weighed)
    matrix = learned.coefficientMatrix.toArray()
    # a fold may lack the last classes
    pad = len(classes) - matrix.shape[0]
    weights = [(g, [float(x) for x in matrix[:, j]] + [0.0] * pad) for j, g in enumerate(counter.vocabulary)]
    return rows.sparkSession.createDataFrame(weights, "gram string, w array<double>"), [float(x) for x in learned.interceptVector] + [-20.0] * pad


def fit(spark: SparkSession, background: DataFrame | None = None, reg: float = 0.002) -> Model:
    """Train on the texts above.  ``background(text)``: corpus paragraphs, which all raise the threshold where they have to."""
    classes = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    pieces = [(f, t) for f, t in TEMPLATES]
    pieces += [(f, s.strip()) for f, t in TEMPLATES for s in t.replace(";", ".").split(". ") if len(s.split()) >= 4]
    texts = spark.createDataFrame([(i, float(classes.index(f)), t) for i, (f, t) in enumerate(pieces)] + [(10_000 + i, 0.0, t) for i, t in enumerate(OTHERS * 2)], "i long, label double, text string")
    rows = scratch.table(texts.select("i", "label", features_of(words_of(F.col("text"))).alias("f")).where("size(f) > 0").coalesce(1), "learned")
    families = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, text string")
    tri = families.withColumn("w", words_of(F.col("text"))).withColumn("g", F.array_distinct(_grams(F.col("w"), 3)))
    trigrams = tri.select("template", "family", F.size("g").alias("template_size"), F.explode("g").alias("gram"))
    # temperature: the best of a grid by the likelihood of texts held out of the fit
    held = None
    for fold in range(FOLDS):
        weights, intercepts = _learn(rows.where(f"i % {FOLDS} <> {fold}").coalesce(1), classes, reg)
        own = _probabilities(rows.where(f"i % {FOLDS} = {fold}"), Model(classes, weights, intercepts, trigrams, 1.0, 0.5), ["i", "label"])
        held = own if held is None else held.unionByName(own)
    logs = held.select("label", F.transform("p", lambda x: F.log(F.greatest(x, F.lit(1e-12)))).alias("l"))
    soft = [F.avg(F.expr(f"l[cast(label as int)] / {t} - ln(aggregate(transform(l, x -> exp(x / {t})), 0D, (a, b) -> a + b))")).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]
    likely = logs.agg(*soft).first()
    temperature = TEMPERATURES[max(range(len(TEMPERATURES)), key=lambda k: likely[f"t{k}"] if likely[f"t{k}"] is not None else -math.inf)]
    weights, intercepts = _learn(rows, classes, reg)
    model = Model(classes, weights, intercepts, trigrams, temperature, 0.5)
    # the threshold: above every counter-example and every paragraph that no template resembles
    wrong = texts.where("label = 0").select("text")
    if background is not None:
        plain = background.select("text").distinct()
        known = [r["gram"] for r in trigrams.select("gram").distinct().collect()]  # of the templates above
        wrong = wrong.unionByName(plain.where(~resembles(words_of(F.col("text")), known)))
    against = scratch.table(wrong.select(F.xxhash64("text").alias("i"), features_of(words_of(F.col("text"))).alias("f")).dropDuplicates(["i"]), "against")
    top = _probabilities(against, model, ["i"]).agg(F.max(F.array_max(F.slice("p", 2, len(classes)))).alias("m")).first()["m"]
    own = _probabilities(rows.where("label > 0"), model, ["i", "label"]).agg(F.min(F.expr("p[cast(label as int)]")).alias("m")).first()["m"]
    model.least = max(0.5, min((top or 0.0) + 0.01, own))
    return model


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, paragraph, text)``: the lines that hold a licence word; the others are unknown."""
    row = F.monotonically_increasing_id().alias("doc")
    lines = docs.select(F.col(id_col).cast("long").alias("id"), row, F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("paragraph", "text"))
    return lines.where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), _literal(anchors())))


def notices(lines: DataFrame, model: Model, least_shared: float = 0.5) -> DataFrame:
    """What :func:`paragraphs` gave and a table keeps, judged: ``(id, paragraph, family, probability, template, similarity, confirmed)`` of believed predictions.

    similarity is the share of the paragraph's or of the template's trigrams, the larger, that both
    have.  Repeated rows give repeated notices; null texts and ids give none and null ids.
    """
    keys = ["doc", "id", "paragraph"]
    p = _probabilities(lines.select(*keys, features_of(words_of(F.col("text"))).alias("f")), model, keys)
    best = F.array_max(F.slice("p", 2, len(model.classes)))
    believed = p.withColumn("probability", best).where((F.col("probability") >= model.least) & (F.col("probability") > F.col("p")[0]))
    believed = believed.select(*keys, "probability", _literal(model.classes)[F.array_position("p", F.col("probability")).cast("int") - 1].alias("family"))
    believed = scratch.table(believed, "believed")
    alike = lines.join(believed.select(*keys), keys, "left_semi").select(*keys, F.array_distinct(_grams(words_of(F.col("text")), 3)).alias("g"))
    shared = alike.select(*keys, F.size("g").alias("size"), F.explode("g").alias("gram")).join(F.broadcast(model.trigrams), "gram")
    shared = shared.groupBy(*keys, "family", "template").agg((F.count("*") / F.least(F.first("size"), F.first("template_size"))).alias("similarity"))
    shared = shared.groupBy(*keys, "family").agg(F.max(F.struct("similarity", (-F.col("template")).alias("t"))).alias("m"))
    out = believed.join(shared, [*keys, "family"], "left")
    similarity = F.coalesce(F.col("m.similarity"), F.lit(0.0))
    return out.select("id", "paragraph", "family", "probability", (-F.col("m.t")).alias("template"), similarity.alias("similarity"), (similarity >= least_shared).alias("confirmed"))


def scan(docs: DataFrame, least_shared: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, families, n_notices, n_unconfirmed, probability)``: one row per id of ``docs``.

    families are those of confirmed notices, sorted; an id without any has an empty list.  Null
    and empty texts have no paragraph.  Rows that share an id are one row, repeated rows count their
    notices again; null ids are one.  A text is read whole, line by line, however long.  Of families
    that tie the first by name is believed, of templates the first.  An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = scratch.table(paragraphs(own, "id", "text"), "lines")
    model = fit(docs.sparkSession, lines.select("text"))
    found = notices(lines, model, least_shared).groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.sum(F.col("confirmed").cast("long")).alias("n_notices"),
        F.sum((~F.col("confirmed")).cast("long")).alias("n_unconfirmed"),
        F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
    )
    ids = own.select("id").distinct()
    none = F.expr("cast(array() as array<string>)")
    joined = ids.join(found.withColumnRenamed("id", "fid"), F.col("id").eqNullSafe(F.col("fid")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("id", F.coalesce("families", none).alias("families"), F.coalesce("n_notices", zero).alias("n_notices"), F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"), "probability")
