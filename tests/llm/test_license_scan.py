import math
import time
import re

from pyspark.sql import functions as F

from gridtrack.llm import license_scan
from tests.llm.helpers import empty_docs, odd_docs


def test_scan(spark):
    texts = [
        "Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the MIT License.\nAll rights reserved.",
        "This is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Redistribution and use in source and binary forms, with or without changes, are permitted provided that these conditions are met:",
        "The driver lost his license on a public road and the source of the file was not found.",
        "Mit dem Zug an die See.",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.families for r in license_scan.scan(df).collect()}
    assert got == {0: ["apache-2.0"], 1: ["gpl"], 2: ["mit", "proprietary"], 3: ["cc-by-sa"], 4: ["bsd"], 5: [], 6: [], 7: [], 8: []}


NOTICES = [
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("// SPDX-License-Identifier: EPL-2.0", "epl-2.0"),
    ("You may redistribute it under the terms of the GNU General Public License as published by the FSF; either version 2 of the License", "gpl"),
    ("Distributed under the Boost Software License, Version 1.0. See the accompanying file.", "bsl-1.0"),
    ("In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    ("All rights reserved to the estate were disputed in court.", None),
    ("The eclipse was seen by the public in many terms.", None),
]


def test_notices_against_plain_arithmetic(spark):
    """Probabilities, believed families and similarities, worked out again from the model's weights."""
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    lines = license_scan.scratch.table(license_scan.paragraphs(docs), "lines")
    model = license_scan.fit(spark, lines.select("text"))
    weights = {r.gram: r.w for r in model.weights.collect()}
    grams = {}
    for r in model.trigrams.collect():
        grams.setdefault((r.template, r.family), set()).add(r.gram)
    got = {r.id: r for r in license_scan.notices(lines, model).collect()}
    for i, (text, family) in enumerate(NOTICES):
        words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        every = {" ".join(words[j : j + n]) for n in (1, 2, 3) for j in range(len(words) - n + 1)}
        known = [g for g in every if g in weights]
        z = [(sum(weights[g][c] for g in known) / math.sqrt(len(known)) + b) / model.temperature for c, b in enumerate(model.intercepts)]
        p = [math.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p]
        best = max(range(1, len(p)), key=lambda c: p[c])
        believed = p[best] >= model.least and p[best] > p[0]
        assert (i in got) == believed, text
        own = {" ".join(words[j : j + 3]) for j in range(len(words) - 2)}
        shared = max((len(own & g) / min(len(own), len(g)) for (_, f), g in grams.items() if f == model.classes[best]), default=0.0)
        if believed:
            assert got[i].family == model.classes[best] and math.isclose(got[i].probability, p[best], rel_tol=1e-9)
            assert math.isclose(got[i].similarity, shared) and got[i].confirmed == (shared >= 0.5)
        assert (got[i].family if believed and shared >= 0.5 else None) == family, (text, p[best], model.least, shared)


def test_threshold_looks_at_all_paragraphs(spark):
    """A paragraph like no template, however rare, raises the threshold."""
    plain = spark.createDataFrame([(f"the license of the {i} road",) for i in range(3000)], "text string")
    odd = spark.createDataFrame([("gnu apache mozilla affero lesser copyleft mit gnu",)], "text string")
    low, high = license_scan.fit(spark, plain).least, license_scan.fit(spark, plain.unionByName(odd)).least
    assert high >= low >= 0.5


def test_odd(spark):
    docs = odd_docs(spark)
    rows = license_scan.scan(docs).collect()
    assert len(rows) == docs.select("doc_id").distinct().count()
    assert license_scan.scan(empty_docs(spark)).count() == 0


def test_a_long_paragraph_takes_time_in_proportion(spark):
    """Words are split once a paragraph, not once a gram."""
    words = ("the quick prose of an unhurried license " * 20_000).strip()
    df = spark.createDataFrame([(words,)], "text string")
    began = time.time()
    w = license_scan.words_of(F.col("text"))
    got = df.select(license_scan.features_of(w).alias("f"), license_scan.resembles(w, ["no such gram"]).alias("no"), license_scan.resembles(w, ["prose of an"]).alias("yes")).first()
    assert time.time() - began < 60
    assert sorted(got.f) == ["an unhurried license", "license", "license the", "license the quick", "unhurried license", "unhurried license the"]
    assert (got.no, got.yes) == (False, True)
