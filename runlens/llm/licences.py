"""License scans in built-in functions: a paragraph classifier over word n-grams, confirmed against templates."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.blocks import table
from runlens.session import keep

UNKNOWN = "unknown"
WORD = r"[\p{L}\p{N}]+"
# Documents whose paragraphs stand for the unknown class, the first by a hash of their id.
SAMPLE = 400
# Probability and shared part of a template from which a licence counts as found.
CERTAIN = 0.5
SHARED = 0.5
# Wrapped notices are sought in stretches of so many lines, one every STEP lines. Lines of more characters are not wrapped.
STRETCH = 12
STEP = 6
BREAK = r"\n[^\p{L}\p{N}\n]*(?=\n)|[^\n]{121,}"
# An n-gram in more than this share of ordinary paragraphs is no feature.
COMMON = 0.002
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
# Customary wordings of notices, by family.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("cc0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "No part of this publication may be reproduced without prior written permission of the publisher."),
]


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\n")


def wrapped(lines: Column) -> Column:
    """(place, text) of the runs of two lines or more that stand together, without blank or long lines between.

    Lines without letters and digits (comment marks, rules) are blank. A run over seven lines comes in overlapping
    parts; the place is the first line of the stretch that holds it.
    """

    def stretch(i: Column) -> Column:
        runs = F.split(F.array_join(F.slice(lines, i + 1, STRETCH), "\n"), BREAK)
        runs = F.filter(runs, lambda x: x.rlike(r"[\p{L}\p{N}][^\n]*\n[^\n]*[\p{L}\p{N}]"))
        return F.transform(runs, lambda x: F.struct(i.alias("place"), x.alias("text")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(STEP)), stretch))


def units(text: Column) -> Column:
    """(place, text) of every line and of the wrapped runs of lines."""
    each = F.transform(paragraphs(text), lambda x, i: F.struct(i.alias("place"), x.alias("text")))
    return F.concat(each, wrapped(paragraphs(text)))


def ngrams(paragraph: Column) -> Column:
    """Hashes of the runs of two and of three words, each once; case and punctuation do not count."""
    words = F.array(F.regexp_extract_all(F.lower(paragraph), F.lit(WORD), F.lit(0)))

    def runs(w: Column) -> Column:
        two = F.transform(w, lambda x, i: F.when(i + 1 < F.size(w), F.xxhash64(x, F.get(w, i + 1))))
        three = F.transform(w, lambda x, i: F.when(i + 2 < F.size(w), F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
        return F.array_distinct(F.array_compact(F.concat(two, three)))

    return F.transform(words, runs)[0]


def constant(value, kind: str) -> Column:
    """A list as one constant of the plan, however long."""
    return F.from_json(F.lit(json.dumps(value)), kind)


@dataclass
class Model:
    """Families, their weights per n-gram hash, intercepts, temperature, and the n-gram hashes of each template."""

    families: list[str]
    weights: dict[int, list[float]]
    intercepts: list[float]
    templates: list[tuple[str, list[int]]]

    def scores(self, found: Column) -> Column:
        """Class scores of a paragraph from its known n-grams (hashes)."""
        table = F.map_from_arrays(constant(list(self.weights), "array<bigint>"), constant(list(self.weights.values()), "array<array<double>>"))
        start = constant(self.intercepts, "array<double>")
        return F.aggregate(found, start, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))

    def probabilities(self, found: Column) -> Column:
        """Class probabilities of a paragraph from its known n-grams (hashes)."""

        def softmax(s: Column) -> Column:
            parts = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
            total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
            return F.transform(parts, lambda x: x / total)

        return F.transform(F.array(self.scores(found)), softmax)[0]

    def similarity(self, grams: Column, family: Column) -> Column:
        """Largest share of a template of the family that the paragraph's n-grams cover."""
        each = [
            F.when(family == name, F.size(F.array_intersect(grams, constant(own, "array<bigint>"))) / F.lit(float(len(own))))
            for name, own in self.templates
        ]
        return F.coalesce(F.greatest(*each, F.lit(0.0)), F.lit(0.0))


def _examples(spark: SparkSession) -> DataFrame:
    """Templates whole and without their first or last third: family, text."""
    rows = []
    for family, text in TEMPLATES:
        words = text.split()
        third = len(words) // 3
        cuts = [words, words[third:], words[: len(words) - third]] if len(words) > 8 else [words]
        rows += [(family, " ".join(c)) for c in cuts]
    return spark.createDataFrame(rows, "family string, text string")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Multinomial logistic regression of the templates against paragraphs of ``sample`` documents.

    Those paragraphs are the unknown class, but for those that share half of a template, alone or in a wrapped run. The scores are divided by the
    temperature that fits the paragraphs of a second sample best, so that the unknown class is calibrated on text that
    was not learnt from.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "i int, family string, text string")
    template_rows = rows.select("i", "family", ngrams(F.col("text")).alias("grams")).orderBy("i").collect()
    templates = [(r["family"], list(r["grams"])) for r in template_rows]
    families = sorted({f for f, _ in templates}) + [UNKNOWN]
    vocabulary = sorted({g for _, own in templates for g in own})

    # At most 2 * sample ids.
    by_hash = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    half = by_hash.withColumn("held_out", F.xxhash64("doc_id", F.lit(1)) % 2 == 0)
    known = constant(vocabulary, "array<bigint>")
    some = docs.select("doc_id", "text").join(F.broadcast(half), "doc_id").dropDuplicates(["doc_id"])
    lines = (
        some.select("doc_id", "held_out", F.explode(paragraphs(F.col("text"))).alias("text"))
        .select("doc_id", "held_out", ngrams(F.col("text")).alias("grams"))
        .withColumn("found", F.array_intersect("grams", known))
    )
    runs = (
        some.select("doc_id", F.explode(wrapped(paragraphs(F.col("text")))).alias("run"))
        .select("doc_id", ngrams(F.col("run.text")).alias("grams"))
        .withColumn("found", F.array_intersect("grams", known))
    )
    shares = [F.size(F.array_intersect("found", constant(own, "array<bigint>"))) / F.lit(float(len(own))) for _, own in templates]
    near = F.when(F.size("found") > 0, F.greatest(*shares)).otherwise(0.0)
    # The known n-grams of wrapped notices, by document: a line with no others is part of one.
    notices = runs.where(near >= SHARED).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("noticed"))
    part = (F.size("found") > 0) & (F.size(F.array_except("found", F.coalesce("noticed", F.array().cast("array<bigint>")))) == 0)
    ordinary = keep(lines.where(near < SHARED).join(notices, "doc_id", "left").where(~part).select("held_out", "found"), "ordinary")
    counts = ordinary.select(F.explode("found").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()  # n-grams of templates only
    total = max(1, ordinary.count())
    common = {r["g"] for r in counts if r["n"] > max(2, COMMON * total)}
    features = [g for g in vocabulary if g not in common]
    kept = constant(features, "array<bigint>")

    def labelled(df: DataFrame) -> DataFrame:
        return df.select(F.transform(F.array_intersect("found", kept), lambda g: g.cast("string")).alias("words"), "label", "weight")

    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    positive = _examples(spark).select(ngrams(F.col("text")).alias("found"), number.cast("double").alias("label"), F.lit(1.0).alias("weight"))
    # Most ordinary paragraphs have no known n-gram at all: those are counted, not listed.
    plain = ordinary.groupBy("held_out", "found").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    plain = plain.select("held_out", "found", F.lit(float(len(families) - 1)).alias("label"), "weight")
    vectors = CountVectorizerModel.from_vocabulary([str(g) for g in features], inputCol="words", outputCol="x")
    learnt = positive.select("found", "label", "weight").union(plain.where(~F.col("held_out")).select("found", "label", "weight"))
    # An empty table still has one example of the unknown class.
    learnt = learnt.union(spark.createDataFrame([([], float(len(families) - 1), 1.0)], "found array<bigint>, label double, weight double"))
    # A few thousand rows: one task, so that a round of the fit is one short job.
    rows = vectors.transform(labelled(keep(learnt, "learnt"))).coalesce(1)
    fitted = LogisticRegression(featuresCol="x", weightCol="weight", family="multinomial", regParam=0.002, maxIter=60).fit(rows)
    matrix = fitted.coefficientMatrix.toArray()
    model = Model(families, {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(features)}, [float(x) for x in fitted.interceptVector], templates)

    tried = positive.select("found", "label", "weight").union(plain.where("held_out").select("found", "label", "weight"))
    tried = keep(tried.withColumn("scores", model.scores(F.array_intersect("found", kept))), "tried")
    loss = [F.sum(_log_loss(F.col("scores"), t, F.col("label").cast("int")) * F.col("weight")).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    losses = list(tried.agg(*loss).first())
    return _scaled(model, TEMPERATURES[losses.index(min(losses))])


def _log_loss(scores: Column, temperature: float, label: Column) -> Column:
    scaled = F.transform(scores, lambda x: x / temperature)
    most = F.array_max(scaled)
    spread = F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + F.exp(x - most))
    return F.log(spread) + most - F.get(scaled, label)


def _scaled(model: Model, t: float) -> Model:
    return Model(model.families, {g: [x / t for x in w] for g, w in model.weights.items()}, [x / t for x in model.intercepts], model.templates)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_candidates, families, found of every row.

    A paragraph is a line; wrapped runs of lines are judged too. A candidate is either with a known n-gram. ``found`` has place, family, probability and similarity of the
    candidates whose most likely class is a family, likely enough and confirmed by a template of that family.
    """
    known = constant(list(model.weights), "array<bigint>")

    def classify(unit: Column) -> Column:
        place = unit["place"]
        grams = F.array(ngrams(unit["text"]))

        def one(g: Column) -> Column:
            found = F.array_intersect(g, known)

            def judge(p: Column) -> Column:
                best = F.array_max(p)
                family = F.get(F.array(*[F.lit(f) for f in model.families]), (F.array_position(p, best) - 1).cast("int"))
                return F.struct(place.alias("place"), family.alias("family"), best.alias("probability"), model.similarity(g, family).alias("similarity"))

            return F.when(F.size(found) > 0, F.transform(F.array(model.probabilities(found)), judge)[0])

        return F.transform(grams, one)[0]

    # The whole text first: few documents have any known n-gram, and those of its paragraphs are among them.
    lines = paragraphs(F.col("text"))
    rows = docs.select("doc_id", "text").withColumn("any", F.size(F.array_intersect(ngrams(F.col("text")), known)) > 0)
    judged = F.when(F.col("any"), F.array_compact(F.transform(units(F.col("text")), classify)))
    rows = rows.select("doc_id", F.size(lines).alias("n_paragraphs"), F.coalesce(judged, F.array_compact(F.array(judged[0]))).alias("judged"))
    sure = F.filter("judged", lambda c: (c["family"] != UNKNOWN) & (c["probability"] >= CERTAIN) & (c["similarity"] >= SHARED))
    rows = rows.select("doc_id", "n_paragraphs", F.size("judged").alias("n_candidates"), sure.alias("found"))
    return rows.select("doc_id", "n_paragraphs", "n_candidates", F.array_sort(F.array_distinct(F.transform("found", lambda c: c["family"]))).alias("families"), "found")


def licence_scan(docs: DataFrame) -> DataFrame:
    """The scan of every row of ``docs`` by a model trained against them.

    Nulls: a null text is one empty paragraph without a licence; a null id stays null and is not learnt from. Repeated
    rows give repeated rows, an empty table none; other columns are not read. Equal probabilities go to the family
    first in the alphabet.
    """
    return scan(docs, train(docs))


def op7(spark, sf_dir):
    return licence_scan(table(spark, sf_dir, "documents"))
