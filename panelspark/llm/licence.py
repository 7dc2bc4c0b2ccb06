"""Licence families of paragraphs by a trained classifier, from DataFrame functions only.

Sparse word n-grams (one and two words, hashed) feed a multinomial logistic regression.
It is trained on the notices below, on notices that name licences of no family here (the
unknown class), and on a bounded sample of prose.  Its temperature and the probability that
a family needs are set with whole notices and whole licence names held out; then it is
fitted again on all of them.  A comparison with the family's notices confirms or doubts
what it says.

Lines are judged one by one, and so are runs of lines that a wrapped sentence makes.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import let, lower_ascii
from panelspark.session import materialize

#: Common forms of public licence notices (fixed values: their wording is the feature).
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "This project is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU GPL version 2 or later.",
        "Released under the GNU Lesser General Public License, version 2.1.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corp. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Names of the families, for the notices made of ``SAYINGS`` (fixed values).
NAMES = {
    "mit": ["MIT License", "MIT license", "Expat License"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License"],
    "gpl": ["GNU General Public License, version 3", "GNU GPL version 2 or later", "GNU Lesser General Public License", "GNU Affero General Public License v3"],
    "bsd": ["BSD 3-Clause License", "2-clause BSD license", "BSD License"],
    "mpl": ["Mozilla Public License 2.0", "Mozilla Public License, v. 1.1", "MPL 2.0"],
    "cc-by": ["CC BY 4.0", "CC BY-SA 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: Licences of no family here (fixed values), which the unknown class is learnt from.
OTHERS = [
    "Eclipse Public License 2.0", "Artistic License 2.0", "Open Software License 3.0", "Academic Free License", "Common Development and Distribution License",
    "European Union Public Licence", "Boost Software License 1.0", "zlib License", "ISC License", "PostgreSQL License", "Python Software Foundation License",
    "PHP License 3.01", "Ruby License", "Microsoft Public License", "SIL Open Font License 1.1", "Vim License", "LaTeX Project Public License", "CeCILL licence 2.1",
    "Q Public License", "W3C Software Notice", "Common Public License 1.0", "IBM Public License", "Zope Public License", "OpenSSL License", "Open Data Commons Open Database License",
    "Server Side Public License", "Business Source License 1.1", "Elastic License 2.0", "house terms of the archive", "rules of the society", "site agreement, section 4",
    "club rules", "terms of the publisher", "agreement of the consortium",
]
SAYINGS = (
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is distributed under the terms of the {}.",
    "Use of this source code is governed by the {}.",
    "You may not use this file except in compliance with the {}.",
    "This program and the accompanying materials are made available under the {}",
    "The text is available under the {}; ask the office for a copy.",
)
FAMILIES = sorted(NOTICES)
NONE, UNKNOWN = "none", "unknown"
LABELS = [NONE, *FAMILIES, UNKNOWN]
#: Hashed n-grams.
FEATURES = 1 << 14
#: Paragraphs of prose that the classifier is trained on at most, in the order of their hash.
SAMPLE = 4000
#: Words of a prose frame around a notice in the variants.
FRAMES = ("{}", "{} See the appendix.", "Notice: {}", "{} 2019-2024", "The authors state: {} Thank you.")
TEMPERATURES = (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Lines that a run of a wrapped sentence has at most.
RUN_LINES = 12
#: A notice is confirmed if this share of its family's nearest notice's n-grams is in the paragraph.
MIN_SHARE = 0.6


def ngrams(text: Column) -> Column:
    """Distinct one- and two-word grams; words are runs of letters and digits, lower-cased."""
    tidy = F.trim(F.regexp_replace(lower_ascii(text), r"[^\p{L}\p{N}]+", " "))

    def grams(ws: Column) -> Column:
        pairs = F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(ws, F.slice(pairs, 1, F.greatest(F.size(ws) - 1, F.lit(0)))))

    return let(F.split(tidy, " "), grams)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, lines, text): lines with a letter or digit, and runs of them.

    ``paragraph`` is the number of the (first) line, from 0.  A run goes on while a line
    doesn't end a sentence and the next one isn't blank; a longer one than ``RUN_LINES``,
    which is no notice, has its lines alone.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("ls"))

    def ends(ls: Column) -> Column:
        last = F.size(ls) - 1
        return F.transform(ls, lambda x, i: x.rlike(r"[.!?:;]\s*$|^\s*$") | (i == last) | F.coalesce(F.get(ls, i + 1).rlike(r"^\s*$"), F.lit(False)))

    def units(ls: Column, es: Column) -> Column:
        def unit(x: Column, i: Column) -> Column:
            begins = (i == 0) | F.coalesce(F.get(es, i - 1), F.lit(True))
            n = F.when(begins & ~F.get(es, i), F.array_position(F.slice(es, i + 1, RUN_LINES), True)).otherwise(0)
            run = F.when(n > 1, F.struct(i.alias("paragraph"), n.cast("int").alias("lines"), F.array_join(F.slice(ls, i + 1, n.cast("int")), " ").alias("text")))
            return F.array(F.struct(i.alias("paragraph"), F.lit(1).alias("lines"), x.alias("text")), run)

        return F.filter(F.flatten(F.transform(ls, unit)), lambda u: u.isNotNull())

    cut = let(F.col("ls"), lambda ls: let(ends(ls), lambda es: units(ls, es)))
    found = rows.select("doc_id", F.explode(cut).alias("u")).select("doc_id", "u.paragraph", "u.lines", "u.text")
    return found.filter(F.col("text").rlike(r"[\p{L}\p{N}]"))


def _rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    items = [F.struct(F.lit(a).alias("label"), F.lit(b).alias("text")) for a, b in rows]
    return spark.range(1).select(F.explode(F.array(*items)).alias("r")).select("r.label", "r.text")


def known_notices(spark: SparkSession) -> DataFrame:
    """(label, text, held): notices in all frames; held out are whole ones, and whole names
    in all their sayings."""
    entries = []
    for label in FAMILIES:
        # long notices are met in parts, too
        whole = [(n, False) for n in NOTICES[label]] + [(n, True) for n in NAMES.get(label, [])]
        whole += [(" ".join(p), False) for n in NOTICES[label] for w in [n.split()] if len(w) > 11 for p in (w[:9], w[-9:], w[len(w) // 3 :])]
        entries += [(label, text, name, i % 3 == 2) for i, (text, name) in enumerate(whole)]
    entries += [(UNKNOWN, text, True, i % 3 == 2) for i, text in enumerate(OTHERS)]
    items = [F.struct(*[F.lit(x).alias(c) for x, c in zip(e, ("label", "entry", "name", "held"), strict=True)]) for e in entries]
    rows = spark.range(1).select(F.explode(F.array(*items)).alias("r")).select("r.*")
    sayings = F.when(F.col("name"), F.array(*[F.lit(x) for x in SAYINGS])).otherwise(F.array(F.lit("{}")))
    said = rows.withColumn("saying", F.explode(sayings)).withColumn("notice", F.replace("saying", F.lit("{}"), "entry"))
    framed = said.withColumn("frame", F.explode(F.array(*[F.lit(x) for x in FRAMES])))
    return framed.select("label", F.replace("frame", F.lit("{}"), "notice").alias("text"), "held")


def _training(spark: SparkSession, lines: DataFrame, sample: int) -> DataFrame:
    """(label, text, held): notices in their frames, and prose of which a quarter is held out."""
    known = known_notices(spark)
    hints = r"(?i)licen[sc]e|copyright|all rights reserved|public domain|creative commons|CC BY"
    hashed = lines.filter((F.col("lines") == 1) & ~F.col("text").rlike(hints)).select("text", F.xxhash64("text", "doc_id", "paragraph").alias("h"))
    # a share of the rows by their hash, some four samples large, so that no task merges more
    n = hashed.count()
    share = min(1.0, 4.0 * (sample + 100) / max(n, 1))
    near = hashed.filter(F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    prose = near.orderBy("h", "text").limit(sample).select(F.lit(NONE).alias("label"), "text")
    return known.unionByName(prose.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(4)) == 0))


def _features(df: DataFrame) -> DataFrame:
    counted = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=FEATURES, binary=True)
    return counted.transform(df.withColumn("__grams", ngrams(F.col("text"))))


def _probabilities(raw: Column, temperature: float) -> Column:
    """Softmax of the raw scores at a temperature."""

    def normal(s: Column) -> Column:
        return let(F.aggregate(s, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(s, lambda x: x / n))

    return let(F.array_max(raw), lambda m: let(F.transform(raw, lambda x: F.exp((x - m) / temperature)), normal))


class LicenceModel:
    """The regression with its temperature and the threshold of the unknown class."""

    def __init__(self, model: LogisticRegressionModel, temperature: float, threshold: float) -> None:
        self.model, self.temperature, self.threshold = model, temperature, threshold

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows whose text is a notice, with family (or ``unknown``) and probability."""
        labels = F.array(*[F.lit(x) for x in LABELS])

        def judged(p: Column) -> Column:
            def named(best: Column) -> Column:
                label = F.element_at(labels, F.array_position(p, best).cast("int"))
                family = F.when((label != NONE) & (best < self.threshold), F.lit(UNKNOWN)).otherwise(label)
                return F.struct(family.alias("family"), best.alias("probability"))

            return let(F.array_max(p), named)

        verdict = let(vector_to_array("rawPrediction"), lambda raw: let(_probabilities(raw, self.temperature), judged))
        # a generator computes the verdict once; a filter above it would compute it again
        found = F.filter(F.array(verdict), lambda v: v["family"] != NONE)
        scored = self.model.transform(_features(rows)).select(*rows.columns, F.explode(found).alias("__verdict"))
        return scored.select(*rows.columns, "__verdict.family", "__verdict.probability")


def _fit(rows: DataFrame) -> LogisticRegressionModel:
    """The regression; prose outnumbers notices, so the classes weigh alike."""
    regression = LogisticRegression(
        featuresCol="__features", labelCol="y", predictionCol="__prediction", weightCol="__weight", family="multinomial", regParam=1e-3, maxIter=30
    )
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, 1.0 / n)])[F.col("label")]
    return regression.fit(_features(rows).withColumn("__weight", weight * sum(sizes.values()) / len(sizes)))


def train(spark: SparkSession, lines: DataFrame, sample: int = SAMPLE) -> LicenceModel:
    """Fits on notices and at most ``sample`` lines of prose, calibrated on what is held out.

    The temperature is the one with the least log loss on the rows held out, the threshold
    the smallest at which at most one in ten of the held out notices of the unknown class
    is taken for a family.  The model itself is fitted on all rows.
    """
    index = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")) - 1
    rows = _training(spark, lines, sample).withColumn("y", index.cast("double"))
    rows = materialize(rows.coalesce(4), "licence-training")
    trial = _fit(rows.filter("NOT held"))
    held = trial.transform(_features(rows.filter("held"))).select("label", "y", vector_to_array("rawPrediction").alias("__raw"))
    held = materialize(held, "licence-held")
    loss = [
        F.avg(-F.log(F.greatest(F.get(_probabilities(F.col("__raw"), t), F.col("y").cast("int")), F.lit(1e-12)))).alias(f"t{i}")
        for i, t in enumerate(TEMPERATURES)
    ]
    losses = held.agg(*loss).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: losses[i] if losses[i] is not None else math.inf)

    def family(p: Column) -> Column:
        """The probability of the likeliest class if that is a family, else 0."""
        best = F.array_max(F.slice(p, 2, len(FAMILIES)))
        return F.when(best == F.array_max(p), best).otherwise(0.0)

    tops = held.filter(F.col("label") == UNKNOWN).select(let(_probabilities(F.col("__raw"), TEMPERATURES[best]), family).alias("p"))
    passed = tops.agg(*[F.avg((F.col("p") >= t).cast("double")).alias(f"u{i}") for i, t in enumerate(THRESHOLDS)]).first()
    threshold = next((t for i, t in enumerate(THRESHOLDS) if passed[i] <= 0.1), THRESHOLDS[-1])
    return LicenceModel(_fit(rows), TEMPERATURES[best], threshold)


def find_licences(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, paragraph, lines, family, probability, similarity, confirmed): every notice.

    ``paragraph`` is the number of the notice's first line and ``lines`` how many it has.
    ``family`` is ``unknown`` where the classifier sees a notice of no family or is sure of
    none; ``similarity`` is the largest share of a notice's n-grams, of the family or of any
    for unknown, that the paragraph has.  A run of wrapped lines that is confirmed stands for
    its lines; of others the lines stand alone.  Null and empty texts have no paragraphs;
    repeated rows give repeated rows; other columns are left alone.  Without a row of prose
    nothing can be learnt about it, so a table without any paragraph gives no rows.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs)
    if lines.isEmpty():
        empty = "doc_id long, paragraph int, lines int, family string, probability double, similarity double, confirmed boolean"
        return spark.createDataFrame([], empty)
    model = train(spark, lines, sample)
    notices = [(f, n) for f in FAMILIES for n in NOTICES[f]]
    shapes = _rows(spark, notices).select("label", ngrams(F.col("text")).alias("g"))
    known = materialize(shapes.groupBy().agg(F.collect_list(F.struct("label", "g")).alias("notices")), "licence-notices").first()["notices"]
    table = F.array(*[F.struct(F.lit(k["label"]).alias("label"), F.array(*[F.lit(x) for x in k["g"]]).alias("g")) for k in known])
    grams = ngrams(F.col("text"))
    own = F.filter(table, lambda k: (k["label"] == F.col("family")) | (F.col("family") == UNKNOWN))
    shares = let(grams, lambda g: F.transform(own, lambda k: F.size(F.array_intersect(g, k["g"])) / F.size(k["g"])))
    compared = model.score(lines).withColumn("similarity", F.array_max(shares))
    compared = compared.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("similarity") >= MIN_SHARE))
    # the few notices: lines of a confirmed run go, and so do runs that are not confirmed
    found = materialize(compared.select("doc_id", "paragraph", "lines", "family", "probability", "similarity", "confirmed"), "licence-found")
    runs = found.filter("lines > 1 AND confirmed").select("doc_id", F.explode(F.sequence(F.col("paragraph"), F.col("paragraph") + F.col("lines") - 1)).alias("paragraph")).distinct()
    runs = runs.withColumnsRenamed({"doc_id": "__doc", "paragraph": "__line"})
    single = found.filter("lines = 1")
    alone = single.join(runs, single["doc_id"].eqNullSafe(runs["__doc"]) & (single["paragraph"] == runs["__line"]), "left_anti")
    return alone.unionByName(found.filter("lines > 1 AND confirmed")).select(
        "doc_id", "paragraph", "lines", "family", F.round("probability", 4).alias("probability"), F.round("similarity", 4).alias("similarity"), "confirmed"
    )
