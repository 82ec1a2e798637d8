"""Licence scans of every paragraph: a trained sparse n-gram classifier, confirmed by templates.

Training rows are written by rule: each name of a licence family in each wording of WORDINGS, the
families' own clauses and the lines that they are wrapped into, statements of rights that name no family (class ``unknown``), sentences that speak
of licences in another sense and a bounded sample of the corpus' own paragraphs (class ``none``). A
multinomial logistic regression with an L1 term over words and bigrams leaves few weights. Most n-grams stand
in rows of ``none`` only, where that term holds their weights at zero; the fit leaves those out, proves it of each
by its gradient, and takes in any of which that does not hold. So its vectors, which the driver holds, follow the
written rows and not the words of the corpus.

A third of the wordings and of the sampled paragraphs is held out of the fit. On it the probabilities
are calibrated by one temperature, and the bound of a family is set: above all that those held-out rows of
``unknown`` and ``none`` reach which a template would confirm. N-grams that are common in the sample, and pairs of two such words, are no features. A paragraph is reported if ``none`` is not its likeliest class; as a family
if its probability is above the bound and a template of that family bears it out (a name of it, whole, or several
n-grams of a clause), else as ``unknown``.

The scan is one pass without shuffle. A text is looked at closer only if it has one of the trigger words:
the weighted n-grams that are no triggers could all stand in one paragraph and still leave it ``none``, so
no paragraph is lost by that.

DataFrame operations only; the fit is Spark's own.

Defined cases: null or empty texts and blank paragraphs give no row; ids may be null; repeated rows
give repeated rows; an empty corpus trains on the written rows alone; a paragraph is a line, however
long; of equally likely families the later of FAMILIES wins; other columns play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import drop_tables, materialise

#: The families' names as they are written, then clauses of their texts.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (
        ("MIT License", "MIT licence", "Expat License", "MIT"),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ),
    ),
    "Apache-2.0": (
        ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache License", "Apache-2.0"),
        (
            "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ),
    ),
    "GPL": (
        ("GNU General Public License", "GNU General Public License, version 2", "GNU GPL version 3", "GNU GPL", "GPL-3.0-or-later", "GPLv3", "GPL"),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program.",
        ),
    ),
    "LGPL": (("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL-2.1-or-later", "LGPL"), ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",)),
    "AGPL": (("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0-only", "AGPL"), ("You should have received a copy of the GNU Affero General Public License along with this program.",)),
    "BSD": (
        ("BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-style license", "BSD-3-Clause", "BSD"),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ),
    ),
    "CC-BY": (("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0"), ()),
    "CC-BY-SA": (("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0"), ()),
    "CC-BY-NC": (("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0"), ()),
    "CC0": (("CC0 1.0 Universal", "CC0", "Creative Commons Zero", "CC0-1.0 public domain dedication"), ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",)),
    "MPL-2.0": (("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",)),
    "Unlicense": (("The Unlicense", "Unlicense"), ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose",)),
}
#: How texts say that a licence holds; the place of a wording in this list says whether it is held out.
WORDINGS = (
    "This software is distributed under the {}", "The code is available under {} terms", "See the file COPYING for the {}", "SPDX-License-Identifier: {}",
    "You may use this work under the {}", "Published under {}", "The {} applies to all files here", "Subject to the terms of the {}", "License: {}",
    "Dieses Werk steht unter der {} Lizenz", "Lizenziert nach {}", "Ce document est publié sous licence {}", "Distribué selon les termes de la {}",
    "Esta obra está bajo una licencia {}", "Publicado con la licencia {}", "Made available according to the {}", "Its contents are licensed under {}", "This is licensed under the {}",
    "Veröffentlicht unter {}-Lizenz", "Lizenz: {}", "Unter der {}-Lizenz veröffentlicht",
)
UNKNOWN = (
    "All rights reserved by the publisher.", "All rights are reserved.", "Copyright by the authors. All rights reserved", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.",
    "This document is licensed under terms set out elsewhere.", "Licensed to the customer for internal use only.", "No part of this publication may be reproduced without prior written permission of the publisher.",
    "Use of this material requires a license from the copyright holder.", "Copyright by the author, licensed for private use.", "Unauthorised copying of this file is prohibited.",
    "The licensee agrees to the terms of the license agreement.", "Licensed under a proprietary license.", "Released under a custom license.", "Rights reserved, see the license agreement.",
)
OTHER_SENSE = (
    "You need a driving license to rent a car.", "The poet took some licence with the facts.", "He asked for permission to leave early.", "The hunting license costs ten coins.",
    "She studied at MIT for three years.", "The Apache people lived in the south west.", "Creative work is a common thing here.", "The general public was not told.",
    "Er kam mit dem Zug nach Hause.", "Mit der Zeit wird es besser.", "Das Kind spielt mit einem Ball.", "Sie spricht mit ihren Eltern.", "Ein Haus mit Garten und Hof.", "Wir reden mit allen anderen.",
)
CLASSES = ("none", "unknown", *FAMILIES)
#: Words of a line of a wrapped text, about, as which clauses are learned: a line each so many words.
LINE_WORDS, LINE_STEP = 12, 6
#: Words one of which has to stand beside a name of a single word.
SAYING = ("license", "licence", "licensed", "licenses", "lizenz", "lizenziert", "licencia", "spdx", "terms", "termes", "copying", "published", "publicado", "publié", "available", "distributed")
#: Sampled paragraphs of class ``none``, by a hash of the paragraph, and repeats of rows that are written once.
NEGATIVES, REPEATS = 2_000, 6
#: A clause confirms by this share of the shorter side's n-grams, and by so many of them; a name only whole.
MIN_SHARED, LEAST_GRAMS = 0.6, 8
#: N-grams in this share of the sampled paragraphs are no features.
COMMON = 0.01
#: Weight of the L1 term, and rows in which a feature stands at least.
L1, LEAST_ROWS = 0.0005, 2
TEMPERATURES = (0.4, 0.5, 0.6, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0)
#: Paragraphs with one of these are no sample of class ``none``.
CUES = r"licen[sc]|lizen[sz]|copyright|permission|warrant|redistribut|rights? reserved|rechte vorbehalten|droits r|derechos reservados|\bcc by\b|\bcc0\b|\bl?a?gpl\b|\bgnu\b|creative commons|spdx|apache|mozilla"
WORD = r"[\p{L}\p{N}]"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), body of each line of every text that has a letter or digit."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "body"))
    return lines.where(F.col("body").rlike(WORD))


def tokens(body: Column) -> Column:
    return F.filter(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def _constant(value, kind: str) -> Column:
    """A nested constant as one literal once the plan is optimised, however many values it has."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _strings(values) -> Column:
    return _constant(list(values), "array<string>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; a plain reuse of the column would repeat it at each mention."""
    return F.transform(F.array(value), body)[0]


@dataclass
class Model:
    """Class weights of n-grams, intercepts, temperature and the bound of families; all literals of the plan."""

    weights: dict[str, list[float]]
    intercept: list[float]
    temperature: float = 1.0
    bound: float = 0.5
    #: In how many sampled paragraphs of class ``none`` an n-gram stands.
    frequency: dict[str, int] = field(default_factory=dict)

    def triggers(self) -> list[str]:
        """The words of which a paragraph has at least one if ``none`` is not its likeliest class.

        The n-grams that are most frequent in the sample are no triggers as long as all of those together could
        not make another class likelier; a trigger pair is known by its rarer word.
        """
        classes = range(1, len(CLASSES))
        room = [self.intercept[0] - self.intercept[c] for c in classes]
        often = lambda g: -self.frequency.get(g, 0)
        out = []
        for gram, w in sorted(self.weights.items(), key=lambda x: (often(x[0]), max(x[1][c] - x[1][0] for c in classes), x[0])):
            gain = [max(0.0, w[c] - w[0]) for c in classes]
            if all(r - g > 0 for r, g in zip(room, gain, strict=True)):
                room = [r - g for r, g in zip(room, gain, strict=True)]
            else:
                out.append(gram)
        words = {g for g in out if " " not in g}
        return sorted(words | {max(g.split(" "), key=lambda w: (often(w), w)) for g in out if " " in g and not words & set(g.split(" "))})

    def touches(self, body: Column) -> Column:
        """Whether a text has a trigger word; true for all texts if ``none`` does not win without one."""
        if any(self.intercept[0] <= x for x in self.intercept[1:]):
            return F.lit(True)
        words = self.triggers()
        return F.lower(body).rlike(f"(?<!{WORD})(?:{'|'.join(map(re.escape, words))})(?!{WORD})") if words else F.lit(False)

    def logits(self, found: Column) -> Column:
        zero = _constant(self.intercept, "array<double>")
        if not self.weights:
            return zero
        table = _constant(dict(sorted(self.weights.items())), "map<string,array<double>>")
        known = F.array_intersect(found, _strings(sorted(self.weights)))
        return F.aggregate(known, zero, lambda s, g: F.zip_with(s, F.element_at(table, g), lambda a, b: a + b))

    def probabilities(self, found: Column) -> Column:
        """array<double> by CLASSES, calibrated."""
        return softmax(_cooled(self.logits(found), self.temperature))


def _cooled(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda x: x / temperature)


def softmax(logits: Column) -> Column:
    raised = _let(logits, lambda v: _let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return _let(raised, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total)))


def best(probabilities: Column) -> Column:
    """struct(p, family): the likelier of the families, unknown and none left out."""
    each = lambda v: [F.struct(v[i].alias("p"), F.lit(i).alias("at"), F.lit(c).alias("family")) for i, c in enumerate(CLASSES) if i >= 2]
    return _let(probabilities, lambda v: F.array_max(F.array(*each(v))))


def wrapped(text: str) -> list[str]:
    """The lines that a clause may be broken into, from every LINE_STEP-th word on."""
    words = text.split()
    return [" ".join(words[k : k + LINE_WORDS]) for k in range(0, max(1, len(words) - LINE_STEP), LINE_STEP)]


def written_rows() -> list[tuple[str, float, int]]:
    """(body, label, fold) by the rule above; fold 2 is held out."""
    rows = [(w.format(name), float(CLASSES.index(c)), k % 3) for c, (names, _) in FAMILIES.items() for name in names for k, w in enumerate(WORDINGS)]
    rows += [(text, float(CLASSES.index(c)), 0) for c, (_, clauses) in FAMILIES.items() for text in clauses for _ in range(REPEATS)]
    rows += [(line, float(CLASSES.index(c)), k % 3) for c, (_, clauses) in FAMILIES.items() for text in clauses for k, line in enumerate(wrapped(text)) for _ in range(2)]
    rows += [(text, float(label), k % 3) for label, texts in ((1, UNKNOWN), (0, OTHER_SENSE)) for k, text in enumerate(texts) for _ in range(REPEATS)]
    return rows


def training_rows(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """body, label, fold: the written rows, and at most ``negatives`` paragraphs without a licence cue."""
    written = _constant([{"body": t, "label": c, "fold": f} for t, c, f in written_rows()], "array<struct<body:string,label:double,fold:int>>")
    ours = docs.sparkSession.range(1).select(F.explode(written).alias("r")).select("r.*")
    # Documents first, by a hash of their id: their texts are all that is looked at.
    some = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(negatives)
    clean = paragraphs(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi")).where(~F.lower("body").rlike(CUES)).select("body")
    sampled = clean.orderBy(F.xxhash64("body"), "body").limit(negatives).select("body", F.lit(0.0).alias("label"), F.pmod(F.xxhash64("body", F.lit(1)), F.lit(3)).cast("int").alias("fold"))
    return ours.unionByName(sampled)


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray, list[float]]:
    """Features, weights (a row a class, a column a feature) and intercepts over ``rows`` of label, grams.

    A feature of rows of ``none`` only has a weight of zero at the optimum if the probability that those rows leave to other
    classes sums to no more than the L1 term. Those features are left out, and taken in where the fit shows that sum to be larger.
    """
    each = rows.select("label", F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"), F.max("label").alias("top"))
    names = [r["g"] for r in each.where((F.col("n") >= LEAST_ROWS) & (F.col("top") > 0)).orderBy(F.desc("n"), "g").collect()]
    regression = LogisticRegression(family="multinomial", regParam=L1, elasticNetParam=1.0, maxIter=60, standardization=False)
    bound = L1 * rows.count()
    while True:
        vector = CountVectorizerModel.from_vocabulary(names, inputCol="grams", outputCol="features", binary=True)
        ready = vector.transform(rows)
        fitted = regression.fit(ready.select("features", "label"))
        left = fitted.transform(ready).select("label", (1 - vector_to_array("probability")[0]).alias("left"), F.explode("grams").alias("g"))
        pulls = left.groupBy("g").agg(F.count("*").alias("n"), F.max("label").alias("top"), F.sum("left").alias("pull"))
        known = set(names)
        more = [r["g"] for r in pulls.where((F.col("n") >= LEAST_ROWS) & (F.col("top") == 0) & (F.col("pull") > bound)).select("g").orderBy("g").collect() if r["g"] not in known]
        if not more:
            return names, fitted.coefficientMatrix.toArray(), [float(x) for x in fitted.interceptVector.toArray()]
        names += more


def train(docs: DataFrame, *, negatives: int = NEGATIVES) -> Model:
    # Some thousand rows at most, as a table: plans over them then hold no constants of theirs.
    written = materialise(training_rows(docs, negatives).withColumn("grams", grams(tokens(F.col("body")))).coalesce(1), "licences")
    plain = written.where("label = 0")
    sampled = plain.where(~F.col("body").isin(*OTHER_SENSE))
    common = sampled.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON * max(100, sampled.count()))
    often = _strings(sorted(r["g"] for r in common.select("g").collect()))
    # Pairs of two common words neither: a feature then has a word that few paragraphs have.
    rare = lambda g: ~F.array_contains(often, g) & ~F.forall(F.split(g, " "), lambda w: F.array_contains(often, w))
    rows = written.withColumn("grams", F.filter("grams", rare)).cache()
    held = rows.where("fold = 2")
    names, matrix, intercept = fit(rows.where("fold < 2"))
    weights = {g: [float(x) for x in matrix[:, j]] for j, g in enumerate(names) if any(abs(x) > 1e-9 for x in matrix[:, j])}
    known = sorted({w for g in weights for w in (g, *g.split(" "))})
    seen = plain.select(F.explode("grams").alias("g")).where(F.array_contains(_strings(known), F.col("g"))).groupBy("g").agg(F.count("*").alias("n"))
    model = Model(weights, intercept, frequency={r["g"]: r["n"] for r in seen.collect()})
    logits = held.select("label", model.logits(F.col("grams")).alias("v"))
    loss = [F.sum(-F.log(F.greatest(F.element_at(softmax(_cooled(F.col("v"), t)), F.col("label").cast("int") + 1), F.lit(1e-12)))).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]
    losses = logits.agg(*loss).first()
    if losses[0] is not None:
        model.temperature = min(zip(losses, TEMPERATURES, strict=True))[1]
    # The family is worked out once; as a column of its own it would be repeated in each branch of the templates.
    confirmed = _let(best(model.probabilities(F.col("grams"))), lambda b: F.when(shared_with_template(F.col("grams"), b["family"]) >= MIN_SHARED, b["p"]))
    highest = held.where("label < 2").agg(F.max(confirmed)).first()[0]
    rows.unpersist()
    drop_tables(written)
    model.bound = max(0.5, float(highest or 0.0))
    return model


def _grams_of(text: str) -> list[str]:
    """``grams`` of a constant."""
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    return list(dict.fromkeys([*words, *map(" ".join, zip(words, words[1:], strict=False))]))


def shared_with_template(found: Column, family: Column) -> Column:
    """How far a paragraph's n-grams bear a family out: 1 if a name of it stands there whole, a name of one word beside a word of
    SAYING; of a clause the share of the shorter side's n-grams that both have, if these are LEAST_GRAMS or more."""
    says = F.arrays_overlap(found, _strings(SAYING))
    out = F.lit(0.0)
    for c, (names, clauses) in FAMILIES.items():
        own = [(g := _grams_of(t), F.size(F.array_intersect(found, _strings(g))) == len(g)) for t in names]
        named = [F.when(whole & (F.lit(len(g) > 1) | says), 1.0).otherwise(0.0) for g, whole in own]
        shares = []
        for t in clauses:
            g = _grams_of(t)
            shorter = F.least(F.size(found), F.lit(len(g)))
            shares.append(_let(F.size(F.array_intersect(found, _strings(g))), lambda n: F.when(n >= LEAST_GRAMS, n / shorter).otherwise(0.0)))  # noqa: B023
        out = F.when(family == c, F.greatest(F.lit(0.0), *named, *shares)).otherwise(out)
    return out


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph, license, probability, shared of each paragraph whose likeliest class is not ``none``."""
    some = docs.select("doc_id", "text").where(model.touches(F.col("text")))
    words = paragraphs(some).where(model.touches(F.col("body"))).select("doc_id", "paragraph", tokens(F.col("body")).alias("words"))

    def judged(found: Column) -> Column:
        """struct(none, top, best, shared) of a paragraph's n-grams, each worked out once."""
        return _let(
            model.probabilities(found),
            lambda p: _let(best(p), lambda b: F.struct(p[0].alias("none"), F.array_max(F.slice(p, 2, len(CLASSES))).alias("top"), b.alias("best"), shared_with_template(found, b["family"]).alias("shared"))),
        )

    scored = words.withColumn("j", _let(grams(F.col("words")), judged)).where(F.col("j.none") < F.col("j.top"))
    sure = (F.col("j.best.p") > model.bound) & (F.col("j.shared") >= MIN_SHARED)
    return scored.select(
        "doc_id", "paragraph", F.when(sure, F.col("j.best.family")).otherwise("unknown").alias("license"), F.col("j.best.p").alias("probability"), F.col("j.shared").alias("shared")
    )


def licenses(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))
