"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed against templates."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_texts

UNKNOWN = "unknown"
#: Bound of the corpus paragraphs that train and calibrate the unknown class.
SAMPLE = 2_000
CONFIRMED = 0.6
TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

#: Notices and leading clauses of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher.",
    ),
}

#: Sentences that speak of licences without granting one.
NEAR_MISSES = (
    "She renewed her driving license at the office in the city.",
    "The version of the story that he published was free of errors.",
    "General public interest in the work grew after the first release.",
    "The license of the restaurant was revoked by the council last year.",
    "They released the album under a new name and it was a success.",
    "A copy of the book may be obtained at the library for any purpose.",
    "The foundation is free to modify the terms of the agreement.",
    "Permission to enter the building is granted to members only.",
)
STOP = frozenset("a an and any are as at be by for from in is it of on or that the this to with".split())


def tokens(paragraph: str) -> list[str]:
    return TOKEN.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    """Words and pairs of words; neither of stop words alone."""
    return [w for w in words if w not in STOP] + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in STOP or b not in STOP]


def pairs(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


def similarity(words: list[str], family: str) -> float:
    """The best share of word pairs in common with a template of the family, of the smaller of both sets."""
    mine = pairs(words)
    best = 0.0
    for template in TEMPLATES.get(family, ()):
        theirs = pairs(tokens(template))
        if len(mine) >= 2 or len(theirs) < 2:
            best = max(best, len(mine & theirs) / max(1, min(len(mine), len(theirs))))
    return best


class Model:
    """Weights by n-gram and class; n-grams outside the training notices count nothing."""

    def __init__(self, classes: list[str], vocabulary: dict[str, int], weights: np.ndarray, intercept: np.ndarray, temperature: float = 1.0):
        self.classes, self.vocabulary, self.weights, self.intercept, self.temperature = classes, vocabulary, weights, intercept, temperature
        self.heads = {g.split(" ")[0] for g in vocabulary if " " in g}

    def logits(self, words: list[str]) -> np.ndarray | None:
        """None without any pair of the vocabulary: such a paragraph is unknown."""
        if self.heads.isdisjoint(words):
            return None
        on = {i for g in grams(words) if (i := self.vocabulary.get(g)) is not None}
        if not any(f"{a} {b}" in self.vocabulary for a, b in zip(words, words[1:], strict=False)):
            return None
        return self.weights[:, sorted(on)].sum(axis=1) + self.intercept

    def noticed(self, words: list[str]) -> bool:
        """Whether a line reads like part of a notice: three in ten of its word pairs, or the only word, are known."""
        if self.heads.isdisjoint(words):
            return len(words) == 1 and words[0] in self.vocabulary
        known = sum(f"{a} {b}" in self.vocabulary for a, b in zip(words, words[1:], strict=False))
        return known >= 0.3 * (len(words) - 1) and known > 0

    def predict(self, words: list[str]) -> tuple[str, float]:
        z = self.logits(words)
        if z is None:
            return UNKNOWN, 1.0
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        best = int(p.argmax())
        return (self.classes[best], float(p[best])) if p[best] > 0.5 else (UNKNOWN, float(p[self.classes.index(UNKNOWN)]))


def examples(background: list[str], seed: int = 7, copies: int = 30) -> list[tuple[str, list[str]]]:
    """Training paragraphs: templates with words lost, cut short or set among corpus words; corpus paragraphs as unknown."""
    rng, out = random.Random(seed), []
    filler = [w for p in background[:200] for w in tokens(p)] or ["lorem"]
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = tokens(notice)
            out += [(family, words)] * 4
            for _ in range(copies):
                w = [x for x in words if rng.random() > 0.08]
                if len(w) > 12:
                    start = rng.randrange(len(w) - 10)
                    w = w[start : start + rng.randrange(10, len(w) + 1)]
                pad = [rng.choice(filler) for _ in range(rng.randrange(0, 6))]
                out.append((family, pad + w if rng.random() < 0.5 else w + pad))
    known = [(UNKNOWN, tokens(p)) for p in background if all(similarity(tokens(p), f) < 0.5 for f in TEMPLATES)]
    out += known + [(UNKNOWN, tokens(p)) for p in NEAR_MISSES for _ in range(copies)]
    for family, notices in TEMPLATES.items():  # single notice words out of context
        words = [w for n in notices for w in tokens(n)]
        out += [(UNKNOWN, rng.sample(filler, min(8, len(filler))) + rng.sample(words, 2)) for _ in range(copies // 2)]
    rng.shuffle(out)
    return out


def train(spark: SparkSession, background: list[str]) -> Model:
    """Multinomial logistic regression over n-grams of the notices; its temperature is fitted on a held-out fifth."""
    data = examples(background)
    vocabulary = {g: i for i, g in enumerate(sorted({g for f, w in data if f != UNKNOWN for g in grams(w)} & {g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))}))}
    classes = [*TEMPLATES, UNKNOWN]
    cut = len(data) * 4 // 5
    rows = []
    for family, words in data[:cut]:
        on = sorted({vocabulary[g] for g in grams(words) if g in vocabulary})
        rows.append((float(classes.index(family)), Vectors.sparse(len(vocabulary), on, [1.0] * len(on))))
    frame = spark.createDataFrame(rows, ["label", "features"]).repartition(4)
    fitted = LogisticRegression(family="multinomial", regParam=3e-4, maxIter=60, standardization=False).fit(frame)
    model = Model(classes, vocabulary, fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray())
    held = [(classes.index(f), z) for f, w in data[cut:] if (z := model.logits(w)) is not None]

    def loss(t: float) -> float:
        return -sum((z[y] - z.max()) / t - np.log(np.exp((z - z.max()) / t).sum()) for y, z in held)

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss) if held else 1.0
    return model


FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("paragraph", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType())]
)


def paragraphs(text: str, model: Model) -> Iterator[tuple[int, list[str]]]:
    """(first line, words): lines that read like a notice and follow each other without a blank line are one paragraph, as wrapped notices are; every other line is one of its own. Comment marks are no words."""
    held: tuple[int, list[str]] | None = None
    for k, line in enumerate(text.split("\n")):
        words = tokens(line)
        if held and words and model.noticed(words):
            held[1].extend(words)
            continue
        if held:
            yield held
            held = None
        if words and model.noticed(words):
            held = k, words
        elif words:
            yield k, words
    if held:
        yield held


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each paragraph of docs (doc_id, text) that the classifier gives to a licence family.

    Columns: doc_id, paragraph (its first line, from 0, blank lines counted), family, probability (calibrated),
    similarity to the family's nearest template, and confirmed (similarity of CONFIRMED or more).
    Paragraphs of the unknown class, and null and empty texts, give no row; repeated rows are scanned
    each, and null ids kept; other columns are ignored. The unknown class is trained on at most `sample`
    lines (of 1 to 2,000 characters; a line of a text drawn by hash), the smallest by hash. No shuffle but for that sample.
    """
    spark = docs.sparkSession
    share = min(1.0, 2 * sample / max(1, docs.count()))  # else each task would send `sample` rows to be merged
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("paragraphs")), F.lit(1 << 30))
    texts = docs.where("text is not null").select("doc_id", drawn.alias("d"), "text").where(F.col("d") < int(share * (1 << 30)))
    lines = texts.select("doc_id", "d", F.filter(F.split("text", "\n"), lambda x: F.length(x).between(1, 2000)).alias("ls")).where(F.size("ls") > 0)
    line = lines.select("doc_id", "d", F.element_at("ls", (F.pmod(F.xxhash64("doc_id", F.lit("line")), F.size("ls")) + 1).cast("int")).alias("p"))
    background = [r["p"] for r in line.orderBy("d", "doc_id", "p").limit(sample).collect()]
    model = spark.sparkContext.broadcast(train(spark, background))

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in part:
            for k, words in paragraphs((text or b"").decode("utf-8", "replace"), model.value):
                family, p = model.value.predict(words)
                if family != UNKNOWN:
                    near = similarity(words, family)
                    yield doc_id, k, family, round(p, 6), round(near, 6), near >= CONFIRMED

    return map_texts(docs, ["doc_id"], rows, FOUND)
