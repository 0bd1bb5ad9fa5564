"""Licence scanning by a trained paragraph classifier, in DataFrame functions only.

Paragraphs are the lines of a text, and the sentences that run over several lines, joined: a sentence
ends at ``.``, ``!`` or ``?`` before white space, and at a line without letters or digits, so marks of
comments before its lines do no harm. Every paragraph is classified: its distinct words and word
pairs are met with the weights of a sparse logistic regression over licence families and an
``unknown`` class. Its scores, at the temperature that made training statements kept from the fit best
calibrated, give the family; a paragraph whose best family has less than ``CERTAIN`` is unknown, and one
without any word that bears weight is, by the model, too. A prediction counts only if the paragraph holds at
least ``AGREES`` of the word pairs of one of that family's templates.

The model is trained on the driver from the templates below and made-up variations of them: a fixed
number of short sentences, whatever the corpus. Grams of common words alone are no features, and a
penalty on absolute weights leaves others without weight, so few rows of a text meet the table. Weights and templates are a few thousand rows
at most, a number fixed by the templates, which is why they may be broadcast.

Texts are read once; what goes on from there are paragraphs that hold a word with weight.

Defined cases: a null or empty text has no paragraphs. Rows that repeat a doc_id, or have none, are
scanned on their own. A paragraph that occurs several times in a text counts each time. Of families with
equal scores the first by name is taken. A sentence over several lines counts only if it is confirmed
for a family that no line of the text is confirmed for; the lines in it are counted as lines all the
same. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.session import cut

CERTAIN, AGREES = 0.5, 0.6
UNKNOWN = "unknown"

#: Short statements of each licence family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is distributed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This file is licensed to you under the Apache License, Version 2.0", "Released under the Apache 2.0 license.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL v3.", "This program is free software under the terms of the GNU General Public License, either version 3 of the License, or any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPL v2.", "This program is free software under the terms of the GNU General Public License, either version 2 of the License, or any later version", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "Licensed under the LGPL.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL v3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Released under the BSD License.", "Licensed under the 3-clause BSD license.", "Licensed under the 2-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright; dedicated to the public domain under CC0.", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License.", "SPDX-License-Identifier: BSL-1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License.", "SPDX-License-Identifier: EPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib license.", "SPDX-License-Identifier: Zlib"],
    "Proprietary": ["All rights reserved.", "Copyright, all rights reserved. Unauthorized copying is prohibited.", "This document is proprietary and confidential."],
}
#: Sentences that hold the same words but state no licence.
OTHERS = [
    "The driver showed his license to the officer.", "She renewed her fishing license last week.", "A poetic license was taken with the story.",
    "The apache helicopter landed near the river.", "He studied at MIT for four years.", "The version of the story was told in public.",
    "The general public was free to attend.", "Copyright law is taught in the second year.", "The licence plate of the car was missing.",
    "They work under the bridge.", "The warranty of the machine has expired.", "Creative people share common spaces.",
    "The licensed plumber fixed the sink.", "All seats are reserved for members.", "Public domain names are sold here.", "The club license costs two pounds.",
]
#: Common words, which say nothing about licences.
COMMON = ["the", "of", "and", "to", "in", "a", "is", "it", "for", "not", "no", "as", "be", "by", "from", "are", "this", "that", "or", "on", "with", "at", "his", "they", "were", "was", "which", "an", "any", "all", "into", "only", "use", "under", "may", "you", "can", "if", "free", "later", "available", "event", "0", "1", "2", "3", "4"]
_BETWEEN = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams_of(text: str) -> set[str]:
    words = words_of(text)
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def _variations(seed: int) -> list[tuple[str, int]]:
    """Made-up statements: templates with words lost, added before or behind, and other sentences."""
    draw = random.Random(seed)
    families = list(TEMPLATES)
    filler = [w for s in OTHERS for w in words_of(s)]
    noise = lambda n: " ".join("".join(draw.choice("aeiourstnlh") for _ in range(draw.randint(2, 9))) for _ in range(n))
    out = []
    for label, family in enumerate(families):
        for template in TEMPLATES[family]:
            for _ in range(12):
                words = words_of(template)
                if len(words) > 8 and draw.random() < 0.5:
                    words.pop(draw.randrange(len(words)))
                before, behind = (noise(draw.choice([0, 0, 2, 8])) for _ in range(2))
                out.append((f"{before} {' '.join(words)} {behind}", label))
    for sentence in OTHERS:
        for _ in range(8):
            out.append((f"{noise(draw.choice([0, 3]))} {sentence} {noise(draw.choice([0, 3, 12]))}", len(families)))
    for _ in range(400):
        mixed = [draw.choice(filler) for _ in range(draw.randint(1, 6))]
        out.append((f"{noise(draw.randint(1, 12))} {' '.join(mixed)} {noise(draw.randint(0, 6))}", len(families)))
    for _ in range(800):
        out.append((" ".join(draw.choice([draw.choice(COMMON), noise(1)]) for _ in range(draw.randint(2, 30))), len(families)))
    draw.shuffle(out)
    return out


@lru_cache(maxsize=1)
def train(rounds: int = 600, rate: float = 2.0, sparse: float = 6e-4) -> Model:
    """Multinomial logistic regression with an absolute penalty, by proximal gradient steps, then its temperature. Grams of common words alone are no features."""
    rows = _variations(9)
    known = {g for family in TEMPLATES.values() for t in family for g in grams_of(t)} | {g for t in OTHERS for g in grams_of(t)}
    place = {g: i for i, g in enumerate(sorted(g for g in known if not set(g.split()) <= set(COMMON)))}
    x = np.zeros((len(rows), len(place)))
    for i, (text, _) in enumerate(rows):
        for g in grams_of(text):
            if g in place:
                x[i, place[g]] = 1.0
    y = np.eye(len(TEMPLATES) + 1)[[label for _, label in rows]]
    kept = np.arange(len(rows)) % 4 == 0
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])

    def chances(scores: np.ndarray) -> np.ndarray:
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    xt, yt = x[~kept], y[~kept]
    for _ in range(rounds):
        off = (chances(xt @ w + b) - yt) / len(xt)
        w -= rate * (xt.T @ off)
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * sparse)
        b -= rate * off.sum(axis=0)
    scores = x[kept] @ w + b
    heat = min(np.arange(0.1, 4.01, 0.1), key=lambda t: -np.log(np.maximum(1e-12, (chances(scores / t) * y[kept]).sum(axis=1))).mean())
    return Model([*TEMPLATES, UNKNOWN], {g: (w[i] / heat).tolist() for g, i in place.items() if w[i].any()}, (b / heat).tolist())


def _weights(spark: SparkSession, model: Model) -> DataFrame:
    """Weights of grams; the empty gram stands for a text itself."""
    return spark.createDataFrame([("", [0.0] * len(model.families)), *sorted(model.weights.items())], "gram string, weights array<double>")


def template_pairs(text: str) -> list[str]:
    words = words_of(text)
    return sorted(set(map(" ".join, zip(words, words[1:], strict=False))) or set(words))


def _templates(spark: SparkSession) -> DataFrame:
    rows = []
    for family, texts in TEMPLATES.items():
        for n, text in enumerate(texts):
            pairs = template_pairs(text)
            rows += [(family, n, g, len(pairs)) for g in pairs]
    return spark.createDataFrame(rows, "family string, template int, gram string, pairs int")


def paragraphs_of(text: Column) -> Column:
    """Array of (line, paragraph): the lines of a text that hold a letter or digit, and its sentences of several lines."""
    solid = lambda s: s.rlike("[A-Za-z0-9]")
    lines = F.filter(F.split(text, "\n"), solid)
    blocks = F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+")
    sentences = F.flatten(F.transform(F.filter(blocks, lambda b: F.contains(b, F.lit("\n"))), lambda b: F.split(b, r"(?<=[.!?])\s+")))
    several = F.filter(sentences, lambda s: F.contains(F.trim(s), F.lit("\n")) & solid(s))
    named = lambda found, line: F.transform(found, lambda p: F.struct(F.lit(line).alias("line"), p.alias("paragraph")))
    return F.concat(named(lines, True), named(several, False))


def _grams(paragraph: Column) -> Column:
    """The distinct words and word pairs of a paragraph."""
    lower = F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, _BETWEEN), lambda w: w != "")
    following = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def judge(docs: DataFrame) -> DataFrame:
    """(row, doc_id, paragraphs, at, line, paragraph, family, chance) of the paragraphs that hold a gram with weight; one
    row with neither number nor paragraph for every text."""
    spark = docs.sparkSession
    model = train()
    n = len(model.families)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), paragraphs_of(text).alias("found"))
    own = F.struct(F.lit(None).cast("boolean").alias("line"), F.lit(None).cast("string").alias("paragraph"))
    rows = rows.select("row", "doc_id", F.size("found").alias("paragraphs"), F.posexplode(F.concat(F.array(own), "found")).alias("at", "p"))
    grams = rows.select("row", "doc_id", "paragraphs", "at", "p.line", "p.paragraph", F.explode(F.when(F.col("at") == 0, F.array(F.lit(""))).otherwise(_grams(F.col("p.paragraph")))).alias("gram"))
    weighed = grams.join(F.broadcast(_weights(spark, model)), "gram")
    first = {c: F.first(c).alias(c) for c in ("doc_id", "paragraphs", "line", "paragraph")}
    sums = weighed.groupBy("row", "at").agg(*first.values(), *[F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(n)])
    scores = sums.select("row", "at", *first, F.array(*[F.col(f"s{i}") + F.lit(model.bias[i]) for i in range(n)]).alias("scores"))
    shifted = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
    chance = 1 / F.aggregate(shifted, F.lit(0.0), lambda a, s: a + s)
    guess = F.element_at(F.array(*map(F.lit, model.families)), F.array_position("scores", F.array_max("scores")).cast("int"))
    judged = scores.select("row", "at", *first, guess.alias("guess"), chance.alias("chance"))
    sure = (F.col("guess") != UNKNOWN) & (F.col("chance") >= CERTAIN) & (F.col("at") > 0)
    family = F.when(sure, F.col("guess")).otherwise(UNKNOWN)
    return judged.select("row", "at", "doc_id", "paragraphs", "line", F.when(sure, F.col("paragraph")).alias("paragraph"), family.alias("family"), "chance")


def confirm(judged: DataFrame) -> DataFrame:
    """The same with ``confirmed``: whether the paragraph holds enough of a template of its family."""
    spark = judged.sparkSession
    named = judged.where("paragraph IS NOT NULL").select("row", "at", "family", F.explode(_grams(F.col("paragraph"))).alias("gram"))
    shared = (
        named.join(F.broadcast(_templates(spark)), ["family", "gram"]).groupBy("row", "at", "template")
        .agg((F.count("*") / F.max("pairs")).alias("share")).groupBy("row", "at").agg(F.max("share").alias("share"))
    )
    return judged.join(shared, ["row", "at"], "left").withColumn("confirmed", F.coalesce(F.col("share") >= AGREES, F.lit(False)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, licenses (families confirmed, sorted), and how many of its
    paragraphs there are, are confirmed, predicted but not confirmed, and unknown."""
    judged = confirm(cut(judge(docs)))
    by_lines = F.collect_set(F.when(F.col("line") & F.col("confirmed"), F.col("family"))).over(Window.partitionBy("row"))
    several = F.col("confirmed") & ~F.col("line") & ~F.array_contains("by_lines", F.col("family"))
    sure = (F.col("family") != UNKNOWN) & F.col("line")
    counted = judged.withColumn("by_lines", by_lines).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licenses"),
        F.first("paragraphs").alias("n_paragraphs"),
        F.count_if((sure & F.col("confirmed")) | several).alias("n_confirmed"),
        F.count_if(sure & ~F.col("confirmed")).alias("n_unconfirmed"),
    )
    known = F.col("n_confirmed") + F.col("n_unconfirmed")
    numbers = {"n_paragraphs": F.col("n_paragraphs"), "n_confirmed": F.col("n_confirmed"), "n_unconfirmed": F.col("n_unconfirmed"), "n_unknown": F.col("n_paragraphs") - known}
    return counted.select("doc_id", "licenses", *[c.cast("long").alias(name) for name, c in numbers.items()])
