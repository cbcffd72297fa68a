"""Licence scans: a paragraph classifier over sparse word n-grams, in DataFrame functions alone.

A paragraph is a run of neighbouring non-blank lines, so a notice that is wrapped over lines is
read as one; comment signs are no part of words. It is judged in windows of ``WINDOW`` words, each
half over the one before. Every window is looked at. Features are which n-grams (up to three words)
of the templates a window holds; a single word counts only beside an *anchor*, a word that notices
and licences live by, since alone it may be any prose (``mit`` is German for with). A window
without an anchor and without n-grams of several words therefore holds nothing, which is ``none``,
and every n-gram of three words holds one of two, so pairs of words tell which windows to
judge; a licence of no known family needs an anchor, as nothing else names a licence there (``all
rights reserved`` names none). A multinomial logistic regression tells the family, ``unknown`` (a
licence, but of no known family) or ``none``; it is fitted in numpy, on the driver, on
variations of the templates, of made-up licences and of sentences that only speak of licences, all
of a size that doesn't depend on the corpus. Its probabilities are calibrated by a temperature on
variations that it was not fitted on. A family counts as confirmed if the window also holds
enough of one of its templates; if not, or if the probability is below ``LEAST``, the paragraph is
of an unknown licence.

N-grams are looked up by hash in constant arrays, within the row; nothing is joined, and only the
verdicts on judged windows are shuffled, to choose among the windows of a paragraph.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed sentences of public licences and of their usual notices.
TEXTS: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the "
        "LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "ISC": [
        "ISC License", "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GPL v3.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "See the GNU Lesser General Public License for more details.", "Licensed under the LGPL v3.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the GNU Affero General Public License, version 3.",
        "See the GNU Affero General Public License for more details.", "Licensed under the AGPL v3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
        "Released under the Mozilla Public License, version 2.0.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
        "Released under the Eclipse Public License, version 1.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
        "For more information, please refer to the Unlicense",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
        "Released under CC0 1.0.", "creativecommons.org/publicdomain/zero/1.0",
    ],
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC": "Attribution-NonCommercial",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_TAGS = {"MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
         "ISC": ["ISC"], "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
         "LGPL": ["LGPL-2.1-only", "LGPL-3.0-or-later"], "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
         "MPL-2.0": ["MPL-2.0"], "EPL": ["EPL-1.0", "EPL-2.0"], "Unlicense": ["Unlicense"],
         "CC0": ["CC0-1.0"]}


def _templates() -> dict[str, list[str]]:
    out = {family: list(texts) for family, texts in TEXTS.items()}
    for code, name in _CC.items():
        out[f"CC-{code}"] = [
            f"Licensed under CC {code} 4.0.", f"This text is available under CC {code} 3.0.",
            f"This work is licensed under a Creative Commons {name} 4.0 International License.",
            f"creativecommons.org/licenses/{code.lower()}/4.0"]
    tags = _TAGS | {f"CC-{code}": [f"CC-{code}-4.0"] for code in _CC}
    for family, names in tags.items():
        out[family] += [f"SPDX-License-Identifier: {tag}" for tag in names]
    return out


TEMPLATES = _templates()
#: Frames of licences that nobody knows, and names for them.
_FRAMES = ["Released under the {} License.", "Licensed under the terms of the {} license.",
           "This file is distributed under the {} license of its own.", "Licensed under {} 1.0.",
           "This work is licensed under the {} Public License, version 1.0.",
           "Released under the {} Public License, version 1.0.", "Available under the {} Public License.",
           "See the file LICENSE for the {} license.", "Use is subject to the {} license agreement.",
           "SPDX-License-Identifier: LicenseRef-{}", "Copyright {}. All rights reserved."]
_NAMES = ["Acme", "Nimbus", "Foo Bar", "project", "Quux Corporation", "custom", "vendor", "Zed"]
GENERIC = [frame.format(name) for frame in _FRAMES for name in _NAMES]
#: Sentences that hold anchors and are no licence.
PLAIN = [
    "She got her driver's license last year.", "The license plate was covered in mud.",
    "He lost his licence after the accident.", "The team obtained a license to build in the valley.",
    "Fishing without a licence is forbidden here.", "The copyright lawyer spoke for two hours.",
    "Copyright law is hard to read.", "The warranty on the car ran out in May.",
    "A warranty card lies in the box.", "The redistribution of land took ten years.",
    "They redistribute the food to the poor.", "The gnu grazed beside the zebra.",
    "Apache helicopters flew over the town.", "The Apache people lived in the south.",
    "Creative people meet in the commons.", "The House of Commons met on Monday.",
    "Mozilla opened an office in the city.", "Permission to enter was not given.",
    "You need permission from the owner to camp here.", "The bar has no licence to sell wine.",
    "The public library and the general store are open.", "The software is free and the source is open.",
    "License fees rose by two percent.", "The foundation licensed its songs to the studio.",
    "A copy of the book was granted to the school free of charge.",
    "My license expires in June.", "They asked to see her license at the door.",
    "A pilot renews a license every year.", "The shop lost its license in the spring.",
    "Without a license nobody may drive here.", "The doctor's license was withdrawn.",
]
#: Words beside which single words count.
ANCHORS = ("license", "licensed", "licence", "licenced", "licenses", "licences", "sublicense",
           "unlicense", "copyright", "warranty", "warranties", "merchantability", "redistribution",
           "redistributions", "redistribute", "permission", "spdx", "gnu", "gpl", "lgpl", "agpl",
           "mpl", "creativecommons", "commons", "cc", "cc0", "unencumbered", "epl", "noncommercial")
#: Words that tell nothing alone.
_COMMON = set("a all an and any are as at be by can for from if in is it its may no not of on or "
              "other shall that the this to under use was were which will with you your".split())
LONGEST = 3
WINDOW = 96
LEAST = 0.5
CONFIRMED = 0.5
NONE, UNKNOWN = "none", "unknown"
_SLOTS = 1 << 15


def _tokens(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def _ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i:i + n]) for n in range(1, LONGEST + 1)
            for i in range(len(words) - n + 1)}


def _features(text: str) -> set[str]:
    return {g for g in _ngrams(_tokens(text)) if not set(g.split()) <= _COMMON}


@dataclass
class Model:
    """Vocabulary, weights per n-gram and class (with the temperature in them), and templates."""

    vocabulary: list[str]
    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def templates(self) -> list[tuple[str, str, set[int]]]:
        """Family, name, and places of its n-grams in the vocabulary, for each template."""
        place = {g: i for i, g in enumerate(self.vocabulary)}
        return [(f, f"{f}-{i}", {place[g] for g in _features(t)})
                for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]


def _variations(text: str) -> list[str]:
    """The text, its parts, and the text with words left out or between other words."""
    words = text.split()
    out = [text, "Note: " + text, text + " More follows.", "It is said that " + text]
    out += [" ".join(words[:i] + words[i + 1:]) for i in range(0, len(words), 4)]
    if len(words) > 8:
        out += [" ".join(words[:-len(words) // 4]), " ".join(words[len(words) // 4:])]
    return out


@functools.lru_cache(maxsize=1)
def fit() -> Model:
    """The model; it depends on the fixed texts above alone."""
    classes = [NONE, UNKNOWN, *TEMPLATES]
    texts = [(t, UNKNOWN) for t in GENERIC] + [(t, NONE) for t in PLAIN]
    texts += [(t, f) for f, ts in TEMPLATES.items() for t in ts]
    vocabulary = sorted(set().union(*(_features(t) for t, _ in texts)))
    place = {g: i for i, g in enumerate(vocabulary)}
    rows = [(_features(v), c) for t, c in texts for v in _variations(t)] + [(set(), NONE)] * 20
    # A word of a licence alone is none.
    rows += [({g}, NONE) for g in vocabulary if " " not in g] * 2
    rows += [({a}, NONE) for a in ANCHORS if a in place] * 12
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for r, (grams, _) in enumerate(rows):
        x[r, [place[g] for g in grams if g in place]] = 1
    y = np.array([classes.index(c) for _, c in rows])
    weight = (1 / np.bincount(y, minlength=len(classes)))[y].astype(np.float32) / len(classes)
    held = np.arange(len(y)) % 5 == 4
    w = np.zeros((x.shape[1], len(classes)), np.float32)
    b = np.zeros(len(classes), np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    fitted, target = x[~held], y[~held]
    for _ in range(150):
        p = fitted @ w + b
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(target)), target] -= 1
        p *= weight[~held][:, None]
        speed_w = 0.9 * speed_w - 1.5 * (fitted.T @ p + 1e-4 * w)
        speed_b = 0.9 * speed_b - 1.5 * p.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    logits = (x[held] @ w + b).astype(float)

    def loss(t):
        z = logits * t
        z = z - z.max(axis=1, keepdims=True)
        return -(weight[held] * (z[np.arange(len(z)), y[held]]
                                 - np.log(np.exp(z).sum(axis=1)))).sum()
    scale = min(np.geomspace(0.5, 8, 40), key=loss)
    return Model(vocabulary, classes, np.round(w * scale, 4).astype(float),
                 np.round(b * scale, 4).astype(float))


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % _SLOTS


def _constant(values, kind: str) -> Column:
    """A constant array, from one literal."""
    return F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")


def _places(grams: Column, model: Model) -> Column:
    """Places in the vocabulary of those n-grams that are in it, by their hashes.

    A slot names the few n-grams that fall into it, so that any other n-gram is told apart.
    """
    slots: dict[int, list[int]] = {}
    for i, gram in enumerate(model.vocabulary):
        slots.setdefault(_slot(gram), []).append(i)
    deep = max(map(len, slots.values()))
    rounds = []
    for k in range(deep):
        table = ["-1"] * _SLOTS
        for slot, members in slots.items():
            if len(members) > k:
                table[slot] = str(members[k])
        rounds.append(_constant(table, "int"))
    words = _constant(model.vocabulary, "string")

    def find(gram):
        slot = (F.crc32(gram) % _SLOTS).cast("int")
        found = F.lit(-1)
        for table in reversed(rounds):
            at = F.get(table, slot)
            found = F.when((at >= 0) & (F.get(words, at) == gram), at).otherwise(found)
        return found
    return F.filter(F.transform(grams, find), lambda i: i >= 0)


def _pairs(words: Column, model: Model) -> Column:
    """For every word, whether it and the next are an n-gram of the vocabulary."""
    pairs = [g for g in model.vocabulary if g.count(" ") == 1]
    first = sorted({g.split()[0] for g in pairs})
    return F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a.isin(first)
                      & b.isNotNull() & F.concat(a, F.lit(" "), b).isin(pairs))


def _grams(words: Column) -> Column:
    """The distinct n-grams of an array of words."""
    def run(n):
        last = F.size(words) - (n - 1)
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                           lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(functools.reduce(F.concat, map(run, range(1, LONGEST + 1))))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """The licence paragraphs of ``docs`` (doc_id, text), one row per paragraph and family:
    ``doc_id, paragraph, family, probability, template, similarity, confirmed``.

    ``paragraph`` is the paragraph's place in the text, ``probability`` that of the most likely
    family, ``template`` the one of it whose n-grams the window holds most of (``similarity``, a
    share). ``family`` is ``unknown`` if the window looks like a licence of no known family; such
    a row is left out where the same paragraph names a known one. Of several windows of one
    family the likeliest counts. Null and empty texts have no paragraphs; a text of any length is
    read whole. Rows without doc_id and repeated rows are scanned like others. Other columns are
    ignored; an empty table gives no rows.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"))
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    paragraphs = texts.select("row", "doc_id", F.posexplode(F.split(
        "low", r"\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*")).alias("paragraph", "text"))
    tokens = F.split(F.trim(F.regexp_replace("text", "[^a-z0-9]+", " ")), " ")
    starts = F.sequence(F.lit(0), F.greatest(
        F.ceil((F.size("words") - WINDOW) / F.lit(WINDOW / 2)).cast("int"), F.lit(0)))
    anchors = F.array(*map(F.lit, ANCHORS))
    windows = F.filter(F.transform(starts, lambda i: F.struct(
        F.slice("words", i * (WINDOW // 2) + 1, WINDOW).alias("words"),
        F.array_contains(F.slice("pairs", i * (WINDOW // 2) + 1, WINDOW - 1), True).alias("paired"))),
        lambda w: w["paired"] | F.arrays_overlap(w["words"], anchors))
    several = _constant([int(" " in g) for g in model.vocabulary], "int")
    key = ["row", "doc_id", "paragraph"]
    judged = paragraphs.select(*key, tokens.alias("words")).withColumn(
        "pairs", _pairs(F.col("words"), model)).select(
        *key, F.explode(windows).alias("window")).select(
        *key, "window.words", F.arrays_overlap("window.words", anchors).alias("anchored")).select(
        *key, "anchored", _places(_grams(F.col("words")), model).alias("places")).select(
        *key, "anchored", F.when(F.col("anchored"), F.col("places")).otherwise(
            F.filter("places", lambda i: F.get(several, i) == 1)).alias("places"))

    def score(k: int) -> Column:
        weights = _constant(model.weights[:, k], "double")
        return F.aggregate("places", F.lit(float(model.bias[k])), lambda a, i: a + F.get(weights, i))

    scores = [score(k) for k in range(len(model.classes))]
    judged = judged.withColumns({f"s{k}": s for k, s in enumerate(scores)})
    scores = [F.col(f"s{k}") for k in range(len(model.classes))]
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(c).alias("family"))
                                 for s, c in zip(scores[2:], model.classes[2:])]))
    top = F.greatest(*scores)
    judged = judged.withColumns({"top": top, "best": best}).withColumn(
        "total", functools.reduce(lambda a, b: a + b, [F.exp(s - F.col("top")) for s in scores]))
    likes = F.array(*[F.struct(
        F.round(F.size(F.array_intersect("places", _constant(sorted(grams), "int"))) /
                F.lit(float(len(grams))), 6).alias("similarity"),
        F.lit(name).alias("template"), F.lit(family).alias("of"))
        for family, name, grams in model.templates()])
    judged = judged.select(
        *key, "anchored", "best", (F.exp(F.col("s0") - F.col("top")) / F.col("total")).alias("none"),
        F.round(F.exp(F.col("best.score") - F.col("top")) / F.col("total"), 6).alias("probability"),
        F.array_max(F.filter(likes, lambda x: x["of"] == F.col("best.family"))).alias("like"))
    confirmed = (F.col("probability") >= LEAST) & (F.col("like.similarity") >= CONFIRMED)
    verdict = F.struct("probability", F.col("like.similarity").alias("similarity"),
                       F.col("like.template").alias("template"))
    chosen = judged.groupBy(
        *key, F.when(confirmed, F.col("best.family")).otherwise(UNKNOWN).alias("family")).agg(
        F.max(F.when((F.col("none") < 0.5) & (F.col("anchored") | confirmed), verdict)).alias("verdict")).where("verdict is not null")
    known = F.max(F.col("family") != UNKNOWN).over(Window.partitionBy("row", "paragraph"))
    return chosen.withColumn("known", known).where(
        (F.col("family") != UNKNOWN) | ~F.col("known")).select(
        "doc_id", "paragraph", "family", "verdict.probability", "verdict.template",
        "verdict.similarity", (F.col("family") != UNKNOWN).alias("confirmed"))


def scan_one(text: str | None, model: Model) -> list[tuple]:
    """``scan`` of one text in plain Python, for tests: paragraph, family, probability, similarity."""
    place = {g: i for i, g in enumerate(model.vocabulary)}
    out = []
    paragraphs = re.split(r"\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*", (text or "").lower())
    for number, paragraph in enumerate(paragraphs):
        words, found = _tokens(paragraph), {}
        for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
            window = words[at:at + WINDOW]
            anchored = bool(set(window) & set(ANCHORS))
            held = {place[g] for g in _ngrams(window) if g in place and (anchored or " " in g)}
            z = model.bias + model.weights[sorted(held)].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            if p[0] >= 0.5:
                continue
            best = max(range(2, len(p)), key=lambda i: (p[i], model.classes[i]))
            like = max((round(len(held & grams) / len(grams), 6), name)
                       for f, name, grams in model.templates() if f == model.classes[best])
            sure = p[best] >= LEAST and like[0] >= CONFIRMED
            if not (anchored or sure):
                continue
            family = model.classes[best] if sure else UNKNOWN
            found[family] = max(found.get(family, (0, 0)), (round(float(p[best]), 6), like[0]))
        if len(found) > 1:
            found.pop(UNKNOWN, None)
        out += [(number, f, *v) for f, v in found.items()]
    return out
