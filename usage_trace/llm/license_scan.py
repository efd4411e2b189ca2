"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line. Its features are its distinct words and pairs of words, if it holds a cue (a word with one
of STEMS in it, such as "licen"); a paragraph without a cue has none and is no licence paragraph, and texts
without any stem are passed over after one look. Multinomial logistic regression, fitted on the driver to
variants of the templates below and to plain sentences with cues, gives a probability for each licence
family and for `unknown`. These are calibrated by a temperature fitted to variants that weren't trained on, and
a family that doesn't reach the confidence at which those variants are right is unknown. A paragraph that is unknown
with a probability of IDLE or more says nothing of licences and is none. A prediction is confirmed if enough of the paragraph's pairs of words
are in the family's template, where a pair that many families have ("licensed under") weighs little.

Training sees the fixed templates alone and the model's size is fixed by them; scoring is DataFrame
operations: one pass over the texts, joins of the few paragraphs with cues to the model's table.

Edge cases: a null or blank text has no paragraph; a document without a licence paragraph has family `none`, score
0 and counts of 0; of several families the one of the highest probability is named, ties by name; rows that repeat a doc_id count
as one document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by which public licences are applied, and central sentences of their texts.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 3.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "Published under the CC BY-NC-ND 4.0 license",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "artistic": ["Licensed under the Artistic License 2.0", "This library is free software; you can redistribute it under the terms of the Artistic License", "SPDX-License-Identifier: Artistic-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "SPDX-License-Identifier: BSL-1.0"],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License", "Licensed under the CDDL, version 1.0", "SPDX-License-Identifier: CDDL-1.0"],
    "epl": ["Licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: EPL-2.0"],
    "eupl": ["Licensed under the EUPL, Version 1.2", "Licensed under the European Union Public Licence", "You may not use this work except in compliance with the Licence, the European Union Public Licence", "SPDX-License-Identifier: EUPL-1.2"],
    "gfdl": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "Text is available under the GNU Free Documentation License", "SPDX-License-Identifier: GFDL-1.3-only"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "Released under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the LGPL, version 3",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mspl": ["This source is subject to the Microsoft Public License", "Licensed under the Microsoft Public License (Ms-PL)", "SPDX-License-Identifier: MS-PL"],
    "odbl": ["This database is made available under the Open Database License", "Licensed under the Open Data Commons Open Database License (ODbL)", "SPDX-License-Identifier: ODbL-1.0"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the SIL Open Font License", "SPDX-License-Identifier: OFL-1.1"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "For more information, please refer to the Unlicense at http://unlicense.org", "Released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
    "wtfpl": ["Licensed under the WTFPL", "Do what the fuck you want to public license", "SPDX-License-Identifier: WTFPL"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib License", "SPDX-License-Identifier: Zlib"],
    "public domain": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal public domain dedication.",
        "This work is in the public domain",
    ],
}
UNKNOWN = "unknown"
PLAIN = [
    "She renewed her driving license last week",
    "The restaurant lost its license to serve wine",
    "Permission to enter the building was refused",
    "The warranty of the car ends after three years",
    "He holds the copyright of two novels and a play",
    "All rights reserved",
    "Copyright 2019 the publisher. All rights reserved.",
    "This software is licensed to the customer under a commercial agreement",
    "A licence is needed for fishing in this lake",
    "The Apache helicopter landed near the village",
    "The students of MIT built a robot",
    "Mozilla published a new browser on Tuesday",
    "The public domain name server was slow",
    "Creative work needs common sense and time",
    "See the license terms of your supplier before use",
    "The film was distributed without permission of the studio",
    "Use of this site is subject to our terms and conditions",
    "The gnu is a large antelope",
    "Er fuhr mit dem Zug nach Hause und sprach mit seiner Mutter",
    "Mit der Zeit wird alles gut",
    "und mit",
    "das mit den Kindern",
    "Demander la permission de sortir",
    "The domain of the function",
    "cc all members of the team",
]
STEMS = ("licen", "copyright", "gpl", "apache", "gnu", "warrant", "permission", "redistribut", "domain", "creative", "commons", "mozilla", "bsd", "cc", "mit", "spdx", "unencumbered")
#: Stems that are words by themselves only, as they are parts of many words.
WHOLE = ("cc", "mit", "gnu", "domain", "creative")
SPLIT = r"[^a-z0-9]+"
#: Share (by weight) of a paragraph's pairs of words that confirms a family; probability of `unknown` from which a paragraph is none.
CONFIRM, IDLE = 0.5, 0.9


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(SPLIT, text.lower()) if w]


def _cue(word: str) -> bool:
    return word in WHOLE or any(s in word for s in STEMS if s not in WHOLE)


def _features(w: list[str]) -> set[str]:
    """Words and pairs of a paragraph with a cue; none without."""
    return set(w) | _pairs(w) if any(map(_cue, w)) else set()


def _pairs(w: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


class Model:
    """weights[feature][class], the last class being unknown; temperature and threshold for its probabilities."""

    def __init__(self, seed: int = 3, variants: int = 12, steps: int = 150):
        r = random.Random(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        rows = [(text, k) for k, name in enumerate(TEMPLATES) for text in TEMPLATES[name]] + [(t, len(TEMPLATES)) for t in PLAIN]
        data = [(self._vary(text, r), k) for text, k in rows for _ in range(variants)] + [(_words(t), k) for t, k in rows]
        held = [(self._vary(text, r), k) for text, k in rows for _ in range(4)]
        classes = len(self.classes)
        found = [_features(w) for w, _ in data]
        names = sorted(set().union(*[_features(_words(t)) for t, _ in rows]))  # what variants add is noise
        place = {x: i for i, x in enumerate(names)}
        x, y = np.zeros((len(data), len(names))), np.zeros((len(data), classes))
        for i, (f, (_, k)) in enumerate(zip(found, data)):
            x[i, [place[n] for n in f if n in place]] = 1
            y[i, k] = 1
        share = y @ (1 / classes / np.maximum(1, y.sum(0)))  # all classes weigh the same
        w, b = np.zeros((len(names), classes)), np.zeros(classes)
        for step in range(steps):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            e = share[:, None] * (y - p / p.sum(1, keepdims=True))
            rate = 20 * classes / 8 / (1 + step / 50)
            b += rate * 0.2 * e.sum(0)
            w += rate * (x.T @ e - 2e-5 * w)
        self.bias, self.weights = b.tolist(), dict(zip(names, w.tolist()))
        # what isn't known should not be claimed: a paragraph with features that say nothing is unknown
        self.bias[-1] = max(self.bias) + 0.5
        logits = [(self.logits(_features(w)), k) for w, k in held]
        loss = lambda t: -sum(math.log(max(1e-9, self._softmax([x / t for x in l])[k])) for l, k in logits)  # noqa: E731, E741
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        claims = sorted(((max(p[:-1]), p.index(max(p)) == k) for l, k in logits if (p := self._softmax([x / self.temperature for x in l])).index(max(p)) < classes - 1), reverse=True)
        self.threshold, right = 0.5, 0
        for i, (p, ok) in enumerate(claims):
            right += ok
            if right / (i + 1) >= 0.99:
                self.threshold = max(0.5, min(p, 0.9))

    @staticmethod
    def _vary(text: str, r: random.Random) -> list[str]:
        """The words of a text with some lost, a number changed, or others around them."""
        w = [x if not x.isdigit() else r.choice([x, str(r.randint(1, 5))]) for x in _words(text)]
        if len(w) > 8:
            a = r.randint(0, len(w) // 3)
            w = r.choice([w, w, w[a:], w[: len(w) - a]])
            w = [x for x in w if r.random() > 0.05] or w
        extra = [r.choice("the file project code author data book page site of in".split()) for _ in range(r.randint(0, 4))]
        return r.choice([w, extra + w, w + extra])

    def logits(self, features: set[str]) -> list[float]:
        out = list(self.bias)
        for x in features:
            if x in self.weights:
                out = [a + b for a, b in zip(out, self.weights[x])]
        return out

    @staticmethod
    def _softmax(x: list[float]) -> list[float]:
        top = max(x)
        e = [math.exp(v - top) for v in x]
        s = sum(e)
        return [v / s for v in e]

    def table(self) -> list[dict]:
        """gram, w (a weight for each class, empty if it isn't a feature), t (for each family, what the pair weighs if its template has it), g (that weight, 0 if no template has it).

        A pair weighs the less the more families have it; one that no template has weighs 1.
        """
        has = {k: set().union(*[_pairs(_words(t)) for t in TEMPLATES[k]]) for k in TEMPLATES}
        families = Counter(p for pairs in has.values() for p in pairs)
        grams = sorted(self.weights.keys() | families.keys())
        weigh = lambda g: 1 / families[g] if g in families else 0.0
        return [{"gram": g, "w": self.weights.get(g, [0.0] * len(self.classes)), "t": [weigh(g) if g in has[k] else 0.0 for k in TEMPLATES], "g": weigh(g)} for g in grams]


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return Model()


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number, from 0), grams (distinct words and pairs), pairs (how many of them): those with a cue."""
    text = F.lower("text")
    inside = "|".join(s for s in STEMS if s not in WHOLE)
    cue = f"{inside}|(?:^|[^a-z0-9])(?:{'|'.join(WHOLE)})(?:$|[^a-z0-9])"
    some = docs.where(functools.reduce(Column.__or__, [F.contains(text, F.lit(s)) for s in STEMS])).select("doc_id", F.posexplode(F.split(text, "\n")).alias("paragraph", "line")).where(F.col("line").rlike(cue))
    w = F.filter(F.split("line", SPLIT), lambda x: x != "")
    both = lambda w: F.transform(F.filter(F.arrays_zip(w.alias("a"), F.slice(w, 2, 1 << 30).alias("b")), lambda x: x["b"].isNotNull()), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    grams = F.element_at(F.transform(F.array(w), lambda w: F.struct(F.array_distinct(w).alias("one"), F.array_distinct(both(w)).alias("two"))), 1)
    return some.select("doc_id", "paragraph", grams.alias("g")).select("doc_id", "paragraph", F.concat("g.one", "g.two").alias("grams"), F.size("g.two").alias("pairs"))


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _softmax(logits: Column) -> Column:
    """The probabilities of an array of logits. Written over the array, as one expression for each class would hold those of all classes."""
    exps = _let(logits, lambda z: _let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
    return _let(exps, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph, family, score, similarity: of each paragraph with a cue that is in the model."""
    model = model or default_model()
    spark, k = docs.sparkSession, len(model.classes)
    weights = pa.list_(pa.float64())
    held = pa.Table.from_pylist(model.table(), pa.schema([("gram", pa.string()), ("w", weights), ("t", weights), ("g", pa.float64())]))
    table = spark.createDataFrame(held)  # rows of a table, not a literal: plans are told as text again and again, and the driver holds them
    rows = paragraphs(docs).select("doc_id", "paragraph", "pairs", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    sums = rows.groupBy("doc_id", "paragraph", "pairs").agg(*[F.sum(F.get("w", F.lit(c))).alias(f"w{c}") for c in range(k)], *[F.sum(F.get("t", F.lit(c))).alias(f"t{c}") for c in range(k - 1)], (F.sum(F.when(F.col("g") > 0, F.col("g") - 1).otherwise(0)) + F.col("pairs")).alias("all"))
    logits = F.array(*[(F.col(f"w{c}") + F.lit(model.bias[c])) / F.lit(model.temperature) for c in range(k)])
    each = sums.select("doc_id", "paragraph", _softmax(logits).alias("p"), F.array(*[f"t{c}" for c in range(k - 1)]).alias("t"), "all")
    names = F.array(*map(F.lit, model.classes))
    similarity = lambda c: F.when(c < k - 1, F.try_divide(F.get("t", c), F.col("all"))).otherwise(0.0)
    choices = F.transform("p", lambda p, c: F.struct((-p).alias("p"), F.get(names, c).alias("family"), similarity(c).alias("similarity")))
    best = each.where(F.get("p", F.lit(k - 1)) < IDLE).select("doc_id", "paragraph", F.array_min(choices).alias("b"))
    sure = (F.col("b.family") != UNKNOWN) & (-F.col("b.p") >= model.threshold) & (F.col("b.similarity") >= CONFIRM)
    return best.select("doc_id", "paragraph", F.when(sure, F.col("b.family")).otherwise(UNKNOWN).alias("family"), (-F.col("b.p")).alias("score"), F.col("b.similarity").alias("similarity"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, family, score, similarity (of its best licence paragraph), n_paragraphs confirmed, n_unknown."""
    docs = docs.select("doc_id", "text")
    found = classify(docs.where("text IS NOT NULL"), model)
    known = F.col("family") != UNKNOWN
    best = F.max_by(F.when(known, F.struct("family", "score", "similarity")), F.when(known, F.struct("score", "similarity", "family")))
    each = found.groupBy("doc_id").agg(best.alias("b"), F.count_if(known).alias("n_paragraphs"), F.count_if(~known).alias("n_unknown"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    family = F.coalesce("b.family", F.when(F.col("n_unknown") > 0, F.lit(UNKNOWN)), F.lit("none"))
    every = docs.select("doc_id").distinct()
    return every.join(each, every["doc_id"].eqNullSafe(each["doc_id"]), "left").select(every["doc_id"], family.alias("family"), zero("b.score").cast("double").alias("score"), zero("b.similarity").cast("double").alias("similarity"), zero("n_paragraphs").alias("n_paragraphs"), zero("n_unknown").alias("n_unknown"))


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)
