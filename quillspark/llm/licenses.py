"""License scan: a trained paragraph classifier with an unknown class, confirmed by comparison with templates.

Paragraphs are lines, and runs of lines that are wrapped: of which each but the last ends inside a sentence. Word
1-grams and 2-grams are hashed into a sparse multinomial logistic regression; a prediction counts only above a threshold
calibrated on templates that the model had not seen, and only if a template of that family resembles the paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import textbatch as tb

BUCKETS = 1 << 16
UNKNOWN = "unknown"
#: Wording of licence notices by family, as published by their stewards; what a scan looks for.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "This project is licensed under Apache-2.0, see the LICENSE file."),
    "mit": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.", "Distributed under the MIT license, see the LICENSE file for details."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program.", "Licensed under the GPL version 2.", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.", "SPDX-License-Identifier: GPL-2.0-only", "This file may be used under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    "agpl": ("This program is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the AGPL version 3."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only", "You should have received a copy of the GNU Lesser General Public License along with this library.", "Licensed under the LGPL version 2.1."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Released under the BSD 2-Clause License."),
    "isc": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "Licensed under the ISC License.", "This package is released under the ISC license."),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."),
    "eclipse": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    "eupl": ("Licensed under the EUPL, Version 1.2.", "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib", "Released under the zlib license."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."),
    "public-domain": ("This work has been released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "The author dedicates this work to the public domain under the CC0 1.0 Universal dedication."),
    "reserved": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
#: Sentences that talk about such matters and are no notice, for the unknown class.
OTHER = (
    "The driver lost his license after the accident.", "You need a fishing license to use the lake.", "A general rule applies to public transport.", "The software was released last year and sold well.",
    "He reserved all rooms of the hotel.", "The terms of the contract are under discussion.", "Version 2.0 of the report is due on Monday.", "Permission to enter was granted by the guard.",
    "They work in the public domain of education.", "The library is free and open on Sundays.", "The source of the river is under the mountain.", "Copyright law is taught in the third year.",
    "This program is broadcast in the evening.", "The foundation published the results in May.", "Attribution of the painting is disputed.", "All people have rights.", "The work was done under difficult conditions.",
    "A copy of the letter was found in the file.", "The Apache helicopter landed near the base.", "MIT is a university in Cambridge.", "Students at MIT built the machine.", "The Mozilla team met in Berlin.", "Use the form to send us a notice.",
    "Any person may attend free of charge.", "The following conditions are common in winter.", "The general told the public about version three.", "Creative people work in common rooms.", "International trade grew by 4.0 percent.",
)


_PART_OF_WORD = np.zeros(256, bool)
_PART_OF_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+.", *range(128, 256)]] = True


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word 1-grams and 2-grams of each value, ordered by value, and the value of each.

    Words are runs of letters, digits, plus signs and inner points (2.0), with A-Z lower-cased.
    """
    data = np.where(_PART_OF_WORD[data], data, np.uint8(32))
    last = np.append(data[1:] == 32, True)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    data = np.where((data == 46) & last, np.uint8(32), data)
    words, owner = tb.word_hashes(data, offsets)
    if not len(words):
        return np.zeros(0, np.int64), owner
    pair = owner[1:] == owner[:-1]
    two = tb.mix(words[:-1] * tb._COEF[0] + words[1:] * tb._COEF[1])[pair]
    ids = np.concatenate([words, two]) >> np.uint64(48)
    own = np.concatenate([owner, owner[:-1][pair]])
    order = np.argsort(own, kind="stable")
    return ids[order].astype(np.int64), own[order]


@dataclass
class LicenseModel:
    families: list[str]  # the last is the unknown class
    weights: np.ndarray  # (BUCKETS, families)
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, owner = _grams(data, offsets)
        n = len(offsets) - 1
        z = np.tile(self.bias, (n, 1)).astype(np.float64)
        counts = np.bincount(owner, minlength=n)
        full = np.flatnonzero(counts)
        if len(full):
            at = (np.cumsum(counts) - counts)[full]
            for c in range(len(self.families)):
                z[full, c] += np.add.reduceat(self.weights[ids, c], at) / np.sqrt(counts[full])
        z /= self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _column(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tb.text_bytes(pa.array(texts, pa.string()))


def examples(templates: dict[str, tuple[str, ...]], other: tuple[str, ...], copies: int = 30, seed: int = 5) -> tuple[list[str], list[str], list[int]]:
    """Labelled paragraphs: the templates and sentences, whole and with words lost, added or taken from elsewhere.

    The last list has the number of the template or sentence within its family, from which each is made.
    """
    rng = np.random.default_rng(seed)
    filler = [w for s in other for w in s.split()]
    texts, labels, made_of = [], [], []
    for label, group in [*templates.items(), (UNKNOWN, other)]:
        for number, t in enumerate(group):
            for k in range(copies if label != UNKNOWN else copies // 2):
                w = t.split()
                if k and len(w) > 3:
                    w = [x for x in w if rng.random() > 0.08] or w
                    if k % 3 == 0:
                        w = [*rng.choice(filler, rng.integers(1, 5)), *w]
                texts.append(" ".join(w))
                labels.append(label)
                made_of.append(number)
    for k in range(40 * copies):  # word salad of prose
        texts.append(" ".join(rng.choice(filler, rng.integers(1, 30))))
        labels.append(UNKNOWN)
        made_of.append(k)
    return texts, labels, made_of


def _train(texts: list[str], y: np.ndarray, families: list[str], steps: int) -> LicenseModel:
    """Multinomial logistic regression over hashed grams by gradient descent."""
    model = LicenseModel(families, np.zeros((BUCKETS, len(families)), np.float32), np.zeros(len(families)), 1.0, 0.5)
    ids, owner = _grams(*_column(texts))
    size = np.sqrt(np.bincount(owner, minlength=len(texts)))
    used, at = np.unique(ids, return_inverse=True)
    w, b = np.zeros((len(used), len(families))), np.zeros(len(families))
    goal = np.eye(len(families))[y]
    scale = 1 / np.maximum(size, 1)
    # sums by example and by bucket as runs: owner is in order, and so is at[order]
    first, order = np.flatnonzero(np.diff(owner, prepend=-1)), np.argsort(at, kind="stable")
    bucket = np.flatnonzero(np.diff(at[order], prepend=-1))
    for _ in range(steps):
        z = np.tile(b, (len(texts), 1))
        z[owner[first]] += np.add.reduceat(w[at], first) * scale[owner[first], None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - goal) / len(texts)
        step = np.add.reduceat((g * scale[:, None])[owner[order]], bucket)
        w -= 40.0 * (step + 1e-6 * w)
        b -= 4.0 * g.sum(axis=0)
    model.weights[used], model.bias = w, b
    return model


def fit(templates: dict[str, tuple[str, ...]] = TEMPLATES, other: tuple[str, ...] = OTHER, steps: int = 200, precision: float = 0.99) -> LicenseModel:
    """Temperature and threshold of ``precision`` come from whole templates and sentences held back (every fourth); the weights then from all."""
    texts, labels, made_of = examples(templates, other)
    families = [*templates, UNKNOWN]
    y = np.array([families.index(x) for x in labels])
    late = np.array(made_of) % 4 == 3
    model = _train([t for t, h in zip(texts, late, strict=True) if not h], y[~late], families, steps)
    data, offsets = _column([t for t, h in zip(texts, late, strict=True) if h])
    truth = y[late]

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(model.probabilities(data, offsets)[np.arange(len(truth)), truth] + 1e-12).mean())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    p = model.probabilities(data, offsets)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    named = best != len(families) - 1
    for t in np.arange(0.3, 1.0, 0.05):
        model.threshold = float(t)
        taken = named & (sure >= t)
        if not taken.any() or (best == truth)[taken].mean() >= precision:
            break
    final = _train(texts, y, families, steps)
    final.temperature, final.threshold = model.temperature, model.threshold
    return final


_WORD = re.compile(r"[^\W_]+(?:[.][^\W_]+)*")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower().replace("-", " ").replace("_", " ")))


def markers(templates: dict[str, tuple[str, ...]]) -> dict[str, set[str]]:
    """Words by which each family is told: those in two of its templates at least and in none of another's."""
    held = {f: [words_of(t) for t in group] for f, group in templates.items()}
    every = {f: set().union(*x) for f, x in held.items()}
    return {f: {w for w in every[f] if sum(w in t for t in x) > 1 and not any(w in every[g] for g in every if g != f)} for f, x in held.items()}


def resemblance(text: str, family: str, templates: dict[str, tuple[str, ...]], known: dict[str, set[str]]) -> float:
    """Best share of words in common with a template of the family, of the shorter side.

    Three words at least must be shared, or all of a text of two. A template whose family's markers the text has not, and a
    text with another family's markers that the template has not, do not resemble each other.
    """
    mine = words_of(text)
    foreign = mine & set().union(*(x for f, x in known.items() if f != family))
    best = 0.0
    for t in templates[family]:
        theirs = words_of(t)
        both = len(mine & theirs)
        if (both >= 3 or both == len(mine) == 2) and theirs & known[family] <= mine and foreign <= theirs:
            best = max(best, both / min(len(mine), len(theirs)))
    return best


_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?:;"]] = True


def _wrapped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and end (exclusive) of the runs of two lines and more, each but the last of which ends inside a sentence."""
    goes_on = (owner[1:] == owner[:-1]) & (starts[1:] == ends[:-1] + 1) & ~_ENDS[data[ends[:-1] - 1]]
    begins = np.concatenate([[True], ~goes_on])
    first = np.flatnonzero(begins)
    stop = np.concatenate([first[1:], [len(starts)]])
    return first[stop - first > 1], stop[stop - first > 1]


def _scanned(model: LicenseModel, templates: dict[str, tuple[str, ...]], least: float):
    unknown, known = len(model.families) - 1, markers(templates)

    def found(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> dict[int, tuple[str, float, float, str]]:
        flat = data[tb.gather(starts[which], (ends - starts)[which])]
        p = model.probabilities(flat, np.concatenate([[0], np.cumsum((ends - starts)[which])]))
        best, sure = p.argmax(axis=1), p.max(axis=1)
        out = {}
        for k in np.flatnonzero((best < unknown) & (sure >= model.threshold)):
            text, family = data[starts[which[k]] : ends[which[k]]].tobytes().decode(), model.families[best[k]]
            if (like := resemblance(text, family, templates, known)) >= least:
                out[int(which[k])] = (family, round(float(sure[k]), 4), round(like, 4), text)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in tb.chunks(offsets):
                d, part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, owner = tb.spans(d != 10, part)
                if not len(starts):
                    continue
                rows = [(k, 1, x) for k, x in found(d, starts, ends, np.arange(len(starts))).items()]
                held = np.concatenate([[0], np.cumsum(np.isin(np.arange(len(starts)), [k for k, *_ in rows]))])
                first, stop = _wrapped(d, starts, ends, owner)
                free = held[stop] == held[first]  # no line of it is a notice by itself
                if free.any():
                    first, stop = first[free], stop[free]
                    rows += [(int(first[k]), int(stop[k] - first[k]), x) for k, x in found(d, starts[first], ends[stop - 1], np.arange(len(first))).items()]
                if rows:
                    rows.sort(key=lambda r: r[:2])
                    breaks = np.concatenate([[0], np.cumsum(d == 10)])
                    at = np.array([k for k, *_ in rows])
                    line = breaks[starts[at]] - breaks[part[owner[at]]]
                    family, sure, like, text = zip(*(x for *_, x in rows), strict=True)
                    yield pa.record_batch([ids.take(pa.array(i + owner[at])), pa.array(line.astype(np.int64)), pa.array([n for _, n, _ in rows], pa.int64()), pa.array(family), pa.array(sure, pa.float64()), pa.array(like, pa.float64()), pa.array(text)], ["doc_id", "line", "n_lines", "family", "probability", "resemblance", "paragraph"])

    return run


def scan(docs: DataFrame, model: LicenseModel, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """Findings (doc_id, line, n_lines, family, probability, resemblance, paragraph) in ``docs`` (doc_id, text).

    A paragraph of which the unknown class is likelier, or no family likely enough, or that resembles no template of
    its family by ``least``, is no finding. Lines count from 0. A wrapped run of lines is a finding if none of its lines is.

    * null or empty text: no finding; null doc_id: findings with a null id; repeated rows: repeated findings;
    * ties between families go to the one listed first; long texts and lines are read whole; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanned(model, templates, least), f"doc_id {kind}, line bigint, n_lines bigint, family string, probability double, resemblance double, paragraph string")
