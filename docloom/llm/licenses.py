"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Sparse word n-grams of a paragraph enter a multinomial logistic regression over licence families
and an unknown class. It is trained here, on variations of the templates below and of sentences
that are no licences; a held-out part of the variations sets its temperature and the least
probability. A predicted family counts only if enough word pairs of one of its templates occur.

A paragraph is a line with words. Licence texts are often wrapped, so runs of lines that no empty
line (or one of comment signs only) parts are judged jointly too, wherever a line alone declares
nothing: at each line's end the shortest run that declares a licence counts for its first line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences by which licences are declared.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.", "Released under the GNU GPL version 2 or later.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC", "Licensed under the ISC License.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License, version 2.0.",
    ),
    "eupl": (
        "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2", "Licensed under the EUPL, Version 1.2.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Sentences that share words with licences and declare none.
OTHERS = (
    "The driver must hold a valid license and show it to the officer.", "A fishing license can be bought at the town hall.", "The software was released in version 2.0 last year.",
    "He reserved all the seats for the evening.", "Public transport is free of charge for children.", "The general public was not admitted to the work.",
    "You may use the file if the author agrees.", "The library is open to any person who lives in the city.", "All copies of the book were sold within a week.",
    "Terms and conditions of the contract apply to both parties.", "The foundation publishes a source of free texts.", "The notice was included in the letter to the court.",
    "Our privacy policy explains how personal data is used.", "The law requires written agreement of the owner.", "Conditions are met when the following values are equal.",
    "The common rights of the citizens are stated in the law.", "A copy of the report is found on the table.", "The program runs under the new system without modification.",
    "In any form of art the work is made by the author.", "International trade fell by four percent.", "The case was distributed to the judges.", "The creative work of the students is shown in the hall.",
)
UNKNOWN = "unknown"
LONGEST = 3
#: Least share of a template's word pairs in the paragraph.
CONFIRM = 0.6
#: Share of held-out texts without a licence that the least probability may let through.
FALSE_SHARE = 0.01
VARIATIONS = 40
#: Words of the first, the last and all inner lines that a run of lines is judged by; the longest template has fewer.
SPAN = 60

NO_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NO_WORD).split()


def grams(tokens: list, longest: int = LONGEST) -> set[tuple]:
    return {tuple(tokens[i : i + n]) for n in range(1, longest + 1) for i in range(len(tokens) - n + 1)}


@dataclass(frozen=True)
class Model:
    vocabulary: dict[bytes, int]
    features: dict[tuple[int, ...], int]
    weights: np.ndarray  # features x classes, already divided by the temperature
    bias: np.ndarray
    classes: tuple[str, ...]
    least: float
    pairs: dict[str, list[set[tuple[int, int]]]]  # word pairs of each family's templates

    def judge(self, ids: list[int | None]) -> tuple[str, float, float]:
        """Family, probability and share of the best template's pairs; unknown if not confirmed."""
        runs, run = [], []
        for x in [*ids, None]:
            if x is None:
                if run:
                    runs.append(run)
                run = []
            else:
                run.append(x)
        have = {g for r in runs for g in grams(r)}
        at = [self.features[g] for g in have if g in self.features]
        z = self.bias + self.weights[at].sum(0)
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        name, chance = self.classes[k], float(p[k])
        if name == UNKNOWN or chance < self.least:
            return UNKNOWN, chance, 0.0
        share = max(len(t & have) / len(t) for t in self.pairs[name])
        return (name if share >= CONFIRM else UNKNOWN), chance, share


@lru_cache(maxsize=1)
def model(variations: int = VARIATIONS, seed: int = 11) -> Model:
    """The classifier, trained anew in each process, always alike."""
    rng = np.random.default_rng(seed)
    classes = (*sorted(TEMPLATES), UNKNOWN)
    vocabulary: dict[bytes, int] = {}
    ids = lambda t: [vocabulary.setdefault(w, len(vocabulary)) for w in words(t.encode())]
    sentences = {k: [ids(t) for t in TEMPLATES[k]] for k in sorted(TEMPLATES)}
    others = [ids(t) for t in OTHERS]
    known = [w for s in sentences.values() for t in s for w in t]
    texts: list[tuple[list[int], int]] = []
    for c, name in enumerate(classes[:-1]):
        for t in sentences[name]:
            for i in range(variations):
                keep = [w for w in t if rng.random() > (0.08 if i and len(t) > 5 else 0)]
                extra = others[rng.integers(len(others))] if i % 3 == 1 else []
                texts.append((extra + keep if i % 2 else keep + extra, c))
    unknown = len(classes) - 1
    for t in others:
        for i in range(variations):
            texts.append(([w for w in t if rng.random() > (0.1 if i else 0)], unknown))
    for _ in range(variations * len(others)):  # words of licences in no order, and short pieces of them
        texts.append((list(rng.choice(known, rng.integers(1, 30))), unknown))
    texts.append(([], unknown))
    features: dict[tuple[int, ...], int] = {}
    for t in [t for s in [*sentences.values(), others] for t in s]:
        for g in sorted(grams(t)):
            features.setdefault(g, len(features))
    rows = [(np.array([features[g] for g in sorted(grams(t)) if g in features], dtype=int), y) for t, y in texts]
    held = np.arange(len(rows)) % 5 == 4
    y = np.array([r[1] for r in rows])
    flat = np.concatenate([r[0] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    onehot = np.eye(len(classes))[y]
    w, b = np.zeros((len(features), len(classes))), np.zeros(len(classes))
    w2, b2 = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    train = ~held

    def raw(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = np.zeros((len(rows), len(classes)))
        np.add.at(z, of, w[flat])
        return z + b

    for _ in range(60):  # full-batch steps, scaled by each weight's own history
        z = raw(w, b)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - onehot) * train[:, None] / train.sum()
        gw, gb = np.zeros_like(w), d.sum(0)
        np.add.at(gw, flat, d[of])
        gw += 1e-5 * w
        w2 += gw**2
        b2 += gb**2
        w -= 0.3 * gw / np.sqrt(w2)
        b -= 0.3 * gb / np.sqrt(b2)
    z = raw(w, b)[held]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[held]]).mean())

    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    s = np.exp((z - z.max(1, keepdims=True)) / heat)
    s /= s.sum(1, keepdims=True)
    wrong = s[y[held] == unknown][:, :unknown].max(1)
    least = float(np.clip(np.quantile(wrong, 1 - FALSE_SHARE), 0.4, 0.8))
    pairs = {k: [{g for g in grams(t, 2) if len(g) == 2} for t in s] for k, s in sentences.items()}
    return Model(vocabulary, features, w / heat, b / heat, classes, least, pairs)


def joint(m: Model, lines: list[list[int | None]], said: bool) -> tuple[int, str, float] | None:
    """First line, family and probability of the shortest run of at least two lines, ending with the last one, that declares one.

    said: the first line belongs to a licence already found; what it holds of that one alone does not count again.
    """
    last = lines[-1][:SPAN]
    inner: list[int | None] = []
    for i in range(len(lines) - 2, -1, -1):
        run = [*lines[i][-SPAN:], *inner, *last]
        have = set(zip(run, run[1:]))  # noqa: B905
        if any(len(t & have) >= CONFIRM * len(t) for ts in m.pairs.values() for t in ts):
            name, chance, _ = m.judge(run)
            alone = set(zip(lines[0], lines[0][1:])) if said and i == 0 else set()  # noqa: B905
            if name != UNKNOWN and not any(len(t & alone) >= CONFIRM * len(t) for t in m.pairs[name]):
                return i, name, chance
        inner = [*lines[i], *inner]
        if len(inner) > SPAN:
            break
    return None


def licences(text: bytes | None) -> tuple[int, list[tuple[str, int, float]]]:
    """Number of paragraphs (lines with words) and (family, paragraph, probability) of those that declare one."""
    m = model()
    get = m.vocabulary.get
    n, found = 0, []
    run: list[list[int | None]] = []  # the lines since an empty one, or from the last of a declared licence
    said = False
    for line in text.split(b"\n") if text else []:
        tokens = words(line)
        if not tokens:
            run, said = [], False
            continue
        ids = list(map(get, tokens))
        run.append(ids)
        paired = any(a is not None and b is not None for a, b in zip(ids, ids[1:]))  # noqa: B905
        got = None
        # no template has fewer than one pair of known words, so other paragraphs cannot be confirmed
        if paired:
            name, chance, _ = m.judge(ids)
            if name != UNKNOWN:
                got = (len(run) - 1, name, chance)
        # a run adds something only where its last line adds a pair of known words
        if got is None and len(run) > 1 and (paired or ids[0] is not None and run[-2][-1] is not None):
            got = joint(m, run, said)
        if got is not None:
            found.append((got[1], n + 1 - len(run) + got[0], got[2]))
            run, said = [ids], True
        elif len(run) > SPAN + 2:  # each line has a word, so a run is no longer
            run, said = run[-SPAN - 2 :], False
        n += 1
    return n, found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families, found for every row of docs(doc_id, text).

    families: those declared, sorted, comma-joined, null for none; found: family:paragraph of each
    declaring paragraph (a wrapped text's first line), from 0, comma-joined. A null or empty text has no paragraphs; repeated
    rows are judged each by itself; an empty table gives no rows; other columns are not read.
    Every paragraph of every text is judged; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [licences(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([len(f) for _, f in got], pa.int64()),
                    pa.array([",".join(sorted({x[0] for x in f})) or None for _, f in got], pa.string()),
                    pa.array([",".join(f"{k}:{i}" for k, i, _ in f) for _, f in got], pa.string()),
                ],
                names=["doc_id", "n_paragraphs", "n_licensed", "families", "found"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_paragraphs bigint, n_licensed bigint, families string, found string")
