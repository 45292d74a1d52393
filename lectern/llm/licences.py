"""Licence paragraphs in documents: a trained classifier, a calibrated unknown class, and comparison with templates.

Paragraphs are lines with a word. Features are distinct word n-grams (n = 1, 2) of the lower-case words, without
punctuation at their ends; a paragraph is a sparse vector over the n-grams of the training set. Multinomial logistic
regression tells the families and "none". It is trained here, on the templates below under word edits, and on other
paragraphs: a bounded sample of the corpus (TRAIN_ROWS documents), so labelled by having no licence word.

The unknown class: a temperature fitted on held-out rows (other wordings of every family, other paragraphs) makes the
probabilities honest, and the lowest cut at which no held-out paragraph of "none" is taken for a family decides; less certain
paragraphs with licence words are "unknown".
A family is confirmed if the paragraph has half the n-grams of one of its templates, or half of its own n-grams stand in
one; else it is unknown too.

Defined results: a null or empty text has no paragraphs and no licences; whole texts are read, and every line is scored;
equal lines and repeated rows get equal results; of equal probabilities the first family counts; other columns are ignored;
an empty table gives an empty table (the classifier then has templates and their shuffles only).
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import smallest_by_hash

#: Notices by family (fixed values: the usual wording of public licences).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ],
    "unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "This text is in the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020 by the authors. All rights reserved.", "No part of this publication may be reproduced in any form without prior written permission of the publisher."],
}
#: Other wordings of notices, on which the classifier is calibrated and never trained (fixed values).
HELD_OUT = {
    "apache-2.0": ["Distributed under the Apache 2.0 License; see the file LICENSE.", "You may use this file under the Apache License, Version 2.0 only."],
    "mit": ["Distributed under the MIT License.", "Source code is available under the terms of the MIT License."],
    "bsd": ["Licensed under the 3-Clause BSD License.", "Source code is governed by a BSD-style license."],
    "gpl": ["Released under the GNU General Public License version 3 or later.", "You can redistribute this work under the terms of the GNU General Public License."],
    "lgpl": ["Released under the GNU Lesser General Public License.", "This library may be used under the terms of the GNU Lesser General Public License, version 2.1."],
    "agpl": ["Released under the GNU Affero General Public License.", "This program is covered by the GNU Affero General Public License, version 3."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify and distribute this software for any purpose is hereby granted."],
    "epl-2.0": ["This program is made available under the Eclipse Public License 2.0.", "Released under the terms of the Eclipse Public License."],
    "unlicense": ["Licensed under the Unlicense.", "This is free and unencumbered software; anyone is free to copy it for any purpose."],
    "mpl-2.0": ["Released under the Mozilla Public License 2.0.", "Subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["This text is licensed under CC BY 4.0.", "Published under a Creative Commons Attribution 4.0 License."],
    "cc-by-sa": ["This text is licensed under CC BY-SA 4.0.", "Published under the Creative Commons Attribution-ShareAlike License."],
    "cc-by-nc": ["This text is licensed under CC BY-NC 4.0.", "Published under the Creative Commons Attribution-NonCommercial License."],
    "public-domain": ["This work is in the public domain.", "Dedicated to the public domain under CC0."],
    "proprietary": ["Copyright by the publisher. All rights reserved.", "No part of this text may be reproduced without prior written permission."],
}
NONE = "none"
CLASSES = [*TEMPLATES, NONE]
#: Words that make a paragraph a candidate for "unknown", and that paragraphs of "none" must not have in training.
CUE = re.compile(r"licen[sc]|copyright|rights? reserved|public domain|permission", re.I)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?()[]{}\"'“”‘’"
#: Sample for "none": documents, paragraphs of each, characters of a paragraph; edits of each template; share of a template
#: (or of a paragraph) that confirms.
TRAIN_ROWS, TRAIN_LINES, TRAIN_CHARS, EDITS, CONFIRM = 500, 4, 400, 30, 0.5
#: Temperatures that are tried.
TEMPERATURES = tuple(0.25 * 1.15**i for i in range(24))


def grams(paragraph: str) -> set[str]:
    """Distinct word 1-grams and 2-grams of a paragraph."""
    w = [x for x in (w.strip(EDGES) for w in WORD.findall(paragraph.lower())) if x]
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


class LicenceModel:
    """The classifier with its temperature, cut and templates."""

    def __init__(self, others: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        rows: list[tuple[set[str], int]] = []
        common = [w for p in others for w in WORD.findall(p)] or ["the", "of", "and"]
        for c, texts in enumerate(TEMPLATES.values()):
            for t in texts:
                w = WORD.findall(t)
                rows.append((grams(t), c))
                for _ in range(EDITS):
                    out = [x for x in w if rng.random() > 0.12]
                    lead = [common[i] for i in rng.integers(0, len(common), rng.integers(0, 6))]
                    tail = [common[i] for i in rng.integers(0, len(common), rng.integers(0, 6))]
                    if rng.random() < 0.5:
                        lead = tail = []
                    rows.append((grams(" ".join([*lead, *out, *tail])), c))
                none = [common[i] for i in rng.integers(0, len(common), 12)]
                for _ in range(EDITS // 3):  # single words of a notice among others are no licence
                    some = list(rng.choice(w, min(2, len(w)), replace=False))
                    rows.append((grams(" ".join(rng.permutation([*none, *some]).tolist())), len(TEMPLATES)))
        rows += [(grams(p), len(TEMPLATES)) for p in others]
        # Held out: other wordings of all families, and a quarter of the paragraphs of none.
        rows += [(grams(t), CLASSES.index(family)) for family, texts in HELD_OUT.items() for t in texts]
        n_held = sum(map(len, HELD_OUT.values()))
        y = np.array([c for _, c in rows])
        held = (np.arange(len(rows)) >= len(rows) - n_held) | ((y == len(TEMPLATES)) & (rng.random(len(rows)) < 0.25))
        known = sorted({g for t in TEMPLATES.values() for x in t for g in grams(x)})
        self.index = {g: i for i, g in enumerate(known)}
        self.pairs = {tuple(g.split(" ")): i for g, i in self.index.items() if " " in g}
        self.templates = [[grams(t) for t in texts] for texts in TEMPLATES.values()]
        x = np.zeros((len(rows), len(known) + 1), np.float32)
        for i, (g, _) in enumerate(rows):
            x[i, self._vector(g)] = 1
        x[:, -1] = 1
        self.w = self._fit(x[~held], y[~held])
        z = x[held] @ self.w
        self.temperature = min(TEMPERATURES, key=lambda t: -np.log(np.maximum(self._softmax(z / t)[np.arange(len(z)), y[held]], 1e-12)).mean())
        p = self._softmax(z / self.temperature)
        self.held_accuracy = float((p[-n_held:].argmax(axis=1) == y[-n_held:]).mean())
        wrong = p[y[held] == len(TEMPLATES), :-1]
        self.cut = float(np.clip((wrong.max() if wrong.size else 0) + 0.01, 0.5, 0.95))

    def _vector(self, g: set[str]) -> list[int]:
        return [self.index[x] for x in g if x in self.index]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150) -> np.ndarray:
        w = np.zeros((x.shape[1], len(CLASSES)), np.float32)
        weight = (1 / np.maximum(np.bincount(y, minlength=len(CLASSES)), 1))[y][:, None] / len(CLASSES)
        target = np.eye(len(CLASSES), dtype=np.float32)[y]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for i in range(1, rounds + 1):
            g = x.T @ (weight * (self._softmax(x @ w) - target)) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return w

    def decide(self, paragraph: str, p: np.ndarray) -> tuple[str, float]:
        """(family, "unknown" or "none"; probability of the best family) from the probabilities of a paragraph."""
        best = int(p[:-1].argmax())
        if p[best] >= self.cut and p[best] > p[-1]:
            g = grams(paragraph)
            if any(len(g & t) >= CONFIRM * len(t) or len(g & t) >= CONFIRM * len(g) for t in self.templates[best]):
                return CLASSES[best], float(p[best])
        return ("unknown" if CUE.search(paragraph) else NONE), float(p[best])

    def classify(self, paragraph: str) -> tuple[str, float]:
        at = self._vector(grams(paragraph))
        return self.decide(paragraph, self._softmax((self.w[at].sum(axis=0) + self.w[-1])[None] / self.temperature)[0])

    def _known(self, paragraph: str) -> list[int]:
        """The n-grams of a paragraph that the model has a weight for: pairs are built of words that it has, too."""
        w = [x for x in (w.strip(EDGES) for w in WORD.findall(paragraph.lower())) if x]
        index, pairs = self.index, self.pairs
        own = {index[x] for x in w if x in index}
        if len(own) > 1:
            own.update(pairs[q] for q in zip(w, w[1:], strict=False) if q in pairs)
        return list(own)

    def scan(self, text: str | None) -> list[tuple[int, str, float]]:
        """(line from 0, family or "unknown", probability) of a text's licence paragraphs; every line is classified, the
        lines of a text at once."""
        if not text:
            return []
        lines = text.split("\n")
        known = [self._known(x) for x in lines]
        sizes = np.array([len(k) for k in known])
        # Each line's weights end with the bias, so that no sum is over nothing.
        at = np.fromiter((i for k in known for i in (*k, -1)), np.int64, int(sizes.sum()) + len(lines))
        z = np.add.reduceat(self.w[at], np.concatenate(([0], np.cumsum(sizes + 1)[:-1])), axis=0)
        p = self._softmax(z / self.temperature)
        out = []
        for i in np.flatnonzero(p[:, :-1].max(axis=1) >= self.cut).tolist() if not CUE.search(text) else range(len(lines)):
            family, chance = self.decide(lines[i], p[i])
            if family != NONE:
                out.append((i, family, chance))
        return out


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, train_lines: int = TRAIN_LINES, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """(key, n_paragraphs, n_licences, families, n_unknown, found) of every document: families sorted and comma-joined;
    found lists line:family:probability in hundredths. The classifier is fitted on the templates and, for "none", on
    `train_lines` paragraphs without licence words, of `train_chars` characters, of `train_rows` documents; it then reads
    every line of every text."""
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema[0].dataType.simpleString()
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 20) & ~x.rlike("(?i)" + CUE.pattern)), 1, train_lines)
    some = smallest_by_hash(own.where("text is not null"), "id", train_rows).select(F.transform(lines, lambda x: F.substring(x, 1, train_chars)).alias("lines"))
    model = LicenceModel([x for r in some.collect() for x in r["lines"]])  # some 100 kB; sent with the function

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for t in pdf["text"]:
                t = t if isinstance(t, str) else None
                got = model.scan(t)
                families = sorted({f for _, f, _ in got if f != "unknown"})
                rows.append((sum(1 for x in (t or "").split("\n") if x.strip()), len(got), ",".join(families), sum(f == "unknown" for _, f, _ in got), ",".join(f"{i}:{f}:{round(100 * p)}" for i, f, p in got)))
            yield pd.DataFrame(rows, columns=["n_paragraphs", "n_licences", "families", "n_unknown", "found"]).assign(id=pdf["id"].to_numpy())[["id", "n_paragraphs", "n_licences", "families", "n_unknown", "found"]]

    return own.mapInPandas(run, f"id {kind}, n_paragraphs long, n_licences long, families string, n_unknown long, found string").withColumnRenamed("id", key)
