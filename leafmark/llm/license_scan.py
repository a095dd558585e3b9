"""License scans: paragraphs are classified by a logistic regression on word n-grams, and templates confirm it.

The classifier is trained here, on altered copies of the templates below and on a bounded sample of ordinary
paragraphs of the corpus as the class `unknown`. Its probabilities are calibrated by a temperature found on altered
copies that it was not trained on. A paragraph is a line; a licence text over several lines, or within a long one, is
found as a passage: where a template's word pairs lie together in a run of lines that have words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.wordhash import grams, normalise, word_hashes

UNKNOWN = "unknown"

# Fixed texts: notices and opening clauses of well-known public licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "You may not use the material for commercial purposes.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
N = (1, 2, 3)
# Fixed words of ordinary prose on the same matters, which alone must not make a licence.
ORDINARY = [
    "The driver showed her license to the officer and asked for permission to leave.", "The city council granted a license to the restaurant last year.",
    "He asked for a copy of the report and the conditions of the contract.", "The software was distributed to all schools without any further notice.",
    "A new version of the work was published by the author in May.", "They use the same source of water for commercial purposes.",
    "Terms and conditions apply to all tickets sold at the door.", "The public library is free to all persons in the town.",
]


def features(data: bytes) -> np.ndarray:
    h = word_hashes(data)
    return np.concatenate([grams(h, n) for n in N if len(h) >= n]) if len(h) else np.zeros(0, dtype=np.uint64)


class Model:
    """Softmax regression over the n-grams of the templates, with a count of n-grams that are in none."""

    def __init__(self, families: dict[str, list[str]], ordinary: list[str], seed: int = 5):
        self.classes = [UNKNOWN, *sorted(families)]
        self.shapes = [(self.classes.index(k), np.unique(grams(word_hashes(normalise(t)), 2))) for k in sorted(families) for t in families[k]]
        self.vocabulary = np.unique(np.concatenate([features(normalise(t)) for ts in families.values() for t in ts]))
        rng = np.random.default_rng(seed)
        rows, labels = [], []
        for k in sorted(families):
            for t in families[k]:
                for _ in range(40):
                    rows.append(self._altered(t, ordinary, rng))
                    labels.append(self.classes.index(k))
        for t in ordinary:
            rows.append(t)
            labels.append(0)
        words = [w for ts in families.values() for t in ts for w in t.split()]
        for _ in range(400):
            rows.append(" ".join(rng.choice(words, int(rng.integers(1, 5)))))
            labels.append(0)
        x = np.stack([self.vector(features(normalise(t))) for t in rows])
        y = np.array(labels)
        test = rng.random(len(y)) < 0.25
        self.weights = self._fit(x[~test], y[~test])
        self.temperature = self._calibrated(x[test] @ self.weights, y[test])

    @staticmethod
    def _altered(text: str, ordinary: list[str], rng: np.random.Generator) -> str:
        words = [w for w in text.split() if rng.random() > 0.08]
        words = [str(rng.choice(ordinary)).split()[0] if rng.random() < 0.04 else w for w in words] or text.split()
        around = str(rng.choice(ordinary)).split()
        before, after = (around[: int(rng.integers(0, 6))] if rng.random() < 0.4 else [] for _ in range(2))
        return " ".join([*before, *words, *after])

    def vector(self, grams_: np.ndarray) -> np.ndarray:
        v = np.zeros(len(self.vocabulary) + 2, dtype=np.float32)
        if len(grams_):
            at = np.searchsorted(self.vocabulary, grams_)
            at[at == len(self.vocabulary)] = 0
            known = self.vocabulary[at] == grams_
            v[np.unique(at[known])] = 1
            norm = np.sqrt(max(1.0, float(v.sum())))
            v[:-2] /= norm
            v[-2] = 1 - known.mean()
        v[-1] = 1
        return v

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
        w = np.zeros((x.shape[1], len(self.classes)), dtype=np.float32)
        goal = np.eye(len(self.classes), dtype=np.float32)[y]
        moved = np.zeros_like(w)
        for _ in range(steps):
            p = self._soft(x @ w)
            moved = 0.9 * moved - rate * (x.T @ (p - goal) / len(y) + decay * w)
            w += moved
        return w

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def _calibrated(self, z: np.ndarray, y: np.ndarray) -> float:
        loss = [(-np.log(self._soft(z / t)[np.arange(len(y)), y] + 1e-12).mean(), t) for t in np.geomspace(0.2, 5, 40)]
        return float(min(loss)[1])

    def classify(self, data: bytes) -> tuple[str, float, float]:
        """Family, its probability, and the share of a template's word pairs of that family that the paragraph has."""
        p = self._soft(self.vector(features(data)) @ self.weights / self.temperature)
        best = int(p.argmax())
        pairs = np.unique(grams(word_hashes(data), 2))
        cover = max((float(np.isin(s, pairs, assume_unique=True).mean()) for k, s in self.shapes if k == best), default=0.0)
        return self.classes[best], float(p[best]), cover


class Passages:
    """Passages of a run of lines that hold enough word pairs of a template, wherever its lines end."""

    STRETCH, AROUND = 1.5, 3

    def __init__(self, model: Model, cover: float):
        self.model, self.cover = model, cover
        self.pairs = np.unique(np.concatenate([s for _, s in model.shapes]))
        self.has = np.stack([np.isin(self.pairs, s) for _, s in model.shapes], axis=1)
        self.need = cover * self.has.sum(axis=0)

    def find(self, data: bytes) -> list[tuple[int, int, str, float, float]]:
        """Begin and end in bytes, family, probability and cover; of passages that overlap the best."""
        g = grams(word_hashes(data), 2) if data.strip() else np.zeros(0)
        if not len(g):
            return []
        at = np.searchsorted(self.pairs, g)
        at[at == len(self.pairs)] = 0
        known = np.flatnonzero(self.pairs[at] == g)
        enough = np.flatnonzero(self.has[np.unique(at[known])].sum(axis=0) >= np.maximum(self.need, 1))
        if not len(enough):
            return []
        b = np.frombuffer(data, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], b != 32, [0]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        got = []
        for t in enough.tolist():
            own = known[self.has[at[known], t]]
            for first, last in self._windows(own.tolist(), at[own].tolist(), float(self.need[t]), self.STRETCH * float(self.has[:, t].sum())):
                lo, hi = max(0, first - self.AROUND), min(len(begin) - 1, last + self.AROUND)
                family, p, c = self.model.classify(data[begin[lo] : end[hi]])
                if family == self.model.classes[self.model.shapes[t][0]]:
                    got.append((int(begin[first]), int(end[last]), family, p, c))
        return _apart(sorted(got, key=lambda x: (-x[4], x[0] - x[1], x)))

    @staticmethod
    def _windows(places: list[int], pairs: list[int], need: float, width: float) -> list[tuple[int, int]]:
        """First and last word of windows with `need` different pairs, each the fullest of those that overlap it, left to right."""
        out: list[tuple[int, int, int]] = []
        inside: dict[int, int] = {}
        i = 0
        for j, (place, pair) in enumerate(zip(places, pairs, strict=True)):
            inside[pair] = inside.get(pair, 0) + 1
            while place - places[i] >= width:
                inside[pairs[i]] -= 1
                if not inside[pairs[i]]:
                    del inside[pairs[i]]
                i += 1
            if len(inside) >= need - 1e-9:
                k, seen = i, dict(inside)
                while seen[pairs[k]] > 1:  # begins as late as it can with the same pairs
                    seen[pairs[k]] -= 1
                    k += 1
                window = (places[k], places[j] + 1, len(inside))
                if out and window[0] <= out[-1][1]:
                    out[-1] = max(out[-1], window, key=lambda w: w[2])
                else:
                    out.append(window)
        return [w[:2] for w in out]


def _overlap(a, b) -> bool:
    return min(a[1], b[1]) - max(a[0], b[0]) > min(a[1] - a[0], b[1] - b[0]) / 2


def _apart(ranked: list[tuple]) -> list[tuple]:
    kept: list[tuple] = []
    for x in ranked:
        if not any(_overlap(x, y) for y in kept):
            kept.append(x)
    return kept


def _runs(parts: list[str]) -> Iterator[tuple[int, str]]:
    """Code point and text of the runs of lines that have words; comment leaders are no words."""
    at, start, run = 0, 0, []
    for part in [*parts, ""]:
        if part.strip() and normalise(part).strip():
            start = start if run else at
            run.append(part)
        elif run:
            yield start, "\n".join(run)
            run = []
        at += len(part) + 1


OUT = "doc_id long, n_paragraphs int, found array<struct<start:long,stop:long,family:string,probability:double,cover:double,confirmed:boolean>>"


def train(docs: DataFrame, sample: int = 400, characters: int = 4000) -> Model:
    """The model; of the corpus it sees at most `sample` different lines, those of least hash, that name no licence, and of each the first `characters`."""
    lines = docs.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike("(?i)licen[cs]|copyright|warrant|permi[st]|rights|spdx|public domain"))
    hashed = lines.where(F.char_length("line") > 20).select(F.xxhash64("line").alias("h"), F.substring("line", 1, characters).alias("line"))
    least = hashed.select("h").distinct().orderBy("h").limit(sample)
    rows = hashed.join(F.broadcast(least), "h").distinct().orderBy("h", "line").collect()
    return Model(TEMPLATES, [*ORDINARY * 5, *(r["line"] for r in rows)])


def scan_licenses(docs: DataFrame, model: Model, probability: float = 0.5, cover: float = 0.6) -> DataFrame:
    """doc_id, n_paragraphs and found (place in code points, family, probability, template cover, confirmed) of every row.

    All paragraphs of whole texts are looked at. One that shares no two-word sequence with a template can't be
    confirmed and isn't classified; the others are, and are found if their class isn't unknown and has at least
    `probability`; they are confirmed if they hold at least `cover` of the word pairs of a template of that family. Null
    and empty texts have nothing; null ids and repeated rows stay; an empty table gives no rows; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = pickle.loads(sent.value)
        passages = Passages(m, cover)
        pairs = passages.pairs
        for f in batches:
            rows = []
            for text in f["text"]:
                text = text if isinstance(text, str) else ""
                found = []
                parts = text.split("\n")
                if text and _touches(normalise(text), pairs):
                    at = 0
                    for part in parts:
                        data = normalise(part)
                        if _touches(data, pairs):
                            family, p, c = m.classify(data)
                            if family != UNKNOWN and p >= probability:
                                found.append({"start": at, "stop": at + len(part), "family": family, "probability": p, "cover": c, "confirmed": c >= cover})
                        at += len(part) + 1
                    found = _with_passages(found, parts, passages, probability, cover)
                rows.append((sum(bool(x.strip()) for x in parts), found))
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "n_paragraphs": [r[0] for r in rows], "found": [r[1] for r in rows]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, OUT)


def _with_passages(found: list[dict], parts: list[str], passages: Passages, probability: float, cover: float) -> list[dict]:
    """Found lines, and the passages that no confirmed line of their family has, by place."""
    sure = [(x["start"], x["stop"], x["family"]) for x in found if x["confirmed"]]
    more = []
    for start, run in _runs(parts):
        data = normalise(run)
        got = [x for x in passages.find(data) if x[3] >= probability and x[4] >= cover]
        if got:
            point = np.cumsum((np.frombuffer(run.encode("utf-8", "surrogatepass"), dtype=np.uint8) & 0xC0) != 0x80)
            more += [{"start": start + int(point[a]) - 1, "stop": start + int(point[z - 1]), "family": k, "probability": p, "cover": c, "confirmed": True} for a, z, k, p, c in got]
    more = [x for x in more if not any(x["family"] == y[2] and _overlap((x["start"], x["stop"]), y) for y in sure)]
    parts_of = lambda x: any(not x["confirmed"] and min(x["stop"], y["stop"]) > max(x["start"], y["start"]) for y in more)
    return sorted([x for x in found if not parts_of(x)] + more, key=lambda x: (x["start"], x["stop"]))


def _touches(data: bytes, pairs: np.ndarray) -> bool:
    h = word_hashes(data)
    if not len(h):
        return False
    g = grams(h, 2)
    at = np.searchsorted(pairs, g)
    at[at == len(pairs)] = 0
    return bool((pairs[at] == g).any())


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_found, licences (confirmed families, sorted, comma-joined) and spans (start:stop:family of confirmed paragraphs).

    See scan_licenses() for nulls, empty and long texts, repeated rows and empty tables.
    """
    found = scan_licenses(docs, train(docs))
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licences"),
        F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x["start"], x["stop"], x["family"])), ",").alias("spans"),
    )


__all__ = ["Model", "TEMPLATES", "license_report", "scan_licenses", "train"]
