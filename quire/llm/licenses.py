"""License scans: a logistic regression over word n-grams names the family of a paragraph's words, a template confirms it.

Paragraphs are parted by empty lines. In each, the model scores every window of SIZES words, so a notice counts the
same in a long line, over many lines or between other text, and no word has to be there for text to be looked at.
Windows that the model may give to a family form regions; in and around these, templates are compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, each, slices, spread, table, tune
from .shingles import _PLACE, LOWER, WS, buffers, mix, word_hashes, words

#: Usual notices of public licences, by family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU General Public License version 2."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU LGPL."],
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "eupl": ["Licensed under the EUPL, Version 1.2 or later", "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"],
    "public-domain": ["This work has been dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission."],
}
#: Sentences on licences that grant nothing, for the class of all else.
OTHERS = [
    "He lost his driving license and had to apply for a new one at the office.", "The company may license the technology to other makers next year.", "Copyright law differs from country to country, as the report explains.",
    "The city revoked the license of the restaurant after the inspection.", "Poetic license lets the author change the order of events.", "The software costs ten euros and needs a license key for each computer.",
    "They discussed the permission of the owner to use the path.", "The public was free to visit the domain of the castle.", "A general public meeting was held under the old bridge.",
    "The apache helicopter landed near the village at night.", "She studied at MIT and later released two records.", "Version 2.0 of the game was released in spring with free maps.",
    "Redistribution of income was the subject of the debate.", "The terms of the contract may be modified by both sides.", "Creative work at school is common, and attribution of ideas is taught early.",
    "Er fuhr mit seiner Schwester mit dem Zug an den See, mit dem Hund und mit viel Zeit.", "Die Lizenz kostet zehn Euro, und alle haben das Recht, mit uns zu reden.", "Wir sprachen mit ihm und mit ihr, all das unter einem Dach.",
    "Elle est venue avec tous ses droits sous le bras, et la loi est la même pour tous.", "Le permis de conduire est valable dix ans dans tout le pays.", "La licencia de pesca cuesta poco, y todos los derechos son de todos.",
    "The general read the public terms in the light of the new version.", "This program was on the radio each week, free for all who paid the fee.", "This work is hard, and all of the rights were sold under pressure.",
    "The source code of the game was lost in a fire.", "They met the following conditions and used the binary form of the answer.",
    "The warranty covers two years of normal use.", "A fishing license is required on this lake.", "The source of the river lies in the hills of the north.",
]
#: The names of an SPDX expression, as words without versions.
SPDX_NAMES = {
    "mit": "mit", "apache": "apache-2.0", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd clause": "bsd", "mpl": "mpl", "isc": "isc", "epl": "epl", "eupl": "eupl", "cc0": "public-domain", "unlicense": "public-domain",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd"}
#: Words that, this near before a notice or in its first words, deny it.
DENIALS, DENIED_WITHIN = {"not", "never", "neither", "nor", "cannot", "isn", "aren", "wasn", "nicht", "pas"}, 3
DIMENSION, GRAMS = 1 << 18, 3
#: Words of a window; a paragraph of fewer words than the smallest isn't scored, as no template is so short.
SIZES = (3, 6, 12, 24)
#: Share of a template's pairs of words that a window must hold; of the negatives' windows that may count as notices of
#: some family in calibration; and of those around which templates are compared.
LEAST_SHARED, MOST_FALSE, MOST_COMPARED = 0.7, 0.001, 0.05
#: Words around a region where a template may go on, and on each side of a span that the model sees too, as the span may lack the word that tells families apart.
AROUND, BESIDE = 48, 3
_ALNUM, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("n_licenses", pa.int64()), ("families", pa.string()), ("spans", pa.string()), ("n_unknown", pa.int64())])


def _hash_of(words_: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words_).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


#: What goes with versions, besides numbers; notices are compared without these.
_VERSION = _hash_of(["version", "only", "or", "later"])


@dataclass
class Words:
    """The words of rows but for versions: hash, start and end in the bytes, paragraph; paragraphs: of each row, those with any word."""

    h: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    paragraph: np.ndarray
    row: np.ndarray
    paragraphs: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    data = LOWER[raw]
    starts, ends, first = words(data, offsets, _ALNUM)
    feeds = np.flatnonzero(data == 10)
    visible = np.cumsum(~WS[data])[feeds] if len(feeds) else feeds
    breaks = np.sort(np.concatenate([offsets, feeds[1:][visible[1:] == visible[:-1]]]))
    paragraph = np.searchsorted(breaks, starts, "right")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    new = np.ones(len(starts), bool)
    new[1:] = paragraph[1:] != paragraph[:-1]
    n = np.bincount(row[new], minlength=len(offsets) - 1)
    h = word_hashes(data, starts, ends)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    letters = letters[ends] - letters[starts]
    keep = (letters > 1) | ((letters == 1) & (data[starts] != 118))
    for v in _VERSION:
        keep &= h != v
    return Words(h[keep], starts[keep], ends[keep], paragraph[keep], row[keep], n)


def tokens(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = words_of(raw, np.array([0, len(raw)]))
    low = LOWER[raw].tobytes()
    return [low[i:j].decode() for i, j in zip(w.starts.tolist(), w.ends.tolist())]


def grams(h: np.ndarray) -> list[np.ndarray]:
    """Buckets of all n-grams of one, two and three words, by the place of their first word."""
    out, x = [], np.zeros(len(h), np.uint64)
    for n in range(GRAMS):
        x = x[: max(0, len(h) - n)] + h[n:] * _PLACE[n]
        out.append((mix(x + _PLACE[40 + n]) >> np.uint64(46)).astype(np.int64))
    return out


def n_grams(size: int) -> int:
    return sum(max(0, size - n) for n in range(GRAMS))


@dataclass
class Model:
    """weights: for each bucket the logits of the families less that of all else; least: the probability that something
    is in any family from which on the model says so; maybe: that from which on templates are compared."""

    families: list[str]
    weights: np.ndarray
    temperature: float
    least: float
    maybe: float

    def __post_init__(self) -> None:
        self.most = self.weights.max(axis=1)

    def logits(self, h: np.ndarray) -> np.ndarray:
        return self.weights[np.concatenate(grams(h))].sum(axis=0) / max(1.0, n_grams(len(h)) ** 0.5) / self.temperature

    def probabilities(self, h: np.ndarray) -> np.ndarray:
        """Of the families and, last, of all else."""
        z = np.append(self.logits(h), 0.0)
        p = np.exp(z - z.max())
        return p / p.sum()

    def passing(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """How many of the windows that the model may give (maybe), and that it gives (least), to a family each word is
        in. A window's sum of the largest weights bounds that of each family, so the few windows that it lets through are
        computed in full."""
        n = len(w.h)
        cover, sure, buckets = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), grams(w.h)
        bound = [np.concatenate([[0.0], np.cumsum(self.most[b], dtype=np.float64)]) for b in buckets]
        odds, high = (np.log(p / (1 - p)) for p in (self.maybe, self.least))
        for size in SIZES:
            if n < size:
                break
            scale = n_grams(size) ** 0.5 * self.temperature
            m = n - size + 1
            most = sum(s[size - k : size - k + m] - s[:m] for k, s in enumerate(bound))
            maybe = np.flatnonzero((most >= (odds - np.log(len(self.families))) * scale) & (w.paragraph[:m] == w.paragraph[size - 1 :]))
            for at in (maybe[i : i + 4096] for i in range(0, len(maybe), 4096)):
                z = sum(self.weights[b[at[:, None] + np.arange(size - k)]].sum(axis=1) for k, b in enumerate(buckets)) / scale
                top = z.max(axis=1)
                z = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
                for held, over in ((cover, odds), (sure, high)):
                    np.add.at(held, at[z >= over], 1)
                    np.add.at(held, at[z >= over] + size, -1)
        return np.cumsum(cover)[:n], np.cumsum(sure)[:n]


def examples(seed: int, n: int, templates: list[tuple[int, str]], others: list[str]) -> tuple[list[list[str]], list[int]]:
    """Templates (family, text) with words lost, changed and added around, and other sentences treated alike or mixed from all."""
    rng = np.random.default_rng(seed)
    notices = [(i, tokens(t)) for i, t in templates]
    rest = [tokens(t) for t in others]
    pool = sorted({w for t in rest for w in t} | {w for _, t in notices for w in t})
    noise = lambda k: [str(w) for w in rng.choice(pool, k)] if rng.random() < 0.5 else ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(k)]
    rows, labels = [], []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            label, row = notices[rng.integers(len(notices))]
            row = [w for w in row if rng.random() > 0.04] or row
        else:
            label, row = len(TEMPLATES), rest[rng.integers(len(rest))] if kind < 0.8 else noise(int(rng.integers(3, 30)))
        rows.append(noise(int(rng.integers(0, 6))) + row + noise(int(rng.integers(0, 6))) if rng.random() < 0.6 else row)
        labels.append(label)
    return rows, labels


def fitted(templates: list[tuple[int, str]], others: list[str]) -> Model:
    """Multinomial logistic regression by stochastic gradient descent; always the same model."""
    rows, labels = examples(1, 4000, templates, others)
    k, found = len(TEMPLATES) + 1, [np.concatenate(grams(_hash_of(r))) for r in rows]
    weights, rng = np.zeros((DIMENSION, k)), np.random.default_rng(2)
    for epoch in range(6):
        for i in rng.permutation(len(rows)):
            f, scale = found[i], max(1.0, len(found[i]) ** 0.5)
            z = weights[f].sum(axis=0) / scale
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            np.subtract.at(weights, f, 0.8 / (1 + epoch) * p / scale)
    weights[np.abs(weights) < 1e-4] = 0
    return Model(list(TEMPLATES), (weights[:, :-1] - weights[:, -1:]).astype(np.float32), 1.0, 0.5, 0.5)


@lru_cache(1)
def model() -> Model:
    """The model of all templates and other sentences. It is calibrated by one that has learned from half of each family's
    templates and two of three sentences: on what that one hasn't seen a temperature is fitted by likelihood, so that it
    stands for notices in words of their own, and the probabilities so that few windows of negatives pass."""
    every = [(i, t) for i, f in enumerate(TEMPLATES.values()) for t in f]
    seen = [(i, t) for i, f in enumerate(TEMPLATES.values()) for n, t in enumerate(f) if n % 2 == 0]
    negatives = [t for i, t in enumerate(OTHERS) if i % 3]
    out, half = fitted(every, OTHERS), fitted(seen, negatives)
    held, want = examples(3, 1500, [x for x in every if x not in seen], OTHERS[::3])
    z = np.stack([np.append(half.logits(_hash_of(r)), 0) for r in held])

    def loss(t: float) -> float:
        y = z / t - np.log(np.exp(z / t).sum(axis=1, keepdims=True))
        return -float(y[np.arange(len(want)), want].mean())

    out.temperature = half.temperature = min((0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    wrong = [1 - float(half.probabilities(h[i : i + s])[-1]) for r, y in zip(held, want) if y == len(TEMPLATES) for h in [_hash_of(r)] for s in SIZES for i in range(len(h) - s + 1)]
    wrong.sort(reverse=True)
    out.least, out.maybe = (max(0.5, wrong[int(share * len(wrong))] + 1e-7) for share in (MOST_FALSE, MOST_COMPARED))  # above that window itself
    plain = [1 - float(out.probabilities(h[i : i + s])[-1]) for t in OTHERS for h in [_hash_of(tokens(t))] for s in SIZES for i in range(len(h) - s + 1)]
    out.least = max(out.least, max(plain) + 1e-7)  # none of the sentences, as they are
    return out


@lru_cache(1)
def _pairs() -> tuple[list[tuple[str, int, int]], dict[tuple[str, str], list[int]]]:
    """Of each template its family, number of distinct pairs of words, and longest window; and the templates of a pair."""
    found, of = [], {}
    for family, texts in TEMPLATES.items():
        for row in map(tokens, texts):
            pairs = set(zip(row, row[1:]))
            for x in pairs:
                of.setdefault(x, []).append(len(found))
            found.append((family, len(pairs), len(row) + len(row) // 2 + 3))
    return found, of


def candidates(row: list[str]) -> list[tuple[float, int, int, str, int]]:
    """(share of a template's pairs, first word, end, family, pairs of the template) of windows that confirm a template, of any place and line."""
    templates, of = _pairs()
    hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for i, x in enumerate(zip(row, row[1:])):
        for k in of.get(x, ()):
            hits.setdefault(k, []).append((i, x))
    best: dict[tuple[int, int], tuple[float, int, int, str, int]] = {}
    for k, at in hits.items():
        family, n, longest = templates[k]
        if len(at) < LEAST_SHARED * n:
            continue
        for i, (start, _) in enumerate(at):
            seen, last = set(), start
            for place, x in at[i : i + longest]:
                if place + 2 - start > longest:
                    break
                if x not in seen:
                    seen.add(x)
                    last = place
            found = (len(seen) / n, start, last + 2, family, n)
            if found[0] >= LEAST_SHARED and found[:2] > best.get((k, last), (0.0, 0))[:2]:
                best[k, last] = found
    return list(best.values())


def confirmed(m: Model, row: list[str], h: np.ndarray) -> list[tuple[int, int, str]]:
    """(first word, end, family) of the notices among the words of one paragraph: windows that hold enough of a template
    of the family that the model gives them, unless they are denied. Of those that overlap the one with the largest share
    of its template counts, then that of the longest template, the shortest, the most probable."""
    ranked = []
    for share, a, b, family, pairs in candidates(row):
        p = m.probabilities(h[max(0, a - BESIDE) : b + BESIDE])
        if m.families[int(p[:-1].argmax())] == family and p[-1] <= 0.5:  # a region is one of least probability already
            ranked.append((-share, -pairs, b - a, -float(p.max()), a, b, family))
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(row))
    for *_, a, b, family in sorted(ranked):
        if any(taken[a:b]) or DENIALS & set(row[max(0, a - DENIED_WITHIN) : a + DENIED_WITHIN]):
            continue
        for a, b, family in expression(row, a, b, family):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, family))
    return sorted(out)


def expression(row: list[str], a: int, b: int, family: str) -> list[tuple[int, int, str]]:
    """A notice, and if it is an SPDX line the further licences that its expression names, each a span of its own."""
    found = [(a, b, family)]
    if row[a : a + 3] != ["spdx", "license", "identifier"]:
        return found
    at, first = a + 3, True
    while at < len(row):
        if row[at] in ("and", "with") and not first:
            at += 1
            continue
        name = next((n for n in (4, 3, 2, 1) if at + n <= len(row) and " ".join(row[at : at + n]) in SPDX_NAMES), 0)
        if not name:
            break
        kind = SPDX_NAMES[" ".join(row[at : at + name])]
        if first:
            found = [(a, at + name, kind)]
        else:
            found.append((at, at + name, kind))
        at, first = at + name, False
    return found


def regions(inside: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, int]]:
    """Runs of marked words of one paragraph."""
    new = np.ones(len(inside), bool)
    new[1:] = (paragraph[1:] != paragraph[:-1]) | ~inside[:-1]
    last = np.ones(len(inside), bool)
    last[:-1] = (paragraph[1:] != paragraph[:-1]) | ~inside[1:]
    return list(zip(np.flatnonzero(inside & new).tolist(), (np.flatnonzero(inside & last) + 1).tolist()))


def scanned(m: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int, str]], int]]]:
    """Number of paragraphs of each row, and for rows with a region (start, end, family) of the notices, in code points,
    and the number of regions that no notice lies in."""
    w = words_of(raw, offsets)
    inside, sure = (x > 0 for x in m.passing(w))
    found: dict[int, tuple[list[tuple[int, int, str]], int]] = {}
    if not inside.any():
        return w.paragraphs, found
    cores = regions(sure, w.paragraph)
    wide = np.zeros(len(inside) + 1, np.int64)
    for a, b in regions(inside, w.paragraph):
        first = np.searchsorted(w.paragraph, w.paragraph[a])
        wide[max(first, a - AROUND)] += 1
        wide[min(np.searchsorted(w.paragraph, w.paragraph[a], "right"), b + AROUND)] -= 1
    low, spans = LOWER[raw].tobytes(), []
    for a, b in regions(np.cumsum(wide)[:-1] > 0, w.paragraph):
        row = [low[i:j].decode() for i, j in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist())]
        spans += [(a + i, a + j, f) for i, j, f in confirmed(m, row, w.h[a:b])]
    begins = np.array([a for a, _, _ in spans], np.int64)
    ends = np.array([b for _, b, _ in spans], np.int64)
    for a, b in cores:  # spans don't overlap, so both their ends ascend
        known = np.searchsorted(ends, a, "right") < np.searchsorted(begins, b)
        r = int(w.row[a])
        found[r] = (found.get(r, ([], 0))[0], found.get(r, ([], 0))[1] + (not known))
    for a, b, f in spans:
        r = int(w.row[a])
        letters = np.cumsum((raw[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80) if r not in found or not found[r][0] else letters
        place = lambda x: int(letters[x - offsets[r]]) - 1
        found.setdefault(r, ([], 0))[0].append((place(w.starts[a]), place(w.ends[b - 1] - 1) + 1, f))
    return w.paragraphs, found


def scan(text: str) -> tuple[int, list[tuple[int, int, str]], int]:
    """n_paragraphs, spans and n_unknown of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n, found = scanned(model(), raw, np.array([0, len(raw)]))
    return (int(n[0]), *found.get(0, ([], 0)))


def _scan(shared):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, (raw, offsets) = shared.value, buffers(b.column("text"))
        n, found = np.zeros(b.num_rows, np.int64), {}
        for i, j in slices(np.diff(offsets).tolist(), 1 << 18):
            n[i:j], got = scanned(m, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            found |= {i + r: x for r, x in got.items()}
        rows = [found.get(i, ([], 0)) for i in range(b.num_rows)]
        return batches({
            "doc_id": b.column("doc_id"), "n_paragraphs": n, "n_licenses": [len(x) for x, _ in rows], "families": [",".join(sorted({f for _, _, f in x})) for x, _ in rows],
            "spans": [",".join(f"{f}:{s}:{e}" for s, e, f in x) for x, _ in rows], "n_unknown": [u for _, u in rows]}, _SCHEMA)

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_paragraphs (blocks between empty lines that have a word of ASCII), n_licenses,
    families (sorted, joined by commas), spans (family:start:end in code points, end exclusive, none of which overlap),
    n_unknown (regions that the model gives to a family and that hold no notice which a template confirms).

    The model is learned on the driver and broadcast (DIMENSION weights for each family). A null or empty text has no
    paragraph. Repeated rows give repeated results; other columns are not read."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        each(_scan(shared)), "doc_id long, n_paragraphs long, n_licenses long, families string, spans string, n_unknown long")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spread(table(spark, sf_dir, "documents")))
