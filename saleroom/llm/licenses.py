"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text, and the runs of lines over which a hard-wrapped notice goes
on, up to a line without a word. Their word 1-, 2- and 3-grams are hashed into a sparse
vector (each gram once) and a multinomial logistic regression gives a licence family or
`unknown`. It is trained in numpy on notices written from the templates below, with words
dropped, added and exchanged, and on at most `PLAIN_ROWS` paragraphs of the corpus itself that
share no three words in a row with a template, as `unknown`. The level that a family's
probability must reach is calibrated on paragraphs kept out of training that a template confirms. A prediction counts
only if the paragraph also holds enough of one of that family's templates.

Families whose notices differ in a word or two (the GNU, Apache, BSD and Creative Commons ones)
form a stem: the classifier answers for the stem, its marks (a version, `Affero`, `Lesser`, `NC
SA`) tell the family, and a template of that very family confirms it. A GNU notice without a
version counts as gpl-3.0; the BSD conditions are the same in bsd and bsd-2, so only a name tells
bsd-2.

Null, empty and blank texts have no paragraphs and no licence. Repeated rows are rows,
repeated paragraphs are counted. A very long text or paragraph is read whole, in pieces of
whole texts. Empty tables give an empty result. Other columns, whatever their names, are
passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.llm.tokens import SpanHash, buffer_of, column, mixed, pieces, sampled, segment_sums, small_batches

# How public licences are commonly named in notices, and the paragraphs they are known by.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "This file is licensed to you under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license",
    ),
    "apache-1.1": (
        "Licensed under the Apache Software License, Version 1.1",
        "Licensed under the Apache License, Version 1.1",
        "SPDX-License-Identifier: Apache-1.1",
        "Released under the Apache 1.1 license",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0",
        "Released under the GNU GPL version 3",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0",
        "Released under the GNU GPL version 2",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1",
        "Released under the GNU LGPL version 3",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0",
        "Released under the GNU AGPL version 3",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the '
        "warranties of merchantability, fitness for a particular purpose and noninfringement",
    ),
    "isc": (
        "Released under the ISC License",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ),
    "bsd-2": (
        "Licensed under the BSD 2-Clause License",
        "Released under the Simplified BSD License",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Eclipse Public License 2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nc-sa": (
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "cc-by-nc-nd": (
        "Licensed under CC BY-NC-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright: CC0 1.0 Universal",
        "Released into the public domain under CC0 1.0",
    ),
    "all-rights-reserved": ("All rights reserved", "Copyright. All rights reserved worldwide"),
}
# Families with near relatives, and the words, or two words in a row, that tell each from those after it.
STEMS: dict[str, dict[str, tuple[str, ...]]] = {
    "gnu": {
        "agpl-3.0": ("affero", "agpl", "agplv3"),
        "lgpl": ("lesser", "lgpl", "gnu library", "lgplv2", "lgplv3"),
        "gpl-2.0": ("version 2", "gpl 2", "license 2", "v2", "gplv2"),
        "gpl-3.0": (),
    },
    "apache": {"apache-1.1": ("version 1", "apache 1", "license 1"), "apache-2.0": ()},
    "bsd": {"bsd-2": ("2 clause", "simplified bsd", "two clause"), "bsd": ()},
    "creative commons": {
        "cc-by-nc-sa": ("nc sa", "noncommercial sharealike"),
        "cc-by-nc-nd": ("nc nd", "noncommercial noderivatives", "noncommercial noderivs"),
        "cc-by-nc": ("by nc", "attribution noncommercial"),
        "cc-by-nd": ("by nd", "attribution noderivatives", "attribution noderivs"),
        "cc-by-sa": ("by sa", "attribution sharealike"),
        "cc-by": (),
    },
}
STEM_OF = {family: next((stem for stem, of in STEMS.items() if family in of), family) for family in TEMPLATES}
UNKNOWN = "unknown"

BUCKETS = 1 << 15
ORDERS = 3
PLAIN_ROWS = 8_000
VARIANTS = 100
EPOCHS = 20
STEP = 1.0
# Share of a template's words, in order of 2-grams, that a paragraph must hold.
HELD = 0.6
# Share of calibration paragraphs without a licence that may pass the level.
FALSE_SHARE = 0.0005

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
# Bytes of a word: letters, digits, everything outside ASCII, and the joints of versions and names.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Grams:
    """bucket of each word gram; paragraph it is in; text and line of each paragraph; hashes of words and their paragraphs."""

    bucket: np.ndarray
    owner: np.ndarray
    text: np.ndarray
    line: np.ndarray
    words: np.ndarray
    word_owner: np.ndarray


def _gram_buckets(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, owner) of the word 1- to 3-grams, each once an owner."""
    buckets, owners = [], []
    key = np.zeros(len(h), np.uint64)
    for n in range(1, ORDERS + 1):
        m = max(0, len(h) - n + 1)
        key = mixed(key[:m] * np.uint64(31) + h[n - 1 :])
        pick = np.flatnonzero(owner[:m] == owner[n - 1 :]) if m else np.zeros(0, np.int64)
        buckets.append((key[pick] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[pick])
    once = np.unique(np.concatenate(owners) * BUCKETS + np.concatenate(buckets))
    return once % BUCKETS, once // BUCKETS


def grams(texts: pa.Array) -> Grams:
    """Word 1- to 3-grams of every paragraph (line with a word) of the texts, ASCII letters lower-cased."""
    data, at = buffer_of(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _INSIDE[data]
    edge = at[(at > 0) & (at < len(data))]
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    begin[edge] = inside[edge + 1]
    end[edge - 1] = inside[edge]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    h = SpanHash(data).of(starts, ends)
    # a paragraph ends with its line and with its text
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10), at[1:-1]]))
    line = np.searchsorted(breaks, starts, "right")
    lines, owner = np.unique(line, return_inverse=True)
    text = np.searchsorted(at, starts[np.searchsorted(line, lines)], "right") - 1 if len(lines) else np.zeros(0, np.int64)
    bucket, of = _gram_buckets(h, owner)
    return Grams(bucket, of, text, lines, h, owner)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mixed(h[:-1] * np.uint64(31) + h[1:])


@dataclass
class Template:
    """family; distinct hashes of two words in a row; hashes of the words that no other stem's templates hold."""

    family: str
    pairs: np.ndarray
    own: np.ndarray


def _word_hashes(text: str) -> np.ndarray:
    return grams(pa.array([text])).words


def template_pairs() -> list[Template]:
    words = [(family, _word_hashes(notice)) for family, notices in TEMPLATES.items() for notice in notices]
    found = []
    for family, w in words:
        others = np.concatenate([v for f, v in words if STEM_OF[f] != STEM_OF[family]])
        found.append(Template(family, np.unique(pair_hashes(w)), np.setdiff1d(w, others)))
    return found


def _phrase(phrase: str) -> int:
    """The hash of a word, or of two words in a row."""
    h = _word_hashes(phrase)
    return int(pair_hashes(h)[0] if len(h) > 1 else h[0])


def _marks() -> dict[str, dict[str, np.ndarray]]:
    return {stem: {f: np.array([_phrase(x) for x in marks], np.uint64) for f, marks in of.items()} for stem, of in STEMS.items()}


def named(words: np.ndarray, stem: str, marks: dict[str, dict[str, np.ndarray]]) -> str:
    """The family of a stem that the words speak of: the first one with a mark among them, else the last."""
    seen = np.concatenate([words, pair_hashes(words)])
    return next((f for f, of in marks[stem].items() if np.isin(of, seen).any()), [*marks[stem]][-1]) if stem in marks else stem


@dataclass
class LicenceModel:
    families: list[str]  # the last is UNKNOWN
    weights: np.ndarray
    bias: np.ndarray
    level: float

    def probabilities(self, g: Grams) -> np.ndarray:
        first = np.searchsorted(g.owner, np.arange(len(g.text) + 1))
        sums = segment_sums(self.weights[g.bucket], first)
        z = sums / np.sqrt(np.maximum(np.diff(first), 1))[:, None] + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return e / e.sum(axis=1, keepdims=True) if len(z) else e

    def stems(self, p: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The stems, UNKNOWN last, and their probabilities: relatives share one, as their notices differ in a word or two."""
        names = [*dict.fromkeys(STEM_OF.get(f, f) for f in self.families)]
        of = np.array([names.index(STEM_OF.get(f, f)) for f in self.families])
        return names, np.stack([p[:, of == k].sum(axis=1) for k in range(len(names))], axis=1)


def _held(words: np.ndarray, family: str, templates: list[Template]) -> tuple[float, int]:
    """(share, number of pairs) of the family's template that the words hold best; 0 without that template's own words."""
    pairs, best = np.unique(pair_hashes(words)), (0.0, 0)
    for t in templates:
        if t.family == family and len(t.pairs) and (not len(t.own) or np.isin(t.own, words).mean() >= HELD):
            n = int(np.isin(t.pairs, pairs).sum())
            best = max(best, (n / len(t.pairs), n))
    return best


def confirmed(g: Grams, paragraph: int, family: str, templates: list[Template], marks: dict[str, dict[str, np.ndarray]] | None = None) -> float:
    """The largest share of one of the family's templates that the paragraph holds; 0 if its words speak of a relative."""
    a, b = np.searchsorted(g.word_owner, [paragraph, paragraph + 1])
    words = g.words[a:b]
    if named(words, STEM_OF[family], marks or _marks()) != family:
        return 0.0
    return _held(words, family, templates)[0]


@dataclass
class Notice:
    """A licence found: number of its text, first and last paragraph, and what speaks for it."""

    text: int
    first: int
    last: int
    family: str
    probability: float
    share: float
    pairs: int


def on_lines(g: Grams, model: LicenceModel, templates: list[Template], marks: dict[str, dict[str, np.ndarray]]) -> list[Notice]:
    """Notices of single lines: the classifier names the stem, marks the family, a template confirms it."""
    names, p = model.stems(model.probabilities(g))
    if not len(p):
        return []
    best = p.argmax(axis=1)
    out = []
    for k in np.flatnonzero((best < len(names) - 1) & (p.max(axis=1) >= model.level)):
        a, b = np.searchsorted(g.word_owner, [k, k + 1])
        family = named(g.words[a:b], names[best[k]], marks)
        share, n = _held(g.words[a:b], family, templates)
        if share >= HELD:
            out.append(Notice(int(g.text[k]), int(k), int(k), family, float(p[k, best[k]]), share, n))
    return out


def wrapped(g: Grams, model: LicenceModel, templates: list[Template], marks: dict[str, dict[str, np.ndarray]]) -> list[Notice]:
    """Notices that go on over the lines of one block, a run of lines with words.

    A notice lies within twice its template's words, so that common pairs of a long block do not
    add up to one. Its lines together are classified as one line is.
    """
    if len(g.words) < 2:
        return []
    goes_on = (g.text[1:] == g.text[:-1]) & (g.line[1:] == g.line[:-1] + 1)
    block = np.concatenate([[0], np.cumsum(~goes_on)])[g.word_owner]
    pairs = pair_hashes(g.words)
    hit = np.flatnonzero(np.isin(pairs, np.unique(np.concatenate([t.pairs for t in templates]))) & (block[1:] == block[:-1]))
    spans: set[tuple[int, int, str]] = set()
    for t in templates:
        own = hit[np.isin(pairs[hit], t.pairs)]
        # a block's words come before the next one's: its hits are cut off where it ends
        until = np.minimum(own + 2 * len(t.pairs) + 1, np.searchsorted(block, block[own], "right") - 1)
        stop = np.searchsorted(own, until, "left")
        for i in np.flatnonzero(stop - np.arange(len(own)) >= HELD * len(t.pairs)):
            a, b = int(g.word_owner[own[i]]), int(g.word_owner[own[stop[i] - 1] + 1])
            if b > a and len(np.unique(pairs[own[i : stop[i]]])) >= HELD * len(t.pairs):
                spans.add((a, b, STEM_OF[t.family]))
    if not spans:
        return []
    of = sorted(spans)
    first = np.searchsorted(g.word_owner, np.arange(len(g.text) + 1))
    words = [g.words[first[a] : first[b + 1]] for a, b, _ in of]
    flat, owner = np.concatenate(words), np.repeat(np.arange(len(of)), [len(w) for w in words])
    together = Grams(*_gram_buckets(flat, owner), np.array([g.text[a] for a, _, _ in of]), np.arange(len(of)), flat, owner)
    names, p = model.stems(model.probabilities(together))
    out = []
    for (a, b, stem), w, row in zip(of, words, p):
        if names[int(row.argmax())] == stem and row.max() >= model.level:
            family = named(w, stem, marks)
            share, n = _held(w, family, templates)
            if share >= HELD:
                out.append(Notice(int(g.text[a]), a, b, family, float(row.max()), share, n))
    return out


def notices(g: Grams, model: LicenceModel, templates: list[Template], marks: dict[str, dict[str, np.ndarray]]) -> list[Notice]:
    """All notices in order; of those of one stem that share a line, the one that holds most of its template's pairs, then the shortest."""
    found = on_lines(g, model, templates, marks) + wrapped(g, model, templates, marks)
    taken: set[tuple[int, str]] = set()
    out = []
    for x in sorted(found, key=lambda x: (-x.pairs, x.last - x.first, x.first, x.family)):
        lines = {(k, STEM_OF[x.family]) for k in range(x.first, x.last + 1)}
        if not lines & taken:
            taken |= lines
            out.append(x)
    return sorted(out, key=lambda x: (x.first, x.family))


def variants(notice: str, rng: np.random.Generator, others: list[str]) -> str:
    """A notice as people write it: some words lost or swapped, other words around it."""
    words = [w for w in notice.split() if rng.random() > 0.06]
    words = [w.upper() if rng.random() < 0.05 else w for w in words]
    around = [others[i] for i in rng.integers(0, len(others), rng.integers(0, 8))] if others and rng.random() < 0.5 else []
    cut = int(rng.integers(0, len(around) + 1))
    return " ".join([*around[:cut], *words, *around[cut:]])


def trained(plain: list[str], seed: int = 19) -> LicenceModel:
    """Logistic regression by stochastic gradient descent; every fifth paragraph calibrates the level."""
    rng = np.random.default_rng(seed)
    others = [w for p in plain[:500] for w in p.split()[:20]]
    families = [*TEMPLATES, UNKNOWN]
    texts, y = [], []
    for k, family in enumerate(TEMPLATES):
        for notice in TEMPLATES[family]:
            texts += [notice] + [variants(notice, rng, others) for _ in range(VARIANTS)]
            y += [k] * (VARIANTS + 1)
    # single words and pairs of the templates alone are no licence
    loose = sorted({w for notices in TEMPLATES.values() for n in notices for w in n.split()})
    stray = [" ".join(rng.permutation(loose)[: rng.integers(1, 4)]) + " " + " ".join(rng.permutation(others)[: rng.integers(0, 12)]) for _ in range(600)]
    # unless they happen to make a whole notice
    g, templates = grams(pa.array(stray)), template_pairs()
    whole = {int(t) for k, t in enumerate(g.text) if any(_held(g.words[g.word_owner == k], f, templates)[0] >= HELD for f in TEMPLATES)}
    stray = [x for k, x in enumerate(stray) if k not in whole]
    texts += [p.replace("\n", " ") for p in plain] + stray
    y += [len(families) - 1] * (len(plain) + len(stray))
    keep = [i for i, t in enumerate(texts) if t.strip()]
    texts, labels = [texts[i].replace("\n", " ") for i in keep], np.array([y[i] for i in keep])
    g = grams(pa.array(texts))
    rows = g.text  # texts without a word have no paragraph
    first = np.searchsorted(g.owner, np.arange(len(rows) + 1))
    labels = labels[rows]
    order = rng.permutation(len(rows))
    held, learn = order[::5], np.setdiff1d(order, order[::5])
    weights, bias = np.zeros((BUCKETS, len(families))), np.zeros(len(families))
    for epoch in range(EPOCHS):
        rng.shuffle(learn)
        rate = 0.5 / (1 + epoch / 5)
        for a in range(0, len(learn), 256):
            pick = learn[a : a + 256]
            sizes = first[pick + 1] - first[pick]
            spans = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            bucket, scale = g.bucket[spans], 1 / np.sqrt(np.maximum(sizes, 1))
            z = segment_sums(weights[bucket], np.concatenate([[0], np.cumsum(sizes)])) * scale[:, None] + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            used, back = np.unique(bucket, return_inverse=True)
            steps = np.repeat(p * scale[:, None], sizes, axis=0)
            weights[used] -= rate * STEP * np.stack([np.bincount(back, steps[:, k], len(used)) for k in range(len(families))], axis=1)
            bias -= rate * p.mean(axis=0)
    model = LicenceModel(families, weights, bias, 0.5)
    blank = np.isin(np.arange(len(rows)), held) & (labels == len(families) - 1)
    if blank.any():
        # what no template confirms cannot come through, whatever its probability
        passed = [x.probability for x in on_lines(g, model, template_pairs(), _marks()) if blank[x.first]]
        scores = np.concatenate([passed, np.zeros(int(blank.sum()) - len(passed))])
        model.level = float(np.clip(np.quantile(scores, 1 - FALSE_SHARE), 0.5, 0.9))
    return model


def learned(docs: DataFrame, text: str = "text") -> LicenceModel:
    """The model, with a bounded sample of the corpus's paragraphs (smallest hashes) as `unknown`."""
    paragraphs = docs.select(F.explode(F.split(F.col(text), "\n")).alias("p")).where(F.trim("p") != "")
    # a line that is everywhere counts once: cut by hash first, then only different ones
    n = paragraphs.count()
    share = min(1.0, 20 * PLAIN_ROWS / max(1, n))
    few = paragraphs.where(F.shiftrightunsigned(F.xxhash64("p"), 1) <= F.lit(min(2**63 - 1, int(share * 2**63)))).distinct()
    sample = sampled(few, F.xxhash64("p"), PLAIN_ROWS).collect()
    known = {" ".join(w[i : i + 3]) for notices in TEMPLATES.values() for n in notices for w in [_WORD.findall(n.lower())] for i in range(len(w) - 2)}
    plain = []
    for row in sample:
        words = _WORD.findall(row["p"].lower())
        if not any(" ".join(words[i : i + 3]) in known for i in range(len(words) - 2)):
            plain.append(row["p"])
    return trained(plain)


def licences(docs: DataFrame, model: LicenceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph (number of its first line among the lines with a word, from 0), family, probability and template_share of every licence found."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, templates, marks = shared.value, template_pairs(), _marks()
        for batch in batches:
            for piece in pieces(batch):
                g = grams(column(piece, "text"))
                found = notices(g, model, templates, marks)
                ids = column(piece, "doc_id")
                first = np.searchsorted(g.text, np.arange(piece.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([f.text for f in found], pa.int64())),
                        pa.array([int(f.first - first[f.text]) for f in found], pa.int64()),
                        pa.array([f.family for f in found], pa.string()),
                        pa.array([f.probability for f in found], pa.float64()),
                        pa.array([f.share for f in found], pa.float64()),
                    ],
                    ["doc_id", "paragraph", "family", "probability", "template_share"],
                )

    return rows.mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, paragraph bigint, family string, probability double, template_share double"
    )
