"""License scans: a trained paragraph classifier, confirmed by templates.

Licence paragraphs are looked for around words that licences use, in sentences however long
the line or text around them is, also across wrapped lines. The features of such a span are
hashed runs of one to three words; multinomial logistic regression over their shares gives
each licence family, an unknown licence, or no licence at all. It is trained on this
module's templates, varied by dropped words and by words around them, on licence sentences
with invented names (class unknown), on sentences that use the word otherwise and on lines of a
bounded sample of documents that share few words with any template (class none). Held-out
variants calibrate the probabilities by one temperature, and give the probability under which
a family is reported as unknown. A family is confirmed by that of its templates whose
neighbouring words the span holds in largest part, and by what tells it from its
neighbours: its name, its version, its conditions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairlift.llm.common import Words, id_and_text, mix64, segment_sums, slices

# Licence families, short statements of them, and their SPDX identifiers.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache License 2.0.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "isc": [
        "Released under the ISC License.",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Released under the GNU GPL version 3 or later.",
        "GNU General Public License Version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "Released under the GNU GPL version 2.",
        "GNU General Public License Version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This work is licensed under the GNU General Public License.",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "bsd-2-clause": [
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
UNKNOWN_FORMS = [
    "Licensed under the {} License.",
    "Released under the {} Public License, version {}.",
    "This work is licensed under {} {}.",
    "All rights reserved. Use is subject to the {} licence terms.",
]
NONE_FORMS = [
    "His driving licence had expired {} years before.",
    "The licence plate began with {} and {}.",
    "She took some poetic license with the story of {}.",
    "The council refused to license the premises in {}.",
    "A licence fee of {} is paid every year.",
    "The commons of {} lay in the mist.",
    "Public opinion in {} changed within a year.",
    "He asked for permission to use the garden of {}.",
]

# What a family's span must and must not say, terms parted by spaces.
_GPL, _NOT_GPL = r"general public licen[sc]e|\bgplv?\d?\b", r"affero|lesser|library general|agpl|lgpl"
_CC = r"\bcc by\b|creative commons attribution"
_NC, _SA, _ND = r"\bnc\b|non ?commercial", r"\bsa\b|share ?alike", r"\bnd\b|no ?deriv"
_V3, _V2 = r"(version|v|gpl|gplv|licen[sc]e) ?3\b", r"(version|v|gpl|gplv|licen[sc]e) ?2\b"
RULES = {
    "apache-2.0": ([r"\bapache\b", r"\b2\b"], []),
    "mit": ([r"\bmit\b|permission is hereby granted free of charge"], []),
    "isc": ([r"\bisc\b|permission to use copy modify and or distribute"], []),
    "gpl-3.0": ([_GPL, _V3], [_NOT_GPL, _V2]),
    "gpl-2.0": ([_GPL, _V2], [_NOT_GPL, _V3]),
    "gpl": ([_GPL], [_NOT_GPL, _V2, _V3]),
    "agpl-3.0": ([r"affero|agpl", r"\b(v|agplv)?3\b"], []),
    "lgpl": ([r"lesser general|library general|lgpl"], []),
    "bsd": ([r"\bbsd\b|redistribution and use in source and binary forms"], [r"\b[02] clause|\btwo clause|simplified bsd"]),
    "bsd-2-clause": ([r"\bbsd 2 clause|\btwo clause bsd|simplified bsd"], []),
    "mpl-2.0": ([r"mozilla|\bmpl\b", r"\b2\b"], []),
    "cc-by": ([_CC], [_NC, _SA, _ND]),
    "cc-by-sa": ([_CC, _SA], [_NC, _ND]),
    "cc-by-nc": ([_CC, _NC], [_SA, _ND]),
    "cc-by-nd": ([_CC, _ND], [_NC, _SA]),
    "cc-by-nc-sa": ([_CC, _NC, _SA], [_ND]),
    "cc-by-nc-nd": ([_CC, _NC, _ND], [_SA]),
    "public-domain": ([r"public domain|\bcc0\b|unencumbered"], []),
}
_RULES = {f: ([re.compile(x) for x in need], [re.compile(x) for x in lack]) for f, (need, lack) in RULES.items()}

# Words around which a licence is looked for.
ANCHOR = (
    r"licen[sc]e|\bgnu\b|\b[al]?gpl|creative commons|\bcc[ -]by\b|\bcc0\b|public domain|unencumbered|permission (is hereby|to use)"
    r"|redistribution and use|\bspdx\b|rights reserved|\bmpl\b"
)
_ANCHOR = re.compile(ANCHOR, re.IGNORECASE)
_TERM = re.compile(r"[^\W_]+")
# Where a sentence ends, or a line that isn't wrapped; terms before and after an anchor that make its spans.
_BREAK = re.compile(r"(?<=[.!?;])\s+(?=[\"'(]?[A-Z])|(?<=[.!?;:])[\")]?[^\S\n]*\n|\n\s*\n")
SPANS = [(2, 1), (4, 2), (8, 14), (14, 34)]
JOINED = 12

NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, UNKNOWN, *TEMPLATES]
BUCKETS = 1 << 16
RUN = 3
VARIANTS = 25
EPOCHS = 6
RATE = 6.0
SEED = 5
# The lines learned as no licence: those of so many documents, so many, of so many characters at most.
SAMPLE_DOCS, SAMPLE_LINES, LINE_CHARS = 400, 4_000, 2_000
# Share of a template's neighbouring words that confirms it; families asked in order of probability.
CONFIRM, ASKED = 0.6, 5


def _run_features(words: Words) -> list[np.ndarray]:
    """For each run length, the bucket of the run that starts at each word (-1 where the line ends before)."""
    of_word = words.hashes()[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    ends = np.repeat(words.starts[1:], words.counts)
    h, out = np.zeros(len(of_word), np.uint64), []
    with np.errstate(over="ignore"):
        for k in range(RUN):
            here = np.flatnonzero(np.arange(len(of_word)) + k < ends)
            h[here] = mix64(h[here] + of_word[here + k] + np.uint64(k + 1))
            bucket = np.full(len(of_word), -1)
            bucket[here] = (h[here] % np.uint64(BUCKETS)).astype(np.int64)
            out.append(bucket)
    return out


def terms(text: str) -> list[str]:
    """Letters and digits in lower case, parted by anything else."""
    return [m.lower() for m in _TERM.findall(text)]


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False)) or {(w, "") for w in words}


_TEMPLATE_PAIRS = {family: [_pairs(terms(t)) for t in forms] for family, forms in TEMPLATES.items()}
# Neighbouring words that licence sentences have: a span without any of them is no unknown licence.
_CUES = set().union(*(_pairs(terms(part)) for form in UNKNOWN_FORMS for part in form.split("{}") if terms(part))) - {
    ("under", "the"), ("to", "the"), ("subject", "to"), ("is", "subject"), ("use", "is"), ("this", "work"), ("work", "is"), ("is", "licensed"),
}


def template_match(words: list[str], family: str) -> float:
    """Largest share of a template's neighbouring words, of one of this family, that the span has too."""
    own = _pairs(words)
    return max((len(own & t) / len(t) for t in _TEMPLATE_PAIRS.get(family, [])), default=0.0)


def told_apart(words: list[str], family: str) -> bool:
    """Whether a span says what tells this family from its neighbours, and nothing that another one would."""
    said = " ".join(words)
    need, lack = _RULES[family]
    return all(r.search(said) for r in need) and not any(r.search(said) for r in lack)


@dataclass(frozen=True)
class Model:
    """weights: a row of class weights for each bucket; odds are divided by ``temperature``."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, lines: pa.Array) -> np.ndarray:
        words = Words(lines, lower=True)
        odds = np.zeros((len(words.counts), len(CLASSES)))
        n = np.zeros(len(words.counts))
        for bucket in _run_features(words):
            here = bucket >= 0
            n += segment_sums(here.astype(np.int64), words.starts)
            rows = np.where(here[:, None], self.weights[np.maximum(bucket, 0)], 0)
            full = words.counts > 0
            if full.any():
                odds[full] += np.add.reduceat(rows, words.starts[:-1][full], axis=0)
        odds = (odds / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def _variants(rng: np.random.Generator, fillers: list[str]) -> tuple[list[str], list[int]]:
    """Templates, unknown licences and other uses of the words, with words dropped, others before and after as a span has them."""
    lines, classes = [], []

    def vary(form: str) -> str:
        words = [w for w in terms(form) if rng.random() > 0.05] or terms(form)
        if fillers and rng.random() < 0.7:
            before, after = (list(rng.choice(fillers, rng.integers(0, n + 1))) for n in SPANS[rng.integers(len(SPANS))])
            words = [*before, *words, *after]
        return " ".join(words)

    names = [a + b for a in ("acm", "bor", "cal", "dex", "evo", "fal", "gam", "hel") for b in ("ia", "on", "ex", "um", "ar")]
    fill = lambda form: form.format(rng.choice(names), round(float(rng.uniform(0, 9)), 1))
    for family, forms in TEMPLATES.items():
        for form in forms:
            lines += [" ".join(terms(form))] + [vary(form) for _ in range(VARIANTS)]
            classes += [CLASSES.index(family)] * (VARIANTS + 1)
    for label, forms, n in ((UNKNOWN, UNKNOWN_FORMS, 3 * VARIANTS), (NONE, NONE_FORMS, VARIANTS)):
        for form in forms:
            lines += [vary(fill(form)) for _ in range(n)]
            classes += [CLASSES.index(label)] * n
    return lines, classes


def train(plain: list[str], *, seed: int = SEED) -> Model:
    """Stochastic gradient descent on variants and ``plain`` lines; a fifth of all is held out for calibration."""
    rng = np.random.default_rng(seed)
    forms = [t for family in _TEMPLATE_PAIRS.values() for t in family]
    plain = [" ".join(w) for w in map(terms, plain) if w and all(len(own & t) < 0.3 * len(t) for own in [_pairs(w)] for t in forms)]
    fillers = sorted({w for x in plain for w in x.split()})
    lines, classes = _variants(rng, fillers)
    lines, classes = [*lines, *plain], np.array(classes + [0] * len(plain))
    words = Words(pa.array(lines, pa.string()), lower=True)
    runs = _run_features(words)
    rows = []
    for a, b in zip(words.starts[:-1], words.starts[1:], strict=True):
        found = np.concatenate([r[a:b] for r in runs])
        buckets, times = np.unique(found[found >= 0], return_counts=True)
        rows.append((buckets, times / max(times.sum(), 1)))
    order = rng.permutation(len(lines))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    weights, bias = np.zeros((BUCKETS, len(CLASSES))), np.zeros(len(CLASSES))
    steps, step = EPOCHS * max(len(used), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            rate = RATE * (1 - step / steps)
            step += 1
            buckets, share = rows[i]
            odds = share @ weights[buckets] + bias
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[classes[i]] -= 1
            # A line's features are many and their shares small: the step is scaled to move its odds by about the rate.
            weights[buckets] -= rate * np.outer(share / max((share**2).sum(), 1e-9), p) * 0.1
            bias -= 0.01 * rate * p
    raw = Model(weights, bias, 1.0, 0.0)
    held_lines, truth = pa.array([lines[i] for i in held], pa.string()), classes[held]
    log_odds = np.log(np.maximum(raw.probabilities(held_lines), 1e-300))

    def loss(temperature: float) -> float:
        z = log_odds / temperature
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    temperature = min(np.geomspace(0.2, 5, 30), key=loss) if len(held) else 1.0
    model = Model(weights.astype(np.float32), bias, float(temperature), 0.0)
    p = model.probabilities(held_lines)
    best = p[:, 2:].max(axis=1)
    right = (p[:, 2:].argmax(axis=1) + 2 == truth) & (truth >= 2)
    # The least probability of a family: what all but 1 % of rightly named held-out lines have, at most a half.
    least = float(min(0.5, np.quantile(best[right], 0.01))) if right.any() else 0.5
    return Model(model.weights, bias, model.temperature, least)


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, line_chars: int = LINE_CHARS) -> Model:
    """The model with at most ``sample_lines`` lines (smallest hashes) of at most ``sample_docs`` documents (smallest hashed ids).

    Longer lines than ``line_chars`` aren't learned from.
    """
    texts = id_and_text(docs).filter(F.col("doc_id").isNotNull())
    ids = texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    lines = texts.join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.filter((F.char_length("line") <= line_chars) & (F.trim("line") != "")).distinct()
    return train([r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(sample_lines).collect()])


@dataclass
class Span:
    """Words around neighbouring anchors: the terms of the narrowest to the widest cut, and their places in the text."""

    cuts: list[list[str]]
    places: list[tuple[int, int]]


def spans_of(text: str) -> list[Span]:
    """Candidates for a licence, one per group of anchors within a sentence."""
    anchors = [m.span() for m in _ANCHOR.finditer(text)]
    if not anchors:
        return []
    breaks = [0, *(m.end() for m in _BREAK.finditer(text)), len(text)]
    out: list[Span] = []
    at = 0
    while at < len(anchors):
        unit = bisect_right(breaks, anchors[at][0]) - 1
        low, high = breaks[unit], breaks[min(unit + 1, len(breaks) - 1)]
        inside = [a for a in anchors[at:] if a[0] < high]
        at += len(inside)
        words = [m.span() for m in _TERM.finditer(text, low, high)]
        starts = [w[0] for w in words]
        marks = sorted({i for a, b in inside for i in range(max(0, bisect_right(starts, a) - 1), bisect_right(starts, b - 1))})
        while marks:
            last = next((k for k in range(len(marks) - 1) if marks[k + 1] - marks[k] > JOINED), len(marks) - 1)
            first, final = marks[0], marks[last]
            marks = marks[last + 1 :]
            cuts = [(max(0, first - before), min(len(words), final + after + 1)) for before, after in SPANS]
            cuts = list(dict.fromkeys(cuts))
            out.append(Span([[text[a:b].lower() for a, b in words[i:j]] for i, j in cuts], [(words[i][0], words[j - 1][1]) for i, j in cuts]))
    return out


def scan_texts(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, int, str, float, float, bool, str]]:
    """(text, line, start, family, probability, template match, confirmed, span) of the spans with a licence, in their order.

    Of a span's cuts that with the most probable licence counts. The families are asked in
    order of probability for their template and what tells them apart. A span that no family
    confirms, or with too low a probability, is reported as unknown, but only if it has
    neighbouring words of a licence statement.
    """
    may = pc.match_substring_regex(texts, f"(?i){ANCHOR}")
    owners, spans = [], []
    for i in np.flatnonzero(pc.fill_null(may, False).to_numpy(zero_copy_only=False)).tolist():
        found = spans_of(texts[i].as_py())
        spans += found
        owners += [i] * len(found)
    cuts = [" ".join(c) for s in spans for c in s.cuts]
    if not cuts:
        return
    p = model.probabilities(pa.array(cuts, pa.string()))
    done = 0
    for owner, span in zip(owners, spans, strict=True):
        own = p[done : done + len(span.cuts)]
        done += len(span.cuts)
        best = int(own[:, 1:].max(axis=1).argmax())
        if own[best, 0] > 0.5:
            continue
        chosen = None
        for c in np.argsort(-own[best, 2:], kind="stable")[:ASKED] + 2:
            # The probability of the most probable family decides whether there is one; which, the template too.
            if own[best, 2:].max() < model.least:
                break
            match, cut = max((template_match(w, CLASSES[c]), -k) for k, w in enumerate(span.cuts))
            words = span.cuts[-cut]
            if match >= CONFIRM and told_apart(words, CLASSES[c]):
                chosen = (CLASSES[c], float(own[best, c]), match, -cut)
                break
        if chosen is None:
            words = span.cuts[best]
            if not _pairs(words) & _CUES:
                continue
            c = int(own[best, 2:].argmax()) + 2
            chosen = (UNKNOWN, float(own[best, c]), template_match(words, CLASSES[c]), best)
        start, stop = span.places[chosen[3]]
        text = texts[owner].as_py()
        yield owner, text.count("\n", 0, start), start, chosen[0], chosen[1], chosen[2], chosen[0] != UNKNOWN, text[start:stop]


_FOUND = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int64()), ("start", pa.int64()), ("family", pa.string()), ("probability", pa.float64()),
     ("template_match", pa.float64()), ("confirmed", pa.bool_()), ("text", pa.string())]
)
_FOUND_DDL = "uid long, doc_id long, line long, start long, family string, probability double, template_match double, confirmed boolean, text string"
_DOC_DDL = "doc_id long, n_lines long, n_confirmed long, n_unknown long, families array<string>, license_lines array<long>"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            uids, doc_ids = part.column("uid").to_pylist(), part.column("doc_id").to_pylist()
            rows = [(uids[r[0]], doc_ids[r[0]], *r[1:]) for r in scan_texts(part.column("text"), shared.value)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def license_lines(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each licence: uid, doc_id, line, start (characters before it), family, probability, template_match, confirmed, text (the span).

    Null, empty and all other texts without a licence have no row; very long lines and texts are scanned whole. Repeated rows are scanned
    each (uid tells them apart). No rows: no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tagged = id_and_text(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    return tagged.mapInArrow(_scan(shared), _FOUND_DDL)


def _summarise(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found: list[list] = [[] for _ in range(part.num_rows)]
            for text, line, _, family, _, _, confirmed, _ in scan_texts(part.column("text"), shared.value):
                found[text].append((line, family, confirmed))
            n_lines = pc.add(pc.count_substring(part.column("text"), "\n"), 1).cast(pa.int64())
            confirmed = [sum(c for _, _, c in f) for f in found]
            columns = [
                part.column("doc_id"),
                n_lines,
                pa.array(confirmed, pa.int64()),
                pa.array([len(f) - c for f, c in zip(found, confirmed, strict=True)], pa.int64()),
                pa.array([sorted({x for _, x, _ in f}) for f in found], pa.list_(pa.string())),
                pa.array([sorted({line for line, _, _ in f}) for f in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_confirmed", "n_unknown", "families", "license_lines"])

    return run


def license_summary(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, whole texts: doc_id, n_lines, n_confirmed, n_unknown, families (sorted), license_lines (numbers of the lines where they begin, from 0, each once).

    A null or empty text is one line without a licence. Repeated rows have a row each; of equal
    probabilities the family that comes first in TEMPLATES counts. Very long lines and texts
    are scanned whole. No rows: no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs, id_col, text_col).mapInArrow(_summarise(shared), _DOC_DDL)
