import random

import pytest

from pairlift.llm import license_scan as ls


def prose(rng, n):
    syllables = ["ka", "lo", "mi", "ter", "en", "sha", "qu", "ber", "tion", "za", "ro", "fi"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return ls.train([prose(rng, rng.randint(1, 40)) for _ in range(1500)])


def planted():
    rng = random.Random(7)
    pairs, want = [], {}
    for k in range(300):
        lines = [prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        families = set()
        if k % 3 == 0:
            family = rng.choice(list(ls.TEMPLATES))
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(ls.TEMPLATES[family]))
            families.add(family)
        elif k % 7 == 0:
            lines.append(f"Licensed under the {rng.choice(['Zorbo', 'Quix', 'Nemea'])} License.")
            families.add(ls.UNKNOWN)
        pairs.append((1000 + k, "\n".join(lines)))
        want[1000 + k] = sorted(families)
    return pairs, want


def test_planted_licences(make_docs, edge_pairs, model):
    pairs, want = planted()
    rows = {r["doc_id"]: r for r in ls.license_summary(make_docs([*edge_pairs, *pairs]), model).collect() if (r["doc_id"] or 0) >= 1000}
    right = sum(rows[i]["families"] == f for i, f in want.items())
    assert right >= 0.98 * len(want)
    clean = [i for i, f in want.items() if not f]
    assert sum(bool(rows[i]["families"]) for i in clean) <= 0.01 * len(clean)


def test_licences_give_places(make_docs, model):
    pairs, _ = planted()
    texts = dict(pairs)
    for r in ls.license_lines(make_docs(pairs), model).collect():
        text = texts[r["doc_id"]]
        assert text[r["start"] :].startswith(r["text"]) and r["line"] == text.count("\n", 0, r["start"])
        assert r["confirmed"] == (r["family"] in ls.TEMPLATES)
        assert not r["confirmed"] or r["template_match"] >= ls.CONFIRM


CASES = [
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3.0"),
    ("This library is licensed under the GNU Lesser General Public License.", "lgpl"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Released under the BSD 2-Clause License.", "bsd-2-clause"),
    ("Released under the BSD 3-Clause License.", "bsd"),
    ("Released under the MIT License.", "mit"),
    ("ISC License", "isc"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"),
    (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0",
    ),
    (
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
        "1. Redistributions of source code must retain the above notice.", "bsd",
    ),
    ("Licensed under the Zorbo License.", "unknown"),
    ("Released under the Nemea Public License, version 4.1.", "unknown"),
]


@pytest.mark.parametrize("around", [0, 15, 130])
def test_near_misses_are_told_apart(model, around):
    """Each case alone, on a line of its own, and in the middle of a long line without other sentences."""
    import pyarrow as pa

    rng = random.Random(around)
    filler = lambda: prose(rng, around).rstrip(".").lower() if around else ""
    texts = [f"{filler()} {case} {filler()}".strip() for case, _ in CASES]
    got = [set() for _ in CASES]
    for owner, _, _, family, *_ in ls.scan_texts(pa.array(texts), model):
        got[owner].add(family)
    wrong = [(c, g) for (c, want), g in zip(CASES, got, strict=True) if g - {"unknown"} != {want} - {"unknown"} or (want == "unknown" and not g)]
    assert not wrong


def test_other_uses_of_the_words_are_no_licence(model):
    import pyarrow as pa

    texts = ["The licence plate was red.", "She has a driving licence from 1980.", "Das Rad fuhr mit Licht.", "A licence fee is due, he said.", "permission to use the road", LONG_PROSE]
    assert list(ls.scan_texts(pa.array(texts), model)) == []


LONG_PROSE = prose(random.Random(2), 20_000)


def test_confirmation_against_its_definition(model):
    """Every reported family has a template whose pairs the span holds to the share asked for, and its own rule; no other is confirmed so."""
    import pyarrow as pa

    for _, _, _, family, probability, match, confirmed, span in ls.scan_texts(pa.array([c for c, _ in CASES]), model):
        words = "".join(c if c.isalnum() else " " for c in span.lower()).split()
        own = set(zip(words, words[1:], strict=False))
        assert 0 <= probability <= 1
        if confirmed:
            shares = []
            for form in ls.TEMPLATES[family]:
                other = "".join(c if c.isalnum() else " " for c in form.lower()).split()
                theirs = set(zip(other, other[1:], strict=False))
                shares.append(len(own & theirs) / len(theirs))
            assert match == max(shares) >= ls.CONFIRM
            assert ls.told_apart(words, family)


def test_edge_rows(make_docs, edge_pairs, model):
    rows = ls.license_summary(make_docs(edge_pairs), model).collect()
    assert len(rows) == len(edge_pairs)
    assert sorted(r["n_lines"] for r in rows) == sorted((t or "").count("\n") + 1 for _, t in edge_pairs)
    assert ls.license_summary(make_docs([]), model).collect() == []


def test_fit_on_documents(make_docs):
    pairs, _ = planted()
    model = ls.fit(make_docs(pairs), sample_docs=100)
    assert 0 < model.least <= 0.5 and model.temperature > 0
    ls.fit(make_docs([]))


def test_template_match():
    assert ls.template_match(ls.terms("released under the MIT license"), "mit") == 1.0
    assert ls.template_match(ls.terms("some other words"), "mit") == 0.0
