"""Licence sentences, rules, and the scan of a table."""

import random

import pytest

from buzzscore.llm import licenses as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


GPL3_OPENING = """
                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble
"""
GPL3_END = """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


@pytest.mark.parametrize(
    "text, found",
    [
        (MIT, ["MIT"]),
        ("Copyright (c) 2019 Jane Doe\n\n" + MIT, ["MIT"]),
        ("no full stop here\nReleased under the MIT License.", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("# SPDX-License-Identifier: BSD-3-Clause\nimport os", ["BSD-3-Clause"]),
        ("// SPDX-License-Identifier: (apache-2.0 OR MIT)\nReleased under the MIT License.", ["Apache-2.0", "MIT"]),
        ("/* SPDX-License-Identifier: GPL-2.0+ WITH Linux-syscall-note AND bsd-3-clause */\nx", ["GPL-2.0-or-later", "BSD-3-Clause"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later OR LicenseRef-Own-1 OR LGPL-2.1", ["GPL-2.0-or-later", "licenseref-own-1", "LGPL-2.1-only"]),
        (GPL3_OPENING, ["GPL-3.0-only"]),
        (GPL3_OPENING + GPL3_END, ["GPL-3.0-only"]),
        (GPL3_END, ["GPL-3.0-or-later"]),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n", ["LGPL-2.1-only"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS", ["Apache-2.0"]),
        ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", ["MPL-2.0"]),
        (ZLIB, ["Zlib"]),
        ("Licensed under the Eclipse Public License 2.0", ["EPL-2.0"]),
        ("Creative Commons Attribution-ShareAlike 4.0 International Public License", ["CC-BY-SA-4.0"]),
        ("CC0 1.0 Universal", ["CC0-1.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["MIT", "CC-BY-NC-4.0"]),
        ("A driving licence was permitted. The warranty of the car ran out.", []),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["unknown"]),
        ("", []),
    ],
)
def test_texts(text, found):
    assert L.match_rules(L.sentence_ids(text)) == found


def test_every_known_sentence_has_a_cue_and_its_identifier():
    for name, text in L.SENTENCES.items():
        assert any(c in text for c in L.CUES), name
        assert L.sentence_id(text.replace("<holder>", "the example foundation")) == name
        assert L.normalise(text.replace("<holder>", "x")) == text.replace("<holder>", "x")


#: An example of each pattern, and of each of its alternatives that holds another cue.
EXAMPLES = {
    "mit-named": ["Available under the Expat licence."],
    "apache": ["Published under the Apache License, Version 2.0"],
    "gpl": ["Released under GPL v3", "Distributed under the terms of the GNU General Public License"],
    "gpl-grant": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "bsd-named": ["Released under the 2-clause BSD license"],
    "mpl-named": ["Released under MPL 2.0", "Available under the Mozilla Public License, version 1.1"],
    "cc": ["Released under CC BY 4.0.", "Distributed under CC 0.", "Published under Creative Commons BY-SA 4.0 International."],
    "gnu-title": ["GNU Affero General Public License Version 3, 19 November 2007", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0."],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https www eclipse org legal epl 2 0"
    ],
    "cc-title": ["Attribution-NonCommercial 4.0 International", "Creative Commons Attribution 3.0 Unported"],
    "spdx": ["SPDX-License-Identifier: MIT"],
    "copyright": ["Copyright (c) 2019 Jane Doe"],
}


def test_every_pattern_has_a_cue_in_its_examples():
    assert set(EXAMPLES) == set(L.PATTERNS)
    for name, examples in EXAMPLES.items():
        for text in examples:
            assert (L.sentence_id(L.normalise(text)) or "").startswith(name), text
            assert L.has_cue(text) and L.has_cue(L.normalise(text)), text
            assert L.sentence_ids(text) == [L.sentence_id(L.normalise(text))]
            assert len(L.normalise(text).split()) <= L._MAX_WORDS


@pytest.mark.parametrize("name", L.SENTENCES)
def test_known_sentences_at_any_line_width(name):
    """A word on each line, also after lines that belong to no sentence."""
    words = L.SENTENCES[name].replace("<holder>", "a b c d e f g h").split()
    for width in (1, 2, 5, 12):
        lines = "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
        assert L.sentence_ids(lines) == [name]
        assert L.sentence_ids("unfinished line\n//\n" + lines + "\nand more") == [name]


@pytest.mark.parametrize(
    "text, found",
    [
        ("Released under CC BY 4.0.", ["CC-BY-4.0"]),
        ("This work is published under CC BY-SA 4.0 International.", ["CC-BY-SA-4.0"]),
        ("Distributed under CC 0.", ["CC0-1.0"]),
        ("Released under\nCC\nBY 4.0.", ["CC-BY-4.0"]),
        ("This work is in the public\ndomain.", ["public-domain"]),
        ("This is free and unencumbered software released into the public\n  domain.", ["Unlicense"]),
        ("The account was accepted under success.", []),
    ],
)
def test_cues_that_were_missed(text, found):
    assert L.match_rules(L.sentence_ids(text)) == found


def test_longer_rules_stand_before_their_beginnings():
    for i, (ids, _) in enumerate(L.RULES):
        assert not any(earlier == ids[: len(earlier)] for earlier, _ in L.RULES[:i])


def test_rules_against_all_cuts():
    """The first rule that fits at each place, found by trying all of them."""
    r, names = random.Random(5), [x for ids, _ in L.RULES for x in ids] + ["copyright", "gpl-2-or"]
    for _ in range(300):
        ids = [r.choice(names) for _ in range(r.randint(0, 8))]
        seq, want, i = [x for x in ids if x != "copyright"], [], 0
        while i < len(seq):
            fits = [(p, lic) for p, lic in L.RULES if seq[i : i + len(p)] == list(p)]
            p, lic = fits[0] if fits else ((seq[i],), L._parametric(seq[i]) or "?")
            want.append(lic)
            i += len(p)
        got = L.match_rules(ids)
        assert [x for x in dict.fromkeys(want) if x != "?"] == [x for x in got if x != "unknown"]


def test_scan_keeps_rows_and_columns(make):
    long_ = "word " * 200_000 + "\nReleased under the MIT License.\n" + "word " * 1000
    df = make([None, "", "plain", long_, "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0."])
    out = L.scan_licenses(df)
    assert out.columns == [*df.columns, "sentence_ids", "_licenses"]
    got = {x["doc_id"]: x["_licenses"] for x in out.collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["MIT"], 4: ["CC-BY-NC-4.0"], 5: ["CC-BY-NC-4.0"]}
    assert L.scan_licenses(make([])).count() == 0


def brute_ids(text):
    """Every run of whole lines of every part, the longest first: no cues, no bound on words."""
    out = []
    if "spdx" in text.lower():
        text = L._SPDX_LINE.sub(lambda m: L._PLUS.sub("-or-later", m[1]) + "\n\n", text)
    for part in L._SENTENCE_END.split(text):
        lines = [x for x in map(L.normalise, part.split("\n")) if x]
        runs = [(i, j) for i in range(len(lines)) for j in range(len(lines), i, -1)]
        known = {r: L.sentence_id(" ".join(lines[slice(*r)])) for r in runs}
        i = 0
        while i < len(lines):
            j = next((j for j in range(len(lines), i, -1) if known[i, j]), None)
            if j:
                out.append(known[i, j])
            i = j or i + 1
    return out


def test_sentences_against_brute_force():
    rnd = random.Random(7)
    sentences = [t.replace("<holder>", "the board") for t in L.SENTENCES.values()]
    examples = [x for xs in EXAMPLES.values() for x in xs]
    for _ in range(60):
        pieces = []
        for _ in range(rnd.randrange(1, 7)):
            words = rnd.choice([rnd.choice(sentences), rnd.choice(examples), "no more than words", "Licence of a warranty:"]).split()
            cuts = sorted(rnd.sample(range(len(words) + 1), min(len(words), rnd.randrange(4))))
            pieces.append("\n".join(" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])))
        text = rnd.choice(["\n", ".\n", "\n\n"]).join(pieces)
        assert L.sentence_ids(text) == brute_ids(text), text
