"""Licence recognition from sentences.

A text is cut into sentences, these are normalised (lower case, runs of other
characters than letters and digits become one blank) and looked up among known
licence sentences.  The identifiers found, in the order of the text, are then
matched against ordered rules: at each place the first rule whose sequence of
identifiers stands there gives a licence; an identifier that no rule takes is
an unknown licence statement.

One Arrow batch at a time, each text on its own; nothing is shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzscore.llm.common import fresh

# --- fixed values: sentences of public licence texts, normalised --------------
# A part in angle brackets stands for any one to eight words.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "gnu-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gnu-details": "see the gnu general public license for more details",
    "gnu-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorsement": "neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-see": "see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt",
    "gnu-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "cc0-title": "cc0 1 0 universal",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public-domain": "this work is in the public domain",
    "all-rights": "all rights reserved",
}
# Sentences with a parameter: its groups, joined by "-", complete the identifier.
_UNDER = r"(?:[a-z0-9]+ ){0,6}?(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?"
PATTERNS = {
    "mit-named": _UNDER + r"(?:mit|expat) licen[sc]e",
    "apache": _UNDER + r"apache (?:software )?licen[sc]e(?: version)? ?(1 1|2 0|2)?(?: the license)?",
    "gpl": _UNDER + r"(?:gnu )?(affero |lesser )?(?:general public licen[sc]e|gpl)(?: version| v)? ?([123])?(?: 0)?(?: (or)(?: at your option)?(?: any)? later(?: version)?)?",
    "gpl-grant": r"this program is free software you can redistribute it and or modify it under the terms of the gnu (affero |lesser )?general public license as published by the free software foundation either version ([123]) of the license (or) at your option any later version",
    "bsd-named": _UNDER + r"(?:(2|3) clause )?bsd licen[sc]e",
    "mpl-named": _UNDER + r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?(1 1|2 0)",
    "cc": _UNDER + r"(?:a )?(?:creative commons|cc) (by(?: nc)?(?: nd| sa)?|0)(?: (1 0|2 0|2 5|3 0|4 0))?(?: international)?(?: licen[sc]e)?",
    "gnu-title": r"gnu (affero |lesser )?general public license version (1|2 1|2|3) (?:[0-9]{1,2} )?[a-z]+ (?:19|20)[0-9]{2}",
    "apache-title": r"apache license version (2 0) january 2004(?: https? www apache org licenses)?",
    "mpl-title": r"mozilla public license version (1 1|2 0)",
    "boost": _UNDER + r"boost software license version (1 0)",
    "epl": r"(?:[a-z0-9]+ ){0,10}?(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?eclipse public licen[sc]e(?: version| v)? ?(1 0|2 0)(?: which (?:is available at|accompanies)(?: [a-z0-9]+){1,8})?",
    "cc-title": r"(?:creative commons )?(attribution(?: noncommercial)?(?: sharealike| noderivatives)?) (1 0|2 0|2 5|3 0|4 0)(?: international| unported| generic)?(?: public license)?",
    "spdx": r"spdx license identifier ([a-z0-9 ]+)",
    "copyright": r"copyright (?:c )?(?:[12][0-9]{3} ?)+(?: [a-z0-9]+){0,12}",
}
#: Ordered: (identifiers in sequence, licence). A longer sequence stands before its beginning.
RULES = (
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant",), "ISC"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement", "bsd-warranty"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("apache-2-0", "apache-use", "apache-copy", "apache-as-is", "apache-limits"), "Apache-2.0"),
    (("apache-2-0", "apache-use", "apache-copy"), "Apache-2.0"),
    (("apache-use", "apache-copy"), "Apache-2.0"),
    (("apache-2-0",), "Apache-2.0"),
    (("apache-2",), "Apache-2.0"),
    (("apache-1-1",), "Apache-1.1"),
    (("zlib-as-is", "zlib-liability", "zlib-grant"), "Zlib"),
    (("zlib-liability", "zlib-grant"), "Zlib"),
    (("zlib-grant",), "Zlib"),
    (("boost-1-0", "boost-see"), "BSL-1.0"),
    (("boost-1-0",), "BSL-1.0"),
    (("boost-title",), "BSL-1.0"),
    (("apache-title-2-0",), "Apache-2.0"),
    (("mpl-title-2-0",), "MPL-2.0"),
    (("mpl-title-1-1",), "MPL-1.1"),
    (("epl-1-0",), "EPL-1.0"),
    (("epl-2-0",), "EPL-2.0"),
    (("cc0-title",), "CC0-1.0"),
    (("mit-named",), "MIT"),
    (("mpl-2", "mpl-copy"), "MPL-2.0"),
    (("mpl-2",), "MPL-2.0"),
    (("mpl-named-2-0",), "MPL-2.0"),
    (("mpl-named-1-1",), "MPL-1.1"),
    (("unlicense",), "Unlicense"),
    (("public-domain",), "public-domain"),
    (("bsd-named-2",), "BSD-2-Clause"),
    (("bsd-named-3",), "BSD-3-Clause"),
    (("bsd-named",), "BSD"),
    (("cc-0",), "CC0-1.0"),
    (("cc-0-1-0",), "CC0-1.0"),
)
#: Identifiers of tags, in their canonical spelling; tags differ from them in case and marks.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 "
    "BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 "
    "BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 "
    "CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 "
    "CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only "
    "GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "HPND ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 "
    "OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby SSPL-1.0 TCL Unicode-DFS-2016 Unlicense "
    "UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
#: Older identifiers, replaced since.
SPDX_OLD = {
    "AGPL-3.0": "AGPL-3.0-only", "GPL-1.0": "GPL-1.0-only", "GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only",
    "LGPL-2.0": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only",
}
# ------------------------------------------------------------------------------
#: Each known sentence, and each sentence of a pattern, holds one of these or the word ``cc``; sentences
#: without any are not looked up. All are parts of one word, so that no line break stands in them.
CUES = ("licen", "copyright", "permi", "redistribution", "warrant", "liable", "domain", "reserved", "gnu", "mpl", "spdx", "bsd", "gpl", "creative", "cc0", "attribution")
_CC = re.compile(r"(?<![a-z0-9])cc(?![a-z0-9])")
_SENTENCE_END = re.compile(r"(?<=[.!?:;])(?<!dentifier:)[ \t]*(?:\n|[ \t]+(?=[^a-z0-9 \t\n]*[A-Z0-9(\"]))|\n[ \t]*\n")
_SPDX_LINE = re.compile(r"(?i)(SPDX-License-Identifier:[^\n]*)")
_PLUS = re.compile(r"(?<=[0-9])\+")
_OTHER = re.compile(r"[^a-z0-9]+")
#: Words of the longest known sentence, each part in angle brackets at its longest.
_MAX_WORDS = max(len(re.sub(r"<[^>]*>", "x" + " x" * 7, t).split()) for t in SENTENCES.values())


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def _compiled() -> tuple[dict[str, str], list[tuple[str, re.Pattern]]]:
    exact = {text: name for name, text in SENTENCES.items() if "<" not in text}
    open_ = {n: re.sub(r"<[^>]*>", r"[a-z0-9]+(?: [a-z0-9]+){0,7}", t) for n, t in SENTENCES.items() if "<" in t}
    return exact, [(name, re.compile(p)) for name, p in {**open_, **PATTERNS}.items()]


_EXACT, _OPEN = _compiled()


def sentence_id(normalised: str) -> str | None:
    """The identifier of a known licence sentence, else null."""
    name = _EXACT.get(normalised)
    if name:
        return name
    for name, pattern in _OPEN:
        m = pattern.fullmatch(normalised)
        if m:
            return "-".join([name, *[g.strip().replace(" ", "-") for g in m.groups() if g]])
    return None


def has_cue(text: str) -> bool:
    """Whether ``text``, normalised or not, may hold a known sentence."""
    low = text.lower()
    return any(c in low for c in CUES) or ("cc" in low and _CC.search(low) is not None)


def sentence_ids(text: str) -> list[str]:
    """Identifiers in the order of the text.

    A sentence may run over lines; where it is not known as a whole, the
    longest known runs of its lines count (a licence line need not follow a
    finished sentence).  A run has at most the words of the longest known
    sentence, on however many lines, or is one line.
    """
    if not has_cue(text):
        return []
    out = []
    if "spdx" in text.lower():  # a tag ends with its line
        text = _SPDX_LINE.sub(lambda m: _PLUS.sub("-or-later", m[1]) + "\n\n", text)
    for part in _SENTENCE_END.split(text):
        if not has_cue(part):
            continue
        whole = sentence_id(normalise(part))
        if whole:
            out.append(whole)
            continue
        lines = [x for x in map(normalise, part.split("\n")) if x]
        size = [x.count(" ") + 1 for x in lines]
        cue = [len(lines)] * len(lines)  # the next line with a cue: a run without one is not known
        for k in range(len(lines) - 1, -1, -1):
            cue[k] = k if has_cue(lines[k]) else cue[k + 1] if k + 1 < len(lines) else len(lines)
        i = 0
        while i < len(lines):
            end, n = i + 1, size[i]
            while end < len(lines) and n + size[end] <= _MAX_WORDS:
                n += size[end]
                end += 1
            for j in range(end, cue[i], -1):
                found = sentence_id(" ".join(lines[i:j]))
                if found:
                    out.append(found)
                    i = j
                    break
            else:
                i += 1
    return out


_GNU = {"affero": "AGPL", "lesser": "LGPL", None: "GPL"}
_CANONICAL = {tuple(normalise(k).split()): v for k, v in {**{x: x for x in SPDX}, **SPDX_OLD}.items()}
_SPDX_WORDS = max(map(len, _CANONICAL))


def spdx_licenses(expression: list[str]) -> list[str]:
    """The licences of a tag's expression (its normalised words), in canonical spelling.

    At each place the longest identifier counts (``or later`` is part of one);
    ``or`` and ``and`` stand between licences, an exception after ``with`` is
    none.  An identifier that is not known is given as its words.
    """
    out, own, i, exception = [], [], 0, False

    def flush() -> None:
        if own:
            out.append("-".join(own))
            own.clear()

    while i < len(expression):
        word = expression[i]
        if word in ("or", "and", "with"):
            flush()
            exception, i = word == "with", i + 1
            continue
        # an identifier starts after an operator only
        sizes = () if exception or own else range(min(_SPDX_WORDS, len(expression) - i), 0, -1)
        size = next((n for n in sizes if tuple(expression[i : i + n]) in _CANONICAL and _ends(expression, i + n)), 0)
        if size:
            out.append(_CANONICAL[tuple(expression[i : i + size])])
        elif not exception:
            own.append(word)
        i += size or 1
    flush()
    return list(dict.fromkeys(out))


def _ends(expression: list[str], i: int) -> bool:
    return i == len(expression) or expression[i] in ("or", "and", "with")


def _parametric(name: str) -> str | None:
    """The licence of an identifier that carries a version."""
    m = re.fullmatch(r"gnu-title(?:-(affero|lesser))?-([123])(?:-(1))?", name)
    if m:
        return f"{_GNU[m[1]]}-{m[2]}.{m[3] or 0}-only"
    m = re.fullmatch(r"cc-title-(attribution(?:-noncommercial)?(?:-sharealike|-noderivatives)?)-([0-9])-([0-9])", name)
    if m:
        short = {"attribution": "BY", "noncommercial": "NC", "sharealike": "SA", "noderivatives": "ND"}
        return f"CC-{'-'.join(short[x] for x in m[1].split('-'))}-{m[2]}.{m[3]}"
    m = re.fullmatch(r"gpl(?:-grant)?(?:-(affero|lesser))?(?:-([123]))?(-or)?", name)
    if m:
        family = _GNU[m[1]]
        return f"{family}-{m[2]}.0-{'or-later' if m[3] else 'only'}" if m[2] else family
    m = re.fullmatch(r"cc-(by(?:-nc)?(?:-nd|-sa)?)(?:-([0-9])-([0-9]))?", name)
    if m:
        return f"CC-{m[1].upper()}" + (f"-{m[2]}.{m[3]}" if m[2] else "")
    return None


def match_rules(ids: list[str]) -> list[str]:
    """The licences of a sequence of identifiers, each once, in order.

    Copyright lines belong to any licence and are passed over; so does a grant
    after the title of its own licence, whose text ends with a specimen of it.
    What no rule takes gives ``unknown``.
    """
    seq, out, i = [x for x in ids if not x.startswith("copyright") and x != "all-rights"], [], 0
    tails = {"gnu-warranty", "gnu-details", "gnu-copy", "mit-notice", "mit-warranty", "mit-liability", "bsd-warranty", "apache-as-is", "apache-limits", "gnu-verbatim", "zlib-as-is", "zlib-liability", "boost-see"}
    texts = set()
    while i < len(seq):
        if seq[i].startswith("spdx-"):
            out += [x for x in spdx_licenses(seq[i][5:].split("-")) if x not in out]
            i += 1
            continue
        for pattern, licence in RULES:
            if tuple(seq[i : i + len(pattern)]) == pattern:
                i += len(pattern)
                break
        else:
            licence = _parametric(seq[i]) or (None if out and seq[i] in tails else "unknown")
            if seq[i].startswith("gnu-title"):
                texts.add(licence)
            elif seq[i].startswith("gpl-grant") and licence and licence.replace("-or-later", "-only") in texts:
                licence = None
            i += 1
        if licence and licence not in out:
            out.append(licence)
    return out


def _scan(texts: pd.Series) -> pd.DataFrame:
    ids = [sentence_ids(t) if t else [] for t in texts]
    return pd.DataFrame({"sentence_ids": ids, "licenses": [match_rules(x) for x in ids]})


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, and ``sentence_ids`` and ``licenses`` (arrays, in order).

    * Null and empty texts, and texts without a known sentence, have empty arrays.
    * Whole texts are read, however long; one text is in memory at a time
      beside its Arrow batch.
    * Repeated rows are scanned alike. Columns of ``docs`` that have a result's
      name are kept; the result then carries underscores in front.
    """
    scan = F.pandas_udf(_scan, "struct<sentence_ids:array<string>,licenses:array<string>>")
    found = fresh(docs, "found")
    out = docs.withColumn(found, scan(F.col(text_col)))
    return out.select(
        *[F.col(c) for c in docs.columns],
        *[F.col(found)[k].alias(fresh(docs, k)) for k in ("sentence_ids", "licenses")],
    )
