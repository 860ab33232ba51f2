"""Licence scans by sentence rules (operator 1).

1. A text is cut into units at line ends and at sentence ends.  Units are normalised
   (lower case, runs of letters and digits).
2. Units in a row that together are a known sentence become its identifier, the
   longest first: a trie of words is followed over as many units as it takes, so
   that sentences broken over any number of lines are found.  List markers (a number
   or letter of its own) before a sentence are left out.  Templates have slots, for
   names, that take up to SLOT words.  An SPDX line gives one identifier for each
   licence of its expression; exceptions after WITH are left out.  A
   unit that speaks of licences but is no known sentence becomes UNKNOWN.  Others
   are left out and part what is before from what is after.
3. The sequence of identifiers is matched against ordered rules: the first rule that
   occurs is a licence found, its sentences are taken away, and matching goes on with
   the same rule and then those after it.

Tables are fixed and small; short forms are built from names and phrases.

Very long texts are read whole, unit by unit; time is linear in the text but for
sentences that begin alike, of which each start is followed to the first difference.

Rows: a null text counts as empty and has no licences; repeated rows are scanned
each; an empty table gives an empty result; other columns are not read.  A rule that
occurs twice is reported once, at its first place; licences are listed in the order
of the rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, sources

UNKNOWN = "UNKNOWN"

#: Names of licences as short forms write them, and their identifiers.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "MIT": ["mit license", "mit licence", "expat license"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "2 clause bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "3 clause bsd license", "modified bsd license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gpl version 2", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gpl version 3", "gplv3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl version 2 1", "lgplv2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl version 3", "lgplv3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl version 3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "creative commons zero v1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
}
#: Families whose notices say which versions are meant, as their names go on after "gnu".
FAMILIES = {"GPL": ("general public license", ("2.0", "3.0")), "LGPL": ("lesser general public license", ("2.1", "3.0")), "AGPL": ("affero general public license", ("3.0",))}
PHRASES = [f"{verb} under{terms}" for verb in ("licensed", "released", "distributed", "available", "published") for terms in ("", " the terms of")]
SUBJECTS = ["", "this work is", "this software is", "this program is", "this project is", "this file is", "this document is", "this code is", "the code is", "this package is"]

#: Sentences of licence texts and notices.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
}

#: Sentences of whole texts that no other licence of the tables has, for texts without their title.
CLAUSES = {
    "GPL-2.0": ["by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"],
    "GPL-3.0": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "AGPL-3.0": ["the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"],
    "LGPL-3.0": ["this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"],
    "BSL-1.0": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "Zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
}

#: Sentences with slots (*), by identifier.
TEMPLATES = {
    "bsd-names": ["neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": ["this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-liability": ["in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
}
#: Words that a slot takes at most.
SLOT = 16

#: Titles of whole licence texts.
TITLES = {
    "GPL-2.0": "gnu general public license version 2 june 1991",
    "GPL-3.0": "gnu general public license version 3 29 june 2007",
    "LGPL-2.1": "gnu lesser general public license version 2 1 february 1999",
    "LGPL-3.0": "gnu lesser general public license version 3 29 june 2007",
    "AGPL-3.0": "gnu affero general public license version 3 19 november 2007",
    "Apache-2.0": "apache license version 2 0 january 2004",
    "MPL-2.0": "mozilla public license version 2 0",
    "EPL-2.0": "eclipse public license v 2 0",
    "BSL-1.0": "boost software license version 1 0 august 17th 2003",
    "CC0-1.0": "cc0 1 0 universal",
    "CC-BY-4.0": "creative commons attribution 4 0 international public license",
    "CC-BY-SA-4.0": "creative commons attribution sharealike 4 0 international public license",
    "CC-BY-NC-4.0": "creative commons attribution noncommercial 4 0 international public license",
    "CC-BY-NC-SA-4.0": "creative commons attribution noncommercial sharealike 4 0 international public license",
    "CC-BY-ND-4.0": "creative commons attribution noderivatives 4 0 international public license",
}


def _spoken(version: str) -> str:
    return version.removesuffix(".0").replace(".", " ")


def _notices() -> dict[str, str]:
    """Sentences of the notices of a family, by sentence."""
    out = {}
    for family, (title, versions) in FAMILIES.items():
        for thing in ("program", "library", "software", "file", "package", "project"):
            free = f"this {thing} is free software you can redistribute it and or modify it under the terms of the gnu {title}"
            for version in versions:
                v = _spoken(version)
                out[f"{free} as published by the free software foundation either version {v} of the license or at your option any later version"] = f"free-{family}-{version}-or-later"
                out[f"{free} as published by the free software foundation version {v} of the license"] = f"free-{family}-{version}-only"
                out[f"{free} version {v} as published by the free software foundation"] = f"free-{family}-{version}-only"
            out[f"this {thing} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "gnu-hope"
            out[f"you should have received a copy of the gnu {title} along with this {thing}"] = "gnu-copy"
        out[f"see the gnu {title} for more details"] = "gnu-details"
    return out


def _forms() -> dict[str, list[str]]:
    """More names of the licences of a family, with the versions that are meant."""
    out: dict[str, list[str]] = {}
    for family, (title, versions) in FAMILIES.items():
        for version in versions:
            v, f = _spoken(version), family.lower()
            forms = [f"{name} {word}{n}" for name in (f"gnu {title}", f) for word in ("version ", "v") for n in dict.fromkeys((v, version.replace(".", " ")))] + [f"{f}v{v}"]
            out[f"{family}-{version}"] = forms
            out[f"{family}-{version}-or-later"] = [f"{form} {later}" for form in forms for later in ("or later", "or any later version")]
            out[f"{family}-{version}-only"] = [f"{form} only" for form in forms]
    return out


FORMS = _forms()
SHORT = list(dict.fromkeys([*FORMS, *NAMES]))
#: What may follow the first sentence of a notice.
_NOTICE = [["gnu-hope", "gnu-details", "gnu-copy"], ["gnu-hope", "gnu-details"], ["gnu-hope"], []]

#: Sequences of identifiers, the more particular first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-grant", "apache-copy"]),
    ("Apache-2.0", ["apache-grant"]),
    *((name, [first, *rest]) for rest in _NOTICE for name, first in (("GPL-3.0-or-later", "gpl3-free"), ("GPL-2.0-or-later", "gpl-free"), ("LGPL-2.1-or-later", "lgpl-free"))),
    *((n.removeprefix("free-"), [n, *rest]) for rest in _NOTICE for n in dict.fromkeys(_notices().values()) if n.startswith("free-")),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["public-domain"]),
    *((name, [f"short-{name}"]) for name in SHORT),
    *((name, [f"title-{name}"]) for name in TITLES),
    *((name, [f"clause-{name}"]) for name in CLAUSES),
]

#: A known sentence and an unknown one of interest hold one of these.
HINTS = ["licen", "copyright", "redistribut", "permission", "warrant", "public domain", "free software", "released under", "distributed under", "available under", "published under", "liable", "cc0 1 0"]
_ONE_WORD = [h for h in HINTS if " " not in h]
_FIRST = list(dict.fromkeys(h.split()[0] for h in HINTS if " " in h))
#: Hints of several words with anything between them that normalising takes away.
_APART = re.compile("|".join(h.replace(" ", r"[\W_]+") for h in HINTS if " " in h))
_UNIT = re.compile(r"[\n\r]+|[.;:!?]+(?=\s|$)")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = r"(?:[0-9]{1,3}|[a-z]|[ivx]+)"
#: A list marker that is a unit, and one in the unit of its sentence.
_MARKER = re.compile(_NUMBER)
_MARKED = re.compile(rf"[\W_]*{_NUMBER}[.:)\]]+(?![0-9])", re.IGNORECASE)


def _known() -> dict[str, str]:
    clauses = {text: f"clause-{name}" for name, texts in CLAUSES.items() for text in texts}
    known = {**_notices(), **clauses, **{text: f"title-{name}" for name, text in TITLES.items()}, **{text: i for i, text in SENTENCES.items()}}
    for name in SHORT:
        for form in dict.fromkeys(FORMS.get(name, []) + NAMES.get(name, [])):
            for phrase in PHRASES:
                for subject in SUBJECTS:
                    for article in ("", "the ", "a "):
                        known[f"{subject} {phrase} {article}{form}".strip()] = f"short-{name}"
            known[f"spdx license identifier {name}".lower().replace("-", " ").replace(".", " ")] = f"short-{name}"
    return known


KNOWN = _known()
_END, _SLOT = "", "*"
#: Licences as an SPDX expression names them, without case.
_SPDX = {name.lower(): name for name in SHORT} | {f"{f}-{v}+".lower(): f"{f}-{v}-or-later" for f, (_, versions) in FAMILIES.items() for v in versions}
_SPDX_LINE = re.compile(r"spdx-license-identifier\s*:?\s*(.*)", re.IGNORECASE | re.DOTALL)
_SPDX_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


def _trie() -> dict:
    """Words and slots lead on; _END leads to the identifier."""
    root: dict = {}
    templates = [(sentence, name) for name, sentences in TEMPLATES.items() for sentence in sentences]
    for sentence, name in [*KNOWN.items(), *templates]:
        node = root
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[_END] = name
    return root


_TRIE = _trie()


def normalise(unit: str) -> str:
    return " ".join(_WORD.findall(unit.lower()))


def hinted(text: str) -> bool:
    """Whether the normalised text holds a hint."""
    lower = text.lower()
    return any(h in lower for h in _ONE_WORD) or (any(h in lower for h in _FIRST) and _APART.search(lower) is not None)


def _longest(units: list[list[str]], at: int, skip: int = 0) -> tuple[str | None, int]:
    """The longest known sentence that starts with this unit (after ``skip`` words) and ends with one, and the unit after it."""
    found, after = None, at
    states: list[tuple[dict, int]] = [(_TRIE, 0)]  # nodes, and the words that a slot before them has taken
    for i in range(at, len(units)):
        for word in units[i][skip:] if i == at else units[i]:
            ahead = []
            for node, taken in states:
                if word in node:
                    ahead.append((node[word], 0))
                if 0 < taken < SLOT:
                    ahead.append((node, taken + 1))
                elif not taken and _SLOT in node:
                    ahead.append((node[_SLOT], 1))
            if not ahead:
                return found, after
            states = ahead
        for node, _ in states:
            if _END in node:
                found, after = node[_END], i + 1
    return found, after


def expression(text: str) -> list[str]:
    """Identifiers of the licences of an SPDX expression."""
    out, skip = [], False
    for word in _SPDX_WORD.findall(text):
        if word.lower() in ("and", "or", "with"):
            skip = word.lower() == "with"
        elif skip:
            skip = False
        else:
            name = _SPDX.get(word.lower().rstrip("."))
            out.append(f"short-{name}" if name else UNKNOWN)
    return out


def identifiers(text: str) -> list[str | None]:
    """Known, UNKNOWN or (for a stretch of other units) None."""
    raw = [(u, n) for u in _UNIT.split(text) for n in [normalise(u)] if n]
    units = [n for _, n in raw]
    words = [n.split() for n in units]
    out: list[str | None] = []
    at = 0
    while at < len(units):
        if units[at].find("spdx license identifier") >= 0 and (line := _SPDX_LINE.search(raw[at][0])):
            own = line[1].strip()
            named = expression(own or (raw[at + 1][0] if at + 1 < len(raw) else ""))
            if named:
                out += named
                at += 1 if own else 2
                continue
        found, after = _longest(words, at)
        if not found and _MARKER.fullmatch(units[at]):
            at += 1
            continue
        if not found and (mark := _MARKED.match(raw[at][0])):
            found, after = _longest(words, at, len(_WORD.findall(mark[0])))
        if found:
            at = after
        else:
            found = UNKNOWN if any(h in units[at] for h in HINTS) else None
            at += 1
        if found is not None or not out or out[-1] is not None:
            out.append(found)
    return out


def match_rules(sequence: list[str | None]) -> tuple[list[str], int]:
    """Licences found, and the number of known sentences that no rule took."""
    found, rest = [], list(sequence)
    for name, rule in RULES:
        k = len(rule)
        at = 0
        while at + k <= len(rest):
            if rest[at : at + k] == rule:
                found.append(name)
                rest[at : at + k] = [None]
            at += 1
    return list(dict.fromkeys(found)), sum(x not in (None, UNKNOWN) for x in rest)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, sentences, n_unmatched, n_unknown) for each row."""
    rows = sources(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                sequence = identifiers(text) if hinted(text) else []
                found, unmatched = match_rules(sequence)
                named = [s for s in sequence if s is not None and s != UNKNOWN]
                out.append((",".join(found), ",".join(named), unmatched, sequence.count(UNKNOWN)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "licences", "sentences", "n_unmatched", "n_unknown"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licences string, sentences string, n_unmatched long, n_unknown long")


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
