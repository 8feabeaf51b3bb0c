"""License scans: a sparse n-gram classifier of paragraphs, confirmed by templates; DataFrame functions only.

A paragraph ends at a blank line, and at the end of a line that ends a sentence; other line ends are white space, so a
notice that is wrapped over lines is one paragraph.  A paragraph's word 1- and 2-grams are scored by a multinomial logistic
regression, trained on the templates below with words dropped, added and exchanged, and on names of licences in the short notices that :data:`CARRIERS` makes.  Its classes are the licence families,
``unknown`` (licence language of no known family) and ``none``.  Small weights are set to zero, and what is left is rounded
to integers after temperature scaling, so that sums are exact.  A family counts if it leads ``none`` and ``unknown`` by ``margin``, which is
calibrated so that held-out paragraphs of no known family rarely reach it, and if the paragraph contains ``CONFIRM_PERCENT``
of the 2-grams of one of the family's templates or names (all its grams, if it has fewer than three words); a paragraph may name
several families, but of those that are much alike (:data:`ALIKE`) only the best counts.  With none the paragraph is ``unknown``, if its
words say that it is about a licence.

Most paragraphs need no scoring: :func:`triggers` derives from the weights a set of words without which no class can reach
``none``, whatever else a paragraph holds.  It is a bound, not a rule of thumb: the DuckDB oracle scores every paragraph.

Per document: the families of its paragraphs, the one with the largest lead, and counts.  Everything is an expression on the
document's own row, with the model as constants of the plan: there is no shuffle and no intermediate table.

Edge cases: null and empty texts have no paragraphs (``license`` is ``none``); repeated rows are scanned each; ties go to the
larger lead, then to the smaller name; a paragraph of one word has 1-grams only; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.llm import _session

NAME = "op1_licenses"

#: Share of a template's 2-grams that a paragraph must have.
CONFIRM_PERCENT = 60
#: The lead of ``none`` over the other classes before any word is seen, as a logarithm of odds.
PRIOR = 6.0

# Fixed phrases of well-known licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software under the terms of the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License v3.0.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "GNU Affero General Public License as published by the Free Software Foundation",
        "AGPLv3",
        "GNU AGPL",
        "AGPL 3.0",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "released under Apache 2.0",
        "under Apache-2.0",
        "Apache Software License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "BSD 2-Clause license",
        "under the BSD terms",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution license.",
        "available under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "available under CC BY-NC 4.0",
        "Creative Commons Attribution-NonCommercial",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "available under CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License v2.0 or later.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Released under the GPL license version 3.",
        "GPLv3",
        "GPLv2",
        "GNU GPL",
        "GPL v3",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "LGPLv3",
        "GNU LGPL",
        "LGPL 2.1",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        'to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "distributed under MIT terms",
        "available under the MIT license",
        "MIT licensed",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "MPL 2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Alle Rechte vorbehalten.",
        "Tous droits reserves.",
        "Todos los derechos reservados.",
        "Copyright (c) Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced without permission of the publisher; all rights reserved.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "placed in the public domain",
        "available under CC0 1.0",
    ],
}
#: What the families are called, in the short ways that notices have.
NAMES: dict[str, list[str]] = {
    "agpl": ["AGPL", "GNU AGPL", "AGPLv3", "AGPL-3.0", "Affero GPL", "GNU Affero General Public License"],
    "apache": ["Apache", "Apache-2.0", "Apache License", "Apache 2.0", "Apache License 2.0", "ASL 2.0"],
    "bsd": ["BSD", "BSD-3-Clause", "BSD-2-Clause", "New BSD", "BSD 3-Clause", "modified BSD"],
    "cc-by": ["CC BY", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution"],
    "cc-by-nc": ["CC BY-NC", "CC-BY-NC-4.0", "CC BY-NC-ND", "CC BY-NC-SA", "Creative Commons Attribution-NonCommercial", "Creative Commons NonCommercial"],
    "cc-by-sa": ["CC BY-SA", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike", "Creative Commons ShareAlike"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GNU GPL", "GPL-3.0", "GPL-2.0-only", "GNU General Public License"],
    "lgpl": ["LGPL", "LGPLv3", "LGPL-2.1", "GNU LGPL", "Lesser GPL", "GNU Lesser General Public License"],
    "mit": ["MIT", "MIT License", "MIT/Expat", "Expat"],
    "mpl": ["MPL", "MPL-2.0", "MPL 1.1", "Mozilla Public License"],
    "public-domain": ["CC0", "CC0-1.0", "public domain", "CC0 1.0 Universal", "Unlicense"],
}
#: Licences that have a name and none of these families.
OTHERS = "isc eupl wtfpl zlib epl cddl ofl bsl sspl artistic boost ecl cecill ms-pl odbl pddl elastic fair-source polyform hippocratic".split()
#: What is around a name, varied by version and punctuation; the name is {0}.
CARRIERS = [
    "License: {0}", "Licence {0}", "license = {0}", "licensed under {0}{1}", "licensed under the {0} license{1}", "released under {0}{1}", "released under the terms of the {0}{1}", "distributed under the {0} licence{1}", "under the {0} licence",
    "available under {0} terms", "is {0} licensed", "the {0} license", "{0}{1} license applies", "SPDX {0}", "published under {0}{1}", "covered by the {0}{1}", "use it under the {0}{1}", "{0} license", "licensed {0}", "the code is {0}", "OSI approved {0} license", "see the {0}{1} for details",
]
#: What makes any name doubtful, so that the paragraph is ``unknown``.
DOUBTS = ["perhaps the {0} license", "{0} license, perhaps", "maybe {0}", "whether it is {0} license is unclear", "{0} license perhaps", "the license may be {0}, maybe", "is it unclear whether {0} applies"]
_VERSIONS = ["", "", "", " version {2}", " v{2}", ", version {2} or later", " {2}.0"]
#: Families of which a paragraph names one only: what their names and texts share is the most.
ALIKE = [("agpl", "gpl", "lgpl"), ("cc-by", "cc-by-nc", "cc-by-sa")]
UNKNOWN = [
    "Licensed under the {0} {1} Agreement.",
    "This work is licensed under the {0} Community License, version {2}.",
    "Use of this content is subject to the {0} license terms.",
    "Copyright {0} and the {1} contributors.",
    "The license of {0} can be requested from the {1} office.",
    "SPDX-License-Identifier: LicenseRef-{0}",
    "Distributed under the {0} Open License {2}.",
    "The {0} may be used under license from {1}.",
    "Released under the {0} license version {2}.",
    "Available under the terms of the {0} Public License.",
    "{0} license, {1}? copyright",
    "Released under the terms of a license of {0}.",
]
NONE = [
    "The driver showed a license to the {0} at the {1}.",
    "License plates of {0} are {1}.",
    "A fishing license costs {2} per year in {0}.",
    "The copyright office of {0} moved to {1} last year.",
    "He spoke about licensing music for {0} and {1}.",
    "The debate on copyright and {0} went on for {2} hours.",
    "Poetic licence lets {0} be {1}.",
    "She reserved a table at the {0} for {1} and all of the {0}.",
    "You should have received a copy of the {0} with the {1}.",
    "The {0} is distributed to the public in the {1}, version {2} of it is available.",
    "The terms of the treaty were published by the {0} foundation, and the public can use the source of the {1}.",
    "He was released from {0} under the terms of a {1} that applies to any person.",
    "He went mit dem {0} nach {1}, und mit den {0} und der {1}.",
    "Das {0} mit der {1} ist mit {2} {0} in der {1}.",
    "The Apache {0} lived in {1} for {2} years, said the general.",
    "This is the {0} of the {1} and it is free to use without {0} or {1}.",
    "Students at MIT in {0} wrote a {1} program and a library of {0}.",
    "His licence to trade in {0} was taken away by {1}.",
    "License fees of {0} rose, and the licence of {1} ended.",
    "They reserved the {0} for {1}, and the rights of {1} were kept.",
    "Seats are reserved for {0} on the right of the {1}.",
    "The rights to {0} belong to {1}.",
    "She was licensed to practise {0} under the rules of {1}.",
    "A paper from MIT says that {0} and {1} are {2} times larger.",
    "MIT and {0} opened a laboratory in {1}.",
    "He sat mit {0} und {1} in the {2} boat.",
    "The Apache tribe of {0} and the {1} helicopter.",
    "The public spoke of the domain of {0}, and the general of the {1} license office.",
    "Version {2} of the {0} is fair, and the artistic {1} was elastic.",
    "The boost to {0} was fair; the expat of {1} was licensed to drive.",
    "It is a work of {0} in the domain of {1}, by the author of the {0}.",
]
FAMILIES = sorted(TEMPLATES)
CLASSES = [*FAMILIES, "none", "unknown"]
_COMMON = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do mit und der die das von zu den im ist nicht le la les des et en un une que de el los por con para del se".split()


def tokens(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _named(rng: random.Random, name: str) -> str:
    """A short notice with one of the names of a family (or of ``unknown``), as carriers have it."""
    if name == "unknown" and rng.random() < 0.4:
        return rng.choice(DOUBTS).format(rng.choice(NAMES[rng.choice(sorted(NAMES))]))
    called = rng.choice(NAMES[name] if name in NAMES else OTHERS)
    return rng.choice(CARRIERS).replace("{1}", rng.choice(_VERSIONS)).format(called, "", rng.choice([1, 2, 3, 4]))


def _variants(rng: random.Random, per_class: int) -> list[tuple[list[str], str]]:
    """Training paragraphs of all classes; of ordinary text the most, with common words in any order."""
    word = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    filler = lambda: rng.choice(_COMMON) if rng.random() < 0.5 else word()
    out = []
    for name in CLASSES:
        source = TEMPLATES.get(name) or (UNKNOWN if name == "unknown" else NONE)
        for k in range(per_class * (4 if name == "none" else 2 if name == "unknown" else 1)):
            text = source[k % len(source)].format(word(), word(), rng.randint(1, 9)) if name in ("unknown", "none") else source[k % len(source)]
            if (name in NAMES or name == "unknown") and (k // len(source)) % 2:  # every other round through the templates
                text = _named(rng, name)
            words = tokens(text)
            if name == "none" and k % 3 == 0:
                words = [filler() for _ in range(rng.randint(1, 60))]
            if name not in ("unknown", "none") and k >= len(source):
                dropped = [w for w in words if rng.random() > 0.06]
                words = dropped if len(dropped) > 1 else words
            if k >= len(source) and rng.random() < 0.6:
                words = [filler() for _ in range(rng.randint(0, 8))] + words + [filler() for _ in range(rng.randint(0, 8))]
            out.append((words, name))
    return out


@lru_cache(maxsize=1)
def model() -> dict:
    """Integer weights (thousandths), intercepts, the calibrated margin and the trigger words."""
    train, check = _variants(random.Random(21), 300), _variants(random.Random(22), 100)
    named = [c.replace("{1}", v).format(n, "", k) for n in (*(n for ns in NAMES.values() for n in ns), *OTHERS) for c, v, k in zip(CARRIERS, itertools.cycle(_VERSIONS), itertools.cycle("1234"), strict=False)]
    phrases = [tokens(t.format("", "", "")) for t in (*(t for ts in TEMPLATES.values() for t in ts), *UNKNOWN, *NONE)] + [tokens(t) for t in (*named, *(x.format(n) for x in DOUBTS for ns in NAMES.values() for n in ns))]
    vocabulary = sorted(g for g in set().union(*map(grams, phrases)) if not set(g.split()) <= set(_COMMON) and len(g) > 1)
    place = {g: k for k, g in enumerate(vocabulary)}

    def matrix(rows: list[tuple[list[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for k, (words, _) in enumerate(rows):
            x[k, [place[g] for g in grams(words) if g in place]] = 1
        return x, np.array([CLASSES.index(c) for _, c in rows])

    x, y = matrix(train)
    w, target = np.zeros((len(vocabulary), len(CLASSES)), dtype=np.float32), np.eye(len(CLASSES), dtype=np.float32)[y]
    b = np.where(np.array(CLASSES) == "none", PRIOR, 0).astype(np.float32)  # a paragraph is ordinary text until its words say otherwise
    for _ in range(240):  # proximal gradient steps: those weights that the loss does not need become zero
        p = _softmax(x @ w + b)
        slope = (p - target) / len(y)
        w -= 4 * x.T @ slope
        w = np.sign(w) * np.maximum(np.abs(w) - 4 * 1e-4, 0)
    x, y = matrix(check)
    best = min(np.linspace(0.5, 3, 26), key=lambda t: -sum(np.log(_softmax((x @ w + b) / t)[np.arange(len(y)), y])))
    weights, intercepts = np.round(1000 * w / best).astype(int), np.round(1000 * b / best).astype(int)
    weights[np.abs(weights) < 60] = 0
    s = x @ weights + intercepts
    lead = s[:, : len(FAMILIES)].max(axis=1) - s[:, len(FAMILIES) :].max(axis=1)
    wrong = np.sort(lead[(lead > 0) & (y >= len(FAMILIES))])
    margin = int(max(500, 1 + (wrong[int(0.99 * (len(wrong) - 1))] if len(wrong) else 0)))
    used = np.flatnonzero((weights != 0).any(axis=1))
    rows = {vocabulary[k]: weights[k].tolist() for k in used}
    return {"weights": rows, "intercepts": intercepts.tolist(), "margin": margin, "triggers": triggers(rows, intercepts.tolist())}


def _softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def triggers(weights: dict[str, list[int]], intercepts: list[int]) -> list[str]:
    """Words of which a paragraph must have one, if any class is to reach the score of ``none``.

    Without any of them, all that a paragraph can add to the lead of a class over ``none`` is the sum of the positive
    differences of the grams without such a word; that sum stays below the lead of ``none`` in the intercepts.
    """
    none = CLASSES.index("none")
    gain = {g: np.maximum(0, np.array(w) - w[none]) for g, w in weights.items()}
    behind = intercepts[none] - np.array(intercepts)
    behind[none] = 1
    if (behind <= 0).any():
        raise ValueError("a class is as likely as none without any word")
    words = sorted({w for g in gain for w in g.split()})
    chosen: list[str] = []
    while True:
        left = {g: v for g, v in gain.items() if not set(g.split()) & set(chosen)}
        total = sum(left.values(), np.zeros(len(CLASSES), dtype=int))
        over = total >= behind
        if not over.any():
            return sorted(chosen)
        worth = {w: 0.0 for w in words if w not in chosen}
        for g, v in left.items():
            for w in set(g.split()):
                worth[w] += float((v[over] / behind[over]).sum()) * (0.1 if w in _COMMON else 1)  # rather a rare word
        chosen.append(max(worth, key=lambda w: (worth[w], w)))


def templates() -> list[tuple[str, int, list[str]]]:
    """Family, number and compared grams of every template."""
    out = []
    for family in FAMILIES:
        for k, text in enumerate([*TEMPLATES[family], *NAMES.get(family, [])]):
            words = tokens(text)
            out.append((family, k, sorted(g for g in grams(words) if " " in g or len(words) < 3)))
    return out


#: An end of a sentence at the end of a line, and a blank line; either becomes a record separator.
_ENDS, _BLANK, _SEPARATOR = r"([.!?;:][)\x22]*)[ \t\r]*\n", r"\n[ \t\r]*\n", "\x1e"


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in values) + ")"


def _by_letter(words: list[str]) -> str:
    """A pattern of these words, tried by their first letters."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(first.items()))


def _found(text: Column) -> Column:
    """An array of the paragraphs with a trigger word, in order: ``place`` and ``grams``."""
    trigger = rf"(?:^|[^a-z0-9])(?:{_by_letter(model()['triggers'])})(?:[^a-z0-9]|$)"
    lower = F.lower(text)
    parts = F.split(F.regexp_replace(F.regexp_replace(lower, _ENDS, "$1" + _SEPARATOR), _BLANK, _SEPARATOR), _SEPARATOR, -1)
    some = F.filter(F.transform(parts, lambda x, k: F.struct(k.alias("place"), x.alias("line"))), lambda s: s["line"].rlike(trigger))
    words = F.transform(some, lambda s: F.struct(s["place"].alias("place"), F.regexp_extract_all(s["line"], F.lit("[a-z0-9]+"), F.lit(0)).alias("words")))

    def both(s: Column) -> Column:
        w = s["words"]
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.struct(s["place"].alias("place"), F.array_distinct(F.concat(w, pairs)).alias("grams"))

    return F.when(lower.rlike(trigger), F.transform(words, both))


def _judged(found: Column) -> Column:
    """``place, family, lead`` of each paragraph, a row for each family that it names."""
    m = model()
    weights = "map(" + ", ".join(f"'{g}', array({', '.join(map(str, w))})" for g, w in sorted(m["weights"].items())) + ")"
    vocabulary, table = F.expr(_strings(sorted(m["weights"]))), F.expr(weights)
    start = F.expr(f"array({', '.join(map(str, m['intercepts']))})").cast("array<int>")
    forms = F.expr("array(" + ", ".join(f"named_struct('family', '{f}', 'grams', {_strings(g)})" for f, _, g in templates()) + ")")
    families = F.expr("array(" + ", ".join(f"named_struct('family', '{f}', 'at', {k + 1}, 'alike', {_numbers(_alike(f))})" for k, f in enumerate(FAMILIES)) + ")")
    none, unknown = CLASSES.index("none"), CLASSES.index("unknown")

    def scored(p: Column) -> Column:
        sums = F.aggregate(F.array_intersect(p["grams"], vocabulary), start, lambda s, g: F.zip_with(s, F.element_at(table, g), lambda a, b: a + b))
        return F.struct(p["place"].alias("place"), p["grams"].alias("grams"), sums.alias("sums"))

    def judged(p: Column) -> Column:
        score = lambda f: F.element_at(p["sums"], f["at"])
        behind = F.greatest(p["sums"][none], p["sums"][unknown])
        first = lambda f: ~F.exists(f["alike"], lambda g: (F.element_at(p["sums"], g) > score(f)) | (F.element_at(p["sums"], g) == score(f)) & (g < f["at"]))
        holds = lambda f: F.exists(forms, lambda t: (t["family"] == f["family"]) & (100 * F.size(F.array_intersect(t["grams"], p["grams"])) >= CONFIRM_PERCENT * F.size(t["grams"])))
        known = F.filter(families, lambda f: (score(f) - behind >= m["margin"]) & first(f) & holds(f))
        rows = F.transform(known, lambda f: F.struct(p["place"].alias("place"), f["family"].alias("family"), (score(f) - behind).cast("long").alias("lead")))
        over = F.array_max(p["sums"]) - p["sums"][none]
        other = F.struct(p["place"].alias("place"), F.when(over > 0, "unknown").otherwise("none").alias("family"), over.cast("long").alias("lead"))
        return F.when(F.size(rows) > 0, rows).otherwise(F.array(other))

    return F.flatten(F.transform(F.transform(found, scored), judged))


def _alike(family: str) -> list[int]:
    """The numbers (from 1) of the families of which a paragraph names one, with this one."""
    return [FAMILIES.index(g) + 1 for group in ALIKE if family in group for g in group if g != family]


def _numbers(values: list[int]) -> str:
    return f"cast(array({', '.join(map(str, values))}) as array<int>)"


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, and ``place`` and ``grams`` of each paragraph with a trigger word; a row without them for a document that has none."""
    return docs.select("doc_id", F.explode_outer(_found(F.col(text).cast("string"))).alias("p")).select("doc_id", "p.place", "p.grams")


def scan_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, place, family, lead`` of each paragraph of licence language, of a known family or ``unknown``."""
    return docs.select("doc_id", F.explode(_judged(_found(F.col(text).cast("string")))).alias("p")).select("doc_id", "p.*").filter("family <> 'none'")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: its licence, all families, licence paragraphs and the lead of the chosen one."""
    rows = docs.select("doc_id", _found(F.col(text).cast("string")).alias("found")).select("doc_id", _judged(F.col("found")).alias("all"))
    rows = rows.select("doc_id", F.coalesce(F.filter("all", lambda p: p["family"] != "none"), F.expr("array()").cast("array<struct<place:int,family:string,lead:bigint>>")).alias("some"))
    # Of the best: a known family before unknown, then the larger lead, then the smaller name.
    first = F.array_min(F.transform("some", lambda p: F.struct((p["family"] == "unknown").alias("unknown"), (-p["lead"]).alias("behind"), p["family"].alias("family"))))
    known = F.filter("some", lambda p: p["family"] != "unknown")
    return rows.select("doc_id", "some", first.alias("first"), known.alias("known")).select(
        "doc_id",
        F.coalesce("first.family", F.lit("none")).alias("license"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("known", lambda p: p["family"]))), ",").alias("families"),
        F.size(F.array_distinct(F.transform("some", lambda p: p["place"]))).cast("long").alias("n_paragraphs"),
        F.size(F.array_distinct(F.transform("known", lambda p: p["place"]))).cast("long").alias("n_known"),
        F.coalesce(-F.col("first.behind"), F.lit(0)).cast("long").alias("lead"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their licences."""
    return scan(_session.table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    """Rows of letters, digits and numbers as SQL."""
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def oracle() -> str:
    """The same scan in DuckDB, of every paragraph, with the model as literal rows."""
    m = model()
    weights = _values([(g, CLASSES[k], w) for g, row in sorted(m["weights"].items()) for k, w in enumerate(row) if w])
    forms = _values([(family, k, g, len(gs)) for family, k, gs in templates() for g in gs])
    classes = _values([(c, k, m["intercepts"][k]) for k, c in enumerate(CLASSES)])
    ends = _ENDS.replace("'", "''")
    return f"""
WITH w(gram, class, weight) AS (VALUES {weights}),
c(class, rank, intercept) AS (VALUES {classes}),
t(family, template, gram, pairs) AS (VALUES {forms}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(regexp_replace(regexp_replace(lower(text), '{ends}', '\\1' || chr(30), 'g'), '{_BLANK}', chr(30), 'g'), chr(30)) AS lines FROM documents),
l AS (SELECT rid, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM d),
p AS (SELECT rid, place, regexp_extract_all(line, '[a-z0-9]+') AS words FROM l),
g AS (SELECT DISTINCT rid, place, gram FROM (SELECT rid, place, unnest(words) AS gram FROM p UNION ALL
      SELECT rid, place, words[i] || ' ' || words[i + 1] FROM (SELECT rid, place, words, unnest(range(1, len(words))) AS i FROM p))),
q AS (SELECT DISTINCT rid, place FROM g SEMI JOIN w USING (gram)),
s AS (SELECT rid, place, class, rank, intercept + coalesce(sum(weight), 0) AS score FROM q CROSS JOIN c LEFT JOIN (g JOIN w USING (gram)) USING (rid, place, class) GROUP BY rid, place, class, rank, intercept),
z AS (SELECT rid, place, max(score) FILTER (class = 'none') AS none, max(score) FILTER (class IN ('none', 'unknown')) AS behind, max(score) AS top FROM s GROUP BY rid, place),
h AS (SELECT DISTINCT rid, place, family AS class FROM (SELECT rid, place, family, template FROM g JOIN t USING (gram) GROUP BY ALL HAVING 100 * count(*) >= {CONFIRM_PERCENT} * max(pairs))),
a(class, kind) AS (VALUES {_values([(f, next((str(k) for k, group in enumerate(ALIKE) if f in group), f)) for f in FAMILIES])}),
r AS (SELECT rid, place, class, score, row_number() OVER (PARTITION BY rid, place, kind ORDER BY score DESC, rank) AS n FROM s JOIN a USING (class)),
k AS (SELECT r.rid, r.place, r.class AS family, r.score - z.behind AS led FROM r JOIN z USING (rid, place) JOIN h USING (rid, place, class) WHERE n = 1 AND r.score - z.behind >= {m["margin"]}),
f AS (SELECT * FROM k UNION ALL SELECT rid, place, CASE WHEN top > none THEN 'unknown' ELSE 'none' END, top - none FROM z ANTI JOIN k USING (rid, place)),
b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY family = 'unknown', led DESC, family) AS n FROM f WHERE family <> 'none')
SELECT doc_id, coalesce(max(family) FILTER (n = 1), 'none') AS license, coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (family <> 'unknown'), '') AS families,
       count(DISTINCT place) AS n_paragraphs, count(DISTINCT place) FILTER (family <> 'unknown') AS n_known, coalesce(max(led) FILTER (n = 1), 0)::BIGINT AS lead
FROM d LEFT JOIN b USING (rid) GROUP BY rid, doc_id
"""
