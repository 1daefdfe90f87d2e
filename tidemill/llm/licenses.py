"""Licence scan with DataFrame functions only: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines; a line that breaks off within a sentence goes on in the next one, as in text wrapped at a fixed
width, and blank lines always end one. Features are all word n-grams (1 to 3). A sparse multinomial logistic regression,
trained on the driver from the examples below, keeps some of them (the vocabulary); its classes are
the licence families and unknown text. The temperature of its probabilities is set on examples held out in turn, whole
names at a time, and so is the least probability of a known class. A prediction is confirmed if the paragraph holds most
of the n-grams of one of the class's templates; a paragraph that holds 0.95 of the n-grams of a template is of that template's
class, whatever the model says. Templates to compare with are found by their rarest n-grams, of which such a paragraph
holds one at least. Every paragraph is classified: words are looked up by their 64-bit hashes, n-grams by those of their
words, in literal tables of buckets; a paragraph without any known n-gram has the constant's verdict, which is unknown
(``model`` sees to that).
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import let

UNKNOWN = "unknown"
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache License 2.0.", "Apache License Version 2.0, January 2004"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This software is distributed under the terms of the MIT license."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-or-later", "either version 3 of the License, or (at your option) any later version of the GNU General Public License", "Released under the GPL version 3."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPL version 2.", "either version 2 of the License, or (at your option) any later version of the GNU General Public License"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-3.0-or-later", "Released under the LGPL version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL version 3."),
    "bsd": ("Licensed under the BSD License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.", "SPDX-License-Identifier: CC0-1.0"),
    "public-domain": ("This work is in the public domain.", "Released into the public domain.", "This is free and unencumbered software released into the public domain."),
    "isc": ("Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "epl-2.0": ("Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Company. All rights reserved.", "Proprietary and confidential. Unauthorized copying is strictly prohibited.", "Copyright (c) 2019 by the authors, all rights reserved"),
    UNKNOWN: (
        "He lost his driving license last year.", "The fishing licence costs ten pounds.", "The museum reserved a room for the mit students.", "They asked for permission to leave the table.",
        "Civil rights were the subject of the debate.", "The commons voted on the bill.", "Creative people work at night.", "A warranty of two years came with the fridge.",
        "Copyright law is taught in the second year.", "The apache helicopter landed.", "He works in the domain of physics.", "The solar eclipse was seen in spring.", "A dog license is required in the city.",
        "The table was reserved for eight.", "The gnu is a large antelope.", "Redistribution of wealth was the theme of his speech.", "The letter was confidential.",
        "The train to the coast leaves at ten and is seldom late.", "She wrote the second version of the report in January.", "Under the bridge the water is two metres deep.", "This file is too large to be sent by mail.",
        "You may not use this door after six.", "The work was done by three people in a week.", "Any person over sixty travels free of charge.", "The terms of the loan were hard to understand.",
        "All of the students passed the test at the university.", "Released in 1994, the film was seen by millions.", "The foundation of the house was laid in 2004.", "The public library is open on Sundays.",
        "General Lee lost the battle.", "The source of the river lies in the mountains.", "Version 2.0 of the game runs faster.", "The software is installed on every machine.", "To the north lies the sea, to the south the desert.",
        "import os", "def main(args):", "for i in range(10): print(i)", "Le train part à dix heures.", "Der Zug fährt um zehn Uhr ab.", "Er kam mit dem Zug.", "Mit und ohne Zucker.", "Sie spielt mit ihm.", "Mit ihr.", "El tren sale a las diez.", "", "", "", "",
    ),
}


#: Names by which notices call a licence, and what notices say of it: further examples.
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"),
    "mit": ("MIT License", "MIT licence", "Expat MIT license"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3 license", "GNU General Public License v3.0"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2 license", "GNU General Public License v2.0"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "GNU Lesser General Public License"),
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "Affero General Public License"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0 license"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0 license", "Creative Commons Attribution 3.0 license"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license", "CC BY-SA 3.0 license"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license", "CC BY-NC 3.0 license"),
    "cc0": ("CC0 1.0 Universal public domain dedication", "CC0 license", "Creative Commons Zero, CC0 1.0"),
    "public-domain": ("Unlicense, into the public domain", "terms of the Unlicense"),
    "isc": ("ISC License", "ISC licence", "ISC open source license"),
    "epl-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0 license"),
}

#: Paragraphs of the licences themselves, of their notices and of the files that go with them (fixed texts).
TEXTS = {
    "apache-2.0": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": ("To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/", "Creative Commons Attribution 4.0 International Public License", "Attribution 4.0 International (CC BY 4.0)"),
    "cc-by-sa": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "Attribution-ShareAlike 4.0 International (CC BY-SA 4.0)", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    "cc-by-nc": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "Attribution-NonCommercial 4.0 International (CC BY-NC 4.0)"),
    "cc0": ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.", "To view a copy of CC0, visit http://creativecommons.org/publicdomain/zero/1.0/"),
    "public-domain": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    "proprietary": (
        "This document is proprietary and confidential. No part of it may be disclosed in any manner to a third party without the prior written consent of the company.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.", "All content is the property of its owner and may not be used without permission. All rights reserved.",
    ),
    UNKNOWN: (
        "The court granted the company permission to build on the land without restriction, subject to the following conditions of the council.", "She is free to copy the recipe, to change it and to sell the cake for any purpose.", "The above notice was included in all copies of the newspaper.",
        "In no event shall the players be late for the game.", "Either version of the story may be true, or any later one.", "The terms of the contract were published by the foundation in June 2007.", "To view the exhibition, visit the museum on Sunday.",
        "The author of the book disclaims any link with the party.", "The program was made available to the public in 2004.", "He waived his right to a lawyer.", "The company lost its licence to sell beer.", "Version 3 of the plan was dropped in 1991.",
    ),
}
PHRASES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "The code is available under the {}, see the file LICENSE.", "{}")
EXAMPLES = {k: (*own, *TEXTS.get(k, ()), *(x.format(n) for n in NAMES.get(k, ()) for x in PHRASES)) for k, own in TEMPLATES.items()}
#: Examples that are measured together: all phrases of a name, and each other example by itself.
GROUPS = {k: (*range(len(TEMPLATES[k]) + len(TEXTS.get(k, ()))), *(1000 + n for n in range(len(NAMES.get(k, ()))) for _ in PHRASES)) for k in EXAMPLES}
#: What a line that goes on in the next one ends with, and what that begins with.
SOFT_BREAK = r"\n(?<=[^\n]{40}[a-z0-9,;\"]\n)[ \t]*(?=[a-z(])"
WORD = "[a-z]+|[0-9]+"
SEED, BUCKETS, FLAGS = 42, 8192, 1 << 16


def paragraphs_of(text: str) -> list[str]:
    return re.split("\r?\n", re.sub(SOFT_BREAK, " ", text))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, or of digits, of ASCII, so that names of versions fall apart alike however they are written."""
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def norm_of(words: list[str]) -> float:
    """The root of the number of n-grams, repeats included; 1 at least."""
    return math.sqrt(max(1, sum(max(0, len(words) - n + 1) for n in (1, 2, 3))))


def gram_hash(gram: str) -> int:
    """As Spark's xxhash64 of the words: each word's hash is the next one's seed. Signed."""
    h = SEED
    for word in gram.split(" "):
        h = xxhash.xxh64_intdigest(word.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def _fit(rows: list[tuple[str, int]], classes: int, rounds: int = 300, rate: float = 1.0, l1: float = 5e-5) -> tuple[dict[str, int], np.ndarray]:
    """The vocabulary of n-grams with a weight, and the weights, the last row being the constants. Each class counts alike."""
    held = [(grams_of(words_of(t)), norm_of(words_of(t)), c) for t, c in rows]
    seen = {g for grams, _, _ in held for g in grams}
    vocabulary = {g: i for i, g in enumerate(sorted(seen))}
    x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
    for k, (grams, norm, _) in enumerate(held):
        x[k, [vocabulary[g] for g in grams]] = 1 / norm
    x[:, -1] = 1
    y = np.eye(classes, dtype=np.float32)[[c for _, c in rows]]
    w = np.zeros((x.shape[1], classes), np.float32)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * 10 * (x.T @ (p - y) / len(rows))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * l1, 0)
    some = np.flatnonzero(np.abs(w[:-1]).max(axis=1) > 0)
    names = sorted(vocabulary)
    return {names[i]: k for k, i in enumerate(some.tolist())}, np.round(np.concatenate((w[:-1][some], w[-1:])).astype(np.float64), 6)


def _logits(text: str, vocabulary: dict[str, int], w: np.ndarray) -> np.ndarray:
    words = words_of(text)
    known = [vocabulary[g] for g in grams_of(words) if g in vocabulary]
    return w[-1] + w[known].sum(axis=0) / norm_of(words)


@functools.cache
def _held_out(folds: int = 5) -> list[tuple[np.ndarray, int, int]]:
    """Logits, class, and class after the comparison with templates, of every example, by a model and templates without its whole group."""
    names = list(EXAMPLES)
    rows = [(t, k, sum(map(ord, n)) + g) for k, n in enumerate(names) for t, g in zip(EXAMPLES[n], GROUPS[n])]
    out = []
    for fold in range(folds):
        own = [r[:2] for r in rows if r[2] % folds != fold]
        vocabulary, w = _fit(own, len(names))
        known = [(k, grams_of(words_of(t))) for t, k in own if names[k] != UNKNOWN]
        for t, c, g in rows:
            if g % folds == fold:
                z = _logits(t, vocabulary, w)
                out.append((z, c, _same(grams_of(words_of(t)), known, int(z.argmax()))[0]))
    return out


def _same(own: set[str], templates: list[tuple[int, set[str]]], best: int) -> tuple[int, bool]:
    """The class of the template that fits best (``_fits``; the first of those that tie) if ``own`` holds enough of one; else ``best``."""
    found = [(fit, -i, k) for i, (k, grams) in enumerate(templates) if grams and (fit := _fits(len(grams & own), len(grams))) >= 0]
    return (max(found)[2], True) if found else (best, False)


def _fits(shared, size):
    """0 or more if a share of 0.95 is there; larger for large templates, and for those of which less is missing."""
    return shared * 20 - size * 19


@functools.cache
def model() -> dict:
    """Vocabulary, weights, temperature and least probability of a known class."""
    names = list(EXAMPLES)
    unknown, held = names.index(UNKNOWN), _held_out()

    def loss(t: float) -> float:
        return sum(math.log(np.exp(z / t - (z / t).max()).sum()) - (z[c] / t - (z / t).max()) for z, c, _ in held)

    temperature = min((t / 20 for t in range(4, 61)), key=loss)
    vocabulary, w = _fit([(t, k) for k, n in enumerate(names) for t in EXAMPLES[n]], len(names))
    if int(w[-1].argmax()) != unknown:
        raise ValueError("text without any known word has to count as unknown")
    false = [np.exp(z / temperature - (z / temperature).max()) for z, c, _ in held if c == unknown]
    least = max([0.3, *(float(np.delete(p / p.sum(), unknown).max()) for p in false)])
    templates = [(k, grams_of(words_of(t))) for k, n in enumerate(names) if n != UNKNOWN for t in EXAMPLES[n]]
    return {"names": names, "vocabulary": vocabulary, "weights": w, "temperature": temperature, "least": min(0.6, least), "templates": templates}


def judge_paragraph(text: str, least: float | None = None) -> tuple[str, float, float, bool]:
    """(class, probability, similarity, whether a template outweighed the model or agreed) of one paragraph in plain Python: the reference of ``scan``."""
    held = model()
    names, templates = held["names"], held["templates"]
    z = _logits(text, held["vocabulary"], held["weights"]) / held["temperature"]
    own = grams_of(words_of(text))
    best, same = _same(own, templates, int(z.argmax()))
    probability = 1 / float(np.exp(z - z[best]).sum())
    return names[best], probability, max((len(g & own) / len(g) for k, g in templates if k == best), default=0.0), same


def _constant(value, kind: str) -> Column:
    """One literal, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _lookup(hashes: dict[int, int]):
    """A function of a hash column: the number that belongs to the hash, or null."""
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for h, i in hashes.items():
        buckets[h % BUCKETS].append({"h": h, "i": i})
    table = _constant(buckets, "array<array<struct<h:bigint,i:int>>>")
    return lambda h: F.get(F.filter(F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int")), lambda x: x["h"] == h), F.lit(0))["i"]


def scan(docs: DataFrame, least: float | None = None, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (from 0), licence, probability, similarity, confirmed: one row for each paragraph of a known licence; no shuffle.

    ``similarity`` is the largest share of a template's n-grams that the paragraph holds, over the templates of the
    class; ``confirmed`` if it is ``confirm`` or more. ``probability`` is the model's for the class, also where a template
    decided it. Of classes that tie, the first of ``EXAMPLES`` counts, of templates the one that fits best (``_fits``) and then the first one.
    Null and empty texts give no rows. Texts and lines may be of any length. Repeated rows and paragraphs are reported
    each, rows without an id with a null id; an empty table gives none; further columns are not carried, whatever their
    names.
    """
    held = model()
    least = held["least"] if least is None else least
    names, vocabulary, w, t, own = held["names"], held["vocabulary"], held["weights"], held["temperature"], held["templates"]
    unknown = names.index(UNKNOWN)
    # numbers of n-grams: those with a weight first, then those that only templates hold
    rest = sorted({g for _, grams in own for g in grams} - vocabulary.keys())
    number = vocabulary | {g: len(vocabulary) + i for i, g in enumerate(rest)}
    seen = Counter(g for _, grams in own for g in grams)
    # a text that holds a share of 0.95 of a template holds one of its rarest n-grams, a few more of them than the others may be
    rare: list[list[int]] = [[] for _ in number]
    for i, (_, grams) in enumerate(own):
        for g in sorted(grams, key=lambda g: (seen[g], -len(g), g))[: len(grams) - math.ceil(len(grams) * 19 / 20) + 1]:
            rare[number[g]].append(i)
    some = [False] * FLAGS
    for g in number:
        some[gram_hash(g.split(" ")[0]) % FLAGS] = True
    flags = _constant(some, "array<boolean>")
    gram_number = _lookup({gram_hash(g): i for g, i in number.items()})
    weights, constant = _constant(w[:-1].tolist(), "array<array<double>>"), _constant(w[-1].tolist(), "array<double>")
    templates = _constant([{"k": k, "i": i, "g": sorted(number[g] for g in grams)} for i, (k, grams) in enumerate(own)], "array<struct<k:int,i:int,g:array<int>>>")
    by_class = _constant([[i for i, (k, _) in enumerate(own) if k == n] for n in range(len(names))], "array<array<int>>")
    rarest = _constant(rare, "array<array<int>>")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).where("_text is not null")
    lines = rows.select("doc_id", F.posexplode(F.split(F.regexp_replace("_text", SOFT_BREAK, " "), "\r?\n", -1)).alias("paragraph", "_line"))
    words = F.regexp_extract_all(F.lower("_line"), F.lit(WORD), F.lit(0))

    def known_grams(words: Column) -> Column:
        """Numbers of the paragraph's n-grams; they begin at words whose flag is set, as those of the table are."""
        spots = F.array_compact(F.transform(words, lambda x, i: F.when(F.get(flags, F.pmod(F.xxhash64(x), F.lit(FLAGS)).cast("int")), i)))
        at = lambda i, k: F.get(words, i + k)
        each = lambda i: F.array(gram_number(F.xxhash64(at(i, 0))), F.when(at(i, 1).isNotNull(), gram_number(F.xxhash64(at(i, 0), at(i, 1)))), F.when(at(i, 2).isNotNull(), gram_number(F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))))
        return F.array_distinct(F.filter(F.flatten(F.transform(spots, each)), lambda i: i.isNotNull()))

    def logits(known: Column, words: Column) -> Column:
        total = F.aggregate(F.filter(known, lambda i: i < len(vocabulary)), F.array_repeat(F.lit(0.0), len(names)), lambda acc, i: F.zip_with(acc, F.get(weights, i), lambda a, b: a + b))
        n = F.size(words)
        count = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
        return let(F.greatest(F.sqrt(count.cast("double")), F.lit(1.0)), lambda s: F.zip_with(total, constant, lambda a, b: (a / s + b) / F.lit(float(t))))

    held_of = lambda x, known: F.size(F.array_intersect(x["g"], known))

    def same(known: Column) -> Column:
        """How well the best template fits, its place and class; null if none does."""
        near = F.array_distinct(F.flatten(F.transform(known, lambda i: F.get(rarest, i))))
        fits = F.transform(near, lambda i: let(F.get(templates, i), lambda x: F.struct(_fits(held_of(x, known), F.size(x["g"])).alias("n"), (-x["i"]).alias("i"), x["k"].alias("k"))))
        return F.array_max(F.filter(fits, lambda x: x["n"] >= 0))

    def classed(known: Column, z: Column, top: Column, match: Column) -> Column:
        best = F.coalesce(match["k"], F.array_position(z, top).cast("int") - 1)

        def told(b: Column) -> Column:
            chance = F.exp(F.get(z, b) - top) / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
            share = lambda i: let(F.get(templates, i), lambda x: held_of(x, known) / F.size(x["g"]))
            similarity = F.coalesce(F.round(F.array_max(F.transform(F.get(by_class, b), share)), 6), F.lit(0.0))
            return F.when((b != unknown) & (match.isNotNull() | (chance >= least)), F.struct(b.alias("best"), F.round(chance, 6).alias("probability"), similarity.alias("similarity")))

        return let(best, told)

    def verdict(ws: Column, known: Column) -> Column:
        return F.when(F.size(known) > 0, let(logits(known, ws), lambda z: let(F.array_max(z), lambda top: let(same(known), lambda match: classed(known, z, top, match)))))

    # all in one expression below an explode, so that no filter is evaluated ahead of it by computing it again
    one = let(words, lambda ws: let(known_grams(ws), lambda known: F.array(verdict(ws, known))))
    judged = lines.select("doc_id", "paragraph", F.explode(F.filter(one, lambda r: r.isNotNull())).alias("_r"))
    licence = F.get(F.array(*[F.lit(n) for n in names]), F.col("_r.best"))
    return judged.select("doc_id", "paragraph", licence.alias("licence"), "_r.probability", "_r.similarity", (F.col("_r.similarity") >= confirm).alias("confirmed"))
