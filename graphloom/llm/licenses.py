"""License scans: a trained paragraph classifier over sparse word n-grams.

Softmax regression on word 1- to 3-grams is trained in numpy on notices of the licence families, on
their damaged variants, and on ordinary prose for the unknown class; its temperature is calibrated
on variants kept aside.  Paragraphs are blocks between blank lines, read both as single lines and
joined, as notices may be wrapped; long ones are read in overlapping windows.  A prediction counts if
its probability passes ``SURE`` and the words hold enough of one of the family's templates, with all
of the template's words that tell versions and variants apart.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table

SURE = 0.5
OVERLAP = 0.6  # share of a template's word pairs that the words must hold
UNKNOWN = "unknown"
VARIANTS = 8
LEAST_SEEN = 3  # training rows that hold an n-gram of the model
EPOCHS = 50
WINDOW, STEP = 120, 60  # words of a window and from one to the next

# Licence families by SPDX identifier, and the names that notices call them by.
NAMES = {
    "Apache-1.1": ("Apache Software License, Version 1.1", "Apache License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License", "MIT licence"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, v. 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "CDDL 1.0"),
    "EUPL-1.2": ("European Union Public Licence v. 1.2", "EUPL 1.2"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "MS-PL": ("Microsoft Public License", "Ms-PL"),
    "PostgreSQL": ("PostgreSQL License",),
    "Python-2.0": ("Python Software Foundation License Version 2", "PSF License"),
    "OpenSSL": ("OpenSSL License",),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "ECL-2.0": ("Educational Community License, Version 2.0",),
    "AFL-3.0": ("Academic Free License version 3.0",),
    "OSL-3.0": ("Open Software License version 3.0",),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3", "GFDL 1.3"),
    "ODbL-1.0": ("Open Database License 1.0", "ODbL 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0"),
}
# Creative Commons licences: by parts and version.
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _p, _n in CC_PARTS.items():
    for _v in ("3.0", "4.0"):
        NAMES[f"CC-{_p}-{_v}"] = (f"CC {_p} {_v}", f"Creative Commons {_n} {_v} International License", f"Creative Commons {_n} {_v} License")
FORMS = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "This software is distributed under the terms of the {}.", "The source code is available under the {}, see LICENSE.", "License: {}")
# Headers of files and paragraphs of the licences' own texts.
GNU_HEADER = "This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
GNU_TITLE = "GNU {name} Version {version}, {date}"
PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
PARAGRAPHS = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "MIT": (PERMISSION, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "BSD-2-Clause": (REDISTRIBUTION + " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",),
    "BSD-3-Clause": (REDISTRIBUTION, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "GPL-2.0": (GNU_HEADER.format(thing="program", name="General Public License", version="2"), GNU_TITLE.format(name="GENERAL PUBLIC LICENSE", version="2", date="June 1991")),
    "GPL-3.0": (GNU_HEADER.format(thing="program", name="General Public License", version="3"), GNU_TITLE.format(name="GENERAL PUBLIC LICENSE", version="3", date="29 June 2007")),
    "LGPL-2.1": (GNU_HEADER.format(thing="library", name="Lesser General Public License", version="2.1"), GNU_TITLE.format(name="LESSER GENERAL PUBLIC LICENSE", version="2.1", date="February 1999")),
    "LGPL-3.0": (GNU_HEADER.format(thing="library", name="Lesser General Public License", version="3"), GNU_TITLE.format(name="LESSER GENERAL PUBLIC LICENSE", version="3", date="29 June 2007")),
    "AGPL-3.0": (GNU_HEADER.format(thing="program", name="Affero General Public License", version="3"), GNU_TITLE.format(name="AFFERO GENERAL PUBLIC LICENSE", version="3", date="19 November 2007")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "proprietary": ("All rights reserved.", "This document is confidential and proprietary. All rights reserved."),
}
# Ordinary prose for the unknown class, some of it about licences.
PROSE = (
    "the driver lost his license after the accident", "a fishing license is needed in this county", "she was granted permission to leave", "the public was invited to the general meeting", "version 2.0 of the song was released under a new label", "free software is discussed in the next chapter of this work", "copies of the document were distributed to the public", "he worked under the terms of the agreement", "creative people share common ideas", "the general public may use this entrance", "the source of the river and its forms", "the rights of the person were reserved for later",
    "the apache helicopter was licensed to fly", "students at mit released a paper in version 3", "the eclipse was public and many people watched it", "a boost in software sales was distributed over the year", "the artistic director has a license to change version 1.0 of the play", "all tables are reserved on friday", "the university of illinois opened its source archive", "the european union published a new version of its terms", "copyright law was discussed at the meeting", "permission to use the hall is granted for a fee",
)

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
# Words of a template that must all be there: numbers, and those by which licences differ.
TELLING = re.compile(r".*[0-9].*|lesser|affero|documentation|sharealike|noncommercial|noderivatives|attribution.*|by(?:-.*)?|nc|nd|sa|.*gpl.*")
FAMILIES = (UNKNOWN, *sorted({f.lower() for f in (*NAMES, *PARAGRAPHS)}))


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def pairs(words: list[str]) -> set:
    return set(zip(words, words[1:], strict=False)) or {(w,) for w in words}


def notices(forms=FORMS) -> list[tuple[str, str]]:
    """(family, notice): each name in each form, the SPDX lines and the paragraphs."""
    named = [(f.lower(), form.format(name)) for f, names in NAMES.items() for name in names for form in forms]
    spdx = [(f.lower(), f"SPDX-License-Identifier: {f}{tail}") for f in NAMES for tail in (("", "-only", "-or-later") if f.startswith(("GPL", "LGPL", "AGPL", "GFDL")) else ("",))]
    return named + spdx + [(f.lower(), p) for f, ps in PARAGRAPHS.items() for p in ps]


class LicenseModel:
    """The classifier, trained from a fixed seed; the driver makes it once and tasks get its weights."""

    def __init__(self, forms=FORMS):
        rng = np.random.default_rng(11)
        known = [(f, tokens(t)) for f, t in notices(forms)]
        prose = [w for t in PROSE for w in tokens(t)]
        train, aside = [], []
        for family, words in known:
            for k in range(VARIANTS):
                (aside if k == VARIANTS - 1 else train).append((family, self._damaged(words, prose, rng) if k else words))
        for k in range(len(known)):
            own = tokens(PROSE[k % len(PROSE)]) if k < 4 * len(PROSE) else list(rng.choice(prose, 14))
            if k % 3 == 2:  # stray words of notices are no licence
                own += list(rng.choice(known[k][1], 2))
            (aside if k % 5 == 4 else train).append((UNKNOWN, own))
        seen = Counter(g for _, w in train for g in ngrams(w))
        self.index = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= LEAST_SEEN))}
        whole = {(f.lower(), tuple(tokens(n))) for f, names in NAMES.items() for n in names} | {(f, tuple(w)) for f, w in known if w[0] == "spdx-license-identifier"} | {(f.lower(), tuple(tokens(p))) for f, ps in PARAGRAPHS.items() for p in ps}
        self.templates: dict = {}
        for family, words in sorted(whole):
            self.templates.setdefault(family, []).append((pairs(list(words)), {w for w in words if TELLING.fullmatch(w)}))
        self.anchors = self._anchors([list(w) for _, w in whole], Counter(prose))
        self.weights, self.temperature = np.zeros((len(self.index) + 1, len(FAMILIES)), np.float32), 1.0
        self._train(train)
        self._calibrate(aside)

    @staticmethod
    def _anchors(templates: list[list[str]], common: Counter) -> set[str]:
        """Words without which no template can be held by ``OVERLAP``: long ones that prose lacks go first."""
        out: set = set()
        for words in templates:
            need = pairs(words)
            for w in sorted(set(words), key=lambda w: (common[w] > 0, -len(w), w)):
                if len(need) < OVERLAP * len(pairs(words)):  # too few pairs without the words chosen so far
                    break
                out.add(w)
                need = {p for p in need if w not in p}
        return out

    @staticmethod
    def _damaged(words, prose, rng):
        own = [w for w in words if len(words) < 6 or rng.random() > 0.04]
        return [*rng.choice(prose, rng.integers(0, 9)), *own, *rng.choice(prose, rng.integers(0, 9))]

    def _rows(self, data):
        return [[self.index[g] for g in ngrams(w) if g in self.index] for _, w in data], np.array([FAMILIES.index(f) for f, _ in data])

    def _logits(self, row):
        return self.weights[row].sum(0) / np.sqrt(len(row) + 1) + self.weights[-1]

    def _train(self, data):
        rows, y = self._rows(data)
        x = np.zeros((len(rows), len(self.index) + 1), np.float32)
        for i, r in enumerate(rows):
            x[i, r] = 1 / np.sqrt(len(r) + 1)
            x[i, -1] = 1
        target, sq = np.eye(len(FAMILIES), dtype=np.float32)[y], np.full_like(self.weights, 1e-8)
        for _ in range(EPOCHS):
            z = x @ self.weights
            p = np.exp(z - z.max(1, keepdims=True))
            g = x.T @ (p / p.sum(1, keepdims=True) - target) / len(rows) + 1e-6 * self.weights
            sq += g**2
            self.weights -= 0.5 * g / np.sqrt(sq)

    def _calibrate(self, data):
        rows, y = self._rows(data)
        z = np.array([self._logits(r) for r in rows])

        def loss(t):
            s = z / t
            return -(s[np.arange(len(y)), y] - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) - s.max(1)).mean()

        self.temperature = min((0.15, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)

    def holds(self, family: str, words: list[str]) -> bool:
        """Whether the words hold enough of a template of the family, and all of its telling words."""
        every = set(words)
        own = pairs(words) | {(w,) for w in every}
        return any(told <= every and len(t & own) >= OVERLAP * len(t) for t, told in self.templates[family])

    def classify(self, words: list[str]) -> tuple[str, float]:
        """(family, probability) of a paragraph's words; unknown if no template confirms the prediction."""
        row = [self.index[g] for g in ngrams(words) if g in self.index]
        z = self._logits(row) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if best and p[best] >= SURE and self.holds(FAMILIES[best], words):
            return FAMILIES[best], float(p[best])
        return UNKNOWN, float(p[0])

    def found(self, text: str) -> list[tuple[str, float]]:
        """Families of a stretch of text, read in windows if it is long."""
        own = tokens(text)
        if self.anchors.isdisjoint(own):
            return []
        parts = [own[i : i + WINDOW] for i in range(0, max(1, len(own) - STEP), STEP)] if len(own) > WINDOW else [own]
        return [got for part in parts if not self.anchors.isdisjoint(part) and (got := self.classify(part))[0] != UNKNOWN]

    def paragraphs(self, text: str) -> tuple[int, list[tuple[str, int, int, float]]]:
        """(number of paragraphs, (family, start, end, probability) of the notices): lines, and blocks of lines whose lines alone say nothing."""
        n, at, out = 0, 0, []
        for block in BLANK_LINE.split(text):
            if block.strip():
                n += 1
            if not self.anchors.isdisjoint(WORD.findall(block.lower())):
                found, line_at = [], at
                lines = block.split("\n")
                for line in lines:
                    found += [(f, line_at, line_at + len(line), p) for f, p in self.found(line)]
                    line_at += len(line) + 1
                if len(lines) > 1:
                    known = {f for f, *_ in found}
                    found += [(f, at, at + len(block), p) for f, p in self.found(block) if f not in known]
                best: dict = {}
                for f, a, b, p in found:
                    best[f, a, b] = max(p, best.get((f, a, b), 0.0))
                out += sorted((f, a, b, p) for (f, a, b), p in best.items())
            at += len(block)
        return n, out


BLANK_LINE = re.compile(r"(?<=\n)(?=[ \t\r]*\n)")


@cache
def model() -> LicenseModel:
    return LicenseModel()


def _scan_part(m: LicenseModel):
    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = m.paragraphs(text or "")
                for col, x in zip(cols, (doc, n, ",".join(sorted({f[0] for f in found})), ",".join(f"{f}:{a}:{b}" for f, a, b, _ in found), max((f[3] for f in found), default=0.0)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "n_paragraphs", "families", "spans", "confidence"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any others): its licence families and where their notices stand.

    Null and empty texts have no paragraphs and no families.  Texts and lines of any length are read
    whole, in windows.  Of equally probable families the first by name counts.  Repeated rows are
    scanned each.  An empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan_part(model()), "doc_id long, n_paragraphs long, families string, spans string, confidence double")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
