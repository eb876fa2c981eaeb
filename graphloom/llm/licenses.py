"""Licence scans by sentence rules.

A text is cut into sentences (at line ends and after ``. ! ? : ;`` before white space).  A sentence, or a run
of them where lines wrap, whose words (lower-cased letters and digits) are exactly those of a known licence
sentence gets that sentence's identifier.  The identifiers of a text, in order, are then matched with the
ordered licence rules: a rule is a sequence of identifiers, of which neighbours may have at most ``GAP``
unrecognised sentences between them; longer rules go first and an identifier serves one rule.  Notices that license
nothing ("All rights reserved") have rules and a column of their own.

Defined cases: null and empty texts hold no licence; a sentence that repeats may match a rule each time;
repeated rows each give their row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import _text as X
from ._session import tune
from .decontaminate import GAP as NOT_WORD

#: Unrecognised sentences allowed between the neighbours of a rule.
GAP = 2

# Sentences of public licences and licence notices, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-notice-3": "This project is licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-retain": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-notice-2": "Licensed under the GNU General Public License, version 3",
    "gpl2-notice": "Licensed under the GNU General Public License, version 2",
    "gpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "lgpl21-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "agpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-notice": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl3-notice": "Licensed under the GNU Affero General Public License, version 3",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl2-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl2-provided": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl1-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl1-notice": "Distributed under the Boost Software License, Version 1.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "all-rights": "All rights reserved",
}
# Licence rules, each an ordered sequence of sentence identifiers.
RULES = [
    ("MIT", ["mit-grant", "mit-retain", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-retain"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("MIT", ["mit-notice-3"]),
    ("Apache-2.0", ["apache2-header", "apache2-comply", "apache2-copy", "apache2-unless"]),
    ("Apache-2.0", ["apache2-header", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-header", "apache2-comply"]),
    ("Apache-2.0", ["apache2-header"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms"]),
    ("GPL-3.0-or-later", ["gpl3-header", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-header"]),
    ("GPL-2.0-or-later", ["gpl2-header", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-header"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-only", ["gpl3-notice-2"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("GPL-3.0-only", ["gpl3-title", "gpl-verbatim"]),
    ("GPL-2.0-only", ["gpl2-title", "gpl-verbatim"]),
    ("LGPL-2.1-only", ["lgpl21-title", "gpl-verbatim"]),
    ("LGPL-3.0-only", ["lgpl3-title", "gpl-verbatim"]),
    ("AGPL-3.0-only", ["agpl3-title", "gpl-verbatim"]),
    ("LGPL-2.1-or-later", ["lgpl21-header", "lgpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-header"]),
    ("LGPL-3.0-or-later", ["lgpl3-header", "gpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-header"]),
    ("AGPL-3.0-or-later", ["agpl3-header", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-header"]),
    ("LGPL-3.0-only", ["lgpl3-notice"]),
    ("AGPL-3.0-only", ["agpl3-notice"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy-2"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("EPL-2.0", ["epl2-title", "epl2-provided"]),
    ("EPL-2.0", ["epl2-title"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("BSL-1.0", ["bsl1-title"]),
    ("BSL-1.0", ["bsl1-notice"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-long"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-long"]),
    ("CC0-1.0", ["cc0-notice"]),
]
# Licence names that tag lines give.
TAGS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in TAGS}
RULES += [(name, [f"spdx-{name}"]) for name in TAGS]
#: Rules of notices that license nothing.
NOTICES = [("All-Rights-Reserved", ["all-rights"])]
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True


class Sentences:
    """Known sentences by the hash of their words; ``rules`` longest first."""

    def __init__(self, sentences: dict[str, str] | None = None, rules: list | None = None, notices: list | None = None):
        known, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
        notices = [n for n in NOTICES if all(s in known for s in n[1])] if notices is None else notices
        self.names = list(known)
        chunk = next(X.chunks(pa.array([known[n] for n in self.names]), 1 << 40))
        w = X.words(chunk, NOT_WORD)
        h = X.word_hashes(chunk, w)
        self.sizes = np.diff(w.bounds)
        self.lengths = np.unique(self.sizes)
        whole = self._hash(h, w.bounds[:-1], self.sizes)
        self.by_hash = {int(x): i for i, x in enumerate(whole)}
        self.sorted = np.sort(whole)
        self.firsts = np.unique(h[w.bounds[:-1]])
        ids = {n: i for i, n in enumerate(self.names)}
        self.rules, self.notices = (sorted(((name, [ids[s] for s in seq]) for name, seq in some), key=lambda r: -len(r[1])) for some in (rules, notices))

    @staticmethod
    def _hash(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        p, q = X.powers(len(h))
        total = np.zeros(len(h) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * p[: len(h)], out=total[1:])
            return X.mix((total[first + size] - total[first]) * q[first] + np.asarray(size).astype(np.uint64))

    def recognise(self, chunk: X.Chunk) -> tuple[X.Words, np.ndarray, list[tuple[int, int, int]]]:
        """(words, ordinal of the sentence of each word, [(first word, sentence id, words)] in order)."""
        w = X.words(chunk, NOT_WORD)
        n = len(w.start)
        if not n:
            return w, np.zeros(0, np.int64), []
        data = chunk.data
        after = np.append(X.SPACE[data[1:]], True)
        after[chunk.offsets[1:][chunk.offsets[1:] > 0] - 1] = True
        breaks = (data == 10) | (_STOP[data] & after)
        seen = np.concatenate([[0], np.cumsum(breaks)])
        begins = np.ones(n, bool)
        begins[1:] = seen[w.start[1:]] > seen[w.end[:-1]]
        begins[w.bounds[:-1][w.bounds[:-1] < n]] = True
        ends = np.append(begins[1:], True)
        h = X.word_hashes(chunk, w)
        start = np.flatnonzero(begins)
        start = start[np.isin(h[start], self.firsts)]
        found = []
        row_end = w.bounds[1:][w.row[start]]
        for size in self.lengths:
            ok = start + size <= row_end
            at = start[ok][ends[start[ok] + size - 1]]
            if len(at):
                x = self._hash(h, at, np.full(len(at), size))
                hit = np.isin(x, self.sorted)
                found += [(int(a), self.by_hash[int(y)], int(size)) for a, y in zip(at[hit], x[hit])]
        return w, np.cumsum(begins), sorted(found)

    @staticmethod
    def match(rules: list, ids: list[tuple[int, int, int]], ordinal: np.ndarray) -> list[tuple[str, int, int]]:
        """(rule, first, last) indexes into ``ids`` of one text."""
        used, out = set(), []
        for name, seq in rules:
            for k in range(len(ids) - len(seq) + 1):
                span = range(k, k + len(seq))
                if [ids[j][1] for j in span] == seq and not used.intersection(span) and all(ordinal[ids[j + 1][0]] - ordinal[ids[j][0] + ids[j][2] - 1] <= GAP + 1 for j in span[:-1]):
                    used.update(span)
                    out.append((name, k, k + len(seq) - 1))
        return sorted(out, key=lambda x: x[1])


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """(key, n_sentences, licenses, spans, notices) of each row: recognised sentences, distinct licences sorted and
    comma-joined, ``licence:start:end`` byte spans in order, comma-joined, and the same of notices that license nothing."""
    tune(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sentences(sentences, rules)
        for batch in batches:
            for chunk in X.chunks(batch.column(1)):
                w, ordinal, found = known.recognise(chunk)
                rows: dict[int, list] = {}
                for f in found:
                    rows.setdefault(int(w.row[f[0]]), []).append(f)
                counts = np.zeros(chunk.rows, np.int64)
                names, spans, notices = ([""] * chunk.rows for _ in range(3))
                for r, ids in rows.items():
                    base = chunk.offsets[r]
                    listed = lambda hits: ",".join(f"{name}:{w.start[ids[a][0]] - base}:{w.end[ids[b][0] + ids[b][2] - 1] - base}" for name, a, b in hits)  # noqa: B023, E731
                    hits = known.match(known.rules, ids, ordinal)
                    counts[r] = len(ids)
                    names[r] = ",".join(sorted({x[0] for x in hits}))
                    spans[r], notices[r] = listed(hits), listed(known.match(known.notices, ids, ordinal))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), pa.array(counts), pa.array(names), pa.array(spans), pa.array(notices)], [key, "n_sentences", "licenses", "spans", "notices"])

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_sentences long, licenses string, spans string, notices string")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
