"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case, shingles have three words. Templates fall into classes by length
(8, 16, 32, ... words). A class's windows are a quarter of its length longer than its longest template and start
that often, so each occurrence lies wholly in some window. With at least ``CONTAINED`` of a template's shingles in it, the window's
Jaccard similarity to the template has a lower bound; ``bands_for`` takes as many bands as make a collision at that bound certain
up to ``MISS``. A window that shares a band with a template is held against it exactly. Templates that differ from relatives in a word or
two (version, lesser, affero) also need the shingles of ``REQUIRED``.

Windows are cut over a whole piece of a batch at once; shingles never cross texts. Null and empty texts have no licenses.
Repeated rows are scanned each for itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm.words import MARKS, pieces, shingles, words

SHINGLE, CONTAINED, MISS, BLOCK = 3, 0.8, 1e-4, 4

# Fixed texts: notices as their publishers word them.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."),
}

_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.")
#: Words that a match must hold besides its share: what tells a version or kind from its relatives. And notices that hold another one whole.
REQUIRED = {"gpl-3.0": ("the GNU General Public License, version 3",), "gpl-3.0-notice": ("the GNU General Public License", "either version 3 of the")}
SUPERSEDES = {"bsd-3-clause": "bsd-2-clause"}
#: More families and versions, as short lines, notices (GPL family) and title lines of full texts.
FAMILIES: dict[str, str] = {}


def _family(name: str, text: str, *required: str) -> None:
    FAMILIES[name] = text
    REQUIRED[name] = required


for _name, _kind, _version, _date in (("gpl-2.0", "", "2", "June 1991"), ("gpl-3.0", "", "3", "29 June 2007"), ("lgpl-2.1", "Lesser ", "2.1", "February 1999"),
                                      ("lgpl-3.0", "Lesser ", "3", "29 June 2007"), ("agpl-3.0", "Affero ", "3", "19 November 2007")):
    if _name != "gpl-3.0":
        _family(_name, f"This work is licensed under the GNU {_kind}General Public License, version {_version}.", f"GNU {_kind}General Public License, version {_version}")
        _what = "library" if _kind == "Lesser " else "program"
        _family(f"{_name}-notice", _GNU.format(what=_what, kind=_kind, version=_version), f"the GNU {_kind}General Public License", f"either version {_version} of the")
    _family(f"{_name}-text", f"GNU {_kind}GENERAL PUBLIC LICENSE Version {_version}, {_date}", f"GNU {_kind}General Public License Version {_version}")
for _short, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
                      ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        _name = f"cc-{_short.lower()}-{_version}"
        if _name not in TEMPLATES:
            _family(_name, f"Licensed under CC {_short} {_version}.", f"CC {_short} {_version}")
        _family(f"{_name}-notice", f"This work is licensed under a Creative Commons {_long} {_version} {_port} License.", f"Creative Commons {_long} {_version}")
_family("cc0-1.0", "Licensed under CC0 1.0.", "under CC0 1.0")
_family("cc0-1.0-text", "CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal")
_family("apache-2.0-text", "Apache License Version 2.0, January 2004", "Apache License Version 2.0")
_family("mpl-2.0-text", "Mozilla Public License Version 2.0", "License Version 2.0")
_family("bsd-3-clause", TEMPLATES["bsd-2-clause"] + (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."), "to endorse or promote products derived from this software")
_family("isc", (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies."), "with or without fee")
_family("unlicense", (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."), "free and unencumbered software")
ALL = TEMPLATES | FAMILIES


def bands_for(similarity: float, miss: float = MISS, most: int = 256) -> tuple[int, int]:
    """(bands, rows a band) with the fewest hashes whose chance to miss a pair of that similarity is at most ``miss``."""
    found = []
    for rows in range(1, 5):
        bands = math.ceil(math.log(miss) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= most:
            found.append((bands * rows, bands, rows))
    if not found:
        raise ValueError(f"no band settings for similarity {similarity}")
    return min(found)[1:]


def _shingles_of(text: str) -> np.ndarray:
    w = words(pa.array([text]), lower=True, blank=MARKS)
    s, ok = shingles(w.hashes(), w.first, SHINGLE)
    return s[ok]


class Index:
    """Templates by length class, with the band settings that their windows need."""

    def __init__(self, templates: dict[str, str]):
        w = words(pa.array(list(templates.values())), lower=True, blank=MARKS)
        s, ok = shingles(w.hashes(), w.first, SHINGLE)
        self.names, self.sets, self.classes, bound = list(templates), [], {}, 1.0
        for k, name in enumerate(self.names):
            own = np.unique(s[w.first[k]:w.first[k + 1]][ok[w.first[k]:w.first[k + 1]]])
            if not len(own):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.sets.append(own)
            size = max(8, 1 << (int(w.counts[k]) - 1).bit_length())
            self.classes.setdefault(size, []).append(k)
            need = math.ceil(CONTAINED * len(own))
            bound = min(bound, need / (self.window(size) + len(own) - need))
        self.required = [np.concatenate([np.zeros(0, np.uint64), *(_shingles_of(x) for x in REQUIRED.get(name, ()))]) for name in self.names]
        self.bands, self.rows = bands_for(bound)
        if self.rows != 1:
            raise ValueError("templates of this length need bands of several rows")  # not reached by windows of 1.25 template lengths
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 2**63, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mins = [[int(((t * f) >> np.uint64(32)).min()) for f in self.factors] for t in self.sets]

    @staticmethod
    def stride(size: int) -> int:
        return max(BLOCK, size // 4)

    @classmethod
    def window(cls, size: int) -> int:
        return size + cls.stride(size)


def _pairwise(x: np.ndarray) -> np.ndarray:
    if len(x) % 2:
        x = np.append(x, np.uint64(2**32))
    return np.minimum(x[::2], x[1::2])


def candidates(index: Index, hashes: np.ndarray, ok: np.ndarray) -> set[tuple[int, int]]:
    """(template, first word of the window) of every window that shares a band with a template."""
    found: set[tuple[int, int]] = set()
    none = np.uint64(2**32)
    n = len(hashes) + (-len(hashes)) % BLOCK
    largest = max(index.classes)
    for band, factor in enumerate(index.factors):
        v = np.full(n, none)
        v[:len(hashes)] = np.where(ok, (hashes * factor) >> np.uint64(32), none)
        level, width = np.minimum(np.minimum(v[::4], v[1::4]), np.minimum(v[2::4], v[3::4])), BLOCK
        size = 8
        while size <= largest:
            stride = Index.stride(size)
            while width < stride:
                level, width = _pairwise(level), width * 2
            if size in index.classes:
                best = level
                for step in range(1, Index.window(size) // stride):
                    best = np.minimum(best, np.append(level[step:], np.full(min(step, len(level)), none)))
                for t in index.classes[size]:
                    found.update((t, int(k) * stride) for k in np.flatnonzero(best == np.uint64(index.mins[t][band])))
            size *= 2
    return found


def matches(index: Index, column) -> list[list[tuple[int, int, str, float]]]:
    """For each text (start, end, template, containment), code points, end exclusive."""
    w = words(column, lower=True, blank=MARKS)
    s, ok = shingles(w.hashes(), w.first, SHINGLE)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in w.counts]
    if not len(s):
        return out
    doc = w.doc
    hits: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    size_of = {t: c for c, ts in index.classes.items() for t in ts}
    for t, first in sorted(candidates(index, s, ok)):
        low, high = first, min(first + Index.window(size_of[t]), len(s))
        template = index.sets[t]
        inside = np.flatnonzero(ok[low:high] & (template[np.minimum(np.searchsorted(template, s[low:high]), len(template) - 1)] == s[low:high])) + low
        for d in np.unique(doc[inside]):
            own = inside[doc[inside] == d]
            share = len(np.unique(s[own])) / len(template)
            if share >= CONTAINED and np.isin(index.required[t], s[own]).all():
                hits.setdefault((int(d), t), []).append((int(own[0]), int(own[-1]) + SHINGLE - 1, share))
    for (d, t), found in hits.items():
        merged: list[list] = []
        for a, b, share in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], b), max(merged[-1][2], share)
            else:
                merged.append([a, b, share])
        base = int(w.offsets[d])
        for a, b, share in merged:
            point = lambda byte: int(((w.data[base:byte] & 0xC0) != 0x80).sum())
            out[d].append((point(int(w.starts[a])), point(int(w.ends[b])), index.names[t], share))
    for d, found in enumerate(out):
        covered = [(SUPERSEDES[name], a, b) for a, b, name, _ in found if name in SUPERSEDES]
        if covered:
            out[d] = [x for x in found if not any(x[2] == name and x[0] < b and a < x[1] for name, a, b in covered)]
    return [sorted(x) for x in out]


def licenses(docs: DataFrame, templates: dict[str, str] = ALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, licenses (names, sorted), n_matches, spans (name:start:end, by start)."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates))  # as large as the templates
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                found = matches(index.value, part.column(1))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([sorted({m[2] for m in x}) for x in found], pa.list_(pa.string())), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([",".join(f"{name}:{a}:{b}" for a, b, name, _ in x) for x in found], pa.string())], names=["doc_id", "licenses", "n_matches", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, licenses array<string>, n_matches long, spans string")
