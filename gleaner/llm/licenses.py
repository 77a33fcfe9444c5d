"""License scanning: winnowed template fingerprints, an inverted index, banded alignment.

Templates are split into words; of the hashes of their word triples (pairs in
short templates) a winnowed choice goes into an inverted index, dense enough
that a copy in which as many words are changed or missing as the coverage
allows holds one. A document's triples and pairs that hit the index
pick candidate templates and the diagonals on which they lie; each is then
confirmed by aligning the template with the document's words around it within
a band, which tolerates changed, missing and added words, and reports how much
of the template was matched and where. Words that tell licenses apart (versions,
names) must be matched, and those of another license must not stand among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

# Well-known license notices and texts.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-clause-1": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-clause-2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "BSD-clause-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
# Names in which licenses of otherwise like words differ; the second set are the modifiers among them.
NAMES = {"affero", "apache", "attribution", "bsd", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa", "cc0", "gnu", "isc", "lesser", "mit", "mozilla", "mpl", "attribution-noderivatives", "attribution-noncommercial", "attribution-sharealike"}
MODIFIERS = {"affero", "attribution-noderivatives", "attribution-noncommercial", "attribution-sharealike", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa", "lesser", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike"}

GRAM, WINDOW, MIN_COVERAGE = 3, 3, 0.8
#: Words that are in most texts; what a text must hold to be looked at is another word if there is one.
_COMMON = {"a", "an", "and", "as", "at", "be", "by", "for", "if", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "you"}
_WORD = regex.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_VERSION = regex.compile(r"v?\d+(?:\.\d+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with where they start and end in the text."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Positions of the smallest hash of every window, the rightmost of equals; all windows share one with any copy of theirs."""
    if not hashes:
        return []
    last = max(1, len(hashes) - window + 1)
    return sorted({min(range(i, min(i + window, len(hashes))), key=lambda j: (hashes[j], -j)) for i in range(last)})


def unbroken(n: int, min_coverage: float) -> int:
    """How many words in a row any copy of ``n`` words holds at the least, if ``min_coverage`` of them are left."""
    left = next((m for m in range(n + 1) if m >= min_coverage * n), n)
    return max(min(n, 1), -(-left // (n - left + 1)))


def telling(words: list[str]) -> dict[int, str]:
    """The words, by position, that tell a template's license from others: versions and names."""
    return {i: w for i, w in enumerate(words) if _VERSION.fullmatch(w) or w in NAMES or (w == "by" and i and words[i - 1] == "cc")}


class Index:
    """Templates, their winnowed fingerprints (hash -> template, position), and the words that any candidate must hold."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE) -> None:
        self.words = {name: [w for w, _, _ in words_of(text)] for name, text in templates.items()}
        self.marks = {name: telling(words) for name, words in self.words.items()}
        self.postings: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            run = unbroken(len(words), min_coverage)
            size = min(GRAM, run)
            grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if size else []
            for i in winnow([xxhash.xxh64_intdigest(" ".join(g)) for g in grams], min(WINDOW, run - size + 1)):
                self.postings.setdefault(grams[i], []).append((name, i))
        #: Templates that a whole copy of the other template also matches.
        self.alike = {(x, y) for x, a in self.words.items() for y, b in self.words.items() if x != y and a and min_coverage * len(a) <= align(a, b, 0, max(len(a), len(b)))[0]}
        self.sizes = sorted({len(g) for g in self.postings})
        self.vocabulary = {w for g in self.postings for w in g}
        self.anchors = ahocorasick.Automaton()
        for gram in self.postings:  # a candidate holds all words of a fingerprint, so the longest uncommon one too
            self.anchors.add_word(max(gram, key=lambda w: (w not in _COMMON, len(w), w)), True)
        if len(self.anchors):
            self.anchors.make_automaton()

    def candidates(self, words: list[str]) -> dict[str, list[int]]:
        """The diagonals (document position less template position) of every template's hits."""
        out: dict[str, list[int]] = {}
        known = [i for i, w in enumerate(words) if w in self.vocabulary]
        for i in known:
            for size in self.sizes:
                for name, at in self.postings.get(tuple(words[i : i + size]), ()):
                    out.setdefault(name, []).append(i - at)
        return out


def align(template: list[str], words: list[str], start: int, band: int, marks: dict[int, str] | None = None) -> tuple[int, int, int, set[str]]:
    """How many template words are matched in order, the first and last document word matched, and which ``marks`` are.

    ``start`` is the diagonal; document words at most ``band`` off it are
    compared. Gaps cost nothing: of the common subsequences in the band that
    hold most marks the longest, and of those the one whose matches end first
    and start last.
    """
    width, marks = 2 * band + 1, marks or {}
    names = sorted(set(marks.values()))
    bit = {i: 1 << names.index(w) for i, w in marks.items()}
    best = [(0, 0, 0, 0, 0)] * (width + 1)  # (marks, matches, first word, -last word, which marks): tuples compare as wanted
    for i, word in enumerate(template):
        row = [(0, 0, 0, 0, 0)] * (width + 1)
        left = (0, 0, 0, 0, 0)
        for c in range(width):
            j = start + i + c - band
            cell = max(left, best[c + 1])  # a document word or a template word left out
            if 0 <= j < len(words) and words[j] == word:
                k, m, first, _, held = best[c]
                cell = max(cell, (k + (i in bit), m + 1, first if m else j, -j, held | bit.get(i, 0)))
            row[c] = left = cell
        best = row
    _, m, first, last, held = max(best)
    return m, first, -last, {w for i, w in enumerate(names) if held >> i & 1}


def fits(found: tuple[int, int, int, set[str]], template: list[str], marks: dict[int, str], words: list[str], min_coverage: float) -> bool:
    """Whether an alignment is an occurrence: covered enough, every telling word matched, no other license's modifier in between."""
    m, first, last, held = found
    foreign = MODIFIERS.difference(template)
    return bool(m) and m >= min_coverage * len(template) and held == set(marks.values()) and foreign.isdisjoint(words[first : last + 1])


def scan_text(text: str | None, index: Index, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, float, int, int, int, int]]:
    """(template, coverage, matched words, template words, start, end) of each occurrence; positions are characters."""
    if not text or not len(index.anchors) or next(index.anchors.iter(text.lower()), None) is None:
        return []
    found = words_of(text)
    words = [w for w, _, _ in found]
    out = []
    for name, diagonals in sorted(index.candidates(words).items()):
        template, marks = index.words[name], index.marks[name]
        band = max(2, len(template) // 8)
        groups: list[list[int]] = []
        for d in sorted(set(diagonals)):
            if groups and d - groups[-1][0] <= band:
                groups[-1].append(d)
            else:
                groups.append([d])
        spans: dict[tuple[int, int], tuple[int, int, int]] = {}
        for g in groups:
            got = align(template, words, g[len(g) // 2], band, marks)
            if fits(got, template, marks, words, min_coverage):
                spans[got[1:3]] = got[:3]
        end = -1
        for m, first, last in sorted(spans.values(), key=lambda s: (s[1], -s[0])):
            if first > end:
                out.append((name, m / len(template), m, len(template), found[first][1], found[last][2]))
                end = last
    beaten = lambda h, x: (h[0], x[0]) in index.alike and (x[2], x[1]) > (h[2], h[1]) and x[4] < h[5] and h[4] < x[5]
    out = [h for h in out if not any(beaten(h, x) for x in out)]
    return sorted(out, key=lambda x: (x[4], x[5], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``(id, license, coverage, matched_words, template_words, span_start, span_end)``: a row for each occurrence.

    Whole texts are scanned. Null, empty and wordless texts have no rows; rows
    with a null id and repeated rows are scanned like others. Occurrences of
    one template don't overlap (the earlier, then the better matched, stays);
    those of different templates may, but where two templates are so alike that
    a copy of one holds the other (a header and the notice it starts with), only
    the one with more words matched is returned. Versions and names must be
    matched (each once at least), and no other license's modifier (NC, Lesser)
    may stand in the span: what is like a license but not it has no row.
    Added words are tolerated as long as a
    fingerprint is left whole. No templates, no rows.
    """
    chosen = TEMPLATES if templates is None else templates
    held: list[Index] = []

    def make(texts: list[str | None]) -> Iterator[tuple[list[int], list]]:
        if not held:
            held.append(Index(chosen, min_coverage))
        found = [(i, *hit) for i, text in enumerate(texts) for hit in scan_text(text, held[0], min_coverage)]
        if found:
            at, *columns = zip(*found, strict=True)
            yield at, columns

    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("__text")), ["__text"], "license string, coverage double, matched_words int, template_words int, span_start int, span_end int", make)
