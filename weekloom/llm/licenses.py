"""License scans by patience alignment of documents with license texts and notices."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm import wordbytes as wb
from weekloom.llm.tables import arrow_map

# Wordings of public licenses and their usual notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    # a notice of rights, no license
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

#: White space and ASCII punctuation lie between the words of a license.
APART = wb.SPACE.copy()
APART[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


#: Whole texts of public licenses, one file each, beside this module: the same on every machine.
LICENSE_FOLDER = Path(__file__).resolve().parent / "license_texts"


def whole_templates(folder: str | Path = LICENSE_FOLDER) -> dict[str, str]:
    """Whole license texts of a folder by file name without its ending."""
    return {f.name.lower().removesuffix(".txt"): f.read_text(errors="replace") for f in sorted(Path(folder).iterdir()) if f.is_file()}


def patience(a: list[int], b: list[int], at: list[int] | None = None, run: int = 3) -> list[tuple[int, int]]:
    """Aligned positions of two word sequences, rising in both.

    Words that occur once in either are candidates; the longest rising run of
    them is kept, and the gaps between its words are aligned in the same way. A
    gap keeps its common start and end. Where it has no such words, as in two
    copies of one text, the longest rising run of the n-grams of ``run`` words
    that both have is kept. ``at`` gives the places of ``b`` in its text, if
    words between were left out.
    """
    at = list(range(len(b))) if at is None else at
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if count_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if count_a[w] == 1 and w in where]
        anchors = _longest_rising(pairs)
        if not anchors:
            out += _gram_run(a, b, at, (a0, a1, b0, b1), run)
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def _gram_run(a: list[int], b: list[int], at: list[int], gap: tuple[int, int, int, int], run: int) -> list[tuple[int, int]]:
    """Words of the longest rising run of shared n-grams in a gap."""
    a0, a1, b0, b1 = gap
    places: dict[tuple[int, ...], list[int]] = {}
    for j in range(b0, b1 - run + 1):
        if at[j + run - 1] - at[j] == run - 1:
            places.setdefault(tuple(b[j : j + run]), []).append(j)
    # later places first, so that an n-gram meets one of its places at most
    pairs = [(i, j) for i in range(a0, a1 - run + 1) for j in reversed(places.get(tuple(a[i : i + run]), ()))]
    last, out = (-1, -1), []
    for i, j in _longest_rising(pairs):
        for k in range(run):
            if i + k > last[0] and j + k > last[1]:
                last = i + k, j + k
                out.append(last)
    return out


def in_runs(pairs: list[tuple[int, int]], run: int) -> list[tuple[int, int]]:
    """The aligned pairs that lie in stretches of ``run`` or more neighbours in both sequences."""
    out: list[tuple[int, int]] = []
    first = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            if k - first >= run:
                out += pairs[first:k]
            first = k
    return out


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first member, whose second members rise too."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[pile], ends[pile] = j, k
    k, out = ends[-1] if ends else -1, []
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


class Template(NamedTuple):
    name: str
    words: list[int]
    vocabulary: np.ndarray
    #: Words of a stretch that counts, at least.
    run: int
    #: Sorted distinct n-grams of that length, and the n-gram of each place.
    grams: np.ndarray
    gram_at: np.ndarray


def make_templates(texts: dict[str, str], run: int = 3) -> list[Template]:
    """Word hashes of the templates; one without words is left out."""
    out = []
    for name, text in texts.items():
        w = wb.words(wb.Slice(0, 1, raw := np.frombuffer(text.encode(), np.uint8), np.array([0, len(raw)])), apart=APART)
        if len(w.hash):
            width = min(run, len(w.hash))
            gram = wb.ngrams(w, 1, width, whole_short=False)[1]
            out.append(Template(name, wb.signed(w.hash).tolist(), np.unique(wb.signed(w.hash)), width, np.unique(gram), gram))
    return out


def find_licenses(templates: list[Template], part: wb.Slice, min_coverage: float) -> list[tuple[int, str, int, int, int, int]]:
    """(row, name, template words, words covered, first word, last word) of each template's alignment with each text of a slice.

    Whole texts are aligned, so anchors are unique in the text, and nothing
    limits how far apart the parts of a license stand. Only stretches of three
    or more words count (all words of a shorter template), so that common words
    scattered over a long text make no license. A text whose n-grams of three
    words can't cover enough of a template isn't aligned with it.
    """
    w = wb.words(part, apart=APART)
    h = wb.signed(w.hash)
    if not len(h):
        return []
    rows = part.last - part.first
    size = np.bincount(w.doc, minlength=rows)
    first = np.cumsum(size) - size
    grams = {run: wb.ngrams(w, rows, run, whole_short=False) for run in {t.run for t in templates}}
    out = []
    for t in templates:
        need = max(1, ceil(min_coverage * len(t.words) - 1e-9))
        doc, value = grams[t.run]
        place = np.minimum(np.searchsorted(t.grams, value), len(t.grams) - 1)
        hit = t.grams[place] == value
        pair = np.unique(doc[hit] * len(t.grams) + place[hit])
        for row in np.unique(pair // len(t.grams)).tolist():
            has = np.zeros(len(t.grams), bool)
            has[pair[np.searchsorted(pair, row * len(t.grams)) : np.searchsorted(pair, (row + 1) * len(t.grams))] - row * len(t.grams)] = True
            covered = np.zeros(len(t.words), bool)
            shared = np.flatnonzero(has[np.searchsorted(t.grams, t.gram_at)])
            for k in range(t.run):
                covered[shared + k] = True
            if covered.sum() < need:
                continue
            text = h[first[row] : first[row] + size[row]]
            at = np.flatnonzero(np.isin(text, t.vocabulary))
            places = at.tolist()
            met = in_runs([(i, places[j]) for i, j in patience(t.words, text[at].tolist(), places, t.run)], t.run)
            if len(met) >= need:
                out.append((row, t.name, len(t.words), len(met), met[0][1], met[-1][1]))
    return sorted(out)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, *, min_coverage: float = 0.85) -> DataFrame:
    """doc_id, license, template_words, covered_words, coverage, first_word and last_word of the licenses found in ``docs`` (doc_id, text).

    coverage is the share of a template's words that align in order with the
    text; words are runs without white space and ASCII punctuation, lower-cased
    in A-Z, in stretches of three words or more, however far apart. A text has
    one alignment with a template; if it holds several copies, words that are
    unique in the text decide, and where there are none, the copy that ends first.
    first_word and last_word are the word numbers of the aligned ends. Null and
    empty texts have none. Other columns are
    ignored, repeated rows give repeated results, and an empty table or no
    templates give an empty result. The templates are held by every task.
    """
    known = make_templates(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.slices(batch.column(1)) if known else ():
                if found := find_licenses(known, part, min_coverage):
                    row, name, words, covered, low, high = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row) + part.first)), pa.array(name), pa.array(words, pa.int64()), pa.array(covered, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["doc_id", "license", "template_words", "covered_words", "first_word", "last_word"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, license string, template_words long, covered_words long, first_word long, last_word long")
    return out.withColumn("coverage", F.round(F.col("covered_words") / F.col("template_words"), 6))
