"""License scans: Dice coefficient over word bigrams against license templates.

Text is normalised to lower-cased words of letters and digits. A template is compared with runs of
consecutive lines, and so with whole texts too; where no run of lines reaches ``least``, with runs of
words that begin and end anywhere inside lines. Dice = 2 * common / (run's bigrams + template's
bigrams), bigrams counted as often as they occur. From least / (2 - least) to (2 - least) / least times
the template's bigrams is the only size that can reach ``least``; a document is only compared with
templates of which it holds the least number of bigrams that such a run must share.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .shared import prepare
from .textops import MARKS, rolled_hashes, text_bytes, word_hashes, words

#: Public license notices and texts, without copyright lines.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License'
        " for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY"
        " SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,"
        " DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS'
        " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
        " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
        " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
        " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    **TEXTS,
}


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _bigrams_of(pa.array(texts, pa.large_string()))


def _bigrams_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, text borders, first bytes of words, words before each text, and a hash of each word with the next."""
    data, offsets = text_bytes(column, lower=True)
    starts, lengths, word_at = words(data, offsets, MARKS)
    return data, offsets, starts, word_at, rolled_hashes(word_hashes(data, starts, lengths), 2)


class Match(NamedTuple):
    row: int
    license: str
    dice: float
    first_line: int
    last_line: int
    #: Of the most similar run of words: common bigrams times Dice, and its first and last bigram.
    weight: float
    first: int
    last: int
    whole_lines: bool


class _Hits:
    """The bigrams of a text that a template has. Runs go from first[i] to before after[j], in words, for i <= j."""

    def __init__(self, counts: dict[int, int], size: int, least: float, need: int, places: np.ndarray, values: np.ndarray):
        self.size, self.least, self.need, self.places = size, least, need, places
        self.most = int(size * (2 - least) / least + 1e-9)
        order = np.argsort(values, kind="stable")
        group = np.flatnonzero(np.concatenate(([True], values[order][1:] != values[order][:-1])))
        sizes = np.diff(np.append(group, len(order)))
        rank = np.arange(len(order)) - np.repeat(group, sizes)
        times = np.repeat([counts[v] for v in values[order][group].tolist()], sizes)
        #: A hit counts in a run unless the run holds, before it, as many equal ones as the template: from this hit on.
        self.back = np.full(len(order), -1)
        late = np.flatnonzero(rank >= times)
        self.back[order[late]] = order[late - times[late]]

    def runs(self, first: np.ndarray, after: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
        """(Dice, first word, word after) of runs that reach ``least`` and don't overlap: the best, the best beside it, and so on.

        Of equals the first counts. ``taken`` holds borders in words of what is excluded, and gets those of the runs.
        """
        begin, end = np.searchsorted(self.places, first), np.searchsorted(self.places, after - 1)
        stop = np.searchsorted(after, first + self.most + 1, "right")
        rich = np.flatnonzero(stop > np.arange(len(first)))
        rich = rich[end[stop[rich] - 1] - begin[rich] >= self.need]

        def best(i: int) -> tuple[float, int, int] | None:
            at, to = bisect_right(taken, (first[i], np.inf)), stop[i]
            if at and taken[at - 1][1] > first[i]:
                return None
            if at < len(taken):
                to = min(to, np.searchsorted(after, taken[at][0], "right"))
            if to <= i or end[to - 1] - begin[i] < self.need:
                return None
            common = np.concatenate(([0], np.cumsum(self.back[begin[i] : end[to - 1]] < begin[i])))[np.maximum(end[i:to] - begin[i], 0)]
            dice = 2 * common / (after[i:to] - first[i] - 1 + self.size)
            j = int(np.argmax(dice))
            return (-float(dice[j]), i, i + j) if dice[j] >= self.least else None

        heap, out = [x for i in rich.tolist() if (x := best(i))], []
        heapify(heap)
        while heap:
            top = heappop(heap)
            if (now := best(top[1])) == top:
                run = int(first[top[1]]), int(after[top[2]])
                insort(taken, run)
                out.append((-top[0], *run))
            elif now:
                heappush(heap, now)
        return out

    def words(self, a: int, b: int) -> tuple[float, int, int]:
        """The most similar run of words among words a to before b: its weight, first and last bigram."""
        places = self.places[(self.places >= a) & (self.places < b - 1)]
        dice, first, after = self.runs(places, places + 2, [(-1, a), (b, b + 1)])[0]
        return self.weight(dice, first, after)

    def weight(self, dice: float, first: int, after: int) -> tuple[float, int, int]:
        return dice * dice * (after - first - 1 + self.size) / 2, first, after - 2


class TemplateIndex:
    def __init__(self, templates: dict[str, str], least: float):
        self.names, self.least = sorted(templates), least
        _, _, _, at, hashes = _bigrams([templates[x] for x in self.names])
        self.counts = [Counter(hashes[a : b - 1].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.sizes = np.array([sum(x.values()) for x in self.counts])
        self.need = np.maximum(1, np.ceil(self.sizes * least / (2 - least) - 1e-9)).astype(int)
        pairs = sorted((h, k) for k, x in enumerate(self.counts) for h in x)
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        self.owners = np.array([k for _, k in pairs], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.hashes >> np.uint64(44)] = True

    def matches(self, column: pa.Array) -> list[Match]:
        """All runs of lines, and of words beside them, that templates match; those of one template don't overlap."""
        data, offsets, starts, word_at, hashes = _bigrams_of(column)
        if not len(hashes) or not len(self.hashes):
            return []
        doc = np.searchsorted(word_at, np.arange(len(hashes)), "right") - 1
        inside = np.arange(len(hashes)) + 1 < word_at[doc + 1]
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(44)] & inside)
        lo, hi = (np.searchsorted(self.hashes, hashes[maybe], side) for side in ("left", "right"))
        maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
        place = np.repeat(maybe, hi - lo)
        owner = self.owners[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)))[:-1], hi - lo) + np.arange(len(place))]
        pair = doc[place] * len(self.names) + owner
        order = np.argsort(pair, kind="stable")
        place = place[order]
        pairs, at, counts = np.unique(pair[order], return_index=True, return_counts=True)
        out = []
        for x in np.flatnonzero(counts >= self.need[pairs % len(self.names)]).tolist():
            row, k = divmod(int(pairs[x]), len(self.names))
            text = data[offsets[row] : offsets[row + 1]]
            breaks = np.flatnonzero(text == 10) + offsets[row]
            line = np.searchsorted(breaks, starts[word_at[row] : word_at[row + 1]])
            own = place[at[x] : at[x] + counts[x]]
            hits = _Hits(self.counts[k], int(self.sizes[k]), self.least, int(self.need[k]), own - word_at[row], hashes[own])
            out += [Match(row, self.names[k], *found) for found in self._found(hits, line)]
        return out

    def _found(self, hits: _Hits, line: np.ndarray) -> list[tuple]:
        lines = np.unique(line[np.concatenate((hits.places, hits.places + 1))])
        taken: list[tuple[int, int]] = []
        whole = hits.runs(np.searchsorted(line, lines, "left"), np.searchsorted(line, lines, "right"), taken)
        parts = hits.runs(hits.places, hits.places + 2, taken)
        found = [(x[0], int(line[x[1]]), int(line[x[2] - 1]), *hits.words(*x[1:]), True) for x in whole]
        found += [(x[0], int(line[x[1]]), int(line[x[2] - 1]), *hits.weight(*x), False) for x in parts]
        return sorted(found, key=lambda x: x[4])

    def scan(self, column: pa.Array) -> list[tuple[int, str, float, int, int]]:
        """(row, license, dice, first line, last line) of all matches.

        A run of words of which over half lies in a heavier match of another template is a part of that, and left out.
        """
        return [x[:5] for x, rivals in with_rivals(self.matches(column)) if x.whole_lines or x.license == rivals[0].license]

    def resolved(self, column: pa.Array) -> list[tuple[int, str, float, int, int, int]]:
        """(row, license, dice, first line, last line, templates that match there) of each place, the heaviest template's.

        A match is left out only where a heavier one that stays has over half of the smaller one's bigrams.
        """
        stay: dict[Match, bool] = {}
        both = with_rivals(self.matches(column))
        for x, rivals in sorted(both, key=lambda z: (-z[0].weight, z[0].license)):
            stay[x] = not any(stay.get(y) for y in rivals if y is not x)
        return [(*x[:5], len({y.license for y in rivals})) for x, rivals in both if stay[x]]


def _shared(x: Match, y: Match) -> bool:
    """Whether over half of the smaller one's bigrams are the other's too."""
    return 2 * (min(x.last, y.last) - max(x.first, y.first) + 1) > min(x.last - x.first, y.last - y.first) + 1


def with_rivals(matches: list[Match]) -> list[tuple[Match, list[Match]]]:
    """Each match and those, heaviest first, that share over half of the smaller one's bigrams, itself among them."""
    out, rows = [], {}
    for x in matches:
        rows.setdefault(x.row, []).append(x)
    for own in rows.values():
        own.sort(key=lambda x: (x.first, x.last))
        near: dict[int, list[int]] = {k: [k] for k in range(len(own))}
        live: list[int] = []
        for k, x in enumerate(own):
            live = [j for j in live if own[j].last >= x.first]
            for j in live:
                if _shared(x, own[j]):
                    near[k].append(j)
                    near[j].append(k)
            live.append(k)
        out += [(x, sorted((own[j] for j in near[k]), key=lambda y: (-y.weight, y.license))) for k, x in enumerate(own)]
    return out


def _run(find, schema: dict[str, pa.DataType]):
    def run(batches):
        for batch in batches:
            if found := find(batch.column(1)):
                ids = batch.column(0).take(pa.array([x[0] for x in found]))
                columns = list(zip(*found, strict=True))[1:]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True))], ["doc_id", *schema])

    return run


_MATCH = {"license": pa.string(), "dice": pa.float64(), "first_line": pa.int64(), "last_line": pa.int64()}
_DDL = "doc_id long, license string, dice double, first_line long, last_line long"


def _rows(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _index(docs: DataFrame, templates: dict[str, str] | None, least: float):
    return docs.sparkSession.sparkContext.broadcast(TemplateIndex(TEMPLATES if templates is None else templates, least))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, dice, first_line, last_line): each run of lines, or of words inside them, that a template matches.

    Matches of one template don't overlap. Lines count from 0. A null or empty text matches nothing, nor does a template
    of fewer than two words. Null doc_ids and repeated rows each come back; other columns are not read.
    """
    index = _index(docs, templates, least)
    return _rows(docs).mapInArrow(_run(lambda column: index.value.scan(column), _MATCH), _DDL)


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, dice, first_line, last_line, n_templates): all licenses of all documents, a row for each place.

    Of templates that match the same words the heaviest counts (common bigrams times Dice, then the first by name);
    n_templates counts them. A document has as many rows as places, and nothing is put together by doc_id: null and
    repeated ids each come back.
    """
    index = _index(docs, templates, least)
    return _rows(docs).mapInArrow(_run(lambda column: index.value.resolved(column), _MATCH | {"n_templates": pa.int64()}), f"{_DDL}, n_templates long")
