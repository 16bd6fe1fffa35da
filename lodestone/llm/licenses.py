"""License scans by matching statistics on a generalised suffix automaton.

The automaton holds the word sequences of all templates and phrases. Each text is streamed through
it: at every word it gives the longest run of words ending there that occurs in some template.
Matches that cannot be extended are kept if long, chained per template into covered spans, and
templates covered far enough give labels. Base phrases are read off the same states: a phrase ends
at a word if its state is on the suffix path of the state reached there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.textbytes import LOWER, blocks, span_hashes, text_buffer, words

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known public license texts and notices, by label.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software.""",
    "warranty-disclaimer": """The software is provided "as is", without warranty of any kind, express or implied, including but not
limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or
copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising
from, out of or in connection with the software or the use or other dealings in the software.""",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "rights-reserved": "All rights reserved.",
}

SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, last_word: long, coverage: double>>"
)


def tokens(text: str) -> list[str]:
    """The words of one text, as the scan sees them."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]))
    low = LOWER[data].tobytes()
    return [low[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class Automaton:
    """A generalised suffix automaton over word ids."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.phrases = list(phrases.items())
        self.labels = list(templates)
        sequences = [tokens(t) for t in templates.values()]
        base = [tokens(p) for p, _ in self.phrases]
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for s in (*sequences, *base) for w in s))}
        data = np.frombuffer("".join(self.vocab).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in self.vocab])
        h = span_hashes(data, np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.where: list[set[tuple[int, int]]] = [set()]  # (template, end) of a state's first occurrences
        self.sizes = [len(s) for s in sequences]
        for k, s in enumerate(sequences):
            last = 0
            for i, w in enumerate(s):
                last = self._extend(last, self.vocab[w])
                self.where[last].add((k, i + 1))
        for p in base:
            last = 0
            for w in p:
                last = self._extend(last, self.vocab[w])
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.where[self.link[v]] |= self.where[v]
        ends_at: dict[int, int] = {}
        for k, p in enumerate(base):
            v = 0
            for w in p:
                v = self.next[v][self.vocab[w]]
            ends_at[v] = ends_at.get(v, 0) | 1 << k
        self.sizes_of_phrases = [len(p) for p in base]
        self.ending = [0] * len(self.length)  # bits of the phrases that are suffixes of a state's longest string
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.ending[v] = self.ending[self.link[v]] | ends_at.get(v, 0)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[last] + 1 == self.length[q] else self._clone(last, c, q)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._clone(p, c, q)
        return new

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.where.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """The ids of words by hash; -1 for those that no template holds."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def scan(self, positions: list[int], ids: list[int], min_match: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Stream known words (their places in the text and ids) through the automaton.

        Returns the (place, phrase bits) where base phrases end, and the maximal matches of at least
        `min_match` words as (last place, length, state)."""
        v, n, before = 0, 0, -2
        bases, matches = [], []
        nxt, link, length, ending = self.next, self.link, self.length, self.ending
        for at, c in zip(positions, ids, strict=True):
            if at != before + 1:
                if n >= min_match:
                    matches.append((before, n, v))
                v = n = 0
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            else:
                if n >= min_match:
                    matches.append((before, n, v))
                while v and c not in nxt[v]:
                    v = link[v]
                n = length[v]
                if c in nxt[v]:
                    v, n = nxt[v][c], n + 1
                else:
                    v = n = 0
            if ending[v]:
                bits = ending[v]
                if n < length[v]:  # only the matched suffix counts
                    bits = sum(1 << k for k, size in enumerate(self.sizes_of_phrases) if bits >> k & 1 and size <= n)
                if bits:
                    bases.append((at, bits))
            before = at
        if n >= min_match:
            matches.append((before, n, v))
        return bases, matches

    def chain(self, matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[str, int, int, float]]:
        """Spans (label, first place, last place, coverage): per template, matches whose places rise in
        text and template, with at most `max_gap` words between, covering their share of it."""
        open_: dict[tuple[int, int], list[int]] = {}
        done: list[tuple[int, int, int, int]] = []
        for at, n, v in matches:
            for k, end in self.where[v]:
                if end < n:
                    continue
                begin, first = end - n, at - n + 1
                best = None
                for key, span in open_.items():
                    if key[0] == k and span[2] <= end - 1 and span[1] < at and begin - span[2] <= max_gap and first - span[1] - 1 <= max_gap and (best is None or span[3] > best[1][3]):
                        best = (key, span)
                if best is not None:
                    key, span = best
                    new = min(n, end - span[2], at - span[1])
                    if new > 0:
                        del open_[key]
                        open_[k, span[0]] = [span[0], at, end, span[3] + new]
                        continue
                if (k, first) not in open_ or open_[k, first][3] < n:
                    open_[k, first] = [first, at, end, n]
            for key in [key for key, span in open_.items() if at - span[1] > max_gap + max(self.sizes)]:
                span = open_.pop(key)
                done.append((key[0], span[0], span[1], span[3]))
        done += [(key[0], span[0], span[1], span[3]) for key, span in open_.items()]
        return [(self.labels[k], first, last, min(1.0, covered / self.sizes[k])) for k, first, last, covered in done]


def _scan(templates: dict[str, str], phrases: dict[str, str], min_match: int, min_coverage: float, max_gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(templates, phrases)
        need = [min(min_match, n) for n in auto.sizes]
        least = min([*need, min_match])
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b in blocks(offs):
                data, own = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                start, end, cut = words(data, own)
                ids = auto.ids_of(span_hashes(data, start, end))
                known = np.flatnonzero(ids >= 0)
                bounds = np.searchsorted(known, cut).tolist()
                rows = []
                for r in range(b - a):
                    here = known[bounds[r] : bounds[r + 1]]
                    bases, matches = auto.scan((here - cut[r]).tolist(), ids[here].tolist(), least)
                    n_base, first, last, base = 0, None, None, set()
                    for at, bits in bases:
                        for k, size in enumerate(auto.sizes_of_phrases):
                            if bits >> k & 1:
                                n_base += 1
                                first = at - size + 1 if first is None else min(first, at - size + 1)
                                last = at - size + 1 if last is None else max(last, at - size + 1)
                                base.add(auto.phrases[k][1])
                    spans = [s for s in auto.chain(matches, max_gap) if s[3] >= min_coverage]
                    best: dict[tuple[str, int], tuple] = {}
                    for s in spans:
                        if s[3] > best.get((s[0], s[2]), (0, 0, 0, 0.0))[3]:
                            best[s[0], s[2]] = s
                    kept = sorted(best.values(), key=lambda s: (s[1], s[2], s[0]))
                    score = max([1.0 if base else 0.0, *(s[3] for s in kept)])
                    rows.append((int(cut[r + 1] - cut[r]), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in kept})), score, [dict(zip(("label", "first_word", "last_word", "coverage"), s, strict=True)) for s in kept]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span_type]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return run


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = 3, min_coverage: float = 0.7, max_gap: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`SCANNED` for the whole text of every row.

    n_base counts every place of every phrase; first_word and last_word are its smallest and largest
    start, null without one. `labels` adds to the base labels those of templates of which chained
    matches of `min_match` words or more cover `min_coverage`; score is the best coverage, 1 with a
    base phrase, 0 with nothing. Null text is empty; empty and wordless texts have no words and empty
    labels; repeated rows give equal rows; other columns are ignored. A text of any length is streamed."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_in_arrow(rows, _scan(templates, phrases, min_match, min_coverage, max_gap), SCANNED)
