"""Licence scans by a generalised suffix automaton of template tokens.

The automaton holds every run of tokens of every template.  A file streams through it once; at each token
it tells the longest run that ends there and where templates hold it (matching statistics).  Maximal runs
are chained in the order of file and template, and the part of a template that a chain covers is its score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.kernels import tidy

#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Well-known licence notices and clauses by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Tokens of a run that is worth chaining; file tokens between runs of a chain; covered part that gives a label.
MIN_RUN, MAX_GAP, COVERED = 3, 12, 0.75

#: Bytes to words: A-Z lower-cased, digits, letters and bytes above 127 kept, the rest white space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Automaton:
    """Suffix automaton of several token sequences: states with transitions, longest length, suffix link."""

    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings no longer than p's and one token."""
        new = self._state(dict(self.moves[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.moves[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.moves[p]:
            self.moves[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, name: int, seq: list[int]) -> None:
        last = 0
        for c in seq:
            last = self._extend(last, c)

    def close(self, seqs: list[list[int]]) -> None:
        """Note at each state where its strings end, in which sequence."""
        for name, seq in enumerate(seqs):
            s = 0
            for i, c in enumerate(seq):
                s = self.moves[s][c]
                t = s
                while t > 0:
                    self.ends[t].add((name, i + 1))
                    t = self.link[t]


class Scanner:
    """The automaton of templates and phrases, and what it says of a file."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases = [tokens(p.encode()) for p, _ in phrases]
        self.phrase_labels = [x for _, x in phrases]
        seqs = [tokens(t.encode()) for _, t in templates]
        self.labels = [x for x, _ in templates]
        self.vocab: dict[bytes, int] = {}
        ids = [[self.vocab.setdefault(w, len(self.vocab)) for w in s] for s in [*seqs, *self.phrases]]
        self.sizes = [len(s) for s in seqs]
        self.auto = Automaton()
        for i, s in enumerate(ids):
            self.auto.add(i, s)
        self.auto.close(ids)
        n = len(seqs)
        # By state: the phrases that its strings end with, its own and those of its suffixes (its own may be
        # longer than what has matched).
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.auto.length]
        for p, seq in enumerate(ids[n:]):
            s = 0
            for c in seq:
                s = self.auto.moves[s][c]
            self.whole[s].append((p, len(seq)))
        for s in sorted(range(1, len(self.auto.length)), key=self.auto.length.__getitem__):
            self.whole[s] = self.whole[s] + self.whole[self.auto.link[s]]
        self.seqs = ids[:n]
        self.places: list[list[tuple[int, int, int]] | None] = [None] * len(self.auto.length)
        self.least = min(MIN_RUN, *map(len, self.phrases))

    def _held(self, s: int) -> list[tuple[int, int, int]]:
        """(template, end, longest) of all places where templates hold a suffix of a state's strings, for each place the longest suffix."""
        if self.places[s] is None:
            out: dict[tuple[int, int], int] = {}
            v = s
            while v > 0 and self.auto.length[v] >= MIN_RUN:
                for p in self.auto.ends[v]:
                    if p[0] < len(self.seqs):
                        out.setdefault(p, self.auto.length[v])
                v = self.auto.link[v]
            self.places[s] = [(t, e, n) for (t, e), n in sorted(out.items())]
        return self.places[s]

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Stretches of known tokens that are long enough for anything."""
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= self.least:
                yield a, ids[a:b].tolist()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], dict[str, float]]:
        """(words, base places (word, phrase), best covered part by label)."""
        words = tokens(text)
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int32, len(words))
        base: list[tuple[int, int]] = []
        found: list[tuple[int, int, int, int]] = []  # start in the file, start in the template, length, template of maximal matches
        moves, length, link = self.auto.moves, self.auto.length, self.auto.link
        for at, run in self._runs(ids):
            s = m = 0
            for i, c in enumerate(run, at):
                to = moves[s].get(c)
                if to is None:
                    while to is None and s:
                        s = link[s]
                        m = length[s]
                        to = moves[s].get(c)
                    if to is None:
                        s = m = 0
                        continue
                s, m = to, m + 1
                for p, n in self.whole[s]:
                    if n <= m:
                        base.append((i + 1 - n, p))
                if m >= MIN_RUN:
                    then = run[i + 1 - at] if i + 1 - at < len(run) else -1
                    for t, e, n in self._held(s):
                        if e == self.sizes[t] or self.seqs[t][e] != then:
                            n = min(n, m)
                            found.append((i + 1 - n, e - n, n, t))
        return len(words), base, self._chains(found)

    def _chains(self, found: list[tuple[int, int, int, int]]) -> dict[str, float]:
        """Per label the largest part of one of its templates that a chain of matches covers."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for f, a, m, t in found:
            by.setdefault(t, []).append((f, a, m))
        out: dict[str, float] = {}
        for t, parts in by.items():
            best: list[tuple[int, int, int]] = []  # file end, template end, covered, of recent chains
            top = 0
            for f, a, m in sorted(parts):
                covered = m
                for fe, ae, c in best:
                    over = max(0, fe - f, ae - a)
                    if over < m and f + MAX_GAP >= fe - MAX_GAP and f - fe <= MAX_GAP and ae <= a + m and fe <= f + m:
                        covered = max(covered, c + m - over)
                best = [b for b in best if f - b[0] <= MAX_GAP] + [(f + m, a + m, covered)]
                top = max(top, covered)
            label = self.labels[t]
            out[label] = max(out.get(label, 0.0), min(1.0, top / self.sizes[t]))
        return out


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        rows = []
        for x in batch.column(1):
            n, base, covered = scanner.scan(x.as_buffer().to_pybytes() if x.is_valid else b"")
            places = sorted(set(p for p, _ in base))
            mine = {scanner.phrase_labels[p] for _, p in base}
            more = {k for k, v in covered.items() if v >= COVERED}
            score = 1.0 if mine else max(covered.values(), default=0.0)
            rows.append((n, len(base), places[0] if places else None, places[-1] if places else None, ",".join(sorted(mine)), ",".join(sorted(mine | more)), score, sorted(covered.items())))
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("covered", pa.float64())]))]
        cols[7:] = [[[{"label": k, "covered": v} for k, v in r] for r in cols[7]]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def license_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score: the largest covered part of any template (1 where a base phrase stands); spans: that part by
    label.  Null and empty texts have no words, no labels and score 0.  Rows are judged alone and whole, in
    one narrow pass that is linear in a text's length; repeated rows get equal verdicts, an empty table an
    empty report.  Other columns are not read, whatever their names.
    """
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,covered:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_scan), kind)
