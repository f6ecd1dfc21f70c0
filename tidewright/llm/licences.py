"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template. A text streams through it and gives, at each word, the longest
run that ends there and is part of a template (its matching statistics). Runs of ``MIN_MATCH`` words or more that cannot
grow are chained per template, in order and with gaps of at most ``GAP`` words; a run may stand for any place that has it
in the template, and the chain that covers most is taken, stray runs left out. A chain that covers ``COVER`` of its
template is a span, and gives its label. Words are numbered per block, and only stretches in which each two neighbouring
words are neighbours in some template can hold a match of three words, so only those are walked word by word.

Fixed phrases are counted apart, wherever their words stand one after another. Defined cases: a null or empty text has no
words, no labels (an empty string) and score 0; no place gives null first and last words; repeated rows and null ids are
scanned like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import ALNUM, blocks, coded, lowered, raw, small_batches, table, words

MIN_MATCH, GAP, COVER = 3, 8, 0.6

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices, as words.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
]


class Automaton:
    """Suffix automaton of several word sequences. ``ends[state]``: for each template that holds the state's runs, the
    place of a last word of theirs in it; ``places[state]``: all such places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        self.places: list[dict[int, set[int]]] = [{}]
        for which, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._add(last, token)
                self.ends[last].setdefault(which, place)
                self.places[last].setdefault(which, set()).add(place)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            for which, place in self.ends[state].items():
                if self.link[state] > 0:
                    self.ends[self.link[state]].setdefault(which, place)
                    self.places[self.link[state]].setdefault(which, set()).update(self.places[state][which])

    def _new(self, length: int, copy: int | None = None) -> int:
        self.next.append({} if copy is None else dict(self.next[copy]))
        self.link.append(-1 if copy is None else self.link[copy])
        self.length.append(length)
        self.ends.append({})
        self.places.append({})
        return len(self.link) - 1

    def _split(self, p: int, token: int) -> int:
        """The state of p's longest run with ``token`` behind, cloned if its own runs are longer."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, token)
        return new

    def matches(self, tokens: list[int]) -> list[tuple[int, int, int]]:
        """(begin, length, state) of every run that is part of a template and cannot grow to either side."""
        state = length = 0
        out = []
        for i, token in enumerate(tokens):
            before = (i - length, length, state)
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                length = 0
            if before[1] and length != before[1] + 1:
                out.append(before)
        if length:
            out.append((len(tokens) - length, length, state))
        return out


class Scanner:
    def __init__(self, templates=tuple(TEMPLATES), phrases=None):
        phrases = PHRASES if phrases is None else phrases
        self.labels = [label for label, _ in templates]
        texts = [text.encode().split() for _, text in templates]
        self.sizes = [len(t) for t in texts]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.number = {w: i for i, w in enumerate(dict.fromkeys([w for t in texts for w in t] + [w for p, _ in self.phrases for w in p]))}
        sequences = [[self.number[w] for w in t] for t in texts]
        self.automaton = Automaton(sequences)
        self.pair = np.zeros((len(self.number) + 1, len(self.number) + 1), bool)
        for s in sequences:
            self.pair[s[:-1], s[1:]] = True

    def places(self, t: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Per phrase, the word numbers where it begins, counted over all texts."""
        out = []
        for phrase, label in self.phrases:
            n = len(phrase)
            if len(t) < n:
                out.append((np.zeros(0, np.int64), label))
                continue
            hit = np.ones(len(t) - n + 1, bool)
            for k, w in enumerate(phrase):
                hit &= t[k : len(t) - n + 1 + k] == self.number[w]
            found = np.flatnonzero(hit)
            own = np.searchsorted(at, found, "right") == np.searchsorted(at, found + n - 1, "right")
            out.append((found[own], label))
        return out

    def spans(self, t: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[str, int, int, float]]]:
        """Per text with any: (label, first word, last word, covered share), words counted within the text."""
        if len(t) < MIN_MATCH:
            return {}
        near = self.pair[t[:-1], t[1:]]
        inner = at[(at > 0) & (at < len(t))]
        near[inner - 1] = False  # no match crosses texts
        edge = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
        begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_ = stops - begins >= MIN_MATCH - 1
        begins, stops = begins[long_], stops[long_]
        found: dict[int, dict[int, list]] = {}
        for a, b, text in zip(begins.tolist(), (stops + 1).tolist(), (np.searchsorted(at, begins, "right") - 1).tolist(), strict=True):
            for start, length, state in self.automaton.matches(t[a:b].tolist()):
                if length >= MIN_MATCH:
                    for which, ends in self.automaton.places[state].items():
                        found.setdefault(text, {}).setdefault(which, []).extend((a + start, length, end - length + 1) for end in ends)
        return {text: spans for text, by in found.items() if (spans := self._chained(by, int(at[text])))}

    def _chained(self, by: dict[int, list], base: int) -> list[tuple[str, int, int, float]]:
        out = []
        for which, runs in by.items():
            least = COVER * self.sizes[which]
            runs = sorted(runs)
            while runs:
                spans = self._best(runs, least)
                out += [(self.labels[which], a - base, b - 1 - base, min(1.0, n / self.sizes[which])) for a, b, n in spans]
                if not spans:
                    break
                # what is left between the spans may chain anew
                begins = [a for a, _, _ in spans]
                before = [bisect_right(begins, start) - 1 for start, _, _ in runs]
                runs = [r for r, k in zip(runs, before, strict=True) if (k < 0 or spans[k][1] <= r[0]) and (k + 1 == len(spans) or r[0] + r[1] <= begins[k + 1])]
        return sorted(set(out), key=lambda x: x[1:])

    @staticmethod
    def _best(runs: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
        """(begin, end, covered words) of chains of ``least`` words or more that share no words, those that cover most first
        to choose. Runs come sorted; those that end too early for one are too early for all that follow."""
        covered, begin, low = [], [], 0
        for j, (start, length, place) in enumerate(runs):
            while runs[low][0] + runs[low][1] < start - GAP:
                low += 1
            most = (length, start)
            for i in range(low, j):
                end, at = runs[i][0] + runs[i][1], runs[i][2] + runs[i][1]
                cut = max(0, end - start, at - place)
                if cut < length and start - end <= GAP and place - at <= GAP:
                    most = max(most, (covered[i] + length - cut, begin[i]))
            covered.append(most[0])
            begin.append(most[1])
        spans: list[tuple[int, int, int]] = []
        for j in sorted((j for j in range(len(runs)) if covered[j] >= least), key=lambda j: (-covered[j], runs[j][0] + runs[j][1])):
            span = (begin[j], runs[j][0] + runs[j][1], covered[j])
            k = bisect_right(spans, span)
            if (not k or spans[k - 1][1] <= span[0]) and (k == len(spans) or span[1] <= spans[k][0]):
                spans.insert(k, span)
        return spans

    def scan(self, texts: pa.Array) -> list[tuple]:
        body, ends = raw(texts)
        found, at = words(lowered(body), ends, ALNUM)
        codes, distinct = coded(found)
        number = np.array([self.number.get(w, len(self.number)) for w in distinct] or [0])
        t = number[codes] if len(codes) else np.zeros(0, np.int64)
        n = len(texts)
        total, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        base: dict[int, set] = {}
        for where, label in self.places(t, at):
            text = np.searchsorted(at, where, "right") - 1
            for i, w in zip(text.tolist(), (where - at[text]).tolist(), strict=True):
                total[i] += 1
                first[i] = w if first[i] < 0 else min(first[i], w)
                last[i] = max(last[i], w)
                base.setdefault(i, set()).add(label)
        spans = self.spans(t, at)
        out = []
        for i, n_words in enumerate(np.diff(at).tolist()):
            own, more = base.get(i, set()), spans.get(i, [])
            score = max([float(bool(own)), *(s[3] for s in more)])
            out.append((n_words, int(total[i]), int(first[i]) if total[i] else None, int(last[i]) if total[i] else None, ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in more})), score, [dict(zip(("label", "first", "last", "covered"), s, strict=True)) for s in more]))
        return out


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, covered: double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN]
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def _scanning(templates, phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for block in blocks(batches):
            rows = scanner.scan(block.column(1))
            yield pa.record_batch([block.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True))], names=_NAMES)

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=tuple(TEMPLATES), phrases=None) -> DataFrame:
    """One row per document: counts and places of the phrases, all labels, a score and the covered spans."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scanning(templates, phrases), _OUT)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
