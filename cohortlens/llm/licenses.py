"""License scan with a generalised suffix automaton of licence texts over words.

The automaton of all template words is built once (its size is at most twice the words of the templates) and shipped
to the tasks. A document is streamed through it: at each word the automaton gives the longest run of words ending
there that occurs in a template (matching statistics). Runs of words that no template holds reset it, so they are
skipped in bulk. Phrases are templates too: a phrase is found wherever the match is at least as long as the phrase and
its state, or one behind its suffix links, ends the phrase.

Matches of at least ``least`` words that cannot be extended are chained, template by template, in the order of both
texts; the share of the template's words that the best chain covers is the score of the template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.layout import bounded
from cohortlens.llm.words import as_bytes, cut, groups, word_hashes

# Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Openings of public licence texts and notices, lower-case words, with their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place
    step: list[dict[int, int]]
    link: list[int]
    length: list[int]
    ends: list[dict[int, int]]  # of each state: template -> first place (word) where its runs end there
    phrase: list[list[tuple[int, int]]]  # of each state: (phrase, length) of phrases that end in its runs, longest first
    labels: list[str]
    sizes: list[int]
    n_templates: int = 0
    names: list[str] = field(default_factory=list)


def build(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Automaton:
    """Automaton of the templates followed by the phrases."""
    texts = [t.split() for _, t in templates] + [p.split() for p in phrases]
    hashes = [word_hashes(t) for t in texts]
    vocabulary = np.unique(np.concatenate(hashes))
    step, link, length, ends = [{}], [-1], [0], [{}]

    def clone_of(p: int, c: int, q: int) -> int:
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        ends.append({})
        new = len(step) - 1
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    last_states = []
    for t, own in enumerate(hashes):
        last = 0
        for place, c in enumerate(np.searchsorted(vocabulary, own).tolist()):
            q = step[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else clone_of(last, c, q)
            else:
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                ends.append({})
                new, p = len(step) - 1, last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[new] = q if length[q] == length[p] + 1 else clone_of(p, c, q)
                last = new
            ends[last].setdefault(t, place)
        last_states.append(last)
    order = sorted(range(1, len(step)), key=lambda s: -length[s])
    for s in order:  # what ends in a state's runs also ends in the shorter runs of its suffix link
        for t, place in ends[s].items():
            ends[link[s]].setdefault(t, place)
    phrase: list[list[tuple[int, int]]] = [[] for _ in step]
    n = len(templates)
    for i, p in enumerate(phrases):
        phrase[last_states[n + i]].append((i, len(p.split())))
    for s in reversed(order):
        phrase[s] = phrase[s] + phrase[link[s]]
    return Automaton(vocabulary, step, link, length, ends, phrase, [x for x, _ in templates] + list(phrases.values()),
                     [len(t) for t in texts], n, list(phrases))


@dataclass(frozen=True)
class Scan:
    n_words: int
    places: list[tuple[int, int]]  # (first word, phrase)
    scores: dict[int, float]  # template -> covered share
    spans: dict[int, list[tuple[int, int]]]  # template -> covered [first, end) word spans of the document


def _chain(anchors: list[tuple[int, int, int]], reach: int) -> tuple[int, list[tuple[int, int]]]:
    """Best chain of (document place, template place, length) in both orders: covered template words and spans.

    ``reach``: document words between the starts of two links at most.
    """
    anchors = sorted(set(anchors))
    best: list[tuple[int, int]] = []
    for i, (d, t, n) in enumerate(anchors):
        top = (n, -1)
        for j in range(i - 1, -1, -1):
            dj, tj, nj = anchors[j]
            if d - dj > reach:
                break
            if dj + nj <= d and tj + nj <= t and best[j][0] + n > top[0]:
                top = (best[j][0] + n, j)
        best.append(top)
    i = max(range(len(best)), key=lambda k: best[k][0])
    covered, spans = best[i][0], []
    while i >= 0:
        spans.append((anchors[i][0], anchors[i][0] + anchors[i][2]))
        i = best[i][1]
    return covered, spans[::-1]


def scan_words(a: Automaton, numbers: np.ndarray, least: int = 4, gap: int = 32) -> Scan:
    """Scan one text given its word numbers (-1: in no template).

    Two links of a chain have at most ``gap`` other words of the document between them.
    """
    inside = np.concatenate([[False], numbers >= 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[0::2], edge[1::2]
    long = end - begin >= min(2, *a.sizes)  # a single word is no phrase and no anchor, unless one has one word
    places: list[tuple[int, int]] = []
    anchors: dict[int, list[tuple[int, int, int]]] = {}
    step, link, length, phrase = a.step, a.link, a.length, a.phrase
    for first, last in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        state, n = 0, 0
        run = numbers[first:last].tolist()
        for i, c in enumerate(run):
            grown = c in step[state]
            if n >= least:  # templates in which the match that ended at the word before does not go on
                _anchor(a, anchors, state, n, first + i, a.ends[step[state][c]] if grown else {})
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            state = step[state].get(c, 0)
            n = n + 1 if state else 0
            if phrase[state]:
                places += [(first + i + 1 - k, p) for p, k in phrase[state] if k <= n]
        if n >= least:
            _anchor(a, anchors, state, n, last)
    scores, spans = {}, {}
    for t, own in anchors.items():
        own.sort()
        part: list[tuple[int, int, int]] = []
        for x in [*own, (1 << 62, 0, 0)]:
            if part and x[0] - (part[-1][0] + part[-1][2]) > gap:
                covered, found = _chain(part, a.sizes[t] + gap)
                share = min(covered / a.sizes[t], 1.0)
                if share > scores.get(t, 0.0):
                    scores[t], spans[t] = share, found
                part = []
            part.append(x)
    return Scan(len(numbers), places, scores, spans)


def _anchor(a: Automaton, anchors: dict, state: int, n: int, end: int, but: dict = {}) -> None:  # noqa: B006
    """An anchor of ``n`` words before ``end`` for each template of the state that is not in ``but``."""
    if len(but) == len(a.ends[state]):
        return
    for t, place in a.ends[state].items():
        if t < a.n_templates and t not in but:
            anchors.setdefault(t, []).append((end - n, place + 1 - n, n))


def scan_texts(a: Automaton, texts: list[bytes], least: int = 4) -> list[Scan]:
    out = []
    for first, end in groups(texts):
        h, which, _, _ = cut(texts[first:end])
        at = np.minimum(np.searchsorted(a.vocabulary, h), len(a.vocabulary) - 1)
        numbers = np.where(a.vocabulary[at] == h, at, -1)
        bounds = np.searchsorted(which, np.arange(end - first + 1))
        out += [scan_words(a, numbers[x:y], least) for x, y in zip(bounds, bounds[1:], strict=False)]
    return out


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                 covered: float = 0.75, least: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phrase places and covered templates of each row.

    Returns key, n_words, n_base (all phrase places), first_word and last_word (their smallest and largest start; else
    null), base_labels, labels (also those of templates covered to at least ``covered``), score (largest covered share
    of a template, or 1 with a phrase) and spans: array of (label, first, end, share) of the covered templates. Null
    and empty texts have no words. Repeated rows are scanned alike and all stay; an empty table gives no rows; other
    columns are not read. One narrow pass, no shuffle.
    """
    a = build(templates, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in scan_texts(a, as_bytes(b.column(1)), least):
                starts = [p for p, _ in s.places]
                base = {a.labels[a.n_templates + p] for _, p in s.places}
                full = {t: x for t, x in s.scores.items() if x >= covered}
                spans = [{"label": a.labels[t], "first": x, "end": y, "share": full[t]}
                         for t in sorted(full) for x, y in s.spans[t]]
                rows.append((s.n_words, len(starts), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(base)), ",".join(sorted(base | {a.labels[t] for t in full})),
                             1.0 if starts else max(s.scores.values(), default=0.0), spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                names=["key", *names])

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return bounded(src).mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, n_words bigint, n_base bigint, "
                               "first_word bigint, last_word bigint, base_labels string, labels string, score double, "
                               "spans array<struct<label:string,first:bigint,end:bigint,share:double>>") \
        .withColumnRenamed("key", key)
