"""Licence scans: a positional rare-token index over licence templates.

Every template is a word sequence with key phrases that must be there. The words of all templates get
their document frequency over the whole corpus; each template is posted under its rarest words with
their positions. A file looks up the licence words it holds, rarest first; every hit proposes a start
(its place minus the template's), starts on which enough different rare words agree are aligned, and
the key phrases are verified inside the aligned window.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import text_batches

_TO = bytearray(b" " * 256)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _TO[_b] = _b
    elif 65 <= _b <= 90:
        _TO[_b] = _b + 32
WORDS = bytes(_TO)

RARE = 5          # rare words a template is posted under
AGREE = 3         # rare words that must agree on a start (all of them where a template has fewer)
SHIFT = 3         # words by which they may differ: a name or a year more or less

# Phrases of the query and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, public licence notice, key phrases that must be there.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at", ["apache license", "in compliance with the license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
     "are met redistributions of source code must retain the above copyright notice", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
     "by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
     ["gnu lesser general public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _split(text: str) -> list[bytes]:
    return words_of(text.encode())


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text: str) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each licence word stands, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for _, texts in text_batches(batches, "text"):
            for t in texts:
                found[b""] += 1
                found.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r.word.encode(): r.n for r in rows}           # at most the words of the templates
    return got, got.get(b"", 0)


class Index:
    """Templates and phrases posted by their rarest words."""

    def __init__(self, df: dict[bytes, int], n: int, templates=TEMPLATES, phrases=PHRASES):
        idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1))
        self.phrases = []
        for phrase, label in phrases.items():
            w = _split(phrase)
            at = max(range(len(w)), key=lambda i: (idf(w[i]), -i))
            self.phrases.append((w, label, at))
        self.templates, self.postings = [], defaultdict(list)
        for t, (label, text, keys) in enumerate(templates):
            w = _split(text)
            rare = sorted(set(w), key=lambda x: (-idf(x), x))[:RARE]
            self.templates.append((label, w, [_split(k) for k in keys], min(AGREE, len(rare))))
            for i, x in enumerate(w):
                if x in rare:
                    self.postings[x].append((t, i))
        self.anchors = {w[at] for w, _, at in self.phrases} | set(self.postings)

    def scan(self, words: list[bytes]) -> tuple:
        """The result columns of one file."""
        if self.anchors.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0
        places = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.anchors:
                places[w].append(i)
        starts, base = [], set()
        for w, label, at in self.phrases:
            for i in places.get(w[at], ()):
                if i >= at and words[i - at:i - at + len(w)] == w:
                    starts.append(i - at)
                    base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        votes = defaultdict(list)
        for w, found in places.items():
            for t, i in self.postings.get(w, ()):
                votes[t].extend((p - i, w) for p in found)
        for t, hits in votes.items():
            label, body, keys, need = self.templates[t]
            hits.sort()
            low, inside = 0, Counter()
            done = None
            for start, w in hits:
                inside[w] += 1
                while hits[low][0] < start - SHIFT:
                    inside[hits[low][1]] -= 1
                    if not inside[hits[low][1]]:
                        del inside[hits[low][1]]
                    low += 1
                if len(inside) >= need and (done is None or start > done + SHIFT):
                    done = start
                    begin, end = max(0, start - 2 * SHIFT), start + len(body) + 2 * SHIFT
                    window = words[begin:end]
                    if all(_holds(window, k) for k in keys):
                        labels.add(label)
                        left = Counter(window)
                        score = max(score, sum(min(c, left[x]) for x, c in Counter(body).items()) / len(body))
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score))


def _holds(window: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(window[i:i + n] == phrase for i in range(len(window) - n + 1))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    NULL and empty texts have no words, no labels and score 0. Repeated rows stay repeated, a NULL doc_id
    stays NULL, no rows give no rows, other columns are ignored. Score: 1 with a base phrase, else the
    share of the best verified template's words in its window."""
    vocabulary = frozenset(w for _, t, _ in templates for w in _split(t)) | frozenset(w for p in phrases for w in _split(p))
    df, n = frequencies(docs, vocabulary, text)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n, templates, phrases)
        for batch, texts in text_batches(batches, "text"):
            cols = list(zip(*(index.scan(words_of(t)) for t in texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SCHEMA}")
