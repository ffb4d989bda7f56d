"""Licence scan with a positional index of rare words.

Licence templates are indexed by word: which template holds it, at which place. One pass over
the corpus counts in how many texts each template word stands. A second one looks up, in each
text, the words of highest IDF of the templates' key phrases; each of their places gives the
relative position of a template in the text, key phrases are verified word for word there, and a
template is found where all its key phrases stand at one relative position, give or take a few
words. As every key phrase holds its own rarest word, no place of a key phrase is missed,
whatever the text's length or the number of licences in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import shielded, span_hasher, text_slices

# Phrases and the labels they give by themselves.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices of well-known licences (label, notice, key phrases that must all stand).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     ("permission is hereby granted free of charge", "to deal in the software without restriction", "sell copies of the software")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ("under the apache license version 2 0", "except in compliance with the license")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     ("under the terms of the gnu general public license", "either version 3 of the license", "any later version")),
    ("gpl-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
     ("under the terms of the gnu general public license", "either version 2 of the license", "any later version")),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form is subject to the terms", "mozilla public license v 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
     ("provided as is without any express or implied warranty", "in no event will the authors be held liable")),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
)

#: Words by which the relative positions of two neighbouring key phrases may differ.
DRIFT = 12
#: Cells of a comparison of places with a template held at once.
CELLS = 1 << 22

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row of each."""
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(word & (~np.r_[False, word[:-1]] | edge[:-1]))
    ends = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


class Index:
    """Template words with their numbers, and what is known of each template."""

    def __init__(self, templates=TEMPLATES, base=None):
        self.base = dict(BASE if base is None else base)
        # phrase tables: (template or -1, label, its words, place in the template)
        texts = [*(t[1] for t in templates), *self.base]
        vocabulary = sorted({w for text in texts for w in text.split()})
        self.number = {w: k for k, w in enumerate(vocabulary)}
        raw = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
        size = np.array([len(w.encode()) for w in vocabulary])
        start = np.cumsum(size + 1) - size - 1
        hashes = span_hasher(raw)(start, start + size)
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.size = hashes[order], order, size
        self.templates = [(label, np.array([self.number[w] for w in text.split()])) for label, text, _ in templates]
        self.keys: list[tuple[int, np.ndarray, int]] = []
        for t, (_, text, keys) in enumerate(templates):
            all_words = text.split()
            last = 0
            for key in keys:
                key_words = key.split()
                place = next((k for k in range(last, len(all_words)) if all_words[k : k + len(key_words)] == key_words), None)
                if place is None:
                    raise ValueError(f"key phrases stand in their template in order: {key}")
                self.keys.append((t, np.array([self.number[w] for w in key_words]), place))
                last = place
        self.base_keys = [(label, np.array([self.number[w] for w in phrase.split()])) for phrase, label in self.base.items()]
        self.idf = np.ones(len(vocabulary))

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those in no template."""
        found = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(ends - starts <= self.size.max())
        if len(short):
            h = span_hasher(data)(starts[short], ends[short])
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            n = self.numbers[at]
            same = (self.hashes[at] == h) & (self.size[n] == ends[short] - starts[short])
            found[short[same]] = n[same]
        return found

    def rare(self, key: np.ndarray) -> int:
        """The place in a phrase of its word of highest IDF."""
        return int(np.argmax(self.idf[key]))


def places(ids: np.ndarray, row: np.ndarray, by_word: dict[int, np.ndarray], key: np.ndarray, rare: int) -> np.ndarray:
    """Where a phrase stands, by the places of its rarest word."""
    at = by_word.get(int(key[rare]), np.zeros(0, np.int64)) - rare
    at = at[(at >= 0) & (at + len(key) <= len(ids))]
    for k, word in enumerate(key):
        at = at[ids[at + k] == word]
    return at[row[at] == row[at + len(key) - 1]]


def _aligned(ids: np.ndarray, row: np.ndarray, at: np.ndarray, of: np.ndarray, template: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each relative position, the weight of the template words that stand at their places in the row."""
    out = np.zeros(len(at))
    step = max(1, CELLS // len(template))
    for a in range(0, len(at), step):
        spot = at[a : a + step, None] + np.arange(len(template))
        inside = (spot >= 0) & (spot < len(ids))
        spot = np.clip(spot, 0, len(ids) - 1)
        same = inside & (ids[spot] == template) & (row[spot] == of[a : a + step, None])
        out[a : a + step] = same @ weight
    return out


def _scan_slice(index: Index, data: np.ndarray, offs: np.ndarray) -> dict[str, list]:
    n = len(offs) - 1
    starts, ends, row = words(data, offs)
    first = np.searchsorted(row, np.arange(n + 1))
    ids = index.ids(data, starts, ends)
    known = np.flatnonzero(ids >= 0)
    order = known[np.argsort(ids[known], kind="stable")]
    cut = np.flatnonzero(np.diff(ids[order])) + 1
    by_word = {int(ids[part[0]]): part for part in np.split(order, cut) if len(part)}
    n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base: list[set[str]] = [set() for _ in range(n)]
    score = np.zeros(n)
    for label, key in index.base_keys:
        at = places(ids, row, by_word, key, index.rare(key))
        r, place = row[at], at - first[row[at]]
        np.add.at(n_base, r, 1)
        np.minimum.at(low, r, place)
        np.maximum.at(high, r, place)
        for k in np.unique(r):
            base[k].add(label)
    more: dict[int, set[str]] = {}
    keys = iter(index.keys)
    pending = next(keys, None)
    for t, (label, template) in enumerate(index.templates):
        weight = index.idf[template] / index.idf[template].sum()
        chain, every = None, []
        while pending is not None and pending[0] == t:
            _, key, place = pending
            at = places(ids, row, by_word, key, index.rare(key))
            relative, of = at - place, row[at]
            every.append((relative, of))
            if chain is None:
                chain = (relative, of)
            else:  # places within DRIFT of one of the phrases before, in the same text
                spot = np.searchsorted(chain[0], relative)
                near = np.zeros(len(relative), bool)
                for side in (spot - 1, spot):
                    inside = (side >= 0) & (side < len(chain[0]))
                    s = np.clip(side, 0, max(len(chain[0]) - 1, 0))
                    if len(chain[0]):
                        near |= inside & (np.abs(chain[0][s] - relative) <= DRIFT) & (chain[1][s] == of)
                chain = (relative[near], of[near])
            pending = next(keys, None)
        for k in np.unique(chain[1]) if chain is not None else ():
            more.setdefault(int(k), set()).add(label)
        relative, of = (np.concatenate(x) for x in zip(*every)) if every else (np.zeros(0, np.int64),) * 2
        if len(relative):
            np.maximum.at(score, of, _aligned(ids, row, relative, of, template, weight))
    some = n_base > 0
    return {
        "n_words": np.diff(first), "n_base": n_base,
        "first_word": [int(x) if s else None for x, s in zip(low, some)], "last_word": [int(x) if s else None for x, s in zip(high, some)],
        "base_labels": [",".join(sorted(b)) for b in base], "labels": [",".join(sorted(b | more.get(k, set()))) for k, b in enumerate(base)],
        "score": np.clip(score, 0, 1),
    }


def _frequencies(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.idf) + 1, np.int64)  # texts with a word; the last: all texts
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                starts, ends, row = words(data, offs)
                ids = index.ids(data, starts, ends)
                pairs = np.unique(row[ids >= 0] * len(index.idf) + ids[ids >= 0])
                total[:-1] += np.bincount(pairs % len(index.idf), minlength=len(index.idf))
                total[-1] += len(offs) - 1
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    return run


def fit(docs: DataFrame, text: str = "text", index: Index | None = None) -> Index:
    """An index whose IDF is counted over all texts; one number a template word reaches the driver."""
    index = index or Index()
    plain, called = shielded(docs)
    rows = plain.select(F.col(called[text]).cast("string")).mapInArrow(_frequencies(index), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r.word: r.n for r in rows}
    all_texts = n.get(len(index.idf), 0)
    index.idf = np.array([math.log((all_texts + 2) / (n.get(k, 0) + 1)) for k in range(len(index.idf))])
    return index


def scan(docs: DataFrame, text: str = "text", index: Index | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score.

    A-Z are lower-cased; words are runs of letters a-z, digits and characters beyond ASCII.
    n_base counts the places of all base phrases, first_word and last_word are the smallest and
    largest of them (words from 0). labels are those of the base phrases and of each template
    whose key phrases all stand in order, each within DRIFT words of its place relative to the
    one before. score is the largest share, weighted by IDF, of a template's words that stand at
    their places around one of its key phrases; 0 without any.

    Defined cases: null and empty texts have no words, 0 places, null first and last word, empty
    labels and score 0; rows are judged by their own text, so null, repeated and odd ids do not
    matter; texts of any length are read whole; an empty table gives an empty result; columns of
    the names returned are replaced, others kept whatever their names.
    """
    index = index or fit(docs, text)
    new = [c.split()[0] for c in RESULT.split(", ")]
    plain, called = shielded(docs)
    keep = [c for c in docs.columns if c not in new]
    rows = plain.select(F.col(called[text]).cast("string").alias("t"), *[called[c] for c in keep])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(new, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())))
        for batch in batches:
            for first, last, data, offs in text_slices(batch.column(0)):
                out = _scan_slice(index, data, offs)
                part = batch.slice(first, last - first)
                yield pa.record_batch([*part.columns[1:], *[pa.array(out[c], kinds[c]) for c in new]], [*part.schema.names[1:], *new])

    return rows.mapInArrow(run, schema).toDF(*keep, *new)
