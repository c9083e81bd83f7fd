"""License scans by a positional rare-token index.

Templates of licence notices are indexed by their rarest words: each template's `RARE` words of highest inverse document frequency (counted
over every document) have postings of (template, position). A text's indexed words are looked up, those of highest IDF first (all of them,
or so many as `looked_up` says); each occurrence votes for a template at a relative position, and a template is taken where at least two of its
words (or all, if it has one) agree on the position and its mandatory phrase stands at that very place. The share of the template's words that
stand there is the score.

Beside it, three base phrases are found wherever their words stand consecutively.

Defined results: a null or empty text has 0 words, no labels (empty strings), null first_word and last_word, and score 0; repeated rows get
a row each; a null doc_id is kept; an empty table gives an empty result; a very long text stands in a slice of its own. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounds, filled, slices, small_batches, table, words

RARE = 4
#: The phrases that are always looked for, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, text of a licence, of its header or of a short notice, and the phrase in it without which it does not count.
TEXTS = [
    ("mit", "released under the MIT License", "MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""", "hereby granted, free of charge"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies.""", "copy, modify, and/or distribute"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"", "fee is hereby granted. THE SOFTWARE"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""", "source and binary forms"),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission.""", "endorse or promote products"),
    ("apache-2.0", "licensed under the Apache License version 2.0", "Apache License version 2"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""", "Apache License, Version 2"),
    ("gpl-2.0", "licensed under the GNU General Public License version 2", "General Public License version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License version 3", "General Public License version 3"),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of
        the License, or (at your option) any later version.""", "Free Software Foundation; either version 2 of"),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version.""", "Free Software Foundation, either version 3 of"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "Lesser General Public License"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation""", "GNU Lesser General Public License as published"),
    ("agpl-3.0", "licensed under the GNU Affero General Public License version 3", "Affero General Public License"),
    ("agpl-3.0", """it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License""", "GNU Affero General Public License as published"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        http://mozilla.org/MPL/2.0/.""", "Mozilla Public License, v. 2.0"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License 2.0"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", "Boost Software License"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
        granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""", "alter it and redistribute it freely"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "unencumbered software"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "licensed under CC BY 4.0", "CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", "CC BY-SA"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", "CC BY-NC"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", "CC BY-ND"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Attribution-ShareAlike 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Attribution-NonCommercial 4.0"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]


def plain_words(text: str) -> str:
    """The words of a text as license_words() takes them, for ASCII text."""
    return " ".join(re.findall("[0-9a-z]+", text.lower()))


#: Label, words of the text, mandatory phrase in it.
TEMPLATES = [(label, plain_words(text), plain_words(must)) for label, text, must in TEXTS]
VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()})

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER[~_WORD[_LOWER]] = 32


def license_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of ASCII letters, digits and all other than ASCII, with A-Z lower-cased: codes, rows and the words by code."""
    arr = filled(text)
    at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(arr) or at[-1] == at[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    raw = np.frombuffer(arr.buffers()[2], np.uint8)[at[0] : at[-1]]
    plain = pa.LargeStringArray.from_buffers(len(arr), pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(_LOWER[raw]))
    return words(plain)


def known(vocab: pa.Array, wanted: list[str]) -> np.ndarray:
    """For each word by code, its place in `wanted`, or -1."""
    if not len(vocab):
        return np.zeros(0, np.int64)
    found = pc.index_in(vocab.cast(pa.large_string()), value_set=pa.array(wanted, pa.large_string()))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def document_frequency(docs: DataFrame) -> dict[str, int]:
    """In how many documents each word of the templates stands; under "" the number of documents."""
    small_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros(len(VOCABULARY) + 1, np.int64)
        for b in slices(batches):
            code, row, vocab = license_words(b.column("text"))
            word = known(vocab, VOCABULARY)[code] if len(code) else code
            pairs = np.unique(row[word >= 0] * len(VOCABULARY) + word[word >= 0])
            total[:-1] += np.bincount(pairs % len(VOCABULARY), minlength=len(VOCABULARY))
            total[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*VOCABULARY, ""]), pa.array(total)], ["word", "n"])

    return {r["word"]: r["n"] for r in docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def build_index(df: dict[str, int]) -> dict:
    """IDF of each word, and postings of the rarest words of each template: word, template, position."""
    n = df.get("", 0)
    idf = np.array([np.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in VOCABULARY])
    place = {w: k for k, w in enumerate(VOCABULARY)}
    posts = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        said = [place[w] for w in text.split()]
        rare = sorted(set(said), key=lambda w: (-idf[w], w))[:RARE]
        posts += [(w, t, p) for p, w in enumerate(said) if w in rare]
    return {"idf": idf, "posts": np.array(sorted(posts), np.int64)}


def base_places(word: np.ndarray, row: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the words of the phrase stand consecutively in one text."""
    n = len(word) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = row[:n] == row[len(phrase) - 1 :]
    for k, w in enumerate(phrase):
        hit &= word[k : k + n] == w
    return np.flatnonzero(hit)


def scan(text: pa.Array, index: dict, looked_up: int | None = None) -> dict[str, list]:
    """Every column of the result for each text."""
    n = len(text)
    code, row, vocab = license_words(text)
    at = bounds(row, n)
    word = known(vocab, VOCABULARY)[code] if len(code) else code
    base, places = [set() for _ in range(n)], []
    for phrase, label in BASE.items():
        found = base_places(word, row, [VOCABULARY.index(w) for w in phrase.split()])
        places.append(found)
        for r in np.unique(row[found]):
            base[r].add(label)
    found = np.concatenate(places)
    n_base = np.bincount(row[found], minlength=n)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, row[found], found - at[row[found]])
    np.maximum.at(last, row[found], found - at[row[found]])
    labels, score = [set(x) for x in base], np.zeros(n)
    for r, t, share in aligned(word, row, at, index, looked_up):
        labels[r].add(TEMPLATES[t][0])
        score[r] = max(score[r], share)
    return {
        "n_words": np.diff(at).tolist(), "n_base": n_base.tolist(), "first_word": [int(x) if c else None for x, c in zip(first, n_base, strict=True)], "last_word": [int(x) if c else None for x, c in zip(last, n_base, strict=True)],
        "base_labels": [",".join(sorted(x)) for x in base], "labels": [",".join(sorted(x)) for x in labels], "score": score.tolist(),
    }


def aligned(word: np.ndarray, row: np.ndarray, at: np.ndarray, index: dict, looked_up: int | None = None):
    """Of each text, the templates that its rare words place and whose mandatory phrase stands there: text, template, share of words."""
    idf, posts = index["idf"], index["posts"]
    indexed = np.zeros(len(VOCABULARY) + 1, bool)
    indexed[posts[:, 0]] = True
    place = np.flatnonzero(indexed[word])  # -1 is the last, which is not indexed
    if not len(place):
        return
    if looked_up is not None:  # only the rarest distinct words of each text
        pairs = np.unique(row[place] * len(VOCABULARY) + word[place])
        of, which = pairs // len(VOCABULARY), pairs % len(VOCABULARY)
        order = np.lexsort((which, -idf[which], of))
        nth = np.arange(len(order)) - np.searchsorted(of, of[order])
        looked = np.sort(pairs[order[nth < looked_up]])
        place = place[np.isin(row[place] * len(VOCABULARY) + word[place], looked)]
    lo, hi = np.searchsorted(posts[:, 0], word[place]), np.searchsorted(posts[:, 0], word[place], side="right")
    many = hi - lo
    hit = np.repeat(place, many)
    post = posts[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    start = hit - post[:, 2]  # where the template would start
    votes, count = np.unique(np.stack([row[hit], post[:, 1], start]), axis=1, return_counts=True)
    rare_of = np.bincount(posts[:, 1], minlength=len(TEMPLATES))
    for (r, t, s), c in zip(votes.T.tolist(), count.tolist(), strict=True):
        if c < min(2, rare_of[t]):
            continue
        said, must = ([VOCABULARY.index(w) for w in x.split()] for x in TEMPLATES[t][1:])
        k = next(i for i in range(len(said)) if said[i : i + len(must)] == must)
        if s + k >= at[r] and s + k + len(must) <= at[r + 1] and word[s + k : s + k + len(must)].tolist() == must:
            a, b = max(s, at[r]), min(s + len(said), at[r + 1])
            yield r, t, sum(word[p] == said[p - s] for p in range(a, b)) / len(said)


def scan_licenses(docs: DataFrame, index: dict) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            out = scan(b.column("text"), index)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[f.name], f.type) for f in schema)], ["doc_id", *schema.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, build_index(document_frequency(docs)))
