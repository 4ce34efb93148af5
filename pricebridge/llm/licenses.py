"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the positions of the same hashes in the templates (a fixed
table, so it is broadcast). A hit votes for a diagonal, document position minus template position; votes are summed up
per document, template and diagonal, neighbouring diagonals are merged as far as the template's length allows, and what
remains is verified word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebridge.llm.common import batches, cut, limit_batches, texts

#: Words of a k-gram; the shortest phrase has two.
K = 2
#: A span's diagonals are no further apart than the template has words by this: so many words may be put in or left out.
SLACK = 6
#: Votes that a span must have for its verification, as a share of the template's voting k-grams, and the share of the
#: template's words that must then be found in order, in as many words as the template and the span's diagonals have.
LEAST_VOTES, LEAST_WORDS = 0.4, 0.8

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences of well-known license notices, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd",
    "to the extent possible under law the author has dedicated all copyright and related rights to the public domain": "cc0",
    "released under the terms of the mit license": "mit",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released into the public domain": "public-domain",
}

# Identifiers of licenses as words, and their labels; they follow "spdx license identifier".
IDENTIFIERS = {
    "mit": "mit",
    "apache 2 0": "apache-2.0",
    "gpl 2 0": "gpl",
    "gpl 3 0": "gpl",
    "agpl 3 0": "agpl",
    "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "mpl 2 0": "mpl-2.0",
    "epl 2 0": "epl",
    "isc": "isc",
    "unlicense": "unlicense",
    "zlib": "zlib",
    "bsl 1 0": "bsl-1.0",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
    "cc0 1 0": "cc0",
}

# Words that say nothing of a license; k-grams of these alone don't vote for notices.
COMMON = frozenset("a and any are for in is it of or the this to under with you".split())

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z, bytes of no word to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the rolling k-gram hashes of all texts one after the other, and where each text's end."""
    return _grams_and_words(raw, k)[:2]


def _grams_and_words(raw: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram_hashes and the words of each text."""
    folded = [t.translate(FOLD) for t in raw]
    buf = np.frombuffer(b" " + b" ".join(folded) + b" ", np.uint8)
    word = buf != 0x20
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    up, down = _powers(len(buf))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])])
    hashes = _mix((total[ends] - total[starts]) * down[starts])
    # where each text begins in the buffer, hence whose a word is
    first = np.cumsum([1, *(len(t) + 1 for t in folded)])
    upto = np.searchsorted(starts, first[1:])
    grams = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - k + 1 + i]
    grams = _mix(grams)
    counts = np.diff(np.concatenate([[0], upto]))
    good = np.ones(len(grams), bool)
    for i in range(1, k):  # those that begin in a text's last words
        at = upto[counts >= i] - i
        good[at[at < len(good)]] = False
    ends_out = np.cumsum(np.maximum(counts - k + 1, 0))
    return grams[good], ends_out, counts


@cache
def templates() -> list[tuple[int, bool, str, list[bytes]]]:
    """(number, is a base phrase, label, words) of every template; the phrases come first."""
    both = [(True, p, label) for p, label in PHRASES.items()] + [(False, p, label) for p, label in NOTICES.items()]
    both += [(False, f"spdx license identifier {p}", label) for p, label in IDENTIFIERS.items()]
    return [(i, base, label, p.encode().split()) for i, (base, p, label) in enumerate(both)]


@cache
def _voters() -> list[tuple[int, int, int]]:
    """(hash, template, position) of all k-grams that vote."""
    out = []
    for i, base, _, words in templates():
        hashes, _ = gram_hashes([b" ".join(words)])
        for at, h in enumerate(hashes.view(np.int64).tolist()):
            if base or any(w.decode() not in COMMON for w in words[at : at + K]):
                out.append((h, i, at))
    return out


def template_grams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_voters(), "gram long, template int, at int")


def _lots(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about 1 MB together."""
    at = 0
    while at < len(raw):
        end, total = at, 0
        while end < len(raw) and (end == at or total + len(raw[end]) < 1 << 20):
            total += len(raw[end])
            end += 1
        yield at, end
        at = end


def rolling_grams(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and grams (array<long>, by word) of rows of doc_id, text, text_hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = texts(batch, "text")
            for at, end in _lots(raw):
                hashes, ends = gram_hashes(raw[at:end])
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], names=["doc_id", "text_hash", "grams"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, grams array<long>")


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words and text of rows of doc_id, text, text_hash: texts without any template's k-gram, which
    have no votes, are null, so that they need not travel to the join with the votes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.array([h for h, _, _ in _voters()], np.int64).view(np.uint64))
        for batch in it:
            raw = texts(batch, "text")
            for at, end in _lots(raw):
                hashes, ends, counts = _grams_and_words(raw[at:end])
                hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                some = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])]) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at), pa.array(counts.astype(np.int64)), pa.array([x if s else None for x, s in zip(raw[at:end], some.tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "text_hash", "n_words", "text"],
                )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_words long, text binary")


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, template, diagonal, votes of all diagonals with votes."""
    grams = rolling_grams(docs).select("doc_id", "text_hash", F.posexplode("grams").alias("pos", "gram"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession)), "gram")  # a fixed table of a few hundred rows
    place = hits.select("doc_id", "text_hash", "template", (F.col("pos") - F.col("at")).alias("diagonal"), "at").distinct()  # rows may repeat
    return place.groupBy("doc_id", "text_hash", "template", "diagonal").agg(F.count("*").alias("votes"))


def _in_order(a: list[bytes], b: list[bytes]) -> list[int]:
    """Which of b's words are words of a in the same order: those of a longest common subsequence."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        above, row = table[-1], [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(j)
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def merged(found: list[tuple[int, int]], width: int, least: float) -> list[tuple[int, int]]:
    """(first, last) diagonals of spans, from (diagonal, votes): neighbours that are at most `width` apart in all and have
    at least `least` votes, those with most votes first, each diagonal in one span."""
    found = sorted(found)
    total, runs, end = [0], [], 0
    for _, n in found:
        total.append(total[-1] + n)
    for i, (d, _) in enumerate(found):
        while end < len(found) and found[end][0] <= d + width:
            end += 1
        if total[end] - total[i] >= least:
            runs.append((total[i] - total[end], end - i, i, end))
    used, out = [False] * len(found), []
    for _, _, a, b in sorted(runs):
        if not any(used[a:b]):
            used[a:b] = [True] * (b - a)
            out.append((found[a][0], found[b - 1][0]))
    return sorted(out)


def verified(words: list[bytes], diagonals: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
    """Base places (template, word), and spans (template, first word, last word, share of its words) of a text's diagonals
    (template, diagonal, votes). Of spans that overlap by half, the one with most words stays, then that with the greatest share."""
    known, count = templates(), Counter(i for _, i, _ in _voters())
    places, spans, by = [], [], {}
    for i, diagonal, n in diagonals:
        by.setdefault(i, []).append((diagonal, n))
    for i, found in sorted(by.items()):
        _, base, _, want = known[i]
        if base:
            places += [(i, d) for d, _ in sorted(found) if d >= 0 and words[d : d + len(want)] == want]
            continue
        for a, b in merged(found, len(want) // SLACK, LEAST_VOTES * count[i]):
            start = max(0, a)
            at = _in_order(want, words[start : b + len(want)])
            if at:
                spans.append((len(at), len(at) / len(want), i, start + at[0], start + at[-1]))
    kept: list[tuple[int, int, int, float]] = []
    for _, share, i, a, b in sorted(spans, key=lambda x: (-x[0], -x[1], *x[2:])):
        if all(2 * (min(b, d) - max(a, c) + 1) < min(b - a, d - c) + 1 for _, c, d, _ in kept):
            kept.append((i, a, b, share))
    return places, sorted(kept)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A-Z count as a-z; words are runs of [0-9a-z] and of characters beyond ASCII. Base places are all places where a
    phrase's words stand one after the other; first_word and last_word are their least and greatest start. Labels of
    notices come on top where at least LEAST_WORDS of a notice's words are found in order, in a stretch that is longer than
    the notice by a SLACK-th of its words at most. score is the greatest share
    found of any template, 1 for a base place, 0 without any. spans: label, first and last word, share.
    Null texts are empty texts: no words, empty strings, score 0. Repeated rows get the same answer each; an empty table
    gives no rows; other columns are ignored.
    """
    limit_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))
    diagonal = F.struct("template", "diagonal", "votes")
    found = cut(votes(rows).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(diagonal).alias("diagonals")), "diagonals")
    # a merge join at every size: what is joined may grow with the input on both sides
    both = carried(rows).join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "n_words", "text", "diagonals")
    known = templates()
    order = lambda labels: ",".join(sorted(labels))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", kind)])

        def rows() -> Iterator[tuple]:
            for batch in it:
                for doc, n, text, diagonals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    places, spans = verified(words_of(text), [tuple(x.values()) for x in diagonals]) if diagonals else ([], [])
                    base = {known[i][2] for i, _ in places}
                    own = {known[i][2] for i, *_, share in spans if share >= LEAST_WORDS}
                    starts = [at for _, at in places]
                    all_spans = [(known[i][2], at, at + len(known[i][3]) - 1, 1.0) for i, at in places] + [(known[i][2], a, b, s) for i, a, b, s in spans]
                    spans = [dict(zip(("label", "first_word", "last_word", "share"), s, strict=True)) for s in all_spans]
                    yield doc, n, len(places), min(starts, default=None), max(starts, default=None), order(base), order(base | own), max((s for *_, s in all_spans), default=0.0), spans

        yield from batches(rows(), schema)

    return both.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,share:double>>")
