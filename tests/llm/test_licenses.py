import re

import numpy as np

from pricebridge.llm import licenses
from tests.llm.fixtures import SMALL, clashing, docs_frame, rows_of

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
COLS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def brute(rows):
    out = []
    for doc, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        found = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        out.append([doc, len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))])
    return sorted(out, key=repr)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = licenses.scan(docs)
    assert rows_of(got, *COLS) == brute(rows)
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["n_base"] == 0 or r["score"] == 1)


def test_awkward_rows(spark):
    check(clashing(docs_frame(spark)))


def test_generated_table(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_empty_table(spark):
    assert licenses.scan(docs_frame(spark, [])).collect() == []


def test_notices_with_edits(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    near = mit.replace("free of charge, ", "").replace("person", "happy person")
    rows = [(1, "x y " + mit + " z", None, None), (2, near, None, None), (3, "permission to copy this software", None, None), (4, mit + " " + mit, None, None)]
    got = {r["doc_id"]: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1 and got[1]["base_labels"] == ""
    assert got[2]["labels"] == "mit" and 0.8 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[3]["score"] < 0.8
    assert len(got[4]["spans"]) == 2 and got[1]["spans"][0]["first_word"] == 2


def test_parts_and_variants_of_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    agpl = "SPDX-License-Identifier: AGPL-3.0-or-later. This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"
    free = "This is free and unencumbered software released into the public domain."
    epl = "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
    rows = [(i, "Some words. " + x + " and more", None, None) for i, x in enumerate([bsd, agpl, free, epl, gpl])]
    got = {r["doc_id"]: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["bsd", "agpl,gpl", "unlicense", "epl", "gpl"]  # gpl of the phrase that the second holds
    assert all(sum(s["share"] >= licenses.LEAST_WORDS and s["first_word"] != s["last_word"] for s in got[i]["spans"]) <= 3 for i in range(5))


def test_scattered_words_are_no_notice(spark):
    rows = [
        (1, "licensed under x licensed under x licensed under x the x mit license", None, None),
        (2, "released by us under the roof, the terms are fine, of the year, mit einem license plate", None, None),
        (3, " ".join(["licensed under"] * 50 + ["the"] * 50 + ["mit license"] * 50), None, None),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3)] == ["", "", ""] and all(got[i]["score"] < 1 for i in (1, 2, 3))


def test_spans_are_no_longer_than_their_notice_allows():
    assert licenses.merged([(0, 2), (3, 2), (6, 2), (9, 2)], 3, 3) == [(0, 3), (6, 9)]
    assert licenses.merged([(0, 1), (2, 9), (4, 1)], 2, 2) == [(0, 2)] or licenses.merged([(0, 1), (2, 9), (4, 1)], 2, 2) == [(2, 4)]
    assert licenses.merged([(5, 1)], 3, 2) == [] and licenses.merged([], 3, 0) == []


def test_rolling_hashes_are_those_of_their_words():
    texts = [b"a b c a b", b"", b"one", b"x,y;a b", b"  A  B "]
    hashes, ends = licenses.gram_hashes(texts)
    grams = [tuple(w[i : i + 2]) for w in map(licenses.words_of, texts) for i in range(max(0, len(w) - 1))]
    assert len(hashes) == len(grams) == ends[-1]
    assert [len(licenses.words_of(t)) - 1 if licenses.words_of(t) else 0 for t in texts] == np.diff([0, *ends]).tolist()
    assert len({(g, h) for g, h in zip(grams, hashes.tolist(), strict=True)}) == len(set(grams)) == len(set(hashes.tolist()))
