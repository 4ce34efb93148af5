import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricebridge.llm import suffix_array, suffix_dedup
from tests.llm.fixtures import SMALL, clashing, docs_frame, rows_of


def brute(texts, m):
    """(bytes, removed, spans, hash of what is kept) of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + m] for b in raw for i in range(len(b) - m + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - m + 1):
            if seen[b[i : i + m]] > 1:
                gone[i : i + m] = b"\1" * m
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def check(spark, docs, m, **how):
    got = suffix_dedup.suffix_dedup(docs, m, **how)
    got = [[r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]] for r in got.collect()]
    rows = docs.select("doc_id", "text").collect()
    want = [[r["doc_id"], *x] for r, x in zip(rows, brute([r["text"] for r in rows], m), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_awkward_rows(spark):
    check(spark, clashing(docs_frame(spark)), 400)


def test_short_windows(spark):
    check(spark, docs_frame(spark), 60)


def test_generated_table(spark):
    check(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), 400)


def test_empty_table(spark):
    assert suffix_dedup.suffix_dedup(docs_frame(spark, []), 400).collect() == []


def test_kept_texts(spark):
    rows = [(1, "x" * 10 + "abcdefghij" * 5, None, None), (2, "abcdefghij" * 5 + "tail", None, None), (3, "other", None, None)]
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs_frame(spark, rows), 48).collect()}
    assert bytes(got[1]["kept"]) == b"x" * 10 and bytes(got[2]["kept"]) == b"tail" and got[3]["kept"] is None


def test_suffix_ranks_are_those_of_sorted_suffixes(spark):
    rng = random.Random(4)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 30))] for _ in range(20)]
    strings += [strings[0], [2] * 25, [2] * 24]
    rows = [(z, i, c, 1) for z, s in enumerate(strings) for i, c in enumerate(s)]
    ranks = suffix_array.suffix_ranks(spark.createDataFrame(rows, "z long, i long, c long, b long"), 1000)
    got = {(r["z"], r["i"]): r["rank"] for r in ranks.collect()}
    suffixes = {(z, i): s[i:] for z, s in enumerate(strings) for i in range(len(s))}
    order = sorted(suffixes.values())
    assert got == {k: order.index(v) for k, v in suffixes.items()}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é", min_size=30, max_size=900), st.integers(0, 60), st.integers(0, 60))
def test_anchors_depend_on_their_windows_only(text, before, after):
    s = suffix_dedup.Shape(48)
    raw = text.encode()
    moved = b"q" * before + raw + b"z" * after
    anchor_of = lambda t: {p: a for a, lo, hi in zip(*(x.tolist() for x in suffix_dedup.anchors(t, s)), strict=True) for p in range(lo, hi + 1)}
    here, there = anchor_of(raw), anchor_of(moved)
    assert set(here) == set(range(max(0, len(raw) - s.m + 1)))
    assert all(there[p + before] == a + before and 0 <= a - p < s.head for p, a in here.items())
    # the next anchor depends on the bytes ahead only
    own = suffix_dedup.anchors(raw, s)[0].tolist()
    far = suffix_dedup.anchors(moved, s)[0].tolist()
    for a, b in zip(own, own[1:], strict=False):
        if a + s.ahead <= len(raw) and a + before in far:
            assert far[far.index(a + before) + 1] == b + before


def test_windows_too_short():
    with pytest.raises(ValueError):
        suffix_dedup.Shape(8)


def test_pieces_do_not_change_the_result(monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd ") for _ in range(5000)) + b"sting " * 200
    s = suffix_dedup.Shape(400)
    found = lambda: [*map(list, suffix_dedup.anchors(text, s)), list(suffix_dedup.cores(text, suffix_dedup.anchors(text, s)[0][:-200], s))]
    whole = found()
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert found() == whole


def test_texts_at_once_are_as_one_by_one():
    rng = random.Random(9)
    raw = [bytes(rng.choice(b"abc ") for _ in range(rng.choice([0, 5, 47, 48, 49, 400]))) for _ in range(60)]
    s = suffix_dedup.Shape(48)
    for text, (at, core) in zip(raw, suffix_dedup.anchored_cores(raw, s), strict=True):
        own, lo, hi = suffix_dedup.anchors(text, s)
        own = own[lo <= hi]
        assert at.tolist() == own.tolist() and core.tolist() == suffix_dedup.cores(text, own, s).tolist()


def test_repeats_of_one_core_against_pairs():
    rng = random.Random(7)
    s = suffix_dedup.Shape(48)
    for n in (2, 5, 30, 60, 150):
        grown = lambda size: bytes(rng.choice(b"ab") if rng.random() < 0.2 else 97 for _ in range(size))
        kinds = {}
        while len(kinds) < n:
            left, right = grown(rng.randint(5, s.head - 1)), grown(s.m - s.core)
            hi = rng.randint(0, len(left))
            kinds[left, right] = (rng.randint(0, hi), hi, left, right)
        kinds = sorted(kinds.values(), key=lambda x: x[3])
        want = []
        for i, (lo, hi, left, right) in enumerate(kinds):
            other = [k for j, k in enumerate(kinds) if j != i]
            want.append([d for d in range(lo, hi + 1) if any(a <= d <= b and left[len(left) - d :] == x[len(x) - d :] and right[: s.m - s.core - d] == y[: s.m - s.core - d] for a, b, x, y in other)])
        got = [[d for a, b in r for d in range(a, b + 1)] for r in suffix_dedup.repeats(kinds, s)]
        assert got == want
        if n <= 30:
            many = suffix_dedup._repeats_of_many(kinds, __import__("numpy").array([suffix_dedup.common_prefix(x[3], y[3]) for x, y in zip(kinds, kinds[1:], strict=False)]), s)
            assert [[d for a, b in r for d in range(a, b + 1)] for r in many] == want


def test_common_ends():
    assert suffix_dedup.common_prefix(b"abcx", b"abdx") == 2 and suffix_dedup.common_suffix(b"xabc", b"yabc") == 3
    assert suffix_dedup.common_prefix(b"", b"a") == suffix_dedup.common_suffix(b"", b"a") == 0 and suffix_dedup.common_prefix(b"ab", b"abc") == 2


def test_cores_that_too_many_anchors_have(spark):
    check(spark, docs_frame(spark), 60, most=3)


def branching(seed: int = 5) -> list[tuple]:
    """Texts that share a passage and go on alike in groups that the passage alone does not tell apart."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, ends = word(350), [word(120) for _ in range(6)]
    return [(i, word(150) + passage + ends[i % 6] + word(60), "en", "s") for i in range(24)]


def test_order_of_suffixes_decides(spark, monkeypatch):
    """With another order of suffixes the neighbours share too little, and repeated strings are missed."""
    docs = docs_frame(spark, branching())
    check(spark, docs, 400)
    right = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(docs, 400).collect())
    scrambled = lambda strings, depth: strings.selectExpr("z", "i", "xxhash64(z, i) AS rank")
    monkeypatch.setattr(suffix_dedup, "suffix_ranks", scrambled)
    wrong = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(docs, 400).collect())
    assert all(n for _, n in right) and sum(n for _, n in wrong) < sum(n for _, n in right)
