import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pricebridge.llm import similar
from tests.llm.fixtures import SMALL, clashing, docs_frame, rows_of


def brute_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [[doc, least.get(find(i))] for i, (doc, _) in enumerate(rows)]


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(brute(rows), key=repr)
    assert rows_of(similar.near_duplicates(docs), "doc_id", "component_id") == want
    return want


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"z{rng.getrandbits(40)}"
    return " ".join(words)


def test_pairs_at_0_8_to_0_95_lose_one(spark):
    rows = []
    # n shingles, k words put behind the last: n of n + k are shared
    for i, (n, k) in enumerate([(100, 25), (100, 26), (100, 17), (100, 11), (95, 5), (4, 1), (4, 2)]):
        words = [f"w{i}x{j}" for j in range(n + 4)]
        rows += [(2 * i, " ".join(words), "en", "s"), (2 * i + 1, " ".join(words + [f"v{i}x{j}" for j in range(k)]), "en", "s")]
    got = [r[0] for r in rows_of(corpus_pipeline.drop_near_copies(spark, docs_frame(spark, rows), SMALL), "doc_id")]
    assert sorted(set(range(14)) - set(got)) == [1, 5, 7, 9, 11]


def test_awkward_rows(spark):
    check(clashing(docs_frame(spark)))


def test_generated_table(spark):
    assert sum(a != b for a, b in check(spark.read.parquet(f"{SMALL}/documents.parquet"))) > 0


def test_empty_table(spark):
    assert similar.near_duplicates(docs_frame(spark, [])).collect() == []


def test_long_lists(spark):
    """Groups of copies so far from each other that not all are linked, among texts that share a passage."""
    rng, rows = random.Random(3), []
    passage = [f"p{j}" for j in range(60)]
    for group, (size, edits) in enumerate([(60, 1), (60, 3), (60, 5), (80, 4)]):
        base = [f"g{group}x{j}" for j in range(140)] + passage
        rows += [(len(rows) + i, edited(rng, base, edits), "en", "s") for i in range(size)]
    rows += [(1000 + i, " ".join([*passage, f"n{i}", f"m{i}"]), "en", "s") for i in range(40)]
    groups = {b for _, b in check(docs_frame(spark, rows))}
    assert 4 < len(groups) < len(rows)


def test_rows_of_shared_shingles_over_batches():
    rng = np.random.default_rng(4)
    for _ in range(200):
        h = np.sort(rng.integers(0, 12, rng.integers(0, 20)))
        rows = np.stack([h, np.arange(len(h)), h, h])
        cuts = np.sort(rng.integers(0, len(h) + 1, 5))
        parts = [similar._batch(rows[:, a:b]) for a, b in zip([0, *cuts], [*cuts, len(h)], strict=True)]
        got = pa.Table.from_batches(list(similar._shared(iter(parts))), parts[0].schema)["node"].to_pylist()
        assert got == [i for i in range(len(h)) if (h == h[i]).sum() > 1]


def test_sketches_rule_out_pairs_and_lose_none():
    """Texts of one list that share much but less than 0.8: nearly all of their pairs were joined and compared."""
    rng = random.Random(9)
    base = [f"b{j}" for j in range(200)]
    own = [np.sort(similar.shingles(edited(rng, base, edits).encode())) for edits in [2] * 20 + [14] * 60]
    m = len(own)
    rows = [pa.array(np.zeros(m, np.int64)), pa.array(range(m)), pa.array([len(x) for x in own]), pa.array(np.zeros(m, np.int64)), pa.array(range(m)), *similar._sketches(own)]
    batch = pa.RecordBatch.from_arrays(rows, names=["h", "node", "n", "place", "label", *similar.SKETCH])
    got = {(r["a"], r["b"]) for out in similar._pairs(None)([batch]) for r in out.to_pylist()}
    overlap = {(i, j): len(np.intersect1d(own[i], own[j])) for i in range(m) for j in range(i + 1, m)}
    like = {(i, j) for (i, j), k in overlap.items() if 9 * k >= 4 * (len(own[i]) + len(own[j]))}
    assert like and like <= got
    assert len(got) < len(like) + 300 < len(overlap)
