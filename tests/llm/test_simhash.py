import random

import numpy as np
import xxhash

from pricebridge.llm import components, simhash
from tests.llm.fixtures import SMALL, clashing, docs_frame, rows_of


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute(rows):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [[doc, f"{fps[i]:016x}", least.get(find(i))] for i, (doc, _) in enumerate(rows)]


def check(docs, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(simhash.near_duplicates(docs, **how), "doc_id", "fingerprint", "component_id") == sorted(brute(rows), key=repr)


def test_awkward_rows(spark):
    check(clashing(docs_frame(spark)))


def test_large_shards_are_cut(spark):
    check(docs_frame(spark), tree=2, most=2)


def test_links_follow_the_edges_of_trees(monkeypatch):
    """Shards are searched through their trees: without edges the links are lost."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[:50] ^ np.uint64(5)]))
    followed = []
    find = simhash.BkTree.find

    def counted(self, queries, who, radius):
        followed.append((len(queries), len(self.fps)))
        return find(self, queries, who, radius)

    monkeypatch.setattr(simhash.BkTree, "find", counted)
    linked = simhash.forest(fps)
    assert linked and sum(q * n for q, n in followed) < 0.8 * len(fps) ** 2 and len(followed) > len(fps) // 8
    monkeypatch.setattr(simhash.BkTree, "find", lambda self, queries, who, radius: iter(()))
    assert simhash.forest(fps) == []


def test_frequent_band_values_are_dealt_again(spark):
    rng = random.Random(6)
    fps = sorted({0xABCD | rng.getrandbits(48) << 16 for _ in range(300)})
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:80]]
    distinct = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(set(fps))], "fp long")
    found = {(r["a"], r["b"]) for r in simhash.links(distinct, tree=16, most=16).collect()}
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(list(found), "a long, b long")).collect()}
    signed = lambda f: int(np.uint64(f).view(np.int64))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3 and a != b:
                assert got[signed(a)] == got[signed(b)]


def test_generated_table(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (20, 2))]]))
    tree = simhash.BkTree(fps, handful=2)
    got = {(int(a), int(b)) for x, y in tree.find(fps, np.arange(len(fps)), 3) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}


def test_forest_connects_what_is_linked():
    rng = random.Random(2)
    for n in (3, 8, 60, 700):
        base = [rng.getrandbits(64) for _ in range(max(1, n // 10))]
        fps = sorted({rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n)})

        def parts(links, fps=fps):
            root = {f: f for f in fps}

            def find(a):
                while root[a] != a:
                    a = root[a]
                return a

            for a, b in links:
                root[find(a)] = find(b)
            return {frozenset(g for g in fps if find(g) == find(f)) for f in fps}

        got = simhash.forest(np.array(fps, np.uint64))
        assert len(got) < len(fps)
        assert parts(got) == parts([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 300) if i != 150] + [(5, 5), (7, 6)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(301)}


def test_keep_one(spark):
    docs = docs_frame(spark, [(1, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (3, "other words here now", "en", "s"), (4, None, None, None), (5, "", "en", "s")])
    assert [r[0] for r in rows_of(simhash.keep_one(docs), "doc_id")] == [1, 3, 4]
