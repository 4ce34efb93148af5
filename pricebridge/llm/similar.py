"""Near copies by the exact similarity of their shingles, for the SimHash operator.

A text is the set of its five-word shingles (64-bit hashes); two texts are near copies if their sets have a Jaccard
similarity of at least 0.8. Pairs whose fingerprints BK-trees link are held against each other first. But texts at 0.8
differ in some ten of 64 bits, far beyond a radius that trees or bands can search, so an all-pairs join on prefixes
finds the rest: in any one order of all shingles, two such sets share one of their first n - ceil(0.8 n) + 1 each, so
only these are joined, and no pair is lost. Shingles that many texts have stand last in the order, which keeps the lists
of texts that share one short; which ones they are is counted on a sample and decides about speed alone.

Pairs that share one are held against each other only if their sizes, places and sketches allow the similarity, and link
only if their whole sets have it. A sketch has a bit for each of 256 values of a shingle's low bits: whether an odd number of
the set's shingles has the value. Two sketches differ in no more bits than their sets in shingles, so no pair is lost. A long list first links its texts with one of them, another in each list; then only pairs of
texts that no chain of links joins yet are compared. So thousands of near copies do not make their square of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebridge.llm.common import cut, drop_cut, limit_batches, partitions, release, small, texts, tidied
from pricebridge.llm.components import connected_components
from pricebridge.llm.simhash import fingerprint_of, links, shingle_hashes

#: The least similarity is FOUR / FIVE; whole numbers, so that a pair at just 0.8 is one.
FOUR, FIVE = 4, 5
#: One of so many texts is counted for common shingles; those that so many of them have are common, the most frequent ones at most.
SAMPLE, COMMON, MOST_COMMON = 8, 8, 50_000
#: Lists of more texts than this are linked round by round.
SHORT, MOST_ROUNDS = 16, 6
#: The columns of a sketch, 64 bits each.
SKETCH = ["s0", "s1", "s2", "s3"]


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted hashes of a text's different word shingles; A-Z count as a-z, and fewer words are one shingle."""
    return np.unique(shingle_hashes(text, words)).view(np.int64)


def sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """node (a hash of the whole set, 0 if empty) and hashes (ascending) of every row of doc_id, text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = [np.sort(shingles(t, words)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(own)), _lists_of(own)], names=["node", "hashes"])

    return docs.mapInArrow(tidied(run), "node long, hashes array<long>")


def _nodes(own: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes()) if len(x) else 0 for x in own], np.uint64).view(np.int64)


def _lists_of(own: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))


def _sketches(own: list[np.ndarray]) -> list[pa.Array]:
    """The columns SKETCH of sets."""
    odd = np.array([np.bincount(x & 255, minlength=256) & 1 for x in own], np.uint8).reshape(-1, 256)
    return [pa.array(c) for c in np.packbits(odd, axis=1).view(np.int64).T.copy()]


def proposed(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash proposes, from (node, fp): of those with one fingerprint, each with the first, and
    the first ones of fingerprints that a shard's tree links."""
    firsts = cut(prints.groupBy("fp").agg(F.min("node").alias("node")), "firsts")
    with_first = prints.join(firsts.withColumnRenamed("node", "first"), "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = cut(links(firsts.select("fp")).distinct(), "fp-links")
    end = lambda c, node: firsts.select(F.col("fp").alias(c), F.col("node").alias(node))
    return with_first.unionByName(linked.withColumnsRenamed({"a": "x", "b": "y"}).join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b"))


def common_shingles(docs: DataFrame, words: int = 5) -> np.ndarray:
    """Shingles that many texts have, the most frequent last."""
    some = sets(docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), words).select(F.explode("hashes").alias("h"))
    found = some.groupBy("h").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").collect()
    return np.array([r["h"] for r in reversed(found)], np.int64)


def prefixes(docs: DataFrame, common: np.ndarray, words: int = 5) -> DataFrame:
    """pos, doc_id, node, fp (the set's fingerprint), n (its size), first (its prefix in the order) and its sketch of every row of doc_id, text."""
    by_hash = np.argsort(common)
    hot = common[by_hash]

    def prefix(values: np.ndarray) -> np.ndarray:
        most = len(values) - -(-FOUR * len(values) // FIVE) + 1
        if len(hot) and len(values):
            at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
            values = values[np.argsort(np.where(hot[at] == values, by_hash[at] + 1, 0), kind="stable")]
        return values[:most]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = TaskContext.get().partitionId() << 33
        for batch in it:
            own = [shingles(t, words) for t in texts(batch, "text")]
            prints = np.array([fingerprint_of(x.view(np.uint64)) for x in own], np.uint64).view(np.int64)
            own = [np.sort(x) for x in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(pos, pos + len(own)), pa.int64()), batch.column(0), pa.array(_nodes(own)), pa.array(prints), pa.array([len(x) for x in own], pa.int64()), _lists_of([prefix(x) for x in own]), *_sketches(own)],
                names=["pos", "doc_id", "node", "fp", "n", "first", *SKETCH],
            )
            pos += len(own)

    return docs.mapInArrow(tidied(run), "pos long, doc_id long, node long, fp long, n long, first array<long>, " + ", ".join(f"{c} long" for c in SKETCH))


def _lists(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The columns of each run of rows with one h, as arrays; the rows are sorted by it."""
    held: list[np.ndarray] = []
    for batch in it:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        cuts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), rows.shape[1]]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0][0, 0] != rows[0, a]:
                yield np.concatenate(held, 1)
                held = []
            held.append(rows[:, a:b])
    if held:
        yield np.concatenate(held, 1)


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose h another row has; the rows are sorted by it."""
    held = None
    for batch in it:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if not rows.shape[1]:
            continue
        rows = rows if held is None else np.concatenate([held[:, -2:], rows], 1)
        new = 0 if held is None else min(2, held.shape[1]) - 1
        held = rows
        same = rows[0, 1:] == rows[0, :-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        keep[:new] = False
        keep[-1] = False  # the next batch says
        yield _batch(rows[:, keep])
    if held is not None and held.shape[1] > 1 and held[0, -1] == held[0, -2]:
        yield _batch(held[:, -1:])


def _batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r)) for r in rows], names=["h", "node", "n", "place"])


def _pairs(seed: int | None):
    """(a, b) of a list's texts that may be similar and bear different labels: all pairs of a short list or without a seed, else those with one text."""

    def of(x: np.ndarray, i: int, js: np.ndarray) -> tuple[int, np.ndarray]:
        _, node, n, place, label = x[:5]
        sketch = x[5:].view(np.uint64)
        least = np.minimum(n[i] - place[i], n[js] - place[js])  # shingles that both can have, if this is the first
        js = js[((label[js] != label[i]) & ((FOUR + FIVE) * least >= FOUR * (n[i] + n[js])))]
        apart = np.bitwise_count(sketch[:, js] ^ sketch[:, i, None]).sum(0, dtype=np.int64)  # at least so many shingles have only one of them
        return node[i], node[js[(FOUR + FIVE) * apart <= (FIVE - FOUR) * (n[i] + n[js])]]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()

        def out() -> pa.RecordBatch:
            pairs = np.array(list(found), np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for x in _lists(it):
            m = x.shape[1]
            if (x[4] == x[4, 0]).all():
                continue
            if seed is None or m <= SHORT:
                stars = ((i, np.arange(i + 1, m)) for i in range(m - 1))
            else:
                stars = iter([((int(x[0, 0]) + seed * 7919) % m, np.arange(m))])
            for i, js in stars:
                a, others = of(x, i, js)
                found.update((min(a, b), max(a, b)) for b in others.tolist())
                if len(found) >= 65536:
                    yield out()
        if found:
            yield out()

    return run


def similar_links(distinct: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, label for all nodes of distinct (node, fp, n, first, SKETCH: one row a set) with similar ones: the smallest node that
    links lead to. sets_of gives the sets (node, hashes) of nodes."""
    n = partitions(distinct.sparkSession)
    firsts = distinct.select("node", "n", "first")
    rows = firsts.select("node", "n", F.posexplode("first").alias("place", "h")).select("h", "node", "n", F.col("place").cast("long").alias("place"))
    kind = "h long, node long, n long, place long"
    # most shingles stand in one text
    lists = rows.repartition(n, "h").sortWithinPartitions("h").mapInArrow(tidied(_shared), kind)
    lists = cut(lists.join(distinct.select("node", *SKETCH), "node").select("h", "node", "n", "place", *SKETCH), "lists")
    del rows
    release(distinct.sparkSession)
    long = cut(lists.groupBy("h").count().filter(F.col("count") > SHORT).select("h"), "long")
    # what SimHash proposes and the sets confirm comes first; the join on prefixes is for what is not joined yet
    found = _similar(cut(proposed(distinct.select("node", "fp")), "proposed"), firsts, sets_of)
    named = cut(connected_components(found), "named")
    most = 4 * lists.count() + 100_000
    for seed in range(MOST_ROUNDS + 1):
        some = lists if seed == 0 else lists.join(small(long), "h", "left_semi")
        some = some.join(named, "node", "left").select("h", "node", "n", "place", F.coalesce("label", "node").alias("label"), *SKETCH)
        if seed:
            classes = some.groupBy("h", "label").count().groupBy("h").agg((F.sum("count") ** 2 - F.sum(F.col("count") ** 2)).alias("apart"))
            left = classes.agg(F.sum("apart")).first()[0] or 0
            if not left:
                return named
        last = seed > 0 and (left / 2 <= most or seed == MOST_ROUNDS)
        pairs = some.repartition(n, "h").sortWithinPartitions("h", "node").mapInArrow(tidied(_pairs(None if last else seed)), "a long, b long")
        # the labels stand for all links before
        found = _similar(cut(pairs.distinct(), "pairs"), firsts, sets_of)
        before, named = named, cut(connected_components(named.toDF("a", "b").unionByName(found)), "named")
        for done in (before, found):
            drop_cut(done)
        release(distinct.sparkSession)
        if last:
            return named
    raise AssertionError


def _beside(pairs: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """pairs with the columns of rows(nodes) for a, as struct x, and for b, as struct y; and what has been written for that."""
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    own = cut(rows(nodes), "own")
    whole = lambda node, name: own.select(F.col("node").alias(node), F.struct(*(c for c in own.columns if c != "node")).alias(name))
    return pairs.join(whole("a", "x"), "a").join(whole("b", "y"), "b"), [nodes, own]


def _similar(pairs: DataFrame, firsts: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs whose sets have the similarity, written; pairs, which have been written too, are deleted.

    What two sets share stands in both prefixes or, for one of them, behind its prefix. That bounds it by far shorter
    arrays than the sets, and few pairs but similar ones reach the sets.
    """
    behind = F.greatest(F.col("x.n") - F.size("x.first"), F.col("y.n") - F.size("y.first"))
    beside, made = _beside(pairs, lambda nodes: firsts.join(small(nodes), "node", "left_semi"))
    near = beside.filter((FOUR + FIVE) * (F.size(F.array_intersect("x.first", "y.first")) + behind) >= FOUR * (F.col("x.n") + F.col("y.n")))
    near = cut(near.select("a", "b"), "near")
    for done in (pairs, *made):
        drop_cut(done)
    del beside
    release(near.sparkSession)
    both, made = _beside(near, sets_of)
    out = cut(both.filter((FOUR + FIVE) * F.size(F.array_intersect("x.hashes", "y.hashes")) >= FOUR * (F.size("x.hashes") + F.size("y.hashes"))).select("a", "b"), "similar")
    for done in (near, *made):
        drop_cut(done)
    del both
    release(out.sparkSession)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """doc_id and component_id of every row of docs.

    Rows whose sets of word shingles have a Jaccard similarity of at least 0.8 are linked, and texts without words, null
    and empty ones too, with each other. component_id is the smallest id reachable over links, the own one included; null
    only where all ids of a component are null. Exact but for collisions of 64-bit hashes. Of every text only the prefix
    is written; the sets of texts that may be similar are made from their texts again.
    """
    limit_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(prefixes(docs, common_shingles(docs, words), words), "prefixes")
    release(docs.sparkSession)
    # of rows with one set the first stands for all
    twice = cut(rows.groupBy("node").agg(F.count("*").alias("rows"), F.min("pos").alias("first_pos")).filter("rows > 1").select("node", "first_pos"), "twice")
    distinct = rows.join(small(twice), "node", "left").filter("first_pos IS NULL OR first_pos = pos").drop("first_pos")

    def sets_of(nodes: DataFrame) -> DataFrame:
        ids = cut(distinct.join(small(nodes), "node", "left_semi").select(F.col("doc_id").alias("id")).distinct(), "ids")
        own = sets(docs.join(small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), words)
        return own.join(small(nodes), "node", "left_semi").dropDuplicates(["node"])

    named = similar_links(distinct, sets_of)
    marks = rows.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    least = marks.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return marks.join(least, "label").select("doc_id", "component_id")
