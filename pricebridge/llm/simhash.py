"""SimHash near-duplicates with BK-trees.

A tree of all fingerprints would have to be searched for each of them, and with random 64-bit values it leaves out only
half of the edges a level: that grows by almost the square. So trees hold a bounded number of fingerprints. Two
fingerprints that differ in at most `radius` = 3 of 64 bits agree in one of four 16-bit bands, so each distinct one goes
to four shards, one a band, which hold all fingerprints with some of the band's values, and each shard is a BK-tree:
children are keyed by their Hamming distance to the parent, and a query follows only the keys within the radius of its
own distance. The number of shards grows with the input and the size of a tree does not. Shards hold distinct
fingerprints, so thousands of copies are one entry.

Trees are not broadcast: together they are the fingerprints of all documents, which must not pass through the driver. They
meet their queries, which are the same shard's fingerprints, in the task that builds them. A shard gives the links of a
spanning forest and not all pairs; components of all links follow from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebridge.llm.common import cut, limit_batches, numbered, partitions, slices, small, texts, tidied
from pricebridge.llm.components import connected_components

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
RADIUS = 3
#: Fingerprints below which a tree branches no further, and those of a shard's tree: on average, and at most.
HANDFUL, TREE, MOST = 4, 2048, 8192


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """The XXH64 of every word shingle of a UTF-8 text, repeats included; A-Z count as a-z, and fewer words are one shingle."""
    split = text.translate(LOWER).split()
    if not split:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(split), len(split)
    if n <= words:
        starts, ends = [0], [len(joined)]
    else:
        sizes = list(map(len, split))
        starts = [0, *accumulate(s + 1 for s in sizes[: n - words])]
        first = sum(sizes[:words]) + words - 1
        ends = list(accumulate((s + 1 for s in sizes[words:]), initial=first))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes: the bits that over half of them have."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        set_bits += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text, unsigned."""
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint(t, words) for t in texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    limit_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, fp long")


class BkTree:
    """A BK-tree of distinct 64-bit fingerprints, built at once. Positions are those in the given array.

    A node's children are keyed by the Hamming distance of all their fingerprints to the node's own; up to `handful`
    fingerprints are kept without further nodes.
    """

    def __init__(self, fps: np.ndarray, at: np.ndarray | None = None, handful: int = HANDFUL):
        at = np.arange(len(fps)) if at is None else at
        self.at, self.fps, self.children = at, fps, {}
        if len(fps) > handful:
            self.at, self.fps = at[:1], fps[:1]
            d = np.bitwise_count(fps[1:] ^ fps[0])
            order = np.argsort(d, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(d[order])) + 1, [len(d)]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = order[a:b] + 1
                self.children[int(d[order[a]])] = BkTree(fps[own], at[own], handful)

    def find(self, queries: np.ndarray, who: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query positions, tree positions) of pairs within the radius; only edges whose key is within it are followed."""
        d = np.bitwise_count(queries[:, None] ^ self.fps[None, :])
        x, y = np.nonzero(d <= radius)
        if len(x):
            yield who[x], self.at[y]
        if self.children:
            own = d[:, 0].astype(np.int16)
            for key, child in self.children.items():
                near = np.flatnonzero((own >= key - radius) & (own <= key + radius))
                if len(near):
                    yield from child.find(queries[near], who[near], radius)


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between distinct fingerprints (as Python ints) that connect all that are linked: each component's least with its others."""
    root = np.arange(len(fps))
    tree = BkTree(fps)
    for start in range(0, len(fps), 8192):
        own = np.arange(start, min(start + 8192, len(fps)))
        for x, y in tree.find(fps[own], own, radius):
            while True:
                a, b = root[x], root[y]
                apart = np.flatnonzero(a != b)
                if not len(apart):
                    break
                low, high = sorted((int(a[apart[0]]), int(b[apart[0]])))
                root[root == high] = low
    return [(int(fps[r]), int(fps[i])) for i, r in enumerate(root) if r != i]


def _shard_links(radius: int):
    """(a, b) links from rows of (shard key, fp) that are sorted by shard."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        links: list[tuple[int, int]] = []
        key, held = None, []
        for batch in it:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != key and held:
                    links += _of_shard(held, radius)
                    held = []
                key = keys[a]
                held.append(fps[a:b])
            if len(links) >= 8192:
                yield out(links)
                links = []
        if held:
            links += _of_shard(held, radius)
        if links:
            yield out(links)

    return run


def _of_shard(held: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    fps = held[0] if len(held) == 1 else np.concatenate(held)
    return forest(fps, radius) if len(fps) > 1 else []


def _bands(shared: int, width: int) -> list[Column]:
    """The next four bands of `width` bits, above the `shared` low bits of `rest`."""
    return [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("rest", shared + i * width).bitwiseAND((1 << width) - 1).alias("value")) for i in range(4)]


def shards(distinct: DataFrame, tree: int, most: int) -> DataFrame:
    """(shard long, fp): every fingerprint in shards such that any two within three bits share one.

    A shard holds all fingerprints with some values of one of four bands: as many values as give trees of about `tree`
    fingerprints. Where values are so frequent that a shard has more than `most`, its fingerprints are dealt again, level
    by level: the bits that a shard's members do not share are kept in `rest`, low bits first, and cut into four bands.
    The last level keeps what it has.
    """
    n = distinct.count()
    rows = distinct.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("shard"))
    done = None
    for left, width in ((64, 16), (48, 12), (36, 9), (28, 7)):
        spread = rows.withColumn("b", F.explode(F.array(*_bands(0, width))))
        low = F.col("rest").bitwiseAND(F.expr(f"shiftleft(1L, b.band * {width}) - 1"))
        high = F.expr(f"shiftleft(shiftrightunsigned(rest, (b.band + 1) * {width}), b.band * {width})")
        # the lowest band's neighbour moves down by its width; a shift by 64 would be none
        high = F.when(F.expr(f"(b.band + 1) * {width} >= 64"), F.lit(0).cast("long")).otherwise(high)
        own = F.xxhash64("shard", F.lit(left), "b.band", "b.value")
        spread = spread.select("fp", low.bitwiseOR(high).alias("rest"), own.alias("shard"), F.xxhash64("b.band", F.pmod(own, F.lit(slices(n, tree)))).alias("tree"))
        if left == 64:
            # values that are frequent by themselves are shards of their own
            large = spread.groupBy("shard").count().filter(F.col("count") > tree).select("shard")
        else:
            large = spread.groupBy("shard").count().filter(F.col("count") > most).select("shard")
        name = F.col("tree") if left == 64 else F.col("shard")
        if width == 7 or large.isEmpty():
            spread = spread.select(name.alias("shard"), "fp")
            return spread if done is None else done.unionByName(spread)
        large, spread = small(cut(large, "large")), cut(spread, "spread")
        fine = spread.join(large, "shard", "left_anti").select(name.alias("shard"), "fp")
        done = fine if done is None else done.unionByName(fine)
        rows = spread.join(large, "shard", "left_semi").drop("tree")
    raise AssertionError


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within the radius (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("four bands find pairs within three bits")
    n = partitions(distinct.sparkSession)
    rows = shards(distinct, tree, most)
    return rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(tidied(_shard_links(radius)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, tree: int = TREE, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    A fingerprint bit is 1 if set in over half of the XXH64 (seed 42) of the text's word shingles, repeats included;
    A-Z count as a-z; fewer words than a shingle has are one shingle; no words, as in null and empty texts, give zero,
    which links like any other. component_id is the smallest id reachable over links, the own one included; null only
    where all ids of a component are null. Repeated rows get the same answer each. An empty table gives no rows; other
    columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp"), radius, tree, most))
    named = found.join(distinct, F.col("node") == F.col("fp")).select("fp", "label", "least")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = cut(named.join(least, "label").select("fp", F.col("component_id").alias("over_links")), "linked")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("over_links", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is that of their component in marks (doc_id, component_id), with all columns.

    Rows that repeat one id stay or go together; a component whose ids are all null stays whole. Columns may have any names.
    """
    docs, (id_col,), restored = numbered(docs, id_col)
    marks = cut(marks, "marks")
    # an id may stand in several components if ids repeat; it goes only where it nowhere stays
    gone = marks.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).filter("NOT stays").select(F.col("doc_id").alias("__gone"))
    gone = cut(gone, "gone")
    return restored(docs.join(small(gone), F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is that of their component, with all columns: one document of each group."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, **how), id_col)


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """keep_one() by links between texts whose sets of shingles have a Jaccard similarity of at least 0.8.

    Fingerprints and trees propose pairs, which their sets confirm; pairs that differ in more bits than a fingerprint's
    radius are found by a join on prefixes of the sets (similar.py), which loses none.
    """
    from pricebridge.llm import similar

    return keep_least(docs, similar.near_duplicates(docs, id_col, text_col, words), id_col)
