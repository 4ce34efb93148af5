"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition makes a run of (digest, best row, rows). In each binomial round a node hands every record to the node
that has the record's digest digit in place of its own, so `fan` nodes exchange slices of their runs with each other;
each node sorts what it got, merges equal digests and retains the best row. After log_fan(nodes) rounds a node holds
one digest range, completely merged. No node ever holds more than its share, and a text that a third of all rows have
is at most one record per node from the first round on.

A record is the SHA-256 of the normalised text and, to verify it at every level, the text's length and an independent
64-bit hash: records merge only when all three agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebridge.llm.common import cut, limit_batches, numbered, partitions, small, texts, tidied

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_DIGEST = "pos long, doc_id long, sha binary, witness long, norm_bytes long, code_points long"
_RUN = "node int, sha binary, witness long, norm_bytes long, code_points long, best_id long, best_pos long, rows long"




_NOT_CONTINUATION = bytes(i for i in range(256) if i & 0xC0 != 0x80)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its place, digest, verification hash, and length in code points."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in it:
            raw = texts(batch, "text")
            norm = [b.translate(None, WHITE) for b in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(at, at + len(raw)), pa.int64()),
                    batch.column(0),
                    pa.array([hashlib.sha256(b).digest() for b in norm], pa.binary()),
                    pa.array([xxhash.xxh3_64_intdigest(b) - (1 << 63) for b in norm], pa.int64()),
                    pa.array([len(b) for b in norm], pa.int64()),
                    pa.array([len(b) - _continuations(b) for b in raw], pa.int64()),
                ],
                names=["pos", "doc_id", "sha", "witness", "norm_bytes", "code_points"],
            )
            at += len(raw)

    limit_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), _DIGEST)


def _continuations(b: bytes) -> int:
    """UTF-8 continuation bytes in b."""
    return len(b.translate(None, _NOT_CONTINUATION))


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code_points, id, pos): more code points, then smaller id (null last), then smaller place."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return min(a, b, key=key)


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent records of equal digest become one. The input is sorted by node and digest."""
    names = ["node", "sha", "witness", "norm_bytes", "code_points", "best_id", "best_pos", "rows"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    key, best, rows, out = None, None, 0, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in it:
        for node, sha, witness, norm, cp, i, pos, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = (node, sha, witness, norm)
            if k == key:
                best, rows = _better(best, (cp, i, pos)), rows + n
                continue
            if key is not None:
                out.append((*key, *best, rows))
                if len(out) >= 8192:
                    yield flush()
                    out = []
            key, best, rows = k, (cp, i, pos), n
    if key is not None:
        out.append((*key, *best, rows))
    if out:
        yield flush()


def merge_runs(table: DataFrame, fan: int = 4, nodes: int | None = None) -> DataFrame:
    """Groups of equal texts, from digests(): sha, witness, norm_bytes, code_points, best_id, best_pos, rows.

    fan: how many nodes exchange runs in a round. nodes: at least so many (default: the shuffle partitions).
    """
    rounds, want = 1, nodes or partitions(table.sparkSession)
    while fan**rounds < want:
        rounds += 1
    total = fan**rounds
    # The digest's first 31 bits say at which node it ends.
    home = F.pmod(F.conv(F.substring(F.hex("sha"), 1, 7), 16, 10).cast("long"), F.lit(total)).cast("int")
    runs = table.select(
        F.pmod(F.shiftright("pos", 33), F.lit(total)).cast("int").alias("node"), "sha", "witness", "norm_bytes", "code_points",
        F.col("doc_id").alias("best_id"), F.col("pos").alias("best_pos"), F.lit(1).cast("long").alias("rows"),
    )
    # each partition's own run first, so that a frequent text leaves it as one record
    runs = runs.sortWithinPartitions("node", "sha", "witness", "norm_bytes").mapInArrow(tidied(_merge), _RUN)
    for r in range(rounds):
        unit = fan**r
        digit = lambda c: F.floor(c / unit) % fan  # noqa: E731, B023
        node = (F.col("node") - digit(F.col("node")) * unit + digit(home) * unit).cast("int")
        runs = runs.withColumn("node", node).repartitionById(total, F.col("node")).sortWithinPartitions("node", "sha", "witness", "norm_bytes").mapInArrow(tidied(_merge), _RUN)
    return runs.drop("node")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 4, nodes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]. The row with the most code points stays,
    then the smallest id (null last); of rows that agree in both, one stays. Null texts are empty texts, which form one
    group; an empty table gives no rows; other columns of docs are ignored, whatever their names.
    """
    table = cut(digests(docs, id_col, text_col), "digests")
    groups = merge_runs(table, fan, nodes).select("sha", "witness", "norm_bytes", F.col("best_id").alias("keep_id"), "best_pos", F.col("rows").alias("group_size"))
    return table.join(groups, ["sha", "witness", "norm_bytes"]).select(
        "doc_id", "keep_id", "group_size", (F.col("pos") == F.col("best_pos")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called.

    Null texts are empty texts, of which one row stays; of rows that repeat one id and text one stays; an empty table gives
    no rows.
    """
    docs, (id_col, text_col), restored = numbered(docs, id_col, text_col)
    marks = cut(exact_dedup(docs, id_col, text_col), "marks")
    gone = marks.filter(~F.col("kept"))
    # ids of which a row stays and a row goes: equal rows under one id. Of these one is kept by its text.
    both = gone.join(marks.filter("kept").select(F.col("doc_id").alias("k")), F.col("doc_id").eqNullSafe(F.col("k")), "left_semi").select("doc_id").distinct()
    both = cut(both, "both")
    only = gone.join(both.withColumnRenamed("doc_id", "k"), F.col("doc_id").eqNullSafe(F.col("k")), "left_anti").select(F.col("doc_id").alias("__gone")).distinct()
    out = docs.join(small(only), F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")
    if both.isEmpty():
        return restored(out)
    ids = small(both.select(F.col("doc_id").alias("__both")))
    plain = out.join(ids, F.col(id_col).eqNullSafe(F.col("__both")), "left_anti")
    twice = out.join(ids, F.col(id_col).eqNullSafe(F.col("__both")), "left_semi")
    # Under such an id other texts, which stay or go on their own, may stand as well.
    stay = marks.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)
    twice = twice.withColumn("__sha", sha).alias("t")
    once = twice.join(stay.alias("s"), F.col(f"t.{id_col}").eqNullSafe(F.col("s.__id")) & (F.col("t.__sha") == F.col("s.__sha")), "left_semi")
    once = once.withColumn("__n", F.length(F.coalesce(F.col(text_col), F.lit(""))))
    top = once.groupBy(F.col(id_col).alias("__id"), "__sha").agg(F.max("__n").alias("__n"))
    once = once.alias("o").join(top.alias("m"), F.col(f"o.{id_col}").eqNullSafe(F.col("m.__id")) & (F.col("o.__sha") == F.col("m.__sha")) & (F.col("o.__n") == F.col("m.__n")), "left_semi")
    return restored(plain.unionByName(once.dropDuplicates([id_col, "__sha"]).drop("__sha", "__n")))
