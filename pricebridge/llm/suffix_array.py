"""A distributed suffix array of strings of symbols, by the difference-cover algorithm.

A level's strings are rows (z, i, c, b): string, position, symbol (above 0) and the bytes that it stands for. The
suffixes at positions 1 and 2 mod 3 are the sample. Their triples are sorted by range and named by rank; the names at
positions 1 mod 3 and those at 2 mod 3 are the next level's strings, whose suffix ranks are the sample's. The remaining
suffixes, at 0 mod 3, are merged: against positions 1 mod 3 by (symbol, rank of the next) and against positions 2 mod 3
by (symbol, symbol, rank of the one after).

Ranks count the strictly smaller suffixes, so equal suffixes share one. Suffixes count as equal when they are so for
`depth` bytes: a name is clear if no other has it, if it reaches its string's end or spans that much. The recursion ends
where all names are clear; where less than half are not, only these go on, each run of them with the clear one behind it.

Sorts are by range with the position as the last key, so one symbol that a third of all rows bear spreads over
partitions. A partition reports only its counts and its first and last key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebridge.llm.common import cut, drop_cut, partitions, release, small


def _as_longs(column: pa.Array) -> np.ndarray:
    """A column of longs, or the hashes of one of byte strings: neighbours are equal where these are."""
    if pa.types.is_binary(column.type):
        return np.array([xxhash.xxh3_64_intdigest(x) for x in column.to_pylist()], np.uint64).view(np.int64)
    return column.to_numpy(zero_copy_only=False)


def _run_counts(run: list[str], keep: list[str]):
    """Per partition, in order: for each row the rows of kind 0 and of kind 1 in earlier runs of equal `run` columns."""

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(2, np.int64)
        start = np.zeros(2, np.int64)
        last = None
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            at = {f: batch.schema.get_field_index(f) for f in [*run, *keep, "kind"]}
            keys = np.stack([_as_longs(batch.column(at[c])) for c in run])
            kind = batch.column(at["kind"]).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
            new[0] = last is None or bool((keys[:, 0] != last).any())
            ones = np.concatenate([[0], np.cumsum(kind == 1)])
            zeros = np.arange(n + 1) - ones
            heads = np.flatnonzero(new)
            which = np.searchsorted(heads, np.arange(n), side="right") - 1
            before = [np.where(which >= 0, seen[k] + c[heads[np.maximum(which, 0)]] if len(heads) else start[k], start[k]) for k, c in ((0, zeros), (1, ones))]
            # keys are looked at in a partition's first and last run only
            inner = (before[0] + before[1] > 0) & (which < which[-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[c]) for c in keep), *(pa.array(np.where(inner, 0, k)) for k in keys), pa.array(np.full(n, part, np.int32)), pa.array(kind), pa.array(before[0]), pa.array(before[1])],
                names=[*keep, *(f"k{j}" for j in range(len(run))), "part", "kind", "l0", "l1"],
            )
            start = np.array([before[0][-1], before[1][-1]])
            last = keys[:, -1].copy()
            seen = seen + np.array([zeros[-1], ones[-1]])

    return local


def ranked(rows: DataFrame, order: list[str], run: list[str], keep: list[str], tie: list[str]) -> DataFrame:
    """keep, n0, n1 of every row: the rows of kind 0 and of kind 1 in strictly smaller runs.

    Rows are sorted by order, then tie; a run are neighbours that agree in the run columns. All columns are longs but
    kind, an int, and columns of order and run that are byte strings. rows should be cheap to read twice. What is counted in partitions is written; drop_cut() of the result deletes it.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    schema = ", ".join([*(f"{c} long" for c in keep), *(f"k{j} long" for j in range(len(run))), "part int", "kind int", "l0 long", "l1 long"])
    wanted = list(dict.fromkeys([*order, *run, *keep, *tie, "kind"]))
    sortd = rows.select(*wanted).repartitionByRange(n, *order, *tie).sortWithinPartitions(*order, *tie)
    local = cut(sortd.mapInArrow(_run_counts(run, keep), schema), "ranked")
    key = [F.col(f"k{j}") for j in range(len(run))]
    # one row per partition
    parts = local.groupBy("part").agg(
        F.sum(F.when(F.col("kind") == 1, 0).otherwise(1)).alias("t0"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("t1"),
        F.min(F.struct((F.col("l0") + F.col("l1")).alias("l"), *key)).alias("first"), F.max(F.struct((F.col("l0") + F.col("l1")).alias("l"), "l0", "l1", *key)).alias("last"),
    ).orderBy("part").collect()
    offsets, at, open_key, open_start = [], (0, 0), None, (0, 0)
    for p in parts:
        first, last = tuple(p["first"])[1:], tuple(p["last"])[3:]
        head = open_start if first == open_key else at
        offsets.append((p["part"], *at, *head))
        open_start = head if p["last"]["l"] == 0 else (at[0] + p["last"]["l0"], at[1] + p["last"]["l1"])
        open_key = last
        at = (at[0] + p["t0"], at[1] + p["t1"])
    table = spark.createDataFrame(offsets, "part int, o0 long, o1 long, h0 long, h1 long")
    inside = (F.col("l0") + F.col("l1")) > 0  # else the partition's first run
    joined = local.join(F.broadcast(table), "part")  # one row per partition
    out = joined.select(*keep, F.when(inside, F.col("o0") + F.col("l0")).otherwise(F.col("h0")).alias("n0"), F.when(inside, F.col("o1") + F.col("l1")).otherwise(F.col("h1")).alias("n1"))
    out._cut_path = local._cut_path
    return out


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """z, i, rank of every suffix of strings (z, i, c, b), all longs, i from 0 without gaps, c above 0."""
    return _ranks(strings.withColumn("stop", F.lit(0)), depth)


def _ahead(*columns: str) -> list[Column]:
    """The columns one and two positions on (in this order, column by column), 0 beyond a stop or a gap."""
    along = Window.partitionBy("z").orderBy("i")
    one = (F.lead("i", 1).over(along) == F.col("i") + 1) & (F.col("stop") == 0)
    two = one & (F.lead("i", 2).over(along) == F.col("i") + 2) & (F.lead("stop", 1).over(along) == 0)
    return [F.when(ok, F.lead(c, n).over(along)).otherwise(0).alias(f"{c}{n}") for c in columns for n, ok in ((1, one), (2, two))]


def _ranks(strings: DataFrame, depth: int) -> DataFrame:
    """suffix_ranks of strings that end at gaps of i, too, and behind rows with a stop."""
    spark = strings.sparkSession
    level = cut(strings.select("z", "i", "c", "b", "stop", *_ahead("c", "b")).select("z", "i", "c", "stop", "c1", "c2", (F.col("b") + F.col("b1") + F.col("b2")).alias("b3")), "level")
    mod = F.col("i") % 3
    sample = level.filter(mod != 0).withColumn("kind", F.lit(0))
    names = ranked(sample, ["c", "c1", "c2"], ["c", "c1", "c2"], ["z", "i", "b3", "c2"], ["z", "i"])
    counted, names = names, names.withColumnRenamed("n0", "name")
    short = F.when((F.col("c2") != 0) & (F.col("b3") < depth), 1)  # neither at its string's end nor deep enough
    unclear = cut(names.groupBy("name").agg(F.count("*").alias("n"), F.count(short).alias("short")).select("name", "n", ((F.col("n") > 1) & (F.col("short") > 0)).alias("open")), "unclear")
    n, n_open = unclear.agg(F.sum("n"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0))).first()
    below = lambda rows: rows.select((F.col("z") * 2 + mod - 1).alias("z"), F.floor(F.col("i") / 3).alias("i"), (F.col("name") + 1).alias("c"), F.col("b3").alias("b"), F.when(F.col("c2") == 0, 1).otherwise(0).alias("stop"))
    above = lambda rows: rows.select(F.floor(F.col("z") / 2).alias("z"), (F.col("i") * 3 + F.col("z") % 2 + 1).alias("i"), "rank")
    deeper = None
    if not n_open:
        ranks = names.select("z", "i", (F.col("name") + 1).alias("r"))
    elif 2 * n_open > n:
        deeper = _ranks(below(names), depth)
        ranks = above(deeper).select("z", "i", (F.col("rank") + 1).alias("r"))
    else:
        # a clear name settles what stands before it: unclear ones go on with no more than the next one
        open_ = cut(names.join(small(unclear.filter("open").select("name")), "name", "left_semi"), "open")
        behind = names.join(open_.select("z", (F.col("i") + 3).alias("i")), ["z", "i"], "left_semi")
        deeper = _ranks(below(open_.select(*names.columns).unionByName(behind).distinct()), depth)
        within = ranked(open_.select("z", "i", "name").join(above(deeper), ["z", "i"]).withColumn("kind", F.lit(0)), ["name", "rank"], ["name", "rank"], ["z", "i", "name"], ["z", "i"])
        first = within.groupBy("name").agg(F.min("n0").alias("first"))
        settled = within.join(first, "name").select("z", "i", (F.col("name") + F.col("n0") - F.col("first") + 1).alias("r"))
        ranks = settled.unionByName(names.join(small(unclear.filter("open").select("name")), "name", "left_anti").select("z", "i", (F.col("name") + 1).alias("r")))
    # one exchange for the join and for what looks ahead
    none = F.lit(None).cast("long")
    both = level.select("z", "i", "c", "c1", "stop", none.alias("r")).unionByName(ranks.select("z", "i", none.alias("c"), none.alias("c1"), none.cast("int").alias("stop"), "r"))
    full = both.repartition(partitions(spark), "z").groupBy("z", "i").agg(F.max("c").alias("c"), F.max("c1").alias("c1"), F.max("stop").alias("stop"), F.coalesce(F.max("r"), F.lit(0)).alias("r"))
    full = cut(full.select("z", "i", "c", "c1", "r", *_ahead("r")), "full")
    for done in (level, counted, unclear, deeper):
        if done is not None:
            drop_cut(done)
    release(spark)
    a = ranked(full.filter(mod != 2).withColumn("kind", mod.cast("int")), ["c", "r1"], ["c", "r1"], ["z", "i"], ["z", "i"])
    b = ranked(full.filter(mod != 1).withColumn("kind", F.when(mod == 0, 0).otherwise(1)), ["c", "c1", "r2"], ["c", "c1", "r2"], ["z", "i"], ["z", "i"])
    # smaller suffixes by class: at 0 mod 3 all of A and B's sample; at 1 and 2 mod 3 the sample's rank and those at 0 mod 3
    share = (
        a.select("z", "i", F.when(mod == 0, F.col("n0") + F.col("n1")).otherwise(F.col("n0")).alias("s"))
        .unionByName(b.select("z", "i", F.when(mod == 0, F.col("n1")).otherwise(F.col("n0")).alias("s")))
        .unionByName(full.filter(mod != 0).select("z", "i", (F.col("r") - 1).alias("s")))
    )
    out = cut(share.groupBy("z", "i").agg(F.sum("s").alias("rank")), "ranks")
    for done in (full, a, b):
        drop_cut(done)
    release(spark)
    return out
