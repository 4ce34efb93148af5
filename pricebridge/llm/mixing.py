"""Mixing sources to target weights by systematic sampling.

Each document expects target/size-of-source copies. Within a source the expectations are summed up in a fixed order,
one offset per source is added, and a document is emitted once for every integer that its stretch crosses. The order
goes by size class, so that the words taken come near the target and not only the documents.

Sums are exact: expectations are integers of 1/UNIT copy. The order is cut into blocks (source, size class, hash) whose
totals are summed first, so that a source with a third of all rows is many small windows and not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebridge.llm.common import cut, numbered, small

UNIT_BITS = 24
UNIT = 1 << UNIT_BITS


def n_words(text: str) -> Column:
    """Runs of [^\\x20\\x09-\\x0D]; null has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], ratio: float, cap: float) -> DataFrame:
    """Targets from (source, source_size): one row per source, so the windows here see sources, never documents.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating, and share ratio times all sizes.
    A target stops at cap times its source's size; the excess goes to the others by weight until none is above.
    That is min(cap * size, level * weight): sources fill up in the order of cap * size / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("i"), F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("w"), "i")
    full = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(ratio)) - full) / left)
    # the first source, in the order of filling, that its level does not fill
    first = F.min(F.when(F.col("most") / F.col("w") >= F.col("level"), F.struct((F.col("most") / F.col("w")).alias("r"), F.col("i").alias("i"), F.col("level").alias("level")))).over(whole)
    target = F.when(first.isNull(), F.col("most")).otherwise(F.least(F.col("most"), first["level"] * F.col("w")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def mix(rows: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, seed: int = 7, block_rows: int = 1 << 16) -> DataFrame:
    """rows with __size, __source_size, __target, __copies; all their own columns stay.

    Rows of size 0 may be emitted too and take no words. A null source is a source. Rows that are equal in id and size
    are interchangeable, so reruns agree. An empty table gives no rows. rows have no columns that begin with __.
    """
    rows = rows.withColumn("__size", size)
    keys = rows.select(F.col(source_col).alias("source"), F.col("__size").alias("size"), F.col(id_col).alias("id"))
    total = keys.agg(F.count("*").alias("n")).first()["n"]
    pieces = max(8, -(-total // block_rows))
    cls = lambda s: F.floor(F.log2(s + 1) * 4).cast("int")
    piece = lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(pieces)).cast("int")
    blocks = keys.groupBy("source", cls(F.col("size")).alias("c"), piece(F.col("id")).alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sources = source_targets(blocks.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ratio, cap)
    b, s = blocks.alias("b"), sources.alias("s")
    each = F.when(F.col("s.source_size") > 0, F.round(F.col("s.target") / F.col("s.source_size") * UNIT)).otherwise(0).cast("long")
    joined = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "c", "p", "n", "s.source_size", "s.target", each.alias("each"))
    before = Window.partitionBy("source").orderBy("c", "p").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(UNIT))
    starts = joined.select(
        F.col("source").alias("__s"), F.col("c").alias("__c"), F.col("p").alias("__p"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("each").alias("__each"), (offset + F.coalesce(F.sum(F.col("n") * F.col("each")).over(before), F.lit(0))).alias("__start"),
    )
    keyed = rows.withColumns({"__cls": cls(F.col("__size")), "__piece": piece(F.col(id_col))})
    match = F.col(source_col).eqNullSafe(F.col("__s")) & (F.col("__cls") == F.col("__c")) & (F.col("__piece") == F.col("__p"))
    keyed = keyed.join(starts, match, "left")
    inside = Window.partitionBy(source_col, "__cls", "__piece").orderBy(F.col(id_col).asc_nulls_last(), "__size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__start") + F.sum("__each").over(inside)
    crossed = F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("__each"), UNIT_BITS)
    return keyed.withColumn("__copies", crossed).drop("__s", "__c", "__p", "__each", "__start", "__cls", "__piece")


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents."""
    rows = cut(docs.select("doc_id", "source", n_words("text").alias("n")), "sizes")  # the texts are read once
    out = mix(rows, F.col("n"), **how)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def emitted(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: every row of documents as often as it is taken, with its own columns, whatever these are called.

    Nulls, empty texts, repeated rows and empty tables are as in mix(). Copies are counted on ids, sources and sizes
    alone. Where ids are unique they are joined back by these, so that texts move once at most; else they are counted on whole rows.
    """
    docs, (id_, source, text), restored = numbered(docs, id_col, source_col, text_col)
    rows = cut(docs.select(id_, source, n_words(text).alias("n")), "sizes")
    n, different = rows.agg(F.count("*"), F.count_distinct(id_)).first()
    own = {"source_col": source, "id_col": id_} | how
    if n == different:
        copies = cut(mix(rows, F.col("n"), **own).filter("__copies > 0").select(F.col(id_).alias("__id"), "__copies"), "copies")
        out = docs.join(small(copies), F.col(id_) == F.col("__id"))
    else:
        out = mix(docs, n_words(text), **own).filter("__copies > 0")
    return restored(out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))))
