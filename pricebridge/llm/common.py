"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIRS: dict[str, str] = {}

#: A DataFrame is broadcast only after its bytes have been summed up and are at most this many.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="pricebridge-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor need what it came from."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows and bytes of a batch that goes to a Python worker, at most. With Spark's own 10,000 rows a worker would hold tens
#: of MB of text several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def limit_batches(spark: SparkSession) -> None:
    """Small batches for Python workers; a session that has smaller ones keeps them."""
    for key, most in BATCH.items():
        told = re.match(r"(-?\d+)b?$", spark.conf.get(key))
        if not told or not 0 < int(told[1]) <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _width(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes in a broadcast."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
        inner = kind.elementType
        return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)) * (8 * (len(inner.fields) + 2) if isinstance(inner, T.StructType) else 8) + 16
    return F.lit(8) if isinstance(kind, T.NumericType | T.BooleanType) else F.octet_length(F.to_json(F.struct(value.alias("x")))) + 16


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take no more than `most` bytes. df should be cheap to read twice."""
    size = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16))
    taken = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if taken <= most else df


def numbered(df: DataFrame, *wanted: str) -> tuple:
    """(df with its columns named c0, c1, ..., the new names of `wanted`, what gives df's own names back to those columns).

    So an operator's columns meet none of df's, whatever these are called.
    """
    names = df.columns
    new = [f"c{i}" for i in range(len(names))]
    lower = [n.lower() for n in names]
    found = [new[names.index(w) if w in names else lower.index(w.lower())] for w in wanted]
    return df.toDF(*new), found, lambda out: out.select(*new).toDF(*names)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty. No text is decoded or checked."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b or b"" for b in col.view(kind).to_pylist()]


def tidy() -> None:
    """Give a Python worker's free memory back to the system; workers live on, and the next tasks in them need other things."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def tidied(run):
    """run, a function on a task's batches, and tidy() behind it."""

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        tidy()

    return whole


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, most_bytes: int = 16 << 20, weigh=None) -> Iterator[pa.RecordBatch]:
    """Record batches of rows: at most size rows each, and closed early once weigh(row) adds up to most_bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= size or weight >= most_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def slices(n: int, most: int) -> int:
    """How many pieces of at most `most` rows n rows need."""
    return max(1, math.ceil(n / most))
