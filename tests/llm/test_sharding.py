import zlib

from pricebridge.llm import sharding
from pricebridge.llm.common import new_path
from tests.llm.fixtures import SMALL, awkward_docs, clashing, docs_frame, rows_of


def check(spark, docs, rows):
    got = sharding.shard(docs, 8, new_path(spark, "map"))
    want = sorted(([doc, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())] for doc, t in rows), key=repr)
    assert rows_of(got, "doc_id", "size", "text_crc32") == want
    slots = {}
    for r in got.collect():
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_awkward_rows(spark):
    check(spark, clashing(docs_frame(spark)), [r[:2] for r in awkward_docs()])


def test_generated_table_is_balanced(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = check(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    sizes = [r["s"] for r in got.groupBy("shard").agg({"size": "sum"}).toDF("shard", "s").collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.25 * sum(sizes) / 8  # no row is split, and one is a tenth of a shard


def test_empty_table(spark):
    assert sharding.shard(docs_frame(spark, []), 8, new_path(spark, "map")).collect() == []


def test_map_edits():
    sizes = [(i * 7919) % 1000 + 1 for i in range(512)]
    first = sharding.SlotMap.first(sizes, 8)
    assert max(first.totals(sizes)) <= 1.01 * sum(sizes) / 8
    grown = first.grown(sizes)
    assert grown.version == 2 and grown.shards == 9
    moved = [i for i in range(512) if grown.shard_of[i] != first.shard_of[i]]
    assert moved == list(grown.moved) and {grown.shard_of[i] for i in moved} == {8}
    assert max(grown.totals(sizes)) <= 1.05 * sum(sizes) / 9
    drifted = [s * (3 if first.shard_of[i] == 0 else 1) for i, s in enumerate(sizes)]
    again = first.rebalanced(drifted)
    assert max(again.totals(drifted)) <= 1.02 * sum(drifted) / 8 and 0 < len(again.moved) < 100


def test_versions_are_stored_and_edited(spark):
    path = new_path(spark, "map")
    docs = docs_frame(spark)
    one = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard(docs, 4, path).collect()}
    same = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard(docs, 4, path).collect()}
    assert same == one
    more = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard(docs, 5, path).collect()}
    stored = sharding.SlotMap.load(spark, path)
    assert stored.shards == 5 and stored.version >= 2 and sharding.SlotMap.load(spark, path, 1).shards == 4
    assert set(more.values()) <= set(range(5))
