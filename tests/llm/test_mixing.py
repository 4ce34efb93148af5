from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricebridge.llm import mixing
from tests.llm.fixtures import SMALL, awkward_docs, clashing, docs_frame, rows_of


def targets(sizes, weights=(3, 1, 2), ratio=1.5, cap=2.0):
    """Excess above the caps handed round by weight until none is left."""
    order = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    full, left = {}, ratio * sum(sizes.values())
    while True:
        open_ = [k for k in order if k not in full]
        total = sum(w[k] for k in open_)
        over = [k for k in open_ if left * w[k] / total > cap * sizes[k]] if open_ else []
        if not over:
            return full | {k: left * w[k] / total for k in open_}
        for k in over:
            full[k] = cap * sizes[k]
        left = ratio * sum(sizes.values()) - sum(full.values())


def n_words(t):
    return len((t or "").encode().split())


def check(docs, rows):
    got = mixing.taken(docs)
    by = defaultdict(int)
    for _, t, source in rows:
        by[source] += n_words(t)
    want = targets(by)
    docs_of = {r["doc_id"]: r for r in docs.select("doc_id", "source").collect()}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got.collect():
        source = docs_of[r["doc_id"]]["source"]
        assert r["source_size"] == by[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for source in by:
        assert abs(taken[source] - want[source]) <= 2 * largest[source] + 1
    assert sorted(r[1] for r in rows_of(got, "doc_id", "size")) == sorted(n_words(t) for _, t, _ in rows)
    assert rows_of(mixing.taken(docs)) == rows_of(got)


def test_awkward_rows(spark):
    check(clashing(docs_frame(spark)), [(r[0], r[1], r[3]) for r in awkward_docs()])


def test_generated_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_taken_words_come_near_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 97 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'hot' when id % 5 = 0 then 'b' else 'c' end").alias("source"))
    rows = mixing.taken(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] / r["w"] - 1) < 0.01 for r in rows)


def test_emitted_rows_are_those_taken(spark):
    docs = docs_frame(spark)
    taken = sum(r["taken"] for r in mixing.taken(docs).collect())
    out = mixing.emitted(docs)
    assert out.columns == docs.columns and sum(n_words(r["text"]) for r in out.collect()) == taken


def test_empty_table(spark):
    assert mixing.taken(docs_frame(spark, [])).collect() == []
