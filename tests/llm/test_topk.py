import math
import random

import numpy as np
from pyspark.sql import functions as F

from pricebridge.llm import topk
from tests.llm.fixtures import SMALL, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    f32 = lambda x: float(np.float32(x))
    good = [(i, [math.floor(256 * f32(x)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(f32(x)) for x in v)]
    out, asked = [], {}
    for i, v in good:
        if i is not None and i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0, i) for i, w in good if i != q)
        out += [[q, r + 1, s[3], -s[0]] for r, s in enumerate(scores[:k])]
    return sorted(out, key=repr)


def check(spark, rows, **how):
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, **how)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows)


def awkward():
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(120)]
    rows += [(200 + i, rows[50][1], 1) for i in range(9)] + [(300, None, 0), (301, [1.0, None] + [0.0] * 6, 0), (302, [float("nan")] * 8, 0), (303, [float("inf")] * 8, 0), (350, [0.5, 0.5], 0), (304, [], 0), (400, [0.0] * 8, None), (None, rows[50][1], 0)]
    return rows + [rows[50], (305, [30000.0] * 8, 0), (450, [-30000.0] * 8, 0)]


def test_awkward_rows(spark):
    check(spark, awkward())


def test_small_packs_and_ranges(spark):
    check(spark, awkward(), pack=2, range_rows=16)


def test_fewer_candidates_than_k(spark):
    check(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)])


def test_empty_tables(spark):
    for rows in ([], [(1, [1.0], 0)], [(50, None, 0)]):
        check(spark, rows)


def test_generated_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute([(r["vec_id"], r["embedding"], 0) for r in df.collect()])


def test_blocks_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (16, 16))
    m = np.repeat(centres, 128, 0) + rng.integers(-5, 5, (2048, 16))
    ids, q = np.arange(2048), m[::500]
    best = topk._Best(len(q), 5)
    scored = topk.score_range(best, np.arange(2048)[::500], q, ids, m)
    assert scored < 0.7 * len(q) * 32
    for x, row in enumerate(q):
        s = m @ row
        s[x * 500] = -(1 << 60)
        assert best.id[x].tolist() == np.lexsort((ids, -s))[:5].tolist()
