import random
import zlib

import pytest
from pyspark.sql import functions as F

from pricebridge.llm import toxicity
from tests.llm.fixtures import clashing, docs_frame, rows_of

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar".split()
BAD = ["worthless", "pathetic", "moron", "clown", "disgusting", "loweischaft"]


def corpus(n, seed=1):
    """(doc_id, text, label): words of syllables, with bad words strewn into a tenth."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(40, 250))]
        bad = int(rng.random() < 0.2)
        for _ in range(bad * rng.randint(2, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), bad))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(900)
    docs = docs_frame(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.classify(clashing(docs), labels)
    held = {r["doc_id"]: r for r in got.collect() if r["held_out"]}
    assert set(held) == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: y for i, _, y in rows}
    assert sum(r["predicted"] == truth[i] for i, r in held.items()) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in held.values())


def test_held_out_labels_are_never_read(spark):
    rows = corpus(200)
    docs = docs_frame(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lies = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, lies)


def test_awkward_rows(spark):
    docs = docs_frame(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (230, 1), (9999, 0), (3, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.classify(clashing(docs), labels)
    assert rows_of(got, "doc_id") == rows_of(docs, "doc_id")
    assert all(0 <= r["score"] <= 1 for r in got.collect())


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_too_few_labels(spark, labels):
    got = toxicity.classify(docs_frame(spark), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len({r["score"] for r in got.collect()}) == 1


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(docs_frame(spark, []), none).collect() == []


def test_long_texts_are_scored_whole(monkeypatch):
    rows = corpus(400, 2)
    model = toxicity.fit([(t.encode(), y) for _, t, y in rows[::2]], [(t.encode(), y) for _, t, y in rows[1::2]])
    text = (" ".join(t for _, t, y in rows if not y) + " moron pathetic " + "x" * 500).encode()
    whole = toxicity.Scorer(model).score(text)
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert toxicity.Scorer(model).score(text) == pytest.approx(whole, abs=1e-3)
    assert toxicity.Scorer(model).score(b"") < 0.5
