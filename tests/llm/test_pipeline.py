import public_tokenizers
from tokenizers import Tokenizer as Known

import corpus_pipeline
from pricebridge.llm import exact_dedup, mixing, simhash, toxicity
from tests.llm.fixtures import SMALL, rows_of
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_similar import brute as brute_near


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    rows = {i: t for i, t in rows.items() if scorer.score((t or "").encode()) < 0.5}
    rows = {i: t for i, t in rows.items() if i in {x[1] for x in brute_exact(list(rows.items()))}}
    rows = {i: t for i, t in rows.items() if i in {x[1] for x in brute_near(list(rows.items()))}}
    held = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        held = stage(spark, held, SMALL)
        assert held.columns == docs.columns
    assert sorted(r["doc_id"] for r in held.collect()) == sorted(rows)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.taken(held).collect() if r["size"]}
    known = Known.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted([i, known.encode(rows[i], add_special_tokens=False).ids] for i, n in taken.items() for _ in range(n))
    assert [[i, ids] for i, ids in rows_of(corpus_pipeline.run(spark, SMALL), "doc_id", "ids") if ids] == sorted(want, key=repr)


def test_shape():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5 and corpus_pipeline.ORACLE_SQL is None
    assert exact_dedup and simhash


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    """Every filtering stage and the mix keep the columns of documents, whatever else stands there, and stand empty tables."""
    from tests.llm.fixtures import clashing, docs_frame

    labels = spark.createDataFrame([(i, i % 5 == 0 and 1 or 0) for i in range(40)], "doc_id long, toxic int")
    docs = clashing(docs_frame(spark))
    for stage in (lambda d: toxicity.without_toxic(d, labels), exact_dedup.keep_one, simhash.keep_one_similar, simhash.keep_one, mixing.emitted):
        out = stage(docs)
        assert out.columns == docs.columns and {r["__size"] for r in out.select("__size").collect()} <= {"clash"}
        assert stage(docs.limit(0)).collect() == []


def test_mix_by_unique_ids_is_the_mix(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = [[r["doc_id"]] * (r["taken"] // r["size"]) for r in mixing.taken(docs).collect() if r["size"]]
    got = [r["doc_id"] for r in mixing.emitted(docs).filter("length(trim(text)) > 0").collect()]
    assert sorted(got) == sorted(i for x in want for i in x)
