import hashlib
import re

import pytest

from pricebridge.llm import exact_dedup
from tests.llm.fixtures import SMALL, awkward_docs, clashing, docs_frame, rows_of

COLS = ("doc_id", "keep_id", "group_size", "text_sha256")


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    return sorted(([doc, min(groups[n])[3], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()] for doc, text in rows for n in [re.sub(r"[\x20\x09-\x0D]", "", text or "")]), key=repr)


def check(docs, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = exact_dedup.exact_dedup(docs, **how)
    assert rows_of(got, *COLS) == brute(rows)
    kept = got.filter("kept").groupBy("text_sha256").count()
    assert all(r["count"] == 1 for r in kept.collect()) and kept.count() == len({x[3] for x in brute(rows)})


@pytest.mark.parametrize("how", [{}, {"fan": 2, "nodes": 16}, {"fan": 3, "nodes": 2}])
def test_awkward_rows(spark, how):
    check(clashing(docs_frame(spark)), **how)


def test_generated_table(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(docs_frame(spark, [])).collect() == []


def test_keep_one_keeps_one_row_of_each_text(spark):
    docs = docs_frame(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    got = sorted(norm(r["text"]) for r in kept.collect())
    assert got == sorted({norm(r[1]) for r in awkward_docs()})


def test_same_id_with_several_texts(spark):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "other", "en", "s"), (2, "ab", "en", "s"), (2, "third", None, "s")]
    got = rows_of(exact_dedup.keep_one(docs_frame(spark, rows)), "doc_id", "text")
    assert got == [[1, "a b"], [1, "other"], [2, "third"]]
