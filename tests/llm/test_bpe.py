import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Known

from pricebridge.llm import bpe
from tests.llm.fixtures import SMALL, awkward_docs, clashing, docs_frame, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  x", "x  ", "don't I'll we've 'S", "a" * 700, "Zz" * 400, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "  \x85\x1c\x1d x\r\n\n y", "\x00\x01\x7f", "١٢ 中文 \U0001f600‍� é", "=" * 300 + "-" * 129]


@pytest.fixture(scope="module")
def known():
    t = Known.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_same_ids_as_the_library(known):
    ours = bpe.Tokenizer(PATH)
    rng = random.Random(5)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x3000, 0x9FFF), 32, 10])) for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    for text in [*ODD, *noise, *(r[1] or "" for r in awkward_docs())]:
        want = known.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == want
        assert ours.decode(ours.encode(text)) == known.decode(want, skip_special_tokens=False)


def test_every_character_is_cut_as_the_library_cuts_it(known):
    ours = bpe.Tokenizer(PATH)
    for start in range(0, sys.maxunicode + 1, 4096):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b" for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)
        assert ours.encode(text).tolist() == known.encode(text, add_special_tokens=False).ids, hex(start)


def test_long_words_merge_alike():
    t = bpe.Tokenizer(PATH)
    rng = random.Random(6)
    for _ in range(200):
        word = bytes(rng.choice(b"thereoin-=AB") for _ in range(rng.randrange(2, 120)))
        assert t.merge(word) == t._merge_long(word)


def test_rows(spark, known):
    docs = clashing(docs_frame(spark))
    got = rows_of(bpe.decode(bpe.encode(docs, PATH), PATH), "doc_id", "ids", "text")
    want = [[r[0], known.encode(r[1] or "", add_special_tokens=False).ids, r[1] or ""] for r in awkward_docs()]
    assert got == sorted(want, key=repr)


def test_query(spark, known):
    from pricebridge.llm.queries import op7_bpe

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = known.encode(r["text"] or "", add_special_tokens=False).ids
        want.append([r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(known.decode(ids, skip_special_tokens=False))])
    assert rows_of(op7_bpe(spark, SMALL)) == sorted(want, key=repr)


def test_null_ids_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert rows_of(bpe.decode(rows, PATH)) == [[1, None, None], [2, [], ""]]
    assert bpe.encode(docs_frame(spark, []), PATH).collect() == []


def test_round_trip_is_encoding_and_decoding(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs_frame(spark)
    want = bpe.decode(bpe.encode(docs, path), path)
    assert rows_of(bpe.round_trip(docs, path), "doc_id", "ids", "text") == rows_of(want, "doc_id", "ids", "text")
    assert bpe.round_trip(docs.limit(0), path).collect() == []
