"""Small tables with the awkward rows that every operator has to stand."""

import random

SMALL = "/root/testdata/sf0.001"

WORDS = "the of and to in nd er on an th tion ing clown re at en es or ti st ar te All rights reserved CC BY".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "", ",", ".", "\n"])) for _ in range(n))


def awkward_docs(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source): nulls in every column, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    long = prose(rng, 6000)
    shared = prose(rng, 120)
    rows = [(i, t, "en", f"src{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[3], "en", "src0") for i in range(25)]
    rows += [(200, texts[5].replace(" ", "  "), "en", "src1"), (201, texts[5] + "\n", None, None), (202, long, "en", "src1"), (203, long[100:9000] + " x", "en", None)]
    rows += [(210 + i, prose(rng, 20) + shared + prose(rng, 20), "en", "src2") for i in range(6)]
    rows += [(220, "sting " * 300, "en", "src2"), (221, "a" * 1500, "en", "src3"), (222, "abé中\U0001f600 " * 120, "en", "src3")]
    rows += [(230, None, None, None), (231, "", "en", "src0"), (232, " \n\t ", "en", "src0"), (None, "no id here", "en", "src1"), (233, "  ", "en", "é")]
    rows += [rows[0], rows[0], (235, texts[0], "en", "src0"), (236, "All rights  reserved. all RIGHTS reserved", "en", "src0"), (237, "cc-by cc by", "en", "src0")]
    return rows


DOCS_SCHEMA = "doc_id long, text string, lang string, source string"


def docs_frame(spark, rows=None):
    return spark.createDataFrame(awkward_docs() if rows is None else rows, DOCS_SCHEMA).repartition(3)


def clashing(docs):
    """docs with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    out = docs
    for c in ("size", "n", "sha", "pos", "kept", "score", "z", "i", "c", "b", "fp", "label", "value", "rank", "shard", "slot", "core", "at", "u", "v", "id", "target", "ids", "__score", "__size", "__s", "__sha", "__n", "__gone", "__id", "__copies", "c0", "c1", "SIZE_"):
        out = out.withColumn(c, F.lit("clash"))
    return out


def rows_of(df, *cols):
    cols = cols or df.columns
    return sorted(([r[c] for c in cols] for r in df.select(*cols).collect()), key=repr)
