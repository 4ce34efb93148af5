"""Toxicity by compression distance: windows of a text compressed with two zstandard dictionaries.

One dictionary is trained on ordinary text. The other begins with what is trained on toxic text and ends with the whole
ordinary one, so a window of ordinary text is as long under both, and only what toxic texts have of their own is
shorter under the second. A window is a word (long words are several windows) between a head and a tail that both
dictionaries hold: without them zstandard would leave so short a text as it is. A window counts if the second
dictionary leaves at most `cost` bytes for the word, in one of several classes by the bytes that it saves; the
threshold, and the weights of the classes, are calibrated on documents that did not train the dictionaries that they are measured with.

What trains: at most 2 * `most_docs` documents a label, of at most `most_bytes` bytes each, taken by a hash of
their ids. Toxic training text is toxic documents' words that stand after clearly more different words there than in
ordinary documents; that sets words strewn into texts apart from those that copies of one text share.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebridge.llm.common import limit_batches, numbered, tidy

MOST_DOCS, MOST_BYTES = 2000, 16384
#: Different words before a word that make it one of toxic text, at least, and how many times as many as in ordinary text.
LEAST_BEFORE, TIMES_MORE = 4, 12
TOXIC_BYTES, ORDINARY_BYTES = 2560, 3072
WINDOW = 48
PIECE = 1 << 20
REMEMBERED = 150_000
HEAD, TAIL = b" the primer of all windows, which both know ", b" and all that follows it, known to both "
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The windows of a text, a piece of it at a time."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.rfind(b" ", at + 1, at + PIECE) + 1 or at + PIECE
        some = text[at:end].split()
        if some and max(map(len, some)) > WINDOW:
            some = [w[i : i + WINDOW] for w in some for i in range(0, len(w), WINDOW)]
        yield some
        at = end


def held_out(doc_id) -> bool:
    """Whether a document's label is never learned from."""
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5 == 0


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=15, hash_log=15, search_log=5, min_match=3, target_length=24, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )


class Distance:
    """(gain, cost) of windows: bytes that the toxic dictionary saves, and bytes that it leaves for the word."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        both = ordinary + TAIL + HEAD
        self.ordinary, self.toxic = self._compressor(both), self._compressor(toxic + both)
        self.least = len(self.toxic.compress(HEAD + TAIL))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=_parameters())
        return zstandard.ZstdCompressor(compression_params=_parameters(), dict_data=d)

    def of(self, word: bytes) -> tuple[int, int]:
        window = HEAD + word + TAIL
        n = len(self.toxic.compress(window))
        return len(self.ordinary.compress(window)) - n, n - self.least


#: Classes of windows: at least so many bytes are saved. Thresholds that calibration tries: at most so many bytes are left.
GAINS, COSTS = (1, 2, 3, 4, 6), (3, 4, 5)


def gain_class(gain: int) -> int:
    """0 if nothing is saved, else which of GAINS is reached."""
    return sum(gain >= g for g in GAINS)


def features(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What weights apply to, from the windows of each class (a row a document) and of all: a constant, the windows that
    reach each class, and their share."""
    reach = np.cumsum(counts[:, ::-1], 1)[:, ::-1]
    return np.concatenate([np.ones((len(counts), 1)), np.log1p(reach), np.log1p(1000 * reach / np.maximum(n, 1)[:, None])], 1)


@dataclass(frozen=True)
class Model:
    """What a task needs to score: the dictionaries' contents, the threshold, and the weights of features()."""

    toxic: bytes
    ordinary: bytes
    cost: int
    weights: tuple[float, ...]

    def score(self, counts: list[int], n: int) -> float:
        x = features(np.array([counts], np.float64), np.array([n], np.float64))[0]
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -40, 40))))


class Scorer:
    """A model with the windows that it has met."""

    def __init__(self, model: Model):
        self.model, self.distance, self.known = model, Distance(model.toxic, model.ordinary), {}

    def score(self, text: bytes) -> float:
        counts, n = [0] * len(GAINS), 0
        for some in words(text):
            known = self.known
            for w in set(some).difference(known):
                gain, cost = self.distance.of(w)
                known[w] = gain_class(gain) if cost <= self.model.cost else 0
            for k in filter(None, map(known.__getitem__, some)):
                counts[k - 1] += 1
            n += len(some)
            if len(known) > REMEMBERED:
                known.clear()
        return self.model.score(counts, n)


def _before(texts: Iterable[bytes]) -> dict[bytes, int]:
    """How many different words stand before each word."""
    seen = defaultdict(set)
    for t in texts:
        last = b""
        for some in words(t):
            for w in some:
                seen[w].add(last)
                last = w
    return {w: len(s) for w, s in seen.items()}


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; where there is too little for that, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def _contents(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes] | None:
    """The toxic and the ordinary dictionary of (text, label) pairs; none if toxic texts have no words of their own."""
    toxic, plain = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not plain:
        return None
    here, there = _before(toxic), _before(plain)
    own = {w for w, n in here.items() if n >= LEAST_BEFORE and n / len(toxic) >= TIMES_MORE * (there.get(w, 0) + 1) / len(plain)}
    line = lambda t, test: b" " + b" ".join(w for w in dict.fromkeys(x for some in words(t) for x in some) if test(w)) + b" "
    picked = [p for p in (line(t, own.__contains__) for t in toxic) if len(p) > 2]
    if not picked:
        return None
    return _dictionary(TOXIC_BYTES, picked), _dictionary(ORDINARY_BYTES, [b" " + b" ".join(x for some in words(t) for x in some) + b" " for t in plain])


def _counts(contents: tuple[bytes, bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of each text, and by threshold and class those that count."""
    distance, known = Distance(*contents), {}
    table, sizes = np.zeros((len(texts), len(COSTS), len(GAINS))), np.zeros(len(texts))
    for row, t in enumerate(texts):
        for some in words(t):
            for w in set(some).difference(known):
                gain, cost = distance.of(w)
                known[w] = (gain_class(gain), sum(cost > c for c in COSTS))
            for k, c in (known[w] for w in some):
                if k:
                    table[row, c:, k - 1] += 1
            sizes[row] += len(some)
    return sizes, table


def fit(one: list[tuple[bytes, int]], other: list[tuple[bytes, int]]) -> Model:
    """A model from two lots of (text, label) pairs: each lot is measured with the other's dictionaries, which calibrates
    the thresholds and weights; the model's own dictionaries are trained on both. Without both labels, or words of their
    own in toxic texts, it knows only how frequent label 1 is."""
    both = one + other
    share = sum(y for _, y in both) / max(1, len(both))
    flat = (float(np.log((share + 1e-3) / (1 - share + 1e-3))), *[0.0] * (2 * len(GAINS)))
    prior = Model(b"", b"", 0, flat)
    lots = [(_contents(a), b) for a, b in ((one, other), (other, one))]
    lots = [(c, rows) for c, rows in lots if c is not None and rows]
    whole = _contents(both)
    y = np.array([label for _, rows in lots for _, label in rows])
    if whole is None or len(set(y.tolist())) < 2:
        return prior
    measured = [_counts(c, [t for t, _ in rows]) for c, rows in lots]
    sizes, table = (np.concatenate(x) for x in zip(*measured, strict=True))
    tried = [(*_logistic(features(table[:, i], sizes), y), cost) for i, cost in enumerate(COSTS)]
    weights, _, cost = min(tried, key=lambda x: x[1])
    return Model(*whole, cost, tuple(float(v) for v in weights))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and loss of a ridge logistic regression, by Newton steps that are halved until they help."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.array([0.0] + [1.0] * (x.shape[1] - 1))
    loss = lambda v: float(np.logaddexp(0, x @ v).sum() - y @ (x @ v) + 0.5 * (penalty * v * v).sum())
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        new = loss(w - size * step)
        if now - new < 1e-7:
            break
        w, now = w - size * step, new
    return w, now


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> Model:
    """Learn from labelled documents, but never from those that are held out.

    The sample, at most 4 * most_docs documents of at most most_bytes bytes, is all that comes to the driver. Ids that
    bear several labels count as toxic if one says so; null ids, labels and texts teach nothing.
    """
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    own = own.filter(F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0).withColumn("__h", F.xxhash64("__id", F.lit(3)))
    take = lambda y: own.filter(F.col("__y") == y).orderBy("__h", "__id").limit(2 * most_docs)
    sample = F.broadcast(take(1).unionByName(take(0)))  # 4 * most_docs rows at most
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("__doc"), text.alias("__text")).filter(text.isNotNull() & (F.octet_length(text) <= most_bytes)).join(sample, F.col("__doc") == F.col("__id"))
    rows = rows.groupBy("__id", "__y", "__h").agg(F.min("__text").alias("__text"))
    found = sorted((r["__h"], r["__id"], r["__y"], r["__text"].encode("utf-8", "surrogatepass")) for r in rows.collect())
    lots = [], []
    for h, _, y, t in found:
        lots[h % 2].append((t, y))
    return fit(*lots)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of their texts, 0 to 1; null texts are empty texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for s in parts:
            yield pd.Series([scorer.score(t.encode("utf-8", "surrogatepass") if t is not None else b"") for t in s], dtype="float64")
        del scorer
        tidy()

    limit_batches(docs.sparkSession)
    return docs.withColumn(name, F.pandas_udf("double")(run)(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    held_out: crc32 of the id as text is divisible by 5 (a null id counts as the empty text). Every whole text is scored,
    empty and null ones too; equal texts score alike. An empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, **how)
    rows = scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever these are called.

    Null and empty texts, ties and repeated rows are scored like any others, equal texts alike; an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col, **how)
    docs, (text_col,), restored = numbered(docs, text_col)
    return restored(scored(docs, model, text_col, "score").filter("score < 0.5"))
