"""Byte-level BPE encoding and decoding with a public tokenizer's file.

A word's parts are contiguous: an array of part boundaries and an array with the merge rank of every adjacent pair.
The least rank is searched by scanning, its boundary is deleted, and the two ranks beside it are looked up anew. That
is quadratic in a word's length and the fastest way for short words; words of more than LONG bytes, such as a line
without spaces, go through a heap with the same result.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebridge.llm.common import limit_batches, texts, tidied

#: Words of more bytes are merged with a heap.
LONG = 128
#: New words after which a task forgets those that it has not met since as many new words before.
REMEMBERED = 240_000
#: How byte-level tokenizers of this kind cut text into words (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such files: printable bytes are themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Tokenizer:
    """Vocabulary, merges and special strings of a tokenizer file; raises ValueError for settings it doesn't know."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, pre = told["model"], told["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or told["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE file {odd}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"]):
            raise ValueError(f"{path}: special strings with unknown settings")
        of = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(of[c] for c in s)
        self.id_of = {raw(s): i for s, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank_of = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORDS)
        found = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, found))) if found else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """The parts of a word."""
        if len(word) > LONG:
            return self._merge_long(word)
        rank_of, bounds = self.rank_of, list(range(len(word) + 1))
        ranks = [rank_of.get((word[i : i + 1], word[i + 1 : i + 2]), NEVER) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            start, end = bounds[i], bounds[i + 1]
            if i < len(ranks):
                ranks[i] = rank_of.get((word[start:end], word[end : bounds[i + 2]]), NEVER)
            if i:
                ranks[i - 1] = rank_of.get((word[bounds[i - 1] : start], word[start:end]), NEVER)
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merge_long(self, word: bytes) -> list[bytes]:
        n, rank_of = len(word), self.rank_of
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, word[i : i + 1], word[i + 1 : i + 2]) for i in range(n - 1) if (r := rank_of.get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has been merged meanwhile
            part[i], part[j], after[i] = a + b, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank_of.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p is not None]

    def _ids(self, word: str) -> bytes:
        """Ids of a word as 32-bit numbers."""
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", [self.id_of[p] for p in self.merge(word.encode("utf-8", "surrogatepass"))]).tobytes()
        if len(word) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.older = dict(self.known)
                self.known.clear()
            self.known[word] = ids
        return ids

    def _encode_plain(self, text: str, out: list[bytes]) -> None:
        known, words = self.known, (m.group() for m in self.words.finditer(text)) if len(text) > 1_000_000 else iter(self.words.findall(text))
        while some := list(islice(words, 65536)):
            out.append(b"".join([known.get(w) or self._ids(w) for w in some]))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special strings in it become their own ids."""
        out: list[bytes] = []
        at = 0
        if self.specials:
            for m in self.specials.finditer(text):
                self._encode_plain(text[at : m.start()], out)
                out.append(np.int32(self.special[m.group()]).tobytes())
                at = m.end()
        self._encode_plain(text[at:] if at else text, out)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD, ids that don't exist are skipped."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _in_pieces(batch: pa.RecordBatch, weights: list[int], most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose weights add up to about `most`."""
    at, total = 0, 0
    for i, w in enumerate(weights):
        total += w
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows


def _encoded(t: Tokenizer, raw: list[bytes]) -> tuple[list[np.ndarray], pa.ListArray]:
    ids = [t.encode(x.decode("utf-8", "replace")) for x in raw]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    return ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs.

    Whole texts, special strings in a text as their own ids, none added. A null text is empty and gives no ids; repeated
    rows and null ids are rows like others; an empty table gives none; other columns are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in it:
            raw = texts(batch, "text")
            for a, b in _in_pieces(batch, [len(x) for x in raw]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _encoded(t, raw[a:b])[1]], names=["doc_id", "ids"])

    limit_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and text, what the ids decode to, of every row of docs: decode(encode(docs)) in one worker a task, so
    that its remembered words are held once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in it:
            raw = texts(batch, "text")
            for a, b in _in_pieces(batch, [len(x) for x in raw], 4 << 20):
                ids, column = _encoded(t, raw[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column, pa.array([t.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "text"])

    limit_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, ids array<int>, text string")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of rows with doc_id and ids. Null ids give a null text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in it:
            col = batch.column(1)
            sizes = [0 if v is None else v for v in col.value_lengths().to_pylist()]
            for a, b in _in_pieces(batch, [4 * n for n in sizes]):
                out = [None if not v.is_valid else t.decode(v.values.to_numpy(zero_copy_only=False)) for v in col.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), col.slice(a, b - a), pa.array(out, pa.string())], names=["doc_id", "ids", "text"])

    limit_batches(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(tidied(run), "doc_id long, ids array<int>, text string")
