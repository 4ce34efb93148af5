"""Removal of byte strings of a given length (400) that occur more than once, with a distributed suffix array.

1. Texts that are equal count once from here on; each knows its copies.
2. The suffixes that are sorted begin at anchors: the anchor of a window of m bytes is the least of the k-gram hashes at
   its first head = (m - 15) / 2 positions, so it depends on the window alone, and each anchor has a run of windows. Anchors whose first
   m - head + 1 bytes (the core, which all its windows hold) occur once in all texts have no window that repeats; they and
   texts without others are left out, exactly.
3. An anchor's next one depends on the first `ahead` = head + 16 bytes from it alone. So texts that agree in these are cut alike into
   chunks from anchor + ahead on, and the order of their chunk strings is that of their bytes. Chunks are named in the
   order of their bytes, and the difference-cover algorithm sorts all suffixes of the strings of names.
4. The remaining suffixes, those at the bytes between anchors, are merged into that order: a suffix d bytes before its
   anchor follows its d bytes first and the anchor's rank then. So of the anchors with one core, in the order of ranks,
   the common prefix of two is the least of those of the neighbours between them, and only neighbours' bytes are compared.
   The window d bytes before an anchor repeats if another anchor has the same d bytes before it and a common prefix of at
   least m - d bytes.

Common prefixes and what stands before anchors are compared as bytes, cores as 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebridge.llm.common import batches, cut, drop_cut, limit_batches, partitions, release, small, texts
from pricebridge.llm.licenses import _BYTE, _powers  # byte weights and powers of the rolling hash
from pricebridge.llm.suffix_array import ranked, suffix_ranks

#: Longer texts are cut into pieces of so many bytes for the vector operations; pieces overlap, so results don't change.
PIECE = 1 << 20
#: Anchors with one core that a task compares at most; the windows of those with more are counted one by one.
MOST = 50_000
#: Different surroundings of a core up to which pairs are compared; above, they are sorted from both ends.
FEW = 32


@dataclass(frozen=True)
class Shape:
    """All lengths that follow from the window's."""

    m: int = 400

    def __post_init__(self):
        if self.m < 32:
            raise ValueError("windows have at least 32 bytes")

    @property
    def k(self) -> int:  # bytes of a k-gram
        return max(2, min(16, self.m // 25))

    @property
    def head(self) -> int:  # positions of a window among which its anchor is
        return (self.m + 1 - self.k) // 2

    @property
    def core(self) -> int:  # bytes from an anchor on that all its windows hold
        return self.m - self.head + 1

    @property
    def ahead(self) -> int:  # bytes from an anchor on that decide which the next one is
        return self.head + self.k


def _hashes(text: bytes, k: int) -> np.ndarray:
    """32-bit hashes of the k-grams at all positions, k at most 16: of their first and of their last 8 bytes."""
    n = len(text) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    size = min(k, 8)
    if size == 8:
        word = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))  # 8 bytes from each position on
    else:
        buf, word = np.frombuffer(text, np.uint8), np.zeros(len(text) - size + 1, np.uint64)
        for i in range(size):
            word |= buf[i : i + len(word)].astype(np.uint64) << np.uint64(8 * i)
    x = word[:n] * np.uint64(0xBF58476D1CE4E5B9)
    if k > 8:
        x ^= word[k - 8 : k - 8 + n] * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i that has w values."""
    n, size, m = len(x) - w + 1, 1, x
    while 2 * size <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


class _Rolling:
    """64-bit hashes of any stretch of a buffer; other weights of the bytes give an independent one."""

    def __init__(self, buf: np.ndarray, weights: np.ndarray = _BYTE):
        self.up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(weights[buf] * self.up[: len(buf)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.down[a]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(29))


def anchors(text: bytes, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, lo, hi) of a text's anchors: the windows that begin at lo to hi have the anchor; hi < lo if all
    stretches that select it are too near to the text's end."""
    n = len(text) - s.k + 1 - s.head + 1  # stretches of `head` positions
    at, lo = [], []
    for start in range(0, n, PIECE):
        piece = text[start : start + PIECE + s.head - 1 + s.k - 1]
        h = _hashes(piece, s.k).astype(np.uint64) << np.uint64(32)
        least = _sliding_min(h | np.arange(len(h), dtype=np.uint64), s.head)
        found = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        at.append(found[first] + start)
        lo.append(first + start)
    if not at:
        return (np.zeros(0, np.int64),) * 3
    at, lo = np.concatenate(at), np.concatenate(lo)
    new = np.concatenate([[True], at[1:] > at[:-1]])  # a piece's last anchor may be the next one's first
    at, lo = at[new], lo[new]
    return at, lo, np.minimum(np.concatenate([lo[1:], [n]]) - 1, len(text) - s.m)


def cores(text: bytes, at: np.ndarray, s: Shape) -> np.ndarray:
    """64-bit hashes of the cores of anchors."""
    out = np.zeros(len(at), np.uint64)
    for i in range(0, len(at), PIECE // 16):
        own = at[i : i + PIECE // 16]
        base = int(own[0])
        out[i : i + len(own)] = _Rolling(np.frombuffer(text[base : int(own[-1]) + s.core], np.uint8)).of(own - base, own - base + s.core)
    return out


def anchored_cores(raw: list[bytes], s: Shape) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions of the anchors that have windows, hashes of their cores) of every text; many short texts at once."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * len(raw)
    lots: list[list[int]] = [[]]
    size = 0
    for i, text in enumerate(raw):
        if len(text) > PIECE:
            at, lo, hi = anchors(text, s)
            out[i] = at[lo <= hi], cores(text, at[lo <= hi], s)
        elif len(text) >= s.m:
            if size + len(text) > PIECE:
                lots.append([])
                size = 0
            lots[-1].append(i)
            size += len(text)
    for lot in filter(None, lots):
        joined = b"".join([raw[i] for i in lot])
        ends = np.cumsum([len(raw[i]) for i in lot])
        begins = np.concatenate([[0], ends[:-1]])
        h = _hashes(joined, s.k).astype(np.uint64) << np.uint64(32)
        least = (_sliding_min(h | np.arange(len(h), dtype=np.uint64), s.head) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        windows = np.zeros(len(joined) + 1, np.int8)  # a window reaches into no other text
        windows[begins] += 1
        windows[ends - s.m + 1] -= 1
        found = least[np.flatnonzero(np.cumsum(windows)[: len(least)])]
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        core = _Rolling(np.frombuffer(joined, np.uint8)).of(found, found + s.core)
        cuts = np.searchsorted(found, ends)
        for i, begin, a, b in zip(lot, begins.tolist(), [0, *cuts.tolist()], cuts.tolist(), strict=False):
            out[i] = found[a:b] - begin, core[a:b]
    return out


def read_texts(docs: DataFrame, s: Shape, id_col: str, text_col: str) -> DataFrame:
    """pos, doc_id, sha, n_bytes of every row, with its anchors that have windows (at) and their cores."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = TaskContext.get().partitionId() << 33
        schema = pa.schema([("pos", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64()), ("at", pa.list_(pa.int64())), ("core", pa.list_(pa.int64()))])

        def rows() -> Iterator[tuple]:
            nonlocal pos
            for batch in it:
                raw = texts(batch, "text")
                for i, text, (at, core) in zip(batch.column(0).to_pylist(), raw, anchored_cores(raw, s), strict=True):
                    yield pos, i, hashlib.sha256(text).digest(), len(text), at, core.view(np.int64)
                    pos += 1

        yield from batches(rows(), schema, weigh=lambda r: 200 + 16 * len(r[4]))

    limit_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pos long, doc_id long, sha binary, n_bytes long, at array<long>, core array<long>")


def strings(at: np.ndarray, marks: np.ndarray, s: Shape, most: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, end) of the strings of a text's anchors: marked ones from first to last are the string's own, and the
    chunks before end reach m bytes from each. No string has more than `most` own ones and what its last needs."""
    own = np.searchsorted(at, marks)
    ends = np.maximum(np.searchsorted(at, marks + s.m - s.ahead), own + 1)
    first = last = end = -1
    for i, e in zip(own.tolist(), ends.tolist(), strict=True):
        if first >= 0 and (i > end or i - first >= most):
            yield first, last, end
            first = -1
        first = i if first < 0 else first
        last, end = i, e
    if first >= 0:
        yield first, last, end


class _Columns:
    """Columns (arrays of numbers, lists of byte strings) that are gathered into batches of at least `size` rows."""

    def __init__(self, schema: str, size: int = 1 << 14):
        self.fields, self.size = [f.split() for f in schema.split(", ")], size
        self.held: list[list] = [[] for _ in self.fields]
        self.rows = 0

    def add(self, *columns) -> Iterator[pa.RecordBatch]:
        for held, c in zip(self.held, columns, strict=True):
            held.append(c)
        self.rows += len(columns[0])
        if self.rows >= self.size:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array([x for part in c for x in part], pa.binary()) if kind == "binary" else pa.array(np.concatenate(c)) for (_, kind), c in zip(self.fields, self.held, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in self.fields])
            self.held, self.rows = [[] for _ in self.fields], 0


_SYMBOL = "z long, i long, b long, chunk binary, pos long, at long, lo long, hi long, kind int"


def symbols(zone_texts: DataFrame, s: Shape) -> DataFrame:
    """The chunks of all strings: string z, number i, its b bytes; the text and the anchor that it belongs to with its
    windows (pos, at, lo to hi); kind is 1 for an own marked anchor with a core that is to be compared, 2 for one of a core that
    too many anchors have, and 0 for what only continues others."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = TaskContext.get().partitionId() << 34
        out = _Columns(_SYMBOL)
        for batch in it:
            field = lambda name: batch.column(batch.schema.get_field_index(name))
            for pos, marks, hot, text in zip(field("pos").to_pylist(), field("marks"), field("hot"), texts(batch, "text"), strict=True):
                at, lo, hi = anchors(text, s)
                marks, hot = marks.values.to_numpy(), np.array(hot.as_py())
                order = np.argsort(marks)
                marks, hot = marks[order], hot[order]
                kind = np.zeros(len(at), np.int32)
                kind[np.searchsorted(at, marks)] = 1 + hot
                for first, last, end in strings(at, marks, s, PIECE // 16):
                    n = end - first
                    a = at[first:end]
                    cuts = np.minimum(np.concatenate([a, at[end : end + 1] if end < len(at) else [len(text)]]) + s.ahead, len(text))
                    own = np.where(np.arange(first, end) <= last, kind[first:end], 0).astype(np.int32)
                    x = cuts.tolist()
                    chunks = [text[x[i] : x[i + 1]] for i in range(n)]
                    yield from out.add(np.full(n, z), np.arange(n), np.diff(cuts), chunks, np.full(n, pos), a, lo[first:end], hi[first:end], own)
                    z += 1
        yield from out.rest()

    return zone_texts.select("pos", "marks", "hot", "text").mapInArrow(run, _SYMBOL)


_PLACE = "k0 long, k1 long, rank long, pos long, at long, lo long, hi long, left binary, right binary"


def places(zone_texts: DataFrame, rows: DataFrame, s: Shape) -> DataFrame:
    """rows (pos, at, lo, hi, rank) with the bytes before their anchors, those after the core, and the core's hash."""
    fields = ["at", "lo", "hi", "rank"]
    held = rows.groupBy("pos").agg(F.collect_list(F.struct(*fields)).alias("x"))  # of one text
    both = zone_texts.select("pos", "text").join(held, "pos").select("pos", "text", *(F.col(f"x.{f}").alias(f) for f in fields))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Columns(_PLACE)
        for batch in it:
            for n, (pos, text) in enumerate(zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True)):
                whole = [batch.column(2 + j)[n].values.to_numpy() for j in range(len(fields))]
                for i in range(0, len(whole[0]), 1 << 14):
                    at, lo, hi, rank = (c[i : i + (1 << 14)] for c in whole)
                    starts = at.tolist()
                    key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[a : a + s.core]) for a in starts), np.int64).reshape(-1, 2)
                    left = [text[max(0, a - s.head + 1) : a] for a in starts]
                    right = [text[a + s.core : a + s.m] for a in starts]
                    yield from out.add(key[:, 0], key[:, 1], rank, np.full(len(at), pos), at, lo, hi, left, right)
        yield from out.rest()

    return both.mapInArrow(run, _PLACE)


def common_prefix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    if not n:
        return 0
    x = int.from_bytes(a[-n:], "little") ^ int.from_bytes(b[-n:], "little")
    return n - (x.bit_length() + 7) // 8


def _union(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of closed ranges that overlap or follow each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def repeats(kinds: list[tuple[int, int, bytes, bytes]], s: Shape) -> list[list[tuple[int, int]]]:
    """For the different surroundings of one core, in the order of their suffixes, (least and greatest d of its windows,
    bytes before the anchor, bytes after the core): the ranges of d whose windows another one has too."""
    shared = [common_prefix(x[3], y[3]) for x, y in zip(kinds, kinds[1:], strict=False)]
    if len(kinds) > FEW:
        return _repeats_of_many(kinds, np.array(shared), s)
    out: list[list[tuple[int, int]]] = [[] for _ in kinds]
    need = s.m - s.core
    for i, (lo, hi, left, _) in enumerate(kinds):
        least = need
        for j in range(i + 1, len(kinds)):
            least = min(least, shared[j - 1])  # the common prefix is the least of those between
            if need - least > hi:
                break
            a, b = max(lo, kinds[j][0], need - least), min(hi, kinds[j][1])
            if a <= b and (b := min(b, common_suffix(left, kinds[j][2]))) >= a:
                out[i].append((a, b))
                out[j].append((a, b))
    return [_union(x) if len(x) > 1 else x for x in out]


def _repeats_of_many(kinds: list[tuple[int, int, bytes, bytes]], shared: np.ndarray, s: Shape) -> list[list[tuple[int, int]]]:
    """repeats() by runs: for each d, those that agree in all that a window has after the anchor are neighbours in the order
    of suffixes, and those that agree in d bytes before it are in the order of these."""
    n = len(kinds)
    lo, hi = np.array([x[0] for x in kinds]), np.array([x[1] for x in kinds])
    order = sorted(range(n), key=lambda i: kinds[i][2][::-1])
    before = np.array([common_suffix(kinds[i][2], kinds[j][2]) for i, j in zip(order, order[1:], strict=False)])
    hit = np.zeros((n, s.head + 2), bool)
    which = np.zeros(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        own = np.flatnonzero((lo <= d) & (d <= hi))
        if len(own) > 1:
            run = np.concatenate([[0], np.cumsum(shared < s.m - s.core - d)])
            which[order] = np.concatenate([[0], np.cumsum(before < d)])
            _, key, count = np.unique((run * n + which)[own], return_inverse=True, return_counts=True)
            hit[own, d + 1] = count[key] > 1
    edges = np.diff(hit.astype(np.int8), axis=1, append=np.int8(0))
    return [list(zip(np.flatnonzero(e == 1).tolist(), (np.flatnonzero(e == -1) - 1).tolist(), strict=True)) for e in edges]


def _of_classes(s: Shape):
    """pos, lo, hi: starts of repeated windows, from places that are sorted by core and rank."""

    def solved(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        kinds: dict[tuple[bytes, bytes], int] = {}
        own = [kinds.setdefault((r[4], r[5]), len(kinds)) for r in rows]
        if len(kinds) == 1:
            yield from ((r[0], r[2], r[3]) for r in rows)
            return
        count = [0] * len(kinds)
        first: list[tuple] = [()] * len(kinds)
        for kind, r in zip(own, rows, strict=True):
            count[kind] += 1
            first[kind] = first[kind] or (r[1] - r[3], r[1] - r[2], r[4], r[5])
        found = repeats(first, s)
        for kind, r in zip(own, rows, strict=True):
            if count[kind] > 1:
                yield r[0], r[2], r[3]
            else:
                yield from ((r[0], r[1] - b, r[1] - a) for a, b in found[kind])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("pos", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

        def rows() -> Iterator[tuple]:
            key, held = None, []
            for batch in it:
                keys = np.stack([batch.column(j).to_numpy() for j in (0, 1)])
                cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
                values = list(zip(*(batch.column(j).to_pylist() for j in range(3, 9)), strict=True))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    now = keys[0, a], keys[1, a]
                    if now != key:
                        yield from solved(held) if len(held) > 1 else ()
                        key, held = now, []
                    held += values[a:b]
            yield from solved(held) if len(held) > 1 else ()

        yield from batches(rows(), schema, size=1 << 16)

    return run


def _one_by_one(s: Shape):
    """w0, w1 (the hash of its bytes), pos and start of each window of places."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("w0", "w1", "pos", "start")])

        def rows() -> Iterator[tuple]:
            for batch in it:
                for k0, k1, _, pos, at, lo, hi, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    core = np.array([k0, k1], np.int64).tobytes()
                    for d in range(at - hi, at - lo + 1):
                        w = xxhash.xxh3_128_intdigest(core + d.to_bytes(4) + left[len(left) - d :] + right[: s.m - s.core - d])
                        yield (w >> 64) - (1 << 63), (w & ((1 << 64) - 1)) - (1 << 63), pos, at - d

        yield from batches(rows(), schema, size=1 << 16)

    return run


def repeated(docs: DataFrame, m: int = 400, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, ranges, zone texts): rows has pos, doc_id, sha, n_bytes, copies of every row of docs; ranges has the starts
    (arrays lo, hi: from and to) of repeated windows by pos, for texts that have only one row or fewer bytes than a window has."""
    s = Shape(m)
    table = cut(read_texts(docs, s, id_col, text_col), "texts")
    rows = table.select("pos", "doc_id", "sha", "n_bytes")
    groups = cut(rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("pos").alias("first")), "groups")
    rows = rows.join(groups, "sha")
    # copies of a text other than its first row
    spare = small(cut(rows.filter("pos <> first").select("pos"), "spare"))
    once = table.join(spare, "pos", "left_anti")
    marks = once.select("pos", F.explode(F.arrays_zip("at", "core")).alias("x")).select("pos", F.col("x.at").alias("at"), F.col("x.core").alias("core"))
    # written first: a join with the bare aggregate could not split a frequent core; broadcast, after a count, while it is small
    twice = cut(marks.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core", (F.col("n") > most).alias("hot")), "twice")
    some_hot = not twice.filter("hot").isEmpty()
    wanted = cut(marks.join(small(twice), "core").groupBy("pos").agg(F.collect_list(F.struct("at", "hot")).alias("marks")), "marks")
    sought = cut(wanted.join(table.select("pos", "doc_id", "sha"), "pos").select("pos", "marks", F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")), "sought")
    drop_cut(wanted)
    drop_cut(twice)
    release(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = small(sought.select("__id").distinct())
    near = plain.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").withColumn("sha", F.unhex(F.sha2("text", 256)))
    found = near.join(sought, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha"))).select("pos", F.col("marks.at").alias("marks"), F.col("marks.hot").alias("hot"), "text")
    if not rows.filter("copies > 1").groupBy("doc_id", "sha").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["pos"])  # rows that repeat id and text
    zone_texts = cut(found, "zones")
    drop_cut(sought)
    release(docs.sparkSession)
    sym = cut(symbols(zone_texts, s), "symbols")
    named = ranked(sym.withColumn("kind", F.lit(0)), ["chunk"], ["chunk"], ["z", "i", "b"], ["z", "i"])
    # suffixes that agree over m bytes from their anchors on need no further order
    ranks = suffix_ranks(named.select("z", "i", (F.col("n0") + 1).alias("c"), "b"), s.m - s.ahead)
    ordered = ranks.join(sym.filter("kind > 0").select("z", "i", "kind", "pos", "at", "lo", "hi"), ["z", "i"]).drop("z", "i")
    if some_hot:
        ordered = cut(ordered, "ordered")
    n = partitions(docs.sparkSession)
    ranges = places(zone_texts, ordered.filter("kind = 1"), s).repartition(n, "k0", "k1").sortWithinPartitions("k0", "k1", "rank").mapInArrow(_of_classes(s), "pos long, lo long, hi long")
    if some_hot:
        windows = cut(places(zone_texts, ordered.filter("kind = 2"), s).mapInArrow(_one_by_one(s), "w0 long, w1 long, pos long, start long"), "windows")
        again = cut(windows.groupBy("w0", "w1").count().filter("count > 1").select("w0", "w1"), "again")
        ranges = ranges.unionByName(windows.join(again, ["w0", "w1"]).select("pos", F.col("start").alias("lo"), F.col("start").alias("hi")))
    ranges = cut(ranges.groupBy("pos").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select("pos", "r.lo", "r.hi"), "ranges")
    for done in (named, ranks, sym):
        drop_cut(done)
    release(docs.sparkSession)
    return rows, ranges, zone_texts


_RESULT = "pos long, spans array<struct<start:long,end:long>>, n_removed long, kept binary"


def _removed(lo: np.ndarray, hi: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the unions of windows of m bytes that start at lo to hi."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + m)
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    return lo[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def _apply(m: int, with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema([("pos", pa.int64()), ("spans", kind), ("n_removed", pa.int64()), ("kept", pa.binary())])

        def rows() -> Iterator[tuple]:
            for batch in it:
                for pos, text, lo, hi in zip(batch.column(0).to_pylist(), texts(batch, "text"), batch.column(2), batch.column(3), strict=True):
                    starts, ends = (x.tolist() for x in _removed(lo.values.to_numpy(), hi.values.to_numpy(), m))
                    kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))
                    yield pos, [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)], len(text) - len(kept), kept if with_text else hashlib.sha256(kept).digest()

        yield from batches(rows(), schema, weigh=lambda r: len(r[3]))

    return run


def suffix_dedup(docs: DataFrame, m: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans (removed ranges), kept (remaining bytes; null where
    nothing goes, which leaves the text), kept_sha256.

    Bytes are those of the whole text in UTF-8; null texts are empty. A byte goes if a string of m bytes that covers it
    also starts anywhere else, in the same or another text; all is judged on the input. Rows that repeat are copies of
    each other like any equal texts. Texts of fewer than m bytes stay. An empty table gives no rows; other columns are
    ignored. with_text=False leaves kept null.
    """
    rows, ranges, zone_texts = repeated(docs, m, id_col, text_col, most)
    cutting = zone_texts.select("pos", "text").join(ranges, "pos").mapInArrow(_apply(m, with_text), _RESULT)
    cutting = cut(cutting, "cutting")
    got = rows.join(cutting, "pos", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= m)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    spans = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")))
    sha = F.sha2("kept", 256) if with_text else F.lower(F.hex("kept"))
    return got.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), spans.alias("spans"),
        (F.when(whole, F.lit(b"")).otherwise(F.col("kept")) if with_text else F.lit(None).cast("binary")).alias("kept"),
        F.when(whole, nothing).otherwise(F.coalesce(sha, F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
