"""Shared by the corpus operators: checkpoints, and vectorised work on UTF-8 text.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII bytes; everything else separates.
Case is folded for ASCII and Latin-1, byte for byte, so offsets in folded text are offsets in the original.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer document is one piece.
PIECE = 1 << 20

WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage, in the checkpoint folder that the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what all executors must reach. A cluster has to name it; a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lean(run: Callable) -> Callable:
    """The same function for mapInArrow or applyInArrow, which gives memory back to the system when it is done: workers live on between tasks."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    def grouped(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            _give_back()

    return mapped if inspect.isgeneratorfunction(run) else grouped


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such function
            ctypes.CDLL(None).malloc_trim(0)


def content_key(text: str) -> Column:
    """Tells rows apart that share an id: a hash of the text, 0 for null."""
    return F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> np.ndarray:
    """The first n powers of the hashes' base, at least."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64, 2 * len(_powers)), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def fold(data: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    if len(low) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        up = (data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)
        low[at[up]] += 0x20
    return low


class Words:
    """The words of some documents: byte ranges, hashes, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        low = fold(data)
        inside = WORD[low]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        end[edges] = inside[edges]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        at = np.searchsorted(self.start, offsets)
        self.lo, self.hi = at[:-1], at[1:]
        lengths = self.end - self.start
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        value = _BYTE[low[inside]]
        if len(place):
            value *= powers(int(place.max()) + 1)[place]
        self.hash = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words, and at which words they begin; none crosses documents."""
        if len(self) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = np.repeat(self.hi, self.hi - self.lo)[: len(self) - n + 1] >= np.arange(n, len(self) + 1)
        return mix(join(self.hash, n))[whole], np.flatnonzero(whole)


def join(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each n consecutive values, by doubling."""
    out, have = None, 0
    block, size = h, 1
    left = n
    while left:
        if left & 1:
            if out is None:
                out, have = block, size
            else:
                m = min(len(out), len(block) - have)
                out = out[:m] * powers(size + 1)[size] + block[have : have + m]
                have += size
        left >>= 1
        if left:
            block = block[:-size] * powers(size + 1)[size] + block[size:]
            size *= 2
    return out[: len(h) - n + 1]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, Words]]:
    """Documents lo..hi at a time, so that arrays stay small whatever the batch."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def hashes_of(text: str) -> list[int]:
    """The word hashes of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)])).hash.tolist()


def without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """raw without the given byte ranges, which may touch or overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out.append(raw[at:a])
        at = max(at, b)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def listed(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A column of lists of structs as each row's range and the fields' values."""
    values = column.flatten()
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())]), [values.field(x).to_numpy(zero_copy_only=False) for x in names]


def merged(row: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs a..b of each row, joined where they touch or overlap: (row, a, b) by row and place; and the largest of their values, if there are any."""
    if not len(row):
        return (row, a, b) if most is None else (row, a, b, most)
    order = np.lexsort((a, row))
    row, a, b = (x[order].astype(np.int64) for x in (row, a, b))
    wide = int(b.max()) + 1
    from_, to = row * wide + a, np.maximum.accumulate(row * wide + b)
    new = np.ones(len(row), bool)
    new[1:] = from_[1:] > to[:-1]
    at = np.flatnonzero(new)
    out = row[at], a[at], to[np.append(at[1:], len(row)) - 1] - row[at] * wide
    return out if most is None else (*out, np.maximum.reduceat(most[order], at))


def replaced(b: pa.RecordBatch, text: str, chars: str, new: dict[int, str]) -> pa.RecordBatch:
    """The batch with some rows' texts, and their lengths, replaced."""
    for name, values in ((text, new), (chars, {k: len(v) for k, v in new.items()})):
        if new and (k := b.schema.get_field_index(name)) >= 0:
            mask = np.zeros(b.num_rows, bool)
            mask[sorted(values)] = True
            column = pc.replace_with_mask(b.column(k), pa.array(mask), pa.array([values[x] for x in sorted(values)], b.column(k).type))
            b = b.set_column(k, b.schema.field(k), column)
    return b


def without_runs(text: str, chars: str):
    """For mapInArrow: the last column lists runs of words (a, b) to remove from each row's text. Rows that have no other words go; `chars`, if there, is counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges, (begin, end) = listed(b.column(b.num_columns - 1), ("a", "b"))
            owner, begin, end = merged(np.repeat(np.arange(b.num_rows), np.diff(edges)), begin, end)
            rows, first = np.unique(owner, return_index=True)
            first = np.append(first, len(owner))
            b = b.select(list(range(b.num_columns - 1)))
            new, keep = {}, np.ones(b.num_rows, bool)
            data, offsets = utf8(b.column(b.schema.get_field_index(text)).take(pa.array(rows, pa.int64())))
            for lo, hi, words in pieces(data, offsets):
                for d in range(hi - lo):
                    x, y = begin[first[lo + d] : first[lo + d + 1]], end[first[lo + d] : first[lo + d + 1]]
                    row, base, word = int(rows[lo + d]), words.offsets[d], words.lo[d]
                    keep[row] = int((y - x).sum()) < words.hi[d] - word
                    raw = words.data[base : words.offsets[d + 1]].tobytes()
                    new[row] = without(raw, list(zip((words.start[word + x] - base).tolist(), (words.end[word + y - 1] - base).tolist(), strict=True)))
            yield replaced(b, text, chars, new).filter(pa.array(keep))

    return run


class Filter:
    """Tells which hashes are in a set: a bitmap first, then the sorted set."""

    def __init__(self, hashes: np.ndarray, bits: int = 22):
        self.sorted = np.unique(hashes.astype(np.uint64))
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.sorted >> self.shift] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Positions in h of members."""
        at = np.flatnonzero(self.map[h >> self.shift])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[place] == h[at]]
