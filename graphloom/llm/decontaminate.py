"""Benchmark decontamination through a generalised suffix automaton of normalised test items.

Every document's words stream past the items. A word sequence of LEAST words that no item holds ends any match that could
count, so documents without one are passed by a vectorised look-up; all others run through the automaton, which gives
each item's own longest match that ends at each word, whatever longer match of another item it lies in. An item leaks where one match has
LONGEST words, or where matches of LEAST words or more, no further apart than the item is long, cover COVERAGE of it. The matched spans
of leaking items are removed.

An automaton takes about 100 bytes a character of items in every Python worker, so a benchmark of more than SHARD_CHARS characters is cut into shards that documents pass
one after another. Spans of all shards refer to the original text and are merged before any is removed: results don't depend on
the shards.

Items of fewer than LEAST words, null and empty items and documents match nothing. Repeated items count once, under each of their ids. Null and repeated document ids are rows
like any other. Very long texts are read whole. An empty benchmark finds nothing. Extra columns are ignored, and kept by `cleaned`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.automaton import SuffixAutomaton
from graphloom.llm.common import Filter, Words, hashes_of, lean, pieces, replaced, utf8, without, without_runs

LEAST = 5
LONGEST = 13
COVERAGE = 0.6
#: Characters of items that one automaton takes.
SHARD_CHARS = 4_000_000
_built: dict[tuple, "Items"] = {}


class Items:
    def __init__(self, items: list[tuple[object, str]], least: int = LEAST, longest: int = LONGEST, coverage: float = COVERAGE):
        self.least, self.longest, self.coverage = least, longest, coverage
        tokens = [(k, hashes_of(t)) for k, t in items if t]
        tokens = [(k, t) for k, t in tokens if len(t) >= least]
        self.names = [k for k, _ in tokens]
        self.automaton = SuffixAutomaton([t for _, t in tokens], least)
        grams = [Words(raw := np.frombuffer(t.encode(), np.uint8), np.array([0, len(raw)])).grams(least)[0] for _, t in items if t]
        self.seen = Filter(np.concatenate([*grams, np.zeros(0, np.uint64)]))

    def find(self, tokens: list[int]) -> tuple[list, int, float, list[tuple[int, int]]]:
        """Leaking items, their longest match, their best coverage, and the word ranges to remove."""
        names, longest, best, spans = [], 0, 0.0, set()
        for k, matches in self.automaton.own(tokens).items():
            size = self.automaton.sizes[k]
            group: list[tuple[int, int, int, int]] = []
            for at in [*sorted(matches), None]:
                if group and (at is None or at[0] - group[-1][1] > size):
                    most = max(b - a for a, b, _, _ in group)
                    share = _covered([(s, e) for _, _, s, e in group]) / size
                    if most >= self.longest or share >= self.coverage:
                        names.append(self.names[k])
                        longest, best = max(longest, most), max(best, share)
                        spans.update((a, b) for a, b, _, _ in group)
                    group = []
                if at:
                    group.append(at)
        return list(dict.fromkeys(names)), longest, best, sorted(spans)

    def scan(self, column: pa.Array) -> Iterator[tuple[int, Words, int, tuple]]:
        """(row, the words of its piece, its place among them, what was found) of each document with a leak."""
        data, offsets = utf8(column)
        for lo, _, words in pieces(data, offsets):
            h, at = words.grams(self.least)
            hits = at[self.seen(h)]
            for d in np.unique(np.searchsorted(words.lo, hits, "right") - 1).tolist():
                a, b = int(words.lo[d]), int(words.hi[d])
                found = self.find(words.hash[a:b].tolist())
                if found[0]:
                    yield lo + d, words, d, found


def _covered(spans: list[tuple[int, int]]) -> int:
    """Places that lie in any of the ranges."""
    a, b = np.array(spans).T
    return int((np.cumsum(np.bincount(a, minlength=b.max() + 1) - np.bincount(b, minlength=b.max() + 1)) > 0).sum())


def _items(items: tuple, limits: tuple) -> Items:
    if (items, limits) not in _built:
        _built.clear()
        _built[items, limits] = Items(list(items), *limits)
    return _built[items, limits]


def shards(benchmark: DataFrame, item: str, text: str, most: int = SHARD_CHARS) -> list[tuple]:
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    parts = -(-(rows.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0) // most)
    cut = [rows] if parts == 1 else [rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) for k in range(parts)]
    return [tuple(sorted({(x["i"], x["t"]) for x in part.collect()}, key=str)) for part in cut]


RUNS = "array<struct<a:int,b:int,start:bigint,end:bigint>>"
_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _hits(rows: DataFrame, benchmark: DataFrame, item: str, parts: list[tuple], limits: tuple) -> DataFrame:
    """A row per row of (i, h, g, t) and shard with a leak: i, h, g, items, longest, coverage, runs (words a..b, characters start..end), words, shard."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = rows.schema["i"].dataType.simpleString(), benchmark.schema[item].dataType
    schema = f"i {kind}, h long, g long, items array<{name.simpleString()}>, longest int, coverage double, runs {RUNS}, words long, shard int"
    out = rows.sparkSession.createDataFrame([], schema)
    for k, items in enumerate(parts):
        found = rows.mapInArrow(lean(_finder(items, limits, to_arrow_type(name), k)), schema)
        out = out.unionByName(found) if k else found
    return out


def _twice(text: str) -> list[Column]:
    """Two hashes of a text, which tell texts apart."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g")]


def contaminated(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, longest: int = LONGEST, coverage: float = COVERAGE, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """A row per document that an item leaks into: id, items, longest match, best coverage, spans of characters, words, and how many are removed."""
    parts = shards(benchmark, item, item_text, shard_chars)
    rows = documents.select(F.col(id).alias("i"), *_twice(text), F.col(text).cast("string").alias("t"))
    found = _hits(rows, benchmark, item, parts, (least, longest, coverage))
    if len(parts) > 1:
        # of rows that repeat id and text, every shard finds as many
        one = found.groupBy("i", "h", "g", "shard").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("items", "longest", "coverage", "runs", "words")])
        every = one.groupBy("i", "h", "g").agg(F.max("n").alias("n"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "runs")], *[F.max(c).alias(c) for c in ("longest", "coverage", "words")])
        found = every.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    removed = "aggregate(runs, struct(0L as n, 0 as at), (x, y) -> struct(x.n + greatest(0, y.b - greatest(x.at, y.a)) as n, greatest(x.at, y.b) as at), x -> x.n)"
    merged = found.withColumn("runs", F.array_sort(F.array_distinct("runs"))).withColumn("items", F.array_sort(F.array_distinct("items")))
    return merged.select(F.col("i").alias(id), "items", "longest", "coverage", F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"), "words", F.expr(removed).alias("removed"))


def _finder(items: tuple, limits: tuple, name: pa.DataType, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _items(items, limits)
        for b in batches:
            rows, found, runs, sizes = [], [], [], []
            for row, words, d, what in known.scan(b.column(3)):
                at, to = words.offsets[d], words.offsets[d + 1]
                chars = np.concatenate([[0], np.cumsum((words.data[at:to] & 0xC0) != 0x80)])
                first = words.lo[d]
                rows.append(row)
                found.append(what)
                runs.append([{"a": a, "b": e, "start": int(chars[words.start[first + a] - at]), "end": int(chars[words.end[first + e - 1] - at])} for a, e in what[3]])
                sizes.append(int(words.hi[d] - first))
            take = pa.array(rows, pa.int64())
            columns = [
                pa.array([f[0] for f in found], pa.list_(name)),
                pa.array([f[1] for f in found], pa.int32()),
                pa.array([round(f[2], 6) for f in found], pa.float64()),
                pa.array(runs, _RUNS),
                pa.array(sizes, pa.int64()),
                pa.array(np.full(len(rows), shard, np.int32)),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), *columns], ["i", "h", "g", "items", "longest", "coverage", "runs", "words", "shard"])

    return run


def cleaned(documents: DataFrame, benchmark: DataFrame, text: str = "text", chars: str = "n_chars", item: str = "item_id", item_text: str = "text", least: int = LEAST, longest: int = LONGEST, coverage: float = COVERAGE, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The documents without leaked spans; those that have no other words go. `chars`, if there, is counted anew."""
    parts, limits = shards(benchmark, item, item_text, shard_chars), (least, longest, coverage)
    if not parts:
        return documents
    if len(parts) == 1:
        return documents.mapInArrow(lean(_cleaner(parts[0], limits, text, chars)), documents.schema)
    rows = documents.select(F.lit(None).cast("int").alias("i"), *_twice(text), F.col(text).cast("string").alias("t"))
    found = _hits(rows, benchmark, item, parts, limits).select(F.col("h").alias("__graphloom_h"), F.col("g").alias("__graphloom_g"), F.explode("runs").alias("r")).groupBy("__graphloom_h", "__graphloom_g").agg(F.collect_set("r").alias("__graphloom_runs"))
    h, g = _twice(text)
    keyed = documents.withColumns({"__graphloom_x": h, "__graphloom_y": g})
    every = keyed.join(found, (keyed["__graphloom_x"] == found["__graphloom_h"]) & (keyed["__graphloom_y"] == found["__graphloom_g"]), "left")
    return every.select(*[keyed[f"`{c}`"] for c in documents.columns], found["__graphloom_runs"]).mapInArrow(lean(without_runs(text, chars)), documents.schema)


def _cleaner(items: tuple, limits: tuple, text: str, chars: str):
    """As `without_runs`, for the only shard: in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _items(items, limits)
        for b in batches:
            new: dict[int, str] = {}
            keep = np.ones(b.num_rows, bool)
            column = b.column(b.schema.get_field_index(text))
            for row, words, d, what in known.scan(column):
                at, to, first = words.offsets[d], words.offsets[d + 1], words.lo[d]
                keep[row] = _covered(what[3]) < words.hi[d] - first
                new[row] = without(words.data[at:to].tobytes(), [(int(words.start[first + a] - at), int(words.end[first + e - 1] - at)) for a, e in what[3]])
            yield replaced(b, text, chars, new).filter(pa.array(keep))

    return run
