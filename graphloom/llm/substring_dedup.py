"""Substring dedup: windows of WINDOW words that occur more than once anywhere, found with super-k-mers.

A window's minimiser is the SEED-word sequence in it with the smallest hash, the leftmost among equals. Consecutive windows
with the same minimiser (at the same place) are a super-k-mer. Equal windows have equal minimisers, and no window occurs
twice in one super-k-mer; so a minimiser that heads one super-k-mer only has no repeats and travels no further: a first pass counts
minimisers, with a partial sum in every task. The others
travel as one packed string of WINDOW - 1 + n words each to the bucket of their minimiser, where sorting all windows
brings equal ones together: fingerprints are sorted and equal neighbours compared word for word, so counts are exact.
Windows of a minimiser with more than HOT super-k-mers travel one by one as strings, to be counted by a grouping that sums equal ones up before they
travel; no task holds all windows of a hot minimiser. Both ways give the same counts.

The first occurrence, by id, hash of the text and place, stays; in all others the window's words are removed. Case
and punctuation don't count. Null, empty and short texts have no windows. Null ids come last and are compared like any
other; rows that repeat both id and text are one document. A text of more than 2^28 words raises ValueError. An empty table has no
repeats. Extra columns are ignored, and kept by `cleaned`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, Words, content_key, cut, fold, join, lean, listed, merged, mix, pieces, utf8, without_runs

WINDOW = 50
SEED = 8
HOT = 20_000
#: Neighbours compared at once.
STEP = 20_000
#: Windows that one bucket takes.
BUCKET = 200_000
_PLACE = 28


def super_kmers(words: Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Document, first word within it, windows, and minimiser of each super-k-mer."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    gram = mix(join(words.hash, seed))
    if len(gram) >> _PLACE:
        raise ValueError(f"a text of more than 2^{_PLACE} words")
    width = window - seed + 1
    low = np.uint64((1 << _PLACE) - 1)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    rows = -(-len(key) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    padded = padded.reshape(rows, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    place = (np.minimum(after[:count], before[width - 1 : width - 1 + count]) & low).astype(np.int64)
    inside = np.flatnonzero(np.repeat(words.hi, words.hi - words.lo)[:count] >= np.arange(window, n + 1))
    if not len(inside):
        return none, none, none, none
    place = place[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)
    at = np.flatnonzero(new)
    first = inside[at]
    doc = np.repeat(np.arange(len(words.lo)), words.hi - words.lo)[first]
    return doc, first - words.lo[doc], np.diff(np.append(at, len(inside))), gram[place[at]].view(np.int64)


def _tally(window: int, seed: int):
    """Minimisers and how many super-k-mers of a piece they head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            for _, _, words in pieces(data, offsets):
                m, n = np.unique(super_kmers(words, window, seed)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(n)], ["m", "c"])

    return run


def _minimise(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            for lo, _, words in pieces(data, offsets):
                doc, first, n, least = super_kmers(words, window, seed)
                rows = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(least), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["i", "h", "m", "s", "n"])

    return run


def _packed(b: pa.RecordBatch) -> Iterator[tuple]:
    """Of each piece: row, the document's first word in the piece, minimiser, first word and windows of each super-k-mer that the last column lists; and the piece's normalised bytes, and where its words begin and end in them."""
    data, offsets = utf8(b.column(2))
    edges, fields = listed(b.column(3), ("m", "s", "n"))
    for lo, hi, words in pieces(data, offsets):
        low = fold(words.data)
        inside = WORD[low]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        keep[words.end[words.end < len(keep)]] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        packed = np.where(inside, low, 32)[keep].astype(np.uint8).tobytes()
        begin, end = at[words.start].tolist(), at[words.end].tolist()
        yield [(d, int(words.lo[d - lo]), m, s, n) for d in range(lo, hi) for m, s, n in zip(*[x[edges[d] : edges[d + 1]].tolist() for x in fields], strict=True)], packed, begin, end


def _pack(buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for listed_, packed, begin, end in _packed(b):
                rows = pa.array([x[0] for x in listed_], pa.int64())
                bucket, first, count = [m % buckets for _, _, m, _, _ in listed_], [x[3] for x in listed_], [x[4] for x in listed_]
                text = [packed[begin[base + s] : end[base + s + n + window - 2]] for _, base, _, s, n in listed_]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), b.column(0).take(rows), b.column(1).take(rows), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(text, pa.binary())], ["k", "i", "h", "s", "n", "t"])

    return run


def _unpack(window: int):
    """As _pack, each window by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for listed_, packed, begin, end in _packed(b):
                rows = pa.array([d for d, _, _, _, n in listed_ for _ in range(n)], pa.int64())
                first = [k for _, _, _, s, n in listed_ for k in range(s, s + n)]
                text = [packed[begin[k] : end[k + window - 1]] for _, base, _, s, n in listed_ for k in range(base + s, base + s + n)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(first, pa.int32()), pa.array(text, pa.binary())], ["i", "h", "s", "t"])

    return run


def _count(window: int, kind: pa.DataType):
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("i", "ascending"), ("h", "ascending"), ("s", "ascending")]).combine_chunks()
        codes = [bucket.column("i").combine_chunks().dictionary_encode("encode").indices.to_numpy(), bucket.column("h").to_numpy(), bucket.column("s").to_numpy()]
        once = np.ones(bucket.num_rows, bool)
        once[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
        bucket = bucket.filter(pa.array(once)).combine_chunks()
        data, offsets = utf8(bucket.column("t").cast(pa.string()))
        n = bucket.column("n").to_numpy()
        parts = [(offsets[lo], words) for lo, _, words in pieces(data, offsets)]
        start, end, h = (np.concatenate(x) for x in ([words.start + at for at, words in parts], [words.end + at for at, words in parts], [words.hash for _, words in parts]))
        del parts
        lo = np.searchsorted(start, offsets)
        if not (np.diff(lo) == n + window - 1).all():
            raise AssertionError("a packed string's words don't match its windows")
        owner = np.repeat(np.arange(len(n)), n)
        at = lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        print_ = join(h, window)[at]
        order = np.argsort(print_, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = print_[order[1:]] == print_[order[:-1]]
        del print_, h
        raw = data.tobytes()
        start, end = start[at], end[at + window - 1]
        a, b = order[np.flatnonzero(same) - 1], order[same]
        for k in range(0, len(a), STEP):
            x, y = a[k : k + STEP], b[k : k + STEP]
            if any(raw[p:q] != raw[r:t] for p, q, r, t in zip(start[x].tolist(), end[x].tolist(), start[y].tolist(), end[y].tolist(), strict=True)):
                return _by_text(bucket, raw, start, end, owner, at - lo[owner], window)
        later = np.zeros(len(order), bool)
        later[order[same]] = True
        group = np.cumsum(~same) - 1
        times = np.zeros(len(order), np.int64)
        times[order] = np.bincount(group)[group] if len(group) else group
        return _runs(bucket, owner, at - lo[owner], times, later, window)

    def _by_text(bucket, raw, start, end, owner, offset, window):
        seen: dict[bytes, list[int]] = {}
        for k, (x, y) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            seen.setdefault(raw[x:y], []).append(k)
        times, later = np.zeros(len(owner), np.int64), np.zeros(len(owner), bool)
        for own in seen.values():
            times[own] = len(own)
            later[own[1:]] = True
        return _runs(bucket, owner, offset, times, later, window)

    def _runs(bucket, owner, offset, times, later, window):
        rows, kinds, begin, end, copies = [], [], [], [], []
        s = bucket.column("s").to_numpy()
        for kind_, flag in ((False, times > 1), (True, later)):
            on = np.flatnonzero(flag)
            new = np.ones(len(on), bool)
            new[1:] = (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]])
            last = np.ones(len(on), bool)
            last[:-1] = new[1:]
            rows.append(owner[on[new]])
            begin.append(s[owner[on[new]]] + offset[on[new]])
            end.append(s[owner[on[last]]] + offset[on[last]] + window)
            copies.append(np.maximum.reduceat(times[on], np.flatnonzero(new)) if len(on) else on)
            kinds.append(np.full(int(new.sum()), kind_))
        rows = pa.array(np.concatenate(rows))
        return pa.table(
            [bucket.column("i").combine_chunks().take(rows).cast(kind), bucket.column("h").combine_chunks().take(rows), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(begin).astype(np.int32)), pa.array(np.concatenate(end).astype(np.int32)), pa.array(np.concatenate(copies).astype(np.int64))],
            names=["i", "h", "later", "a", "b", "c"],
        )

    return run


def _spans(documents: DataFrame, id: str, text: str, window: int, seed: int, hot: int, bucket: int) -> DataFrame:
    """(i, h, r): per document with repeated windows, runs of words (a, b), the most occurrences of a window in them (c) and whether they are removed (later)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema[id].dataType
    name = kind.simpleString()
    rows = documents.select(F.col(id).alias("i"), content_key(text).alias("h"), F.col(text).cast("string").alias("t"))
    shared = rows.select("t").mapInArrow(lean(_tally(window, seed)), "m long, c long").groupBy("m").agg(F.sum("c").alias("c")).where("c > 1")
    found = rows.mapInArrow(lean(_minimise(window, seed)), f"i {name}, h long, m long, s int, n int").join(shared, "m")
    wanted = cut(found.groupBy("i", "h").agg(F.collect_set(F.struct("m", "s", "n", "c")).alias("l")))

    def total(most: str):
        return F.sum(F.expr(f"aggregate(filter(l, x -> {most}), 0L, (x, y) -> x + y.n)"))

    sizes = wanted.select(total(f"x.c <= {hot}").alias("cold"), total(f"x.c > {hot}").alias("hot")).first()
    buckets = -(-(sizes["cold"] or 0) // bucket) or 1

    def texts(which: str) -> DataFrame:
        own = wanted.select(F.col("i").alias("j"), F.col("h").alias("g"), F.expr(f"filter(l, x -> {which})").alias("l")).where("size(l) > 0")
        return rows.join(own, rows["i"].eqNullSafe(own["j"]) & (rows["h"] == own["g"])).select("i", "h", "t", "l")

    packed = texts(f"x.c <= {hot}").mapInArrow(lean(_pack(buckets, window)), f"k long, i {name}, h long, s int, n int, t binary")
    counted = packed.groupBy("k").applyInArrow(lean(_count(window, to_arrow_type(kind))), f"i {name}, h long, later boolean, a int, b int, c long")
    if sizes["hot"]:
        once = texts(f"x.c > {hot}").groupBy("i", "h").agg(F.first("t").alias("t"), F.first("l").alias("l"))
        windows = once.mapInArrow(lean(_unpack(window)), f"i {name}, h long, s int, t binary")
        place = F.struct(F.col("i").isNull().alias("z"), "i", "h", "s")
        first = windows.groupBy("t").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
        repeated = windows.join(first, "t").withColumn("later", F.explode(F.when(place.eqNullSafe(F.col("first")), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
        counted = counted.unionByName(repeated.select("i", "h", "later", F.col("s").alias("a"), (F.col("s") + window).alias("b"), "c"))
    return counted.groupBy("i", "h").agg(F.collect_list(F.struct("later", "a", "b", "c")).alias("r"))


def repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """A row per document with a window that occurs elsewhere, or again: its runs of repeated words with the occurrences of their commonest window, and the runs removed."""
    kind = documents.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges, (later, begin, end, copies) = listed(b.column(1), ("later", "a", "b", "c"))
            owner = np.repeat(np.arange(b.num_rows), np.diff(edges))
            lists, sums = [], []
            for on in (~later, later):
                row, x, y, c = merged(owner[on], begin[on], end[on], copies[on])
                fields = {"start": pa.array(x, pa.int32()), "end": pa.array(y, pa.int32())} | ({} if lists else {"copies": pa.array(c, pa.int64())})
                span = pa.StructArray.from_arrays(list(fields.values()), list(fields))
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32()), span))
                sums.append(pa.array(np.bincount(row, y - x, b.num_rows).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, *sums], ["i", "repeated", "removed", "repeated_words", "removed_words"])

    spans = "repeated array<struct<start:int,end:int,copies:bigint>>, removed array<struct<start:int,end:int>>"
    return _spans(documents, id, text, window, seed, hot, bucket).select("i", "r").mapInArrow(lean(run), f"`{id}` {kind}, {spans}, repeated_words long, removed_words long")


def cleaned(documents: DataFrame, id: str = "doc_id", text: str = "text", chars: str = "n_chars", window: int = WINDOW, seed: int = SEED, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """The documents without later copies of windows; those that have no other words go. `chars`, if there, is counted anew."""
    names = documents.columns
    spans = _spans(documents, id, text, window, seed, hot, bucket).select(F.col("i").alias("__graphloom_i"), F.col("h").alias("__graphloom_h"), F.filter("r", lambda x: x["later"]).alias("__graphloom_spans")).where(F.size("__graphloom_spans") > 0)
    keyed = documents.withColumn("__graphloom_key", content_key(text))
    every = keyed.join(spans, keyed[id].eqNullSafe(spans["__graphloom_i"]) & (keyed["__graphloom_key"] == spans["__graphloom_h"]), "left").select(*[keyed[c] for c in names], spans["__graphloom_spans"])

    return every.mapInArrow(lean(without_runs(text, chars)), documents.schema)
