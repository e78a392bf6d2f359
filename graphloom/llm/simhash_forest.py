"""Near-duplicate groups by SimHash and an LSH forest.

A document's signature has 256 bits: the signs of the sum of its distinct word pairs' hashed vectors (of its one word, if it
has no pair), whatever other documents share its batch. Equal signatures are one leaf. A trie of the forest orders the leaves by
KEY_BITS of their bits in its own random order; a node is the leaves that share a prefix.

How deep a leaf looks depends on how dense its surroundings are: in every trie it climbs from the bottom to the shortest prefix
whose node has NODE leaves at most, and all pairs of that node are verified on the whole signature. Two leaves at the farthest
distance that counts share a node of depth d with probability p^d, p being the share of equal bits, so each leaf knows from its own
depths the chance that such a partner was missed. Tries are added in rounds; a leaf whose recall has reached the target leaves the
forest, which is thinner for the others (nodes are a partition, so its partners saw it exactly where it saw them). What still is
short after ROUNDS, in the densest places, climbs to the short prefix at which few more tries reach the target, whatever the node's size;
nodes of more than BLOCK leaves are verified as pairs of blocks. There is no cap on a node, and no node is held whole.

Null, empty and wordless texts and null ids belong to no group and are kept. Rows that share an id are one document, whatever their texts.
Of each group the smallest id is kept. Very long texts are signed whole. Extra columns are ignored. An empty table has no groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Words, cut, join, lean, mix, pieces, utf8
from graphloom.llm.components import components

BITS = 256
#: Signatures up to this distance are near duplicates: word pairs with a cosine of about 0.845.
FARTHEST = 46
#: Recall that the forest reaches at that very distance; nearer pairs have more.
RECALL = 0.95
KEY_BITS = 48
#: Leaves that a node has at most where its depth adapts.
NODE = 1024
#: Leaves that a task's piece of a trie has on average; pieces of more than HEAVY times that are cut at longer prefixes.
PIECE = 1 << 14
HEAVY = 4
STEP = 4
ROUNDS = 2
#: Tries of a round at most.
MOST_TRIES = 64
#: Leaves that are compared at once where nodes have any size.
BLOCK = 1 << 13
#: Ids of removed documents that are broadcast, so that texts needn't be shuffled to leave them out; more are joined by shuffling.
BROADCAST = 1_000_000
#: Microseconds of a row in a trie and of a verified pair, to weigh tries against depth.
ROW_US, PAIR_US = 8.0, 0.008
_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_SIGN = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)


def signatures(words: Words) -> np.ndarray:
    """(documents, 32) bytes; all zero where a document has no word."""
    n = len(words.lo)
    count = words.hi - words.lo
    doc = np.repeat(np.arange(n), count)
    if len(words) > 1:
        pair = mix(join(words.hash, 2))
        inside = doc[1:] == doc[:-1]
        pair, owner = pair[inside], doc[:-1][inside]
    else:
        pair, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    single = np.flatnonzero(count == 1)
    pair = np.concatenate([pair, words.hash[words.lo[single]]])
    owner = np.concatenate([owner, single])
    order = np.lexsort((pair, owner))
    feature, owner = pair[order], owner[order]
    fresh = np.ones(len(feature), bool)
    fresh[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
    feature, owner = feature[fresh], owner[fresh]
    out = np.zeros((n, BITS // 8), np.uint8)
    at = owner * 256
    for word, salt in enumerate(_SALT):
        part = mix(feature ^ salt).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            table = np.bincount(at + part[:, k], minlength=n * 256).reshape(n, 256).astype(np.float32)
            out[:, word * 8 + k] = np.packbits(table @ _SIGN > 0, axis=1)[:, 0]
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(1))
        rows, some = [], []
        for _, _, words in pieces(data, offsets):
            rows += [x.tobytes() for x in signatures(words)]
            some.append(words.hi > words.lo)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary(), mask=~np.concatenate([*some, np.zeros(0, bool)]))], ["i", "s"])


def signed(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(i, s): ids and signatures."""
    kind = documents.schema[id].dataType.simpleString()
    return documents.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(lean(_sign), f"i {kind}, s binary")


def missed(depth: np.ndarray | int, farthest: int = FARTHEST) -> np.ndarray:
    """Logarithm of the chance that a node of that depth lacks a partner at the farthest distance."""
    p = (1 - farthest / BITS) ** np.asarray(depth, float)
    return np.log1p(-np.minimum(p, 1 - 1e-12))


def needed(depth: float, short: float, farthest: int = FARTHEST) -> int:
    """Tries of that depth that add `short`, which is negative, to the logarithm of the chance to miss."""
    return max(1, math.ceil(short / missed(depth, farthest) - 1e-9))


def shape(leaves: int, short: float, farthest: int = FARTHEST) -> tuple[int, int]:
    """Depth to climb to and number of tries that add `short` to the logarithm of the chance to miss at least cost."""
    costs = ((needed(d, short, farthest) * (ROW_US + PAIR_US * leaves / 2 ** (d + 1)), d) for d in range(KEY_BITS + 1))
    depth = min(costs)[1]
    return depth, needed(depth, short, farthest)


def keys(signs: np.ndarray, trie: int) -> np.ndarray:
    """The first KEY_BITS bits of signatures (rows of bits) in a trie's order, as numbers."""
    order = np.random.default_rng([7, trie]).permutation(BITS)[:KEY_BITS]
    out = np.zeros((len(signs), 8), np.uint8)
    out[:, 8 - KEY_BITS // 8 :] = np.packbits(signs[:, order], axis=1)
    return out.view(">u8")[:, 0].astype(np.int64)


def _bits(column: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)


def _planter(tries: range, top: int, heavy: dict[tuple[int, int], np.ndarray], blocks: dict[tuple[int, int], int]):
    """Rows (trie, depth, prefix, block, block) and the leaf's own columns. heavy: by trie and depth, prefixes whose piece is cut at STEP bits more. blocks: by trie and prefix, the blocks of nodes too large to be held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = _bits(b.column("s"))
            draw = mix(np.packbits(bits[:, :64], axis=1).view(np.uint64)[:, 0]) if blocks else None
            for k in tries:
                key = keys(bits, k)
                depth = np.full(len(key), top, np.int32)
                while True:
                    prefix, deeper = key >> (KEY_BITS - depth), np.zeros(len(key), bool)
                    for d in np.unique(depth).tolist():
                        if (k, d) in heavy:
                            deeper |= (depth == d) & np.isin(prefix, heavy[k, d])
                    if not deeper.any():
                        break
                    depth[deeper] += STEP
                rows, x, y = [np.arange(len(key))], [np.zeros(len(key), np.int32)], [np.zeros(len(key), np.int32)]
                if blocks:
                    parts = np.array([blocks.get((k, p), 1) for p in prefix.tolist()])
                    own = (draw % parts.astype(np.uint64)).astype(np.int32)
                    for other in range(parts.max(initial=1)):
                        at = np.flatnonzero((other < parts) & (other != own))
                        rows.append(at)
                        x.append(np.minimum(own[at], other))
                        y.append(np.maximum(own[at], other))
                    rows[0], x[0], y[0] = (v[0][parts == 1] for v in (rows, x, y))
                at, x, y = np.concatenate(rows), np.concatenate(x), np.concatenate(y)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(depth[at]), pa.array(prefix[at]), pa.array(x), pa.array(y), *(c.take(take) for c in b.columns)], ["k", "d", "p", "x", "y", *b.schema.names])

    return run


def _counter(tries: range, depth: int, under: dict[int, np.ndarray] | None):
    """Rows (trie, prefix, leaves) of a batch, at that depth; under: by trie, only below these prefixes of STEP bits less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = _bits(b.column(0))
            for k in tries:
                if under is not None and k not in under:
                    continue
                prefix = keys(bits, k) >> (KEY_BITS - depth)
                if under is not None:
                    prefix = prefix[np.isin(prefix >> STEP, under[k])]
                prefix, n = np.unique(prefix, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(prefix), pa.array(n)], ["k", "p", "n"])

    return run


def _oversized(leaves: DataFrame, tries: range, depth: int, most: int, under: dict[int, np.ndarray] | None = None) -> list:
    """(trie, prefix, leaves) of each node at that depth with more leaves than `most`; there can't be more than leaves * tries / most."""
    counted = leaves.select("s").mapInArrow(lean(_counter(tries, depth, under)), "k int, p long, n long")
    return [(x["k"], x["p"], x["n"]) for x in counted.groupBy("k", "p").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()]


def depths(key: np.ndarray, top: int, most: int) -> np.ndarray:
    """For each of the sorted keys the shortest prefix, of `top` bits at least, that no more than `most` of them share; KEY_BITS if there is none."""
    out = np.full(len(key), KEY_BITS)
    pending = np.ones(len(key), bool)
    for d in range(top, KEY_BITS):
        prefix = key >> (KEY_BITS - d)
        edge = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        small = pending & np.repeat(size <= most, size)
        out[small] = d
        pending &= ~small
        if not pending.any():
            break
    return out


def linked(sign: np.ndarray, farthest: int) -> np.ndarray:
    """For each signature (a row of 4 words) the first of its component, all pairs within `farthest` being joined."""
    n = len(sign)
    root = np.arange(n)
    left = np.arange(n)
    while len(left):
        root[left[0]] = left[0]
        first, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            rest = np.arange(len(left))
            for x in front:
                hit = np.bitwise_count(sign[left[rest]] ^ sign[x]).sum(1, dtype=np.int32) <= farthest
                if hit.any():
                    near[rest[hit]] = True
                    rest = rest[~hit]
                    if not len(rest):
                        break
            front, left = left[near], left[~near]
            root[front] = first
    return root


def joined(sign: np.ndarray, farthest: int) -> np.ndarray:
    """As linked, by comparing all pairs while few of them are near."""
    n = len(sign)
    root = np.arange(n)
    found, total = [], 0
    for lo in range(0, n, 256):
        x, y = sign[lo : lo + 256], sign[lo:]
        half = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0])
        half += np.bitwise_count(x[:, 1, None] ^ y[None, :, 1])
        a, b = np.nonzero(half <= farthest)
        later = b > a
        a, b = a[later], b[later]
        near = np.bitwise_count(x[a] ^ y[b]).sum(1, dtype=np.int32) <= farthest
        found.append((a[near] + lo, b[near] + lo))
        total += int(near.sum())
        if total > 64 * n:
            return linked(sign, farthest)
    if not total:
        return root
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verifier(farthest: int, kind: pa.DataType, most: int | None):
    """Of each leaf of a piece: its id, a leaf that it is joined with (or null), and the logarithm of its chance to have missed a partner. most: a node's leaves, where its depth adapts; none: the piece is a node."""

    def run(piece: pa.Table) -> pa.Table:
        top = piece.column("d")[0].as_py()
        ids, sign = piece.column("i").combine_chunks(), np.frombuffer(b"".join(piece.column("s").to_pylist()), np.uint64).reshape(piece.num_rows, -1)
        if most is None:
            order, node = np.arange(len(sign)), np.zeros(len(sign), np.int64)
            depth = np.full(len(sign), top)
        else:
            key = keys(np.unpackbits(sign.view(np.uint8), axis=1), piece.column("k")[0].as_py())
            order = np.argsort(key, kind="stable")
            key = key[order]
            depth = depths(key, top, most)
            prefix = key >> (KEY_BITS - depth)
            node = np.cumsum(np.concatenate([[0], (depth[1:] != depth[:-1]) | (prefix[1:] != prefix[:-1])]))
        partner = np.full(len(sign), -1)
        edge = np.append(np.flatnonzero(np.diff(node, prepend=-1)), len(node))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi - lo > 1:
                root = joined(sign[order[lo:hi]], farthest)
                partner[lo:hi] = np.where(root == np.arange(hi - lo), -1, order[lo + root])
        other = ids.take(pa.array(partner, mask=partner < 0))
        take = pa.array(order)
        return pa.table([ids.take(take).cast(kind), piece.column("q").combine_chunks().take(take), other.cast(kind), pa.array(missed(depth, farthest))], names=["i", "q", "b", "m"])

    return run


def _planted(leaves: DataFrame, tries: range, top: int, heavy: dict, blocks: dict, farthest: int, most: int | None) -> DataFrame:
    """(i, q, m, l): of each leaf, the logarithm of its chance to have missed a partner in these tries, and the leaves it is joined with."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = leaves.schema["i"].dataType
    name = kind.simpleString()
    rows = leaves.select("i", "q", "s").mapInArrow(lean(_planter(tries, top, heavy, blocks)), f"k int, d int, p long, x int, y int, i {name}, q long, s binary")
    seen = rows.groupBy("k", "d", "p", "x", "y").applyInArrow(lean(_verifier(farthest, to_arrow_type(kind), most)), f"i {name}, q long, b {name}, m double")
    return cut(seen.groupBy("i", "q").agg(F.sum("m").alias("m"), F.collect_set("b").alias("l")))


def _forest(leaves: DataFrame, farthest: int, recall: float, node: int, piece: int, block: int, rounds: int) -> DataFrame:
    """(a, b): pairs of joined leaves; leaves: (s, i, q) of distinct signatures, of which an id can have several, told apart by q."""
    goal = math.log(1 - recall)
    every = leaves.where("false").select(F.col("i").alias("a"), F.col("i").alias("b"))
    left, first, n, worst = leaves.withColumn("m", F.lit(0.0)), 0, leaves.count(), 0.0
    # as if signatures were spread evenly; where they aren't, later rounds add what is short
    tries = needed(max(0, math.ceil(math.log2(max(1, n) / node))), goal, farthest)
    for _ in range(rounds):
        if n < 2:
            return every
        these = range(first, first + min(tries, MOST_TRIES))
        first = these.stop
        top, heavy = max(0, int(math.log2(n / piece))) if n > piece else 0, {}
        most, depth, under = HEAVY * max(piece, n * len(these) // 100_000), top, None
        while n > most and depth + STEP <= KEY_BITS:
            found: dict[int, list[int]] = {}
            for k, p, _ in _oversized(left, these, depth, most, under):
                found.setdefault(k, []).append(p)
            if not found:
                break
            under = {k: np.array(v) for k, v in found.items()}
            heavy |= {(k, depth): v for k, v in under.items()}
            depth += STEP
        seen = _planted(left, these, top, heavy, {}, farthest, node)
        every = every.unionByName(seen.select(F.col("i").alias("a"), F.explode("l").alias("b")))
        more = seen.select("i", "q", F.col("m").alias("more"))
        left = cut(left.join(more, ["i", "q"]).select("s", "i", "q", (F.col("m") + F.col("more")).alias("m")).where(F.col("m") > goal))
        row = left.agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.max("m").alias("worst")).first()
        n, worst = row["n"], row["worst"]
        if n:
            tries = max(1, math.ceil(1.5 * first * (goal / row["mean"] - 1)))
    if n < 2:
        return every
    depth, tries = shape(n, goal - worst, farthest)
    these = range(first, first + tries)
    blocks = {(k, p): -(-2 * size // block) for k, p, size in _oversized(left, these, depth, block)} if n > block else {}
    seen = _planted(left, these, depth, {}, blocks, farthest, None)
    return every.unionByName(seen.select(F.col("i").alias("a"), F.explode("l").alias("b")))


def groups(documents: DataFrame, id: str = "doc_id", text: str = "text", farthest: int = FARTHEST, recall: float = RECALL, node: int = NODE, piece: int = PIECE, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """A row per document: id, group (the smallest id of its group), kept."""
    every = cut(signed(documents, id, text))
    moved = _moved(every, farthest, recall, node, piece, block, rounds)
    return every.join(moved, every["i"] == moved["j"], "left").select(F.col("i").alias(id), F.coalesce("g", "i").alias("group_id"), F.col("g").isNull().alias("kept"))


def _moved(every: DataFrame, farthest: int = FARTHEST, recall: float = RECALL, node: int = NODE, piece: int = PIECE, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(j, g): each id that isn't the least of its group, and the least."""
    known = every.where("i is not null and s is not null")
    leaves = cut(known.groupBy("s").agg(F.min("i").alias("i")).select("s", "i", F.xxhash64("s").alias("q")))
    # an id that has several texts joins them
    again = cut(known.groupBy("i").agg(F.count("*").alias("n")).where("n > 1").select(F.col("i").alias("j")))
    owned = known.select("i", "s").join(again, F.col("i") == F.col("j"), "left_semi").join(leaves.select(F.col("s").alias("z"), F.col("i").alias("leaf")), F.col("s") == F.col("z"))
    same = owned.select(F.col("leaf").alias("a"), F.col("i").alias("b"))
    root = components(_forest(leaves, farthest, recall, node, piece, block, rounds).unionByName(same))
    to = leaves.join(root, leaves["i"] == root["node"], "left").select(F.col("s").alias("z"), F.coalesce("root", "i").alias("g"))
    # one row per text; what texts share an id are in one component, so its rows agree
    return known.join(to, F.col("s") == F.col("z")).where("i <> g").select(F.col("i").alias("j"), "g").distinct()


def deduplicated(documents: DataFrame, id: str = "doc_id", text: str = "text", farthest: int = FARTHEST, recall: float = RECALL) -> DataFrame:
    """One document of each group, with its own columns; of rows that share an id, the one with the smallest text."""
    every = cut(signed(documents, id, text))
    gone = cut(_moved(every, farthest, recall).select(F.col("j").alias("__graphloom_gone")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    again = cut(every.where("i is not null").groupBy("i").count().where("count > 1").select(F.col("i").alias("__graphloom_again")))
    kept = documents.join(gone, documents[id] == gone["__graphloom_gone"], "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept[id] == again["__graphloom_again"], "left_anti")
    least = kept.join(again, kept[id] == again["__graphloom_again"], "left_semi")
    first = least.groupBy(id).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), F.struct(F.coalesce(F.col(text), F.lit("")))).alias("__graphloom_row"))
    return once.unionByName(first.select("__graphloom_row.*"))
