"""Masked pseudo-likelihood scores of documents.

A word's probability is predicted from RADIUS words on either side by a window network: a table per place looks the
neighbours up and their sum passes a tanh; a class of words and then the word in it are two softmax layers. A document's score is the
sum of its words' conditional log-probabilities, each word being masked in turn.

Outputs are the commonest words of the whole corpus, hash buckets that share the others (a quarter of the outputs), and the
document's edge (a neighbour only). Their number grows with the fourth root of the corpus' words (`width`): a partition sends its whole
network to be averaged, which has to stay small beside the text that it reads. A word in a bucket has the bucket's probability times its
own share of the bucket's count, so every word of the corpus has its own probability. Word counts come from all documents; scoring has
those of the commonest words at hand, as many count classes as KNOWN words allow, and joins the documents' other words with the rest.

Training is distributed. Every document is trained on once, in one of ROUNDS rounds by a hash of its text; in each, every partition starts from
the same weights, runs Adagrad over its own documents of that round, and the weights are averaged by words trained on, in two
levels, so that a group holds the square root of the partitions' number.

Null, empty and wordless texts have 0 words, log-likelihood 0 and a null mean. Null and repeated ids are rows like any
other; extra columns are ignored. A corpus without words leaves the network as it starts. Weights depend on how the input is
partitioned, in the last digits of the scores.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Words, cut, pieces, utf8

RADIUS = 2
CLASSES = 32
PER_CLASS = 32
OUTPUTS = CLASSES * PER_CLASS
BUCKETS = 255
COMMON = OUTPUTS - 1 - BUCKETS
EDGE = OUTPUTS - 1
#: Words besides the outputs whose counts every task has in memory.
KNOWN = 1 << 20
HIDDEN = 32
ROUNDS = 2
RATE = 0.1
BATCH = 8192
#: Softmax inputs stay within this.
LARGEST = 60.0
BLOCK = 1 << 12
PLACES = [x for x in range(-RADIUS, RADIUS + 1) if x]


def width(words: int) -> int:
    """Classes, and words per class, for a corpus of so many words."""
    return max(CLASSES, math.ceil(4 * words**0.125))


class Vocabulary:
    def __init__(self, common: list[int], outputs: int = OUTPUTS, more: np.ndarray | None = None, shares: np.ndarray | None = None):
        """common: hashes of the commonest words, commonest first. more: sorted hashes of others, with the logarithms of their shares of their buckets."""
        h = np.array(common, np.int64).view(np.uint64)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.edge = outputs - 1
        self.buckets = outputs // 4 - 1
        self.common = self.edge - self.buckets
        self.more = np.zeros(0, np.uint64) if more is None else more
        self.shares = np.zeros(0) if shares is None else shares

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = self.common + ((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int32)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            known = self.sorted[at] == h
            out[known] = self.order[at[known]]
        return out

    def within(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each word's share of its output (0 where it isn't known here), and whether it is missing."""
        out, missing = np.zeros(len(h)), ids >= self.common
        if len(self.more):
            rare = np.flatnonzero(missing)
            at = np.minimum(np.searchsorted(self.more, h[rare]), len(self.more) - 1)
            known = self.more[at] == h[rare]
            out[rare[known]] = self.shares[at[known]]
            missing[rare[known]] = False
        return out, missing


class Network:
    def __init__(self, counts: np.ndarray, seed: int = 3):
        """counts: of each output, for the softmax layers' first biases; a square number of them."""
        r = np.random.default_rng(seed)
        self.classes = self.per = math.isqrt(len(counts))
        p = (counts + 1.0).reshape(self.classes, self.per)
        self.look = r.normal(0, 0.1, (len(PLACES), len(counts), HIDDEN)).astype(np.float32)
        self.bias = np.zeros(HIDDEN, np.float32)
        self.to_class = r.normal(0, 0.01, (HIDDEN, self.classes)).astype(np.float32)
        self.class_bias = np.log(p.sum(1) / p.sum()).astype(np.float32)
        self.to_word = r.normal(0, 0.01, (self.classes, HIDDEN, self.per)).astype(np.float32)
        self.word_bias = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.look, self.bias, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for x in self.parts():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def _forward(self, around: np.ndarray, word: np.ndarray, gradient: bool):
        """Scores of the words sorted by class, that order, and the gradients."""
        kind = (word // self.per).astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        kind, word, around = kind[order], word[order], around[:, order]
        edges = np.searchsorted(kind, np.arange(self.classes + 1))
        h = self.look[0].take(around[0], axis=0)
        h += self.bias
        for k in range(1, len(PLACES)):
            h += self.look[k].take(around[k], axis=0)
        np.tanh(h, out=h)
        a = h @ self.to_class
        a += self.class_bias
        score, inverse = self._softmax(a, kind)
        if gradient:
            a *= inverse[:, None]
            a[np.arange(len(word)), kind] -= 1
            back = a @ self.to_class.T
            g = [h.T @ a, a.sum(0), np.zeros_like(self.to_word), np.zeros_like(self.word_bias)]
        own = word - kind.astype(np.int64) * self.per
        for c in range(self.classes):
            lo, hi = edges[c], edges[c + 1]
            if lo < hi:
                x = h[lo:hi]
                b = x @ self.to_word[c]
                b += self.word_bias[c]
                more, inverse = self._softmax(b, own[lo:hi])
                score[lo:hi] += more
                if gradient:
                    b *= inverse[:, None]
                    b[np.arange(hi - lo), own[lo:hi]] -= 1
                    back[lo:hi] += b @ self.to_word[c].T
                    g[2][c], g[3][c] = x.T @ b, b.sum(0)
        if not gradient:
            return score, order, None
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        return score, around, (back, g)

    @staticmethod
    def _softmax(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities at the given columns, and the inverse of each row's sum; a becomes its exponential."""
        np.clip(a, -LARGEST, LARGEST, out=a)
        score = a[np.arange(len(a)), at]
        np.exp(a, out=a)
        total = a @ np.ones(a.shape[1], np.float32)
        score -= np.log(total)
        return score, 1 / total

    def score(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log-probability of each word, given its neighbours (a row per place)."""
        out = np.zeros(len(word), np.float32)
        for k in range(0, len(word), BLOCK * 4):
            score, order, _ = self._forward(around[:, k : k + BLOCK * 4], word[k : k + BLOCK * 4], False)
            out[k + order] = score
        return out

    def gradients(self, around: np.ndarray, word: np.ndarray, sparse: bool = False) -> list:
        """Of the summed negative log-probability; sparse: of the tables, for each place the rows looked up and theirs."""
        _, around, (back, g) = self._forward(around, word, True)
        small = np.uint16 if self.look.shape[1] <= 1 << 16 else np.int32  # sorts faster
        tables = []
        for k in range(len(PLACES)):
            order = np.argsort(around[k].astype(small), kind="stable")
            ids = around[k][order]
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            tables.append((ids[first], np.add.reduceat(back.take(order, axis=0), first, axis=0)))
        if sparse:
            return [tables, back.sum(0), *g]
        look = np.zeros_like(self.look)
        for k, (rows, x) in enumerate(tables):
            look[k][rows] = x
        return [look, back.sum(0), *g]

    def train(self, around: np.ndarray, word: np.ndarray, state: list[np.ndarray], rate: float = RATE) -> None:
        for k in range(0, len(word), BATCH):
            n = len(word[k : k + BATCH])
            look, *rest = self.gradients(around[:, k : k + BATCH], word[k : k + BATCH], sparse=True)
            steps = [(self.look[p], g, state[0][p], rows) for p, (rows, g) in enumerate(look)]
            for x, g, s, rows in [*steps, *((x, g, s, None) for x, g, s in zip(self.parts()[1:], rest, state[1:], strict=True))]:
                g /= n
                if rows is None:
                    s += g * g
                    x -= rate * g / (np.sqrt(s) + 1e-6)
                else:  # where the gradient is 0 nothing would change
                    s[rows] = now = s[rows] + g * g
                    x[rows] -= rate * g / (np.sqrt(now) + 1e-6)


def neighbours(ids: np.ndarray, words: Words, edge: int = EDGE) -> np.ndarray:
    """The ids around each word, a row per place; `edge` outside its document."""
    lo = np.repeat(words.lo, words.hi - words.lo)
    hi = np.repeat(words.hi, words.hi - words.lo)
    at = np.arange(len(ids))
    out = np.full((len(PLACES), len(ids)), edge, np.int32)
    for k, x in enumerate(PLACES):
        inside = (at + x >= lo) & (at + x < hi)
        out[k][inside] = ids[(at + x)[inside]]
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def whole(parts):
        h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        h, at = np.unique(h, return_inverse=True)
        return h, np.bincount(at, n, len(h)).astype(np.int64)

    def rows(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["w", "n"])

    parts, size = [], 0
    for b in batches:
        data, offsets = utf8(b.column(0))
        for _, _, words in pieces(data, offsets):
            h, n = np.unique(words.hash, return_counts=True)
            parts.append((h, n))
            size += len(h)
            if size > 1_000_000:
                parts = [whole(parts)]
                size = len(parts[0][0])
                if size > 500_000:
                    yield rows(*parts[0])
                    parts, size = [], 0
    if parts:
        yield rows(*whole(parts))


def _trainer(vocabulary: Vocabulary, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(np.zeros(vocabulary.edge + 1)).load(weights)
        state = [np.zeros_like(x) for x in net.parts()]
        seen = 0
        for b in batches:
            data, offsets = utf8(b.column(0))
            for _, _, words in pieces(data, offsets):
                ids = vocabulary.ids(words.hash)
                net.train(neighbours(ids, words, vocabulary.edge), ids, state)
                seen += len(ids)
        if seen:
            flat, part = net.flat(), TaskContext.get().partitionId()
            blocks = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([float(seen)] * n), pa.array(blocks, pa.binary())], ["k", "g", "n", "v"])

    return run


def _average(rows: pa.Table) -> pa.Table:
    n = rows.column("n").to_numpy()
    v = np.stack([np.frombuffer(x, np.float32) for x in rows.column("v").to_pylist()])
    mean = (v * (n / n.sum())[:, None]).sum(0).astype(np.float32)
    return pa.table([pa.array([rows.column("k")[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([n.sum()]), pa.array([mean.tobytes()], pa.binary())], names=["k", "g", "n", "v"])


def fitted(documents: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    return _fitted(documents, text, rounds)[:2]


def _fitted(documents: DataFrame, text: str, rounds: int) -> tuple[Vocabulary, np.ndarray, DataFrame, np.ndarray]:
    """Vocabulary, weights, the count of every word (w, n), and that of every output."""
    texts = documents.select(F.col(text).cast("string").alias("t")).where("t is not null")
    counts = cut(texts.mapInArrow(_tally, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    outputs = width(counts.agg(F.sum("n").alias("n")).first()["n"] or 0) ** 2
    sizes = Vocabulary([], outputs)
    common = [(x["w"], x["n"]) for x in counts.orderBy(F.desc("n"), "w").limit(sizes.common).collect()]
    vocabulary = Vocabulary([w for w, _ in common], outputs)
    every_bucket = {x["b"]: x["n"] for x in counts.groupBy(_bucket(vocabulary).alias("b")).agg(F.sum("n").alias("n")).collect()}
    prior = np.zeros(outputs)
    prior[: len(common)] = [n for _, n in common]
    for k, n in every_bucket.items():
        prior[vocabulary.common + k] = n
    for w, n in common:
        prior[vocabulary.common + (w % 2**64 >> 20) % vocabulary.buckets] -= n
    weights = Network(prior).flat()
    groups = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    schema = "k int, g int, n double, v binary"
    for k in range(rounds):
        trained = texts.where(F.pmod(F.xxhash64("t"), F.lit(rounds)) == k).mapInArrow(_trainer(vocabulary, weights), schema)
        half = trained.withColumn("g", F.pmod("g", F.lit(groups))).groupBy("k", "g").applyInArrow(_average, schema)
        new = half.groupBy("k").applyInArrow(_average, schema).collect()
        if new:
            weights = np.concatenate([np.frombuffer(x["v"], np.float32) for x in sorted(new, key=lambda x: x["k"])])
    return vocabulary, weights, counts, prior


def _bucket(vocabulary: Vocabulary):
    return F.pmod(F.shiftrightunsigned("w", 20), F.lit(vocabulary.buckets))


def scored(documents: DataFrame, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """A row per document: id, words, summed log-probability, and its mean."""
    spark = documents.sparkSession
    vocabulary, weights, counts, prior = _fitted(documents, text, rounds)
    rare = counts.join(F.broadcast(spark.createDataFrame([(int(w),) for w in vocabulary.sorted.view(np.int64)], "w long")), "w", "left_anti")
    # whole classes of counts, from the highest down: no sort, and no task that all of them meet in
    classes = rare.groupBy(F.floor(F.log2("n") * 16).alias("c")).count().orderBy(F.desc("c")).collect()
    fit = sum(x <= known for x in itertools.accumulate(x["count"] for x in classes))
    top = rare.where(F.floor(F.log2("n") * 16) >= classes[fit - 1]["c"] if fit else F.lit(False)).toArrow()
    w, n = top.column("w").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(w)
    w, n = w[order], n[order]
    vocabulary = Vocabulary(vocabulary.sorted[np.argsort(vocabulary.order)].view(np.int64).tolist(), vocabulary.edge + 1, w, np.log(n / prior[vocabulary.ids(w)]))
    kind = documents.schema[id].dataType.simpleString()
    model = spark.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = model.value
        net = Network(np.zeros(vocabulary.edge + 1)).load(weights)
        for b in batches:
            data, offsets = utf8(b.column(1))
            count, total, others = [np.zeros(0, np.int64)], [np.zeros(0)], []
            for _, _, words in pieces(data, offsets):
                c, t, missing = document_scores(net, vocabulary, words)
                count.append(c)
                total.append(t)
                at = words.hash.view(np.int64)[missing]
                edge = np.concatenate([[0], np.cumsum(missing)])
                others += [at[a:b] for a, b in zip(edge[words.lo].tolist(), edge[words.hi].tolist(), strict=True)]
            c, t = np.concatenate(count), np.concatenate(total)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c), pa.array(t), pa.array(others, pa.list_(pa.int64()))], ["i", "c", "s", "o"])

    rows = documents.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"i {kind}, c long, s double, o array<long>")
    if fit < len(classes):
        rows = cut(rows.withColumn("r", F.monotonically_increasing_id()))
        filled = spark.createDataFrame([(k, float(x)) for k, x in enumerate(prior[vocabulary.common : vocabulary.edge])], "b long, all double")
        share = rare.join(F.broadcast(filled), _bucket(vocabulary) == F.col("b")).select("w", F.log(F.col("n") / F.col("all")).alias("x"))
        more = rows.select("r", F.explode("o").alias("w")).groupBy("r", "w").count().join(share, "w").groupBy("r").agg(F.sum(F.col("count") * F.col("x")).alias("x"))
        rows = rows.join(more, "r", "left").withColumn("s", F.col("s") + F.coalesce("x", F.lit(0.0)))
    return rows.select(F.col("i").alias(id), F.col("c").alias("words"), F.round("s", 4).alias("log_likelihood"), F.when(F.col("c") > 0, F.round(F.col("s") / F.col("c"), 6)).alias("mean"))


def document_scores(net: Network, vocabulary: Vocabulary, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and summed log-probability of each document; of words that the vocabulary hasn't, which are told, that of their buckets."""
    ids = vocabulary.ids(words.hash)
    shares, missing = vocabulary.within(words.hash, ids)
    every = net.score(neighbours(ids, words, vocabulary.edge), ids) + shares
    sums = np.concatenate([[0.0], np.cumsum(every)])
    return (words.hi - words.lo).astype(np.int64), sums[words.hi] - sums[words.lo], missing
