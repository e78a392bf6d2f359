"""Language identification by cross-parsing entropy.

A suffix automaton per language is built from a bounded sample of labelled text. A document is cross-parsed
against each: the longest match from the current symbol is one phrase, the next begins after it. The language
with the fewest normalised phrases (phrases * log2 of the reference's length) wins; divided by the document's
symbols this estimates the cross-entropy. Documents are parsed whole, in segments of SEGMENT symbols, all
segments of a batch in lockstep through a dense transition table.

A document is rejected if no language explains it: if its bits, each segment in the language that explains it best, so that documents in
several known languages stay, lie more than SHARE of the way from what text of
that language usually needs (the median over all its labelled documents of HELD_SYMBOLS characters or more that aren't in the reference)
to what the same texts need with their characters shuffled; further where few symbols make the estimate uncertain; and in any case beyond
MOST_BITS, the only limit of a language with no such documents. Documents of the reference are scored against it like others and need few bits.

Null, empty and letterless texts are rejected with a null language. Ties go to the first language by name. Null and
repeated ids are rows like any other; extra columns are ignored. Without any labelled text every document is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.automaton import SuffixAutomaton
from graphloom.llm.common import WORD, fold, lean, utf8

SEGMENT = 512
#: Bound of the labelled sample: documents per language, and symbols per language that all of them give together.
SAMPLE_DOCS = 64
SAMPLE_SYMBOLS = 16_384
#: A document is rejected if its winning language needs more bits a symbol.
MOST_BITS = 7.5
#: Of the way from usual to shuffled text, and how much more for few symbols: SHARE * (1 + LOOSE / sqrt(symbols)).
SHARE, LOOSE = 0.8, 6.0
#: Characters of a held-out text at least, steps of a bit in which their bits are counted, and bytes of them that are worked on at once.
HELD_SYMBOLS = 100
STEPS = 10_000
HELD_PIECE = 1 << 20
#: Characters that are shuffled with one another.
SHUFFLE = 1 << 16
PIECE = 4 << 20
_parsers: dict[tuple, "CrossParser"] = {}
_orders: dict[int, np.ndarray] = {}


def sample(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, symbols: int = SAMPLE_SYMBOLS) -> dict[str, list[str]]:
    """Per language, the labelled texts of the `docs` smallest id hashes, until they give `symbols` characters."""
    return sampled(documents, id, text, lang, docs, symbols)[0]


def sampled(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, symbols: int = SAMPLE_SYMBOLS) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The sample, and the texts of those documents for which it has no room."""
    return _drawn(documents, id, text, lang, docs, symbols)[:2]


def _drawn(documents: DataFrame, id: str, text: str, lang: str, docs: int = SAMPLE_DOCS, symbols: int = SAMPLE_SYMBOLS) -> tuple[dict[str, list[str]], dict[str, list[str]], set[int]]:
    """`sampled`, and the hashes of label and whole text of the documents in the sample."""
    order = Window.partitionBy("l").orderBy("h", "i")
    ids = (
        documents.where(F.col(lang).isNotNull() & F.col(id).isNotNull())
        .select(F.col(lang).cast("string").alias("l"), F.col(id).alias("i"), F.xxhash64(id).alias("h"))
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= docs)
        .select("l", "i", "h")
    )
    wanted = {(x["l"], x["i"]): x["h"] for x in ids.collect()}
    if not wanted:
        return {}, {}, set()
    rows = documents.where(F.col(id).isin(sorted({i for _, i in wanted}))).select(F.col(lang).cast("string").alias("l"), F.col(id).alias("i"), F.left(F.col(text), F.lit(symbols)).alias("t"), _labelled(text, lang).alias("x")).collect()
    out: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    used: set[int] = set()
    for x in sorted((x for x in rows if (x["l"], x["i"]) in wanted and x["t"]), key=lambda x: (x["l"], wanted[x["l"], x["i"]], x["t"])):
        have = out.setdefault(x["l"], [])
        if room := max(0, symbols - sum(map(len, have))):
            have.append(x["t"][:room])
            used.add(x["x"])
        elif x["t"] not in have:
            held.setdefault(x["l"], []).append(x["t"])
    return out, held, used


def _labelled(text: str, lang: str) -> Column:
    return F.xxhash64(F.col(lang).cast("string"), F.col(text).cast("string"))


class CrossParser:
    """Automata of all languages as one table; an entry is the next state's row times 4 plus the phrases that end."""

    def __init__(self, reference: dict[str, list[str]]):
        self.langs = sorted(reference)
        raw = {k: [fold(np.frombuffer(t.encode(), np.uint8)) for t in reference[k]] for k in self.langs}
        letters = np.zeros(256, bool)
        for texts in raw.values():
            for t in texts:
                letters[t] = True
        letters &= WORD
        letters[48:58] = False
        self.classes = np.zeros(256, np.uint8)  # 0: no letter
        self.classes[letters] = np.arange(1, letters.sum() + 1)
        self.other = int(letters.sum()) + 1  # letters that no reference has
        rest = WORD & ~letters
        rest[48:58] = False
        self.classes[rest] = self.other
        self.width = 1 << (self.other).bit_length()
        self.root, tables, self.weight, base = [], [], [], 0
        for k in self.langs:
            texts = [self.symbols(t, np.array([0, len(t)]))[0].tolist() for t in raw[k]]
            m = SuffixAutomaton(texts, least=1 << 30)
            kind = np.int32 if base + len(m.next) * self.width < 1 << 29 else np.int64
            table = np.zeros((len(m.next), self.width), kind)
            start = np.array([m.next[0].get(c, 0) for c in range(self.width)])
            known = start > 0
            table[:] = start
            ended = np.empty(table.shape, np.int8)
            ended[:] = np.where(known, 1, 2)
            ended[0] = np.where(known, 0, 1)
            for s, edges in enumerate(m.next):
                for c, to in edges.items():
                    table[s, c], ended[s, c] = to, 0
            table *= self.width
            table += base
            table *= 4
            table += ended
            tables.append(table.ravel())
            self.root.append(base)
            base += table.size
            self.weight.append(float(np.log2(max(2, sum(map(len, texts))))))
        self.kind = np.int32 if base < 1 << 29 else np.int64
        self.table = np.concatenate(tables).astype(self.kind, copy=False) if tables else np.zeros(0, self.kind)

    def symbols(self, folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, runs of non-letters as one, and the offsets that go with them."""
        c = self.classes[folded]
        stay = np.ones(len(c), bool)
        stay[1:] = (c[1:] != 0) | (c[:-1] != 0)
        stay[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return c[stay], np.concatenate([[0], np.cumsum(stay)])[offsets]

    def _parsed(self, c: np.ndarray, at: np.ndarray, roots: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each segment's document, and its phrases from each of the roots, which are given by document."""
        lanes = -(-np.diff(at) // SEGMENT)
        doc = np.repeat(np.arange(len(at) - 1), lanes)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = at[:-1][doc] + within * SEGMENT
        length = np.minimum(SEGMENT, at[1:][doc] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, doc = begin[order], length[order], doc[order]
        active = np.searchsorted(-length, -np.arange(SEGMENT), "left")
        first = [r.astype(self.kind)[doc] for r in roots]
        state = [r.copy() for r in first]
        count = [np.zeros(len(doc), np.int32) for _ in roots]
        for step in range(SEGMENT):
            m = active[step]
            if not m:
                break
            x = c[begin[:m] + step].astype(self.kind)
            for s, k in zip(state, count, strict=True):
                e = self.table.take(s[:m] + x)
                k[:m] += e & 3
                np.right_shift(e, 2, out=s[:m])
        for r, s, k in zip(first, state, count, strict=True):
            k += s != r
        return doc, count

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each document (rows) in each language, symbols, whether it has any letter, and its bits with each segment in its best language."""
        c, at = self.symbols(fold(data), offsets)
        n = len(at) - 1
        doc, count = self._parsed(c, at, [np.full(n, r) for r in self.root])
        out = np.zeros((n, len(self.langs)), np.int64)
        least = np.full(len(doc), np.inf)
        for j, k in enumerate(count):
            out[:, j] = np.bincount(doc, k, n)
            np.minimum(least, k * self.weight[j], out=least)
        some = np.concatenate([[0], np.cumsum(c != 0)])[at]
        return out, np.diff(at), np.diff(some) > 0, np.bincount(doc, least, n)

    def own_bits(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The bits a symbol that each document needs in the one language given for it."""
        c, at = self.symbols(fold(data), offsets)
        doc, (count,) = self._parsed(c, at, [np.array(self.root)[lang]])
        return np.bincount(doc, count, len(lang)) * np.array(self.weight)[lang] / np.maximum(np.diff(at), 1)


def _parser(reference: dict[str, list[str]]) -> CrossParser:
    key = tuple((k, tuple(map(hash, v))) for k, v in sorted(reference.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(reference)
    return _parsers[key]


def shuffled(text: str) -> str:
    """The text's characters in an order that only their number decides; a long text block by block."""
    out = []
    for lo in range(0, len(text), SHUFFLE):
        part = np.frombuffer(text[lo : lo + SHUFFLE].encode("utf-32-le"), "<u4")
        size = 1 << (len(part) - 1).bit_length()
        if size not in _orders:
            _orders[size] = np.random.default_rng(11).permutation(np.arange(size, dtype=np.int32))
        order = _orders[size]
        out.append(part[order[order < len(part)]].tobytes().decode("utf-32-le"))
    return "".join(out)


def _both_bits(parser: CrossParser, texts: pa.Array, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`own_bits` of texts as they are and with their characters shuffled."""
    data, offsets = utf8(texts)
    n = len(lang)
    out, lo = (np.zeros(n), np.zeros(n)), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + HELD_PIECE, "right")) - 1)
        out[0][lo:hi] = parser.own_bits(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lang[lo:hi])
        mixed = [shuffled(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")) for k in range(lo, hi)]
        out[1][lo:hi] = parser.own_bits(*utf8(pa.array(mixed, pa.large_string())), lang[lo:hi])
        lo = hi
    return out


def usual_bits(reference: dict[str, list[str]], held: dict[str, list[str]]) -> dict[str, tuple[float, float]]:
    """The median bits a symbol that held-out texts of each language need in it, as they are and with their characters shuffled."""
    parser, out = _parser(reference), {}
    for k, name in enumerate(parser.langs):
        texts = [t for t in held.get(name, []) if len(t) >= HELD_SYMBOLS]
        if texts:
            both = [float(np.median(x)) for x in _both_bits(parser, pa.array(texts), np.full(len(texts), k))]
            out[name] = (both[0], max(both))
    return out


def learned(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, symbols: int = SAMPLE_SYMBOLS) -> tuple[dict[str, list[str]], dict[str, tuple[float, float]]]:
    """The sample as reference, and its `usual_bits`, to 1 / STEPS, of all labelled documents whose text isn't in it."""
    reference, _, used = _drawn(documents, id, text, lang, docs, symbols)
    if not reference:
        return {}, {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(reference)
        for b in batches:
            own = pc.index_in(b.column(0), pa.array(parser.langs, b.column(0).type)).to_numpy(zero_copy_only=False)
            for kind, bits in enumerate(_both_bits(parser, b.column(1), own)):
                (k, v), n = np.unique(np.stack([own, np.rint(bits * STEPS).astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(parser.langs, pa.string()).take(pa.array(k)), pa.array(np.full(len(n), kind, np.int32)), pa.array(v), pa.array(n)], ["l", "kind", "v", "n"])

    rest = documents.where(F.col(lang).cast("string").isin(sorted(reference)) & (F.length(F.col(text).cast("string")) >= HELD_SYMBOLS) & ~_labelled(text, lang).isin(sorted(used)))
    counts = rest.select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t")).mapInArrow(lean(run), "l string, kind int, v long, n long")
    median = counts.groupBy("l", "kind", "v").agg(F.sum("n").alias("n")).groupBy("l", "kind").agg(F.expr("percentile(v, 0.5, n)").alias("v"))
    bits = {(x["l"], x["kind"]): x["v"] / STEPS for x in median.collect()}
    return reference, {k: (bits[k, 0], max(bits[k, 0], bits[k, 1])) for k in reference if (k, 0) in bits}


def limits(usual: np.ndarray, size: np.ndarray, most_bits: float = MOST_BITS) -> np.ndarray:
    """The bits a symbol up to which a document of so many symbols is accepted; usual: rows of `usual_bits`, not numbers where there are none."""
    return np.fmin(usual[:, 0] + SHARE * (1 + LOOSE / np.sqrt(np.maximum(size, 1))) * (usual[:, 1] - usual[:, 0]), most_bits)


def identify(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", reference: dict[str, list[str]] | None = None, most_bits: float = MOST_BITS, usual: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A row per document: id, detected language, its phrases and bits a symbol, the runner-up's bits, accepted. A given reference comes with the usual bits of its languages, or has MOST_BITS as its only limit."""
    if reference is None:
        reference, usual = learned(documents, id, text, lang)
    kind = documents.schema[id].dataType
    rows = documents.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(lean(_identifier(reference, usual or {}, most_bits)), f"`{id}` {kind.simpleString()}, detected string, phrases long, bits double, next_bits double, accepted boolean")


def _identifier(reference: dict[str, list[str]], usual: dict[str, tuple[float, float]], most_bits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(reference)
        for b in batches:
            name, count, bits, after, ok = decide(parser, b.column(1), most_bits, usual)
            yield pa.RecordBatch.from_arrays([b.column(0), name, count, bits, after, ok], ["i", "detected", "phrases", "bits", "next_bits", "accepted"])

    return run


def decide(parser: CrossParser, column: pa.Array, most_bits: float, usual: dict[str, tuple[float, float]]) -> tuple[pa.Array, ...]:
    data, offsets = utf8(column)
    n, k = len(offsets) - 1, len(parser.langs)
    count, size, some, mixed = np.zeros((n, k), np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n)
    lo = 0
    while lo < n and k:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        count[lo:hi], size[lo:hi], some[lo:hi], mixed[lo:hi] = parser.phrases(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    if not k:
        none = pa.nulls(n)
        return none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64()), pa.array(np.zeros(n, bool))
    bits = count * np.array(parser.weight) / np.maximum(size, 1)[:, None]
    best = bits.argmin(1)
    least = bits[np.arange(n), best]
    after = np.sort(bits, 1)[:, 1] if k > 1 else np.full(n, np.nan)
    name = np.array(parser.langs, object)[best] if n else np.zeros(0, object)
    most = limits(np.array([usual.get(x, (np.nan, np.nan)) for x in parser.langs])[best], size, most_bits)
    hide = ~some
    return (
        pa.array(name, pa.string(), mask=hide),
        pa.array(count[np.arange(n), best], mask=hide),
        pa.array(least.round(6), mask=hide),
        pa.array(after.round(6), mask=hide | np.isnan(after)),
        pa.array(some & (mixed / np.maximum(size, 1) <= most)),
    )


def accepted(documents: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", most_bits: float = MOST_BITS) -> DataFrame:
    """The documents that some language accepts, with their own columns."""
    reference, usual = learned(documents, id, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(reference)
        for b in batches:
            yield b.filter(decide(parser, b.column(b.schema.get_field_index(text)).cast(pa.string()), most_bits, usual)[-1])

    return documents.mapInArrow(lean(run), documents.schema)
