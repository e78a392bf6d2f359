"""Token counts by section: a document is encoded once, and its tokens are attributed by their offsets.

The tokenizer is byte-level, so its tokens' bytes make up the document's: adding up their lengths gives each token's span.
Sections are lines, with the line feed that ends them; or, where `fields` names columns, those fields, each followed by a line feed, which
together are the document then. Spans and sections are joined as intervals. A token that crosses a
boundary goes, whole, to one section by the rule:
  first  the section of its first byte
  last   the section of its last byte
  most   the section of most of its bytes, the first among equals
`share` adds up the part of each token's bytes that lie in the section, whatever the rule.

A document has one section at least: null and empty texts have section 0 with no tokens, null fields count as empty. Null and repeated ids are
rows like any other; extra columns are ignored; an empty table has no sections. The counts of a document's sections add up to its tokens.
Texts of any length are encoded whole. A run of more than LONG_RUN white space characters, on which the tokenizer's pattern would run out of
stack, is cut where the pattern would cut it. The vocabulary is read on the driver and broadcast (about a MB).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
PIECE = 4 << 20
LONG_RUN = 100_000
#: What \\s means in PATTERN.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_loaded: dict[bytes, tuple] = {}


def encoder(path: str = VOCABULARY):
    """The encoding, and the bytes of each of its tokens."""
    return _encoder(Path(path).read_bytes())


def _encoder(vocabulary: bytes):
    key = hashlib.blake2b(vocabulary).digest()
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            sizes[k] = len(token)
        _loaded[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[key]


def encoded(encoding, texts: list[str], long: int = LONG_RUN) -> list[list[int]]:
    """Each text's tokens. The pattern takes all of a run of two or more spaces but the last, or all at the end of the text, as one piece: so are long runs cut."""
    runs = re.compile(f"[{SPACE}]{{{long},}}")
    cut = {k: found for k, t in enumerate(texts) if len(t) >= long and (found := [m.span() for m in runs.finditer(t)])}
    out = encoding.encode_ordinary_batch([t for k, t in enumerate(texts) if k not in cut], num_threads=1)
    for k, spans in sorted(cut.items()):
        ids, at = [], 0
        for begin, end in spans:
            stop = end if end == len(texts[k]) else end - 1
            ids += encoding.encode_ordinary(texts[k][at:begin])
            ids += encoding._encode_single_piece(texts[k][begin:stop])
            at = stop
        out.insert(k, ids + encoding.encode_ordinary(texts[k][at:]))
    return out


def attribute(start: np.ndarray, end: np.ndarray, edge: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and shares of each section; edge: where sections begin, and the end of the last. All on one axis."""
    n = len(edge) - 1
    first = np.searchsorted(edge, start, "right") - 1
    last = np.searchsorted(edge, end - 1, "right") - 1
    owner = first if rule == "first" else last if rule == "last" else first.copy()
    share = np.bincount(first[first == last], minlength=n).astype(float)
    for t in np.flatnonzero(first != last):
        parts = np.arange(first[t], last[t] + 1)
        size = np.minimum(edge[parts + 1], end[t]) - np.maximum(edge[parts], start[t])
        share[parts] += size / (end[t] - start[t])
        if rule == "most":
            owner[t] = parts[size.argmax()]
    return np.bincount(owner, minlength=n), share


def counted(documents: DataFrame, id: str = "doc_id", text: str = "text", rule: str = "first", path: str = VOCABULARY, fields: list[str] | None = None) -> DataFrame:
    """A row per section: id, section, its start and end in bytes, tokens by the rule, share."""
    if rule not in RULES:
        raise ValueError(f"{rule!r} is none of {', '.join(RULES)}")
    kind = documents.schema[id].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoder(shared.value)
        for b in batches:
            data, offsets = utf8(b.column(1))
            ends = b.column(2).flatten().to_numpy() if fields else None
            n, lo = len(offsets) - 1, 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
                raw, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                whole = raw.tobytes()
                ids = encoded(encoding, [whole[x:y].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                end = np.cumsum(sizes[np.fromiter((x for row in ids for x in row), np.int64, sum(map(len, ids)))])
                start = np.concatenate([[0], end[:-1]]) if len(end) else end
                if len(end) and end[-1] != len(raw):
                    raise AssertionError("the tokens' bytes aren't the text's")
                if fields:
                    breaks = (at[:-1, None] + ends[lo * len(fields) : hi * len(fields)].reshape(-1, len(fields))).ravel()
                else:
                    breaks = np.flatnonzero(raw == 10) + 1
                edge = np.unique(np.concatenate([at, breaks]))
                tokens, share = attribute(start, end, edge, rule)
                doc = np.searchsorted(at, edge[:-1], "right") - 1
                begin, stop = edge[:-1] - at[doc], edge[1:] - at[doc]
                empty = np.flatnonzero(at[:-1] == at[1:])
                zero = np.zeros(len(empty), np.int64)
                doc, begin, stop, tokens, share = (np.concatenate(x) for x in ((doc, empty), (begin, zero), (stop, zero), (tokens, zero), (share, zero.astype(float))))
                order = np.lexsort((begin, doc))
                doc, begin, stop, tokens, share = doc[order], begin[order], stop[order], tokens[order], share[order]
                section = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(lo + doc)), pa.array(section.astype(np.int32)), pa.array(begin), pa.array(stop), pa.array(tokens), pa.array(share.round(6))],
                    ["i", "section", "start", "end", "tokens", "share"],
                )
                lo = hi

    columns = [F.col(id).alias("i"), F.col(text).cast("string").alias("t")]
    if fields:
        parts = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n")) for c in fields]
        columns = [F.col(id).alias("i"), F.concat(*parts).alias("t"), F.array(*[sum((F.octet_length(p).cast("long") for p in parts[: k + 1]), F.lit(0)) for k in range(len(parts))]).alias("e")]
    return documents.select(*columns).mapInArrow(run, f"`{id}` {kind}, section int, start long, end long, tokens long, share double")
