"""URL filters: allow and block entries in a trie over reversed host labels and then path segments.

An entry is a host, which also holds for its subdomains, or a host and a path, which holds for that very host and the paths
below. The entry with the most labels and segments decides; of an allow and a block entry at the same place, allow. URLs that
no entry matches get the default. Scheme, user, port, query, fragment, empty segments and case of the host don't count;
leading "www." is no exception.

Null, empty and hostless URLs are "invalid" and match nothing. Null and repeated ids are rows like any other, extra columns
are ignored. Without entries every valid URL gets the default.

The trie is broadcast while it has no more than BROADCAST entries. Beyond that, the same parser lists the places in the trie that a
URL could reach, no deeper than the deepest entry, and a shuffled join looks them up, with the same result. URLs of any length and
with any characters, line feeds included, are parsed alike: the scheme ends at the first "://", the host at the first slash after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST = 500_000
ENTRIES = [
    *(("block", f"{name}.example.{end}") for name in ("casino-win", "adult-x", "spam-farm", "cheap-pills", "ads-track", "free-bets") for end in ("com", "net", "org")),
    ("allow", "help.casino-win.example.com"),
    ("block", "tionsh.example.net/de"),
    ("allow", "tionsh.example.net/de/7"),
    ("block", "blog.tionsh.example.net"),
    ("allow", "blog.tionsh.example.net/en"),
]


def split(url: str | None) -> tuple[list[str], list[str]]:
    """Host labels from the right, and path segments; no labels if there is no host."""
    if not url:
        return [], []
    head, mark, rest = url.strip().partition("://")
    if not mark or not head:
        return [], []
    for k, c in enumerate(rest):
        if c in "?#":
            rest = rest[:k]
            break
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower()
    labels = [x for x in host.split(".") if x]
    return labels[::-1], [x for x in path.split("/") if x]


class Trie:
    def __init__(self, entries: list[tuple[str, str]]):
        self.root: dict = {}
        for action, entry in entries:
            if action not in ("allow", "block"):
                raise ValueError(f"{action!r} is neither allow nor block")
            labels, segments = split("any://" + entry)
            if not labels:
                raise ValueError(f"no host in {entry!r}")
            node = self.root
            for x in [*labels, *("/" + s for s in segments)]:
                node = node.setdefault(x, {})
            if node.get("", ("block", ""))[0] == "block":
                node[""] = (action, "/".join([".".join(labels[::-1]), *segments]))

    def match(self, labels: list[str], segments: list[str]) -> tuple[str, str, int] | None:
        """Action, entry and depth of the longest match."""
        node, found, depth = self.root, None, 0
        for x in [*labels, *("/" + s for s in segments)]:
            node = node.get(x)
            if node is None:
                break
            depth += 1
            if "" in node:
                found = (*node[""], depth)
        return found


def filtered(pages: DataFrame, entries: list[tuple[str, str]] = ENTRIES, id: str = "page_id", url: str = "url", default: str = "allow", broadcast: int = BROADCAST) -> DataFrame:
    """A row per page: id, url, verdict (allow, block or invalid), the entry that decided, and its labels and segments."""
    kind = pages.schema[id].dataType.simpleString()
    rows = pages.select(F.col(id).alias("i"), F.col(url).cast("string").alias("u"))
    if len(entries) > broadcast:
        return _joined(rows, entries, default).select(F.col("i").alias(id), F.col("u").alias(url), "verdict", "entry", "depth")
    shared = pages.sparkSession.sparkContext.broadcast(Trie(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            verdict, entry, depth = [], [], []
            for u in b.column(1).to_pylist():
                labels, segments = split(u)
                found = trie.match(labels, segments) if labels else ("invalid", None, 0)
                v, e, d = found or (default, None, 0)
                verdict.append(v)
                entry.append(e)
                depth.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(verdict, pa.string()), pa.array(entry, pa.string()), pa.array(depth, pa.int32())], ["i", "u", "verdict", "entry", "depth"])

    return rows.mapInArrow(run, f"`{id}` {kind}, `{url}` string, verdict string, entry string, depth int")


def _joined(rows: DataFrame, entries: list[tuple[str, str]], default: str) -> DataFrame:
    """The same by join, for tries too large to broadcast: each distinct URL's places in the trie meet the entries, and the deepest that exists decides."""
    places = _entries(entries)
    known = rows.sparkSession.createDataFrame(places, "key string, action string, deep int")
    hosts = max((len(split("any://" + key)[0]) for key, _, _ in places), default=0)
    paths = max((len(split("any://" + key)[1]) for key, _, _ in places), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, keys = [], []
            for u in b.column(0).to_pylist():
                labels, segments = split(u)
                valid.append(bool(labels))
                host = ".".join(labels[::-1])
                keys.append([".".join(labels[:k][::-1]) for k in range(1, min(hosts, len(labels)) + 1)] + ["/".join([host, *segments[:k]]) for k in range(1, min(paths, len(segments)) + 1) if labels])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(valid, pa.bool_()), pa.array(keys, pa.list_(pa.string()))], ["v", "valid", "keys"])

    urls = rows.select(F.col("u").alias("v")).where("v is not null").distinct().mapInArrow(run, "v string, valid boolean, keys array<string>")
    best = urls.select("v", F.explode("keys").alias("key")).join(known, "key").groupBy("v").agg(F.max_by(F.struct("action", "key", "deep"), "deep").alias("best"))
    decided = urls.where("valid").select(F.col("v").alias("w")).join(best, F.col("w") == F.col("v"), "left").select("w", "best")
    verdict = F.when(F.col("w").isNull(), "invalid").otherwise(F.coalesce("best.action", F.lit(default)))
    return rows.join(decided, F.col("u") == F.col("w"), "left").select("i", "u", verdict.alias("verdict"), F.col("best.key").alias("entry"), F.coalesce("best.deep", F.lit(0)).alias("depth"))


def _entries(entries: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """Key, action and depth of each place in the trie."""
    out: list[tuple[str, str, int]] = []
    stack = [(Trie(entries).root, 0)]
    while stack:
        node, depth = stack.pop()
        for x, to in node.items():
            if x == "":
                out.append((to[1], to[0], depth))
            else:
                stack.append((to, depth + 1))
    return out


def oracle_sql(entries: list[tuple[str, str]] = ENTRIES, default: str = "allow") -> str:
    values = ", ".join(f"('{k}', '{a}', {d})" for k, a, d in sorted(_entries(entries)))
    return f"""
WITH known(key, action, deep) AS (VALUES {values}),
trimmed AS (SELECT page_id, url, regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS t FROM pages),
rest AS (SELECT page_id, url, CASE WHEN strpos(t, '://') > 1 THEN regexp_extract(substr(t, strpos(t, '://') + 3), '^[^?#]*') END AS r FROM trimmed),
part AS (SELECT *, list_filter(string_split(lower(regexp_extract(string_split(regexp_extract(r, '^[^/]*'), '@')[-1], '^[^:]*')), '.'), lambda x: x <> '') AS labels,
  list_filter(string_split(CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/') + 1) ELSE '' END, '/'), lambda x: x <> '') AS segments FROM rest),
keys AS (SELECT page_id, url, labels,
  list_concat(list_transform(range(1, len(labels) + 1), lambda k: array_to_string(labels[len(labels) - k + 1:], '.')),
    list_transform(range(1, len(segments) + 1), lambda k: array_to_string(labels, '.') || '/' || array_to_string(segments[1:k], '/'))) AS key FROM part),
found AS (SELECT url, k.key, k.action, k.deep, row_number() OVER (PARTITION BY url ORDER BY k.deep DESC) AS n
  FROM (SELECT DISTINCT url, unnest(key) AS key FROM keys WHERE len(labels) > 0) u JOIN known k ON u.key = k.key)
SELECT p.page_id, p.url, CASE WHEN coalesce(len(p.labels), 0) = 0 THEN 'invalid' ELSE coalesce(f.action, '{default}') END AS verdict,
  f.key AS entry, CAST(coalesce(f.deep, 0) AS INTEGER) AS depth
FROM keys p LEFT JOIN found f ON f.url = p.url AND f.n = 1"""
