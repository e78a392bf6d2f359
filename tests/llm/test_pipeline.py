"""run() against brute-force versions of all five stages, one after another."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from test_operators import SCHEMA, WORD, brute_repeats, brute_signature, near_copies, tokens

import __spark_entry__
import corpus_pipeline
from graphloom.llm import common, decontaminate, language_id, simhash_forest, source_mixing


def known(rows, reference, usual):
    """Phrases by trying every length against the references' texts."""
    parser = language_id.CrossParser(reference)

    def symbols(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return bytes(parser.symbols(common.fold(raw), np.array([0, len(raw)]))[0].tolist())

    refs = {k: [symbols(p) for p in v] for k, v in reference.items()}
    out = []
    for row in rows:
        s = symbols(row[1] or "")
        if not s.strip(b"\0"):
            continue
        best, limit, pieces = math.inf, 0, defaultdict(lambda: math.inf)
        for k, parts in refs.items():
            count, weight = 0, math.log2(sum(map(len, parts)))
            for lo in range(0, len(s), language_id.SEGMENT):
                piece, at, own = s[lo : lo + language_id.SEGMENT], 0, 0
                while at < len(piece):
                    n = 0
                    while at + n < len(piece) and any(piece[at : at + n + 1] in r for r in parts):
                        n += 1
                    at, own = at + max(1, n), own + 1
                count += own
                pieces[lo] = min(pieces[lo], own * weight)
            if (bits := count * weight / len(s)) < best:
                best, limit = bits, min(language_id.MOST_BITS, usual[k][0] + language_id.SHARE * (1 + language_id.LOOSE / math.sqrt(len(s))) * (usual[k][1] - usual[k][0]))
        if sum(pieces.values()) / len(s) <= limit:
            out.append(row)
    return out


def one_each(rows):
    sign = {r[0]: np.frombuffer(s, np.uint64) for r in rows if (s := brute_signature(r[1]))}
    root = {i: i for i in sign}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sign), 2):
        if np.bitwise_count(sign[a] ^ sign[b]).sum() <= simhash_forest.FARTHEST:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def without(text, gone):
    at = [m.span() for m in WORD.finditer(text)]
    runs, out, last = [], [], 0
    for k in sorted(gone):
        if runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1])
    for a, b in runs:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def unrepeated(rows):
    _, later = brute_repeats([r[:2] for r in rows], 50)
    out = [(r[0], without(r[1], later.get(r[0], ())), *r[2:]) for r in rows if len(later.get(r[0], ())) < len(tokens(r[1]))]
    return [(*r[:4], len(r[1]) if r[0] in later else r[4]) for r in out]


def unleaked(rows, items):
    out = []
    for r in rows:
        t, gone = tokens(r[1]), set()
        for q in (tokens(x) for x in items):
            n = next((n for n in range(len(q), decontaminate.LONGEST - 1, -1) if any(t[a : a + n] == q[s : s + n] for a in range(len(t) - n + 1) for s in range(len(q) - n + 1))), 0)
            if n:  # planted whole or not at all here
                at = next(a for a in range(len(t)) if t[a : a + n] == q[:n])
                gone |= set(range(at, at + n))
        if len(gone) < len(t):
            out.append((*r[:1], text := without(r[1], gone), *r[2:4], len(text) if gone else r[4]))
    return out


def mixture(rows):
    n = {r[0]: len(r[1].split()) for r in rows}
    cells = defaultdict(float)
    for i, _, lang, source, _ in rows:
        cells[source, lang] += n[i]
    rate, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    goals = []
    for side in (0, 1):
        tokens_of = defaultdict(float)
        for c, x in cells.items():
            tokens_of[c[side]] += x
        goals.append(source_mixing.targets(tokens_of))
    for _ in range(800):
        for side, goal in enumerate(goals):
            for k, share in goal.items():
                now = sum(cells[c] * rate[c] for c in cells if c[side] == k)
                for c in cells:
                    if c[side] == k:
                        rate[c] *= share * total / now
    low = min(rate.values())
    return {r[0]: rate[r[3], r[2]] / low for r in rows}


def test_run(spark, corpus, tmp_path):
    base, words = corpus
    lang = {i: x for i, _, x, _, _ in base}
    source = {i: s for i, _, _, s, _ in base}
    items = [words("en", 30), words("en", 25)]
    passage = words("en", 70)
    rows = []
    for i, text in near_copies(corpus, groups=4, copies=4):
        if i in (3, 40):
            text += " " + items[i % 2]
        if i in (10, 20, 30):
            text = passage + ".\n" + text
        rows.append((i, text, lang.get(i, "en"), source.get(i, "s1"), len(text)))
    rows += [(5000, passage, "en", "s0", len(passage)), (5001, "", "en", "s0", 0), (5002, None, "en", "s0", None), (5003, "你好世界这是中文", "en", "s0", 8), (5004, "nopea ruskea kettu hyppää laiskan koiran yli " * 9, None, "s0", 396)]
    d = spark.createDataFrame(rows, SCHEMA)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    reference, held = language_id.sampled(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    usual = language_id.usual_bits(reference, held)
    accepted = known(rows, reference, usual)
    assert set(usual) == {"en", "de", "fr", "es"} and {r[0] for r in rows} - {r[0] for r in accepted} == {5001, 5002, 5003, 5004}
    want = unleaked(unrepeated(one_each(accepted)), items)
    assert 150 < len(want) < len(rows) - 12
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(x)[:5] for x in got) == sorted(want)
    rate = mixture(want)
    for x in got:
        assert x["mix_rate"] == pytest.approx(rate[x["doc_id"]], rel=1e-5)
        assert x["mix_copies"] in (int(x["mix_rate"]), int(x["mix_rate"]) + 1)
    for item in items:
        assert not any(item in x["text"] for x in got)


def test_entry_has_them():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{k}_") for x in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
