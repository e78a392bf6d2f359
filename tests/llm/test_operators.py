"""Each operator against brute force, an exact round trip or held-out data."""

import itertools
import json
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, decontaminate, language_id, license_scan, pseudo_likelihood, quality_rules, simhash_forest, source_mixing, substring_dedup, token_counts, url_filter
from graphloom.llm.automaton import SuffixAutomaton

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def tokens(text):
    return [w.lower() for w in WORD.findall(text or "")]


def words_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return common.Words(raw, np.array([0, len(raw)]))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_words_and_hashes():
    texts = ["", "one Two,three", "ÉTÉ été", "x", "  ", "Übung übung"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    w = common.Words(np.frombuffer(data, np.uint8), offsets)
    assert (w.hi - w.lo).tolist() == [0, 3, 2, 1, 0, 2]
    assert w.hash[3] == w.hash[4] and w.hash[6] == w.hash[7] and len(set(w.hash.tolist())) == 6
    h = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64)
    for n in (1, 2, 3, 7, 50):
        seen = {h[k : k + n].tobytes(): x for k, x in enumerate(common.join(h, n))}
        assert len(common.join(h, n)) == 201 - n and len(set(seen.values())) == len(seen)
    twice = np.concatenate([h, h])
    assert (common.join(twice, 50)[:151] == common.join(twice, 50)[200:351]).all()
    assert common.without("héllo wörld".encode(), [(0, 6), (3, 7)]) == "wörld"


def test_word_hashes_depend_on_order_and_not_on_the_process():
    assert len(set(common.hashes_of("listen silent enlist tinsel"))) == 4
    before = common.hashes_of("some words")
    common.hashes_of("x" * 5000)
    assert common.hashes_of("some words") == before
    a, b = (words_of(t).grams(2)[0].tolist() for t in ("one two", "two one"))
    assert a != b
    fresh = subprocess.run([sys.executable, "-c", "from graphloom.llm import common; print(common.hashes_of('some words'))"], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert json.loads(fresh.stdout) == before


def test_automaton():
    r = random.Random(3)
    for _ in range(60):
        sequences = [[r.choice("ab") for _ in range(r.randint(0, 9))] for _ in range(3)]
        m = SuffixAutomaton(sequences, least=1)
        text = [r.choice("abc") for _ in range(12)]

        def where(part):
            return {(k, s, s + len(part)) for k, q in enumerate(sequences) for s in range(len(q) - len(part) + 1) if q[s : s + len(part)] == part}

        for k, (n, state) in enumerate(m.matching(text)):
            best = max(x for x in range(k + 2) if x == 0 or where(text[k + 1 - x : k + 1]))
            assert n == best
            if n:
                assert {(q, s, e) for q in range(3) for s, e in m.occurrences(state, n, q)} == where(text[k + 1 - n : k + 1])


# 1


def test_url_filter_against_every_prefix(spark):
    r = random.Random(1)
    hosts = [".".join(r.choice("abc") for _ in range(n)) for n in (1, 2, 3, 3, 2)]
    rules = [(r.choice(["allow", "block"]), h + "".join("/" + r.choice("xyz") for _ in range(r.randint(0, 2)))) for h in hosts * 3]
    urls = [f"http://{'.'.join(r.choice('abc') for _ in range(r.randint(1, 4)))}/{'/'.join(r.choice('xyz') for _ in range(r.randint(0, 3)))}" for _ in range(200)]
    best = {}
    for action, rule in rules:
        if best.get(rule) != "allow":
            best[rule] = action

    def brute(url):
        host, _, path = url[7:].partition("/")
        labels, parts = host.split("."), [p for p in path.split("/") if p]
        keys = [".".join(labels[k:]) for k in range(len(labels) - 1, -1, -1)] + [host + "".join("/" + p for p in parts[:k]) for k in range(1, len(parts) + 1)]
        found = [k for k in keys if k in best]
        return best[found[-1]] if found else "allow"

    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for limit in (1000, 0):
        got = {x["page_id"]: x["verdict"] for x in url_filter.filtered(d, rules, broadcast=limit).collect()}
        assert got == {k: brute(u) for k, u in enumerate(urls)}


# 2


def brute_repeats(rows, window):
    seen, again, later = {}, defaultdict(set), defaultdict(set)
    for i, text in sorted(rows):
        t = tokens(text)
        for k in range(len(t) - window + 1):
            g = tuple(t[k : k + window])
            if g in seen:
                j, m = seen[g]
                again[j].update(range(m, m + window))
                again[i].update(range(k, k + window))
                later[i].update(range(k, k + window))
            else:
                seen[g] = (i, k)
    return again, later


@pytest.mark.parametrize("hot,bucket,window,seed", [(50_000, 400_000, 50, 8), (2, 300, 50, 8), (50_000, 5_000, 12, 3), (1, 1, 5, 5)])
def test_substring_dedup(spark, corpus, hot, bucket, window, seed):
    rows, words = corpus
    rows = [r[:2] for r in rows[:60]]
    passage = words("en", 60)
    rows = [(i, t + " " + passage if i % 7 == 0 else passage.upper() + "\n" + t if i % 11 == 0 else t) for i, t in rows]
    rows += [(100, rows[5][1]), (101, "same word again " * 60), (102, "same word again " * 20)]
    d = frame(spark, [(i, t, "en", "a", len(t)) for i, t in rows])
    again, later = brute_repeats(rows, window)
    of = {i: tokens(t) for i, t in rows}
    counts = Counter(tuple(t[k : k + window]) for t in of.values() for k in range(len(t) - window + 1))
    got = {x["doc_id"]: x for x in substring_dedup.repeats(d, window=window, seed=seed, hot=hot, bucket=bucket).collect()}
    assert set(got) == set(again)
    for i, x in got.items():
        assert {k for s in x["repeated"] for k in range(s["start"], s["end"])} == again[i]
        assert {k for s in x["removed"] for k in range(s["start"], s["end"])} == later.get(i, set())
        assert x["removed_words"] == len(later.get(i, ()))
        times = {k: n for k in again[i] if (n := counts[tuple(of[i][k : k + window])]) > 1}
        for s in x["repeated"]:
            assert s["copies"] == max(n for k, n in times.items() if s["start"] <= k and k + window <= s["end"])
    clean = {x["doc_id"]: x for x in substring_dedup.cleaned(d, window=window, seed=seed, hot=hot, bucket=bucket).collect()}
    for i, t in rows:
        left = [w for k, w in enumerate(tokens(t)) if k not in later.get(i, ())]
        assert (i in clean) == bool(left)
        if left:
            assert tokens(clean[i]["text"]) == left and clean[i]["n_chars"] == len(clean[i]["text"])
        if i not in later:
            assert clean[i]["text"] == t


def test_a_passage_in_most_documents(spark, corpus):
    """A hot minimiser's windows are counted without a bucket of their own; rows that repeat id and text count once."""
    rows, words = corpus
    passage = words("en", 80)
    d = frame(spark, [(i, f"{t} {passage} end{i}", "en", "a", 0) for i, t, *_ in rows] + [(0, f"{rows[0][1]} {passage} end0", "en", "a", 0), (None, passage, "en", "a", 0)])
    cold, got = ({x["doc_id"]: x for x in substring_dedup.repeats(d, hot=hot).collect()} for hot in (100_000, 50))
    assert got == cold and len(got) == len(rows) + 1
    assert all(x["repeated_words"] >= 80 and max(s["copies"] for s in x["repeated"]) == len(rows) + 1 for x in got.values())
    assert {i for i, x in got.items() if x["removed_words"] < 80} == {0}


# 3


def test_cross_parsing(corpus):
    rows, _ = corpus
    reference = {k: [t for _, t, lang, _, _ in rows[:40] if lang == k] for k in ("de", "en", "fr")}
    parser = language_id.CrossParser(reference)

    def symbols(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return parser.symbols(common.fold(raw), np.array([0, len(raw)]))[0].tolist()

    def brute(text, parts):
        refs = [bytes(symbols(p)) for p in parts]
        s, count = bytes(symbols(text)), 0
        for lo in range(0, len(s), language_id.SEGMENT):
            piece, k = s[lo : lo + language_id.SEGMENT], 0
            while k < len(piece):
                n = 0
                while k + n < len(piece) and any(piece[k : k + n + 1] in r for r in refs):
                    n += 1
                k += max(1, n)
                count += 1
        return count

    texts = [rows[k][1] for k in range(40, 60)] + ["", "ß?", "!!", "xyzzy 42 Ωmega", "The " * 700]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got, size, some, mixed = parser.phrases(np.frombuffer(data, np.uint8), offsets)
    assert got.tolist() == [[brute(t, reference[k]) for k in parser.langs] for t in texts]
    for k, t in enumerate(texts):
        pieces = [symbols(t)[lo : lo + language_id.SEGMENT] for lo in range(0, len(symbols(t)), language_id.SEGMENT)]
        if len(pieces) == 1:
            assert mixed[k] == pytest.approx(min(n * w for n, w in zip(got[k], parser.weight, strict=True)))
        assert mixed[k] <= min(n * w for n, w in zip(got[k], parser.weight, strict=True)) + 1e-9
    assert size.tolist() == [len(symbols(t)) for t in texts] and some.tolist()[-5:] == [False, True, False, True, True]


def test_languages_of_held_out_documents(spark, corpus):
    rows, _ = corpus
    d = frame(spark, rows)
    reference = language_id.sample(d.where("doc_id < 80"), docs=10)
    assert all(len(v) <= 10 and sum(map(len, v)) <= language_id.SAMPLE_SYMBOLS for v in reference.values())
    got = language_id.identify(d.where("doc_id >= 80"), reference=reference).join(d, "doc_id").collect()
    assert sum(x["detected"] == x["lang"] for x in got) / len(got) >= 0.95
    assert all(x["accepted"] for x in got)


def test_other_languages_are_rejected(spark, corpus):
    rows, _ = corpus
    finnish = "Nopea ruskea kettu hyppää laiskan koiran yli samalla kun aurinko laskee kukkuloiden taakse ja linnut laulavat metsässä"
    d = frame(spark, rows + [(900, "привет мир это текст на другом языке", None, "a", 1), (901, "zxqj vkwq pfgx qqxz wvkj jjkq xzzv", None, "a", 1), (902, finnish, None, "a", 1)])
    kept = {x["doc_id"] for x in language_id.accepted(d).collect()}
    assert kept == {r[0] for r in rows}


def test_limits_follow_held_out_text(spark, corpus):
    rows, _ = corpus
    reference, held = language_id.sampled(frame(spark, rows), symbols=2000)
    assert all(set(held[k]).isdisjoint(v) for k, v in reference.items())
    usual = language_id.usual_bits(reference, held)
    assert set(usual) == set(reference)
    assert all(x < y for x, y in usual.values())
    english, german = (" ".join(t for _, t, lang, *_ in rows if lang == x)[:1536] for x in ("en", "de"))
    parser = language_id.CrossParser(reference)
    *_, both = parser.phrases(*common.utf8(pa.array([english, german, english + " " + german])))
    assert both[2] < 1.1 * (both[0] + both[1])
    most = language_id.limits(np.array([(2.0, 8.0), (2.0, 8.0), (np.nan, np.nan), (7.0, 9.0)]), np.array([10**8, 100, 100, 100]))
    assert most.tolist() == pytest.approx([6.8, 7.5, language_id.MOST_BITS, language_id.MOST_BITS], abs=0.01)


def test_limits_come_from_all_labelled_documents(spark, corpus):
    _, words = corpus
    langs = ("de", "en", "es", "fr")
    rows = [(k, words(langs[k % 4], 18 + k % 7), langs[k % 4], "a", 0) for k in range(480)]
    text = words("fr", 600)
    d = frame(spark, rows + [(900, "".join(random.Random(7).sample(text, len(text))), None, "a", 0), (901, text, None, "a", 0)])
    reference, usual = language_id.learned(d)
    assert all(len(v) == language_id.SAMPLE_DOCS and sum(map(len, v)) < language_id.SAMPLE_SYMBOLS for v in reference.values())
    parser = language_id.CrossParser(reference)
    for k, name in enumerate(parser.langs):
        rest = [t for _, t, x, *_ in rows if x == name and len(t) >= language_id.HELD_SYMBOLS and t not in reference[name]]
        for column, texts in zip(usual[name], (rest, [language_id.shuffled(t) for t in rest]), strict=True):
            count, size, *_ = parser.phrases(*common.utf8(pa.array(texts)))
            assert column == pytest.approx(np.median(count[:, k] * parser.weight[k] / size), abs=1 / language_id.STEPS)
    got = {x["doc_id"]: x["accepted"] for x in language_id.identify(d).collect()}
    assert not got[900] and got[901] and sum(got.values()) >= 0.99 * len(rows)
    assert {x["doc_id"]: x["accepted"] for x in language_id.identify(d.repartition(7)).collect()} == got
    assert {x["doc_id"] for x in language_id.accepted(d).collect()} == {i for i, ok in got.items() if ok}


def test_shuffled_text_keeps_its_characters():
    for t in ("", "a", "zażółć 日本 \U0001f600 gęślą", "ab" * 70_000):
        assert sorted(language_id.shuffled(t)) == sorted(t) and language_id.shuffled(t) == language_id.shuffled(t)
    assert language_id.shuffled("the quick brown fox") != "the quick brown fox"


# 4


def test_decontaminate(spark, corpus):
    rows, words = corpus
    r = random.Random(8)
    items = [(k, words("en", r.randint(6, 40))) for k in range(30)]
    docs = []
    for i, text, *_ in rows[:80]:
        t, plant = text.split(), None
        if i % 2:
            item = items[i % 30][1].split()
            n = r.randint(3, len(item))
            a = r.randint(0, len(item) - n)
            plant = item[a : a + n]
            at = r.randint(0, len(t))
            t[at:at] = [w.upper() for w in plant]
        docs.append((i, " ".join(t), "en", "a", 0))
    least, longest, cover = decontaminate.LEAST, decontaminate.LONGEST, decontaminate.COVERAGE

    def brute(text):
        t, hit = tokens(text), {}
        for k, item in items:
            q = tokens(item)
            runs = []
            for a in range(len(t)):
                n = max((n for n in range(len(q) + 1) if any(t[a : a + n] == q[s : s + n] for s in range(len(q) - n + 1)) and a + n <= len(t)), default=0)
                if n >= least and not any(x <= a and a + n <= y for x, y in runs):
                    runs.append((a, a + n))
            group = []
            for x in [*runs, None]:
                if group and (x is None or x[0] - group[-1][1] > len(q)):
                    covered = {s + j for a, b in group for s in range(len(q)) if t[a:b] == q[s : s + b - a] for j in range(b - a)}
                    if max(b - a for a, b in group) >= longest or len(covered) / len(q) >= cover:
                        hit.setdefault(k, []).extend(group)
                    group = []
                if x:
                    group.append(x)
        return hit

    d = frame(spark, docs)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {i: h for i, t, *_ in docs if (h := brute(t))}
    assert len(want) > 10
    got = {x["doc_id"]: x for x in decontaminate.contaminated(d, b).collect()}
    assert {i: set(x["items"]) for i, x in got.items()} == {i: set(h) for i, h in want.items()}
    text = {x[0]: x[1] for x in docs}
    clean = {x["doc_id"]: x["text"] for x in decontaminate.cleaned(d, b).collect()}
    for i, t in text.items():
        gone = {k for runs in want.get(i, {}).values() for a, e in runs for k in range(a, e)}
        assert tokens(clean.get(i, "")) == [w for k, w in enumerate(tokens(t)) if k not in gone]
        if not gone:
            assert clean[i] == t
        else:
            assert {k for s in got[i]["spans"] for k in range(len(tokens(t[: s["start"]])), len(tokens(t[: s["end"]])))} == gone
    for chars in (60, 500):
        sharded = {x["doc_id"]: x for x in decontaminate.contaminated(d, b, shard_chars=chars).collect()}
        assert sharded == got
        assert {x["doc_id"]: x["text"] for x in decontaminate.cleaned(d, b, shard_chars=chars).collect()} == clean


def test_overlapping_items_in_different_shards(spark):
    words = [f"a{k}" for k in range(50)]
    d = frame(spark, [(1, " ".join(words), "en", "a", 0), (1, " ".join(words), "en", "a", 0), (None, " ".join(words), "en", "a", 0), (2, "other words than those", "en", "a", 0)])
    b = spark.createDataFrame([("x", " ".join(words[:30])), ("y", " ".join(words[18:40])), (None, " ".join(words[18:40]))], "item_id string, text string")
    want = [(None, ["x", "y", None], 30, 40), (1, ["x", "y", None], 30, 40), (1, ["x", "y", None], 30, 40)]
    for chars in (60, 20_000_000):
        got = decontaminate.contaminated(d, b, shard_chars=chars).collect()
        assert sorted(((x["doc_id"], x["items"], x["longest"], x["removed"]) for x in got), key=str) == sorted(want, key=str)
        clean = sorted((x["text"] for x in decontaminate.cleaned(d, b, shard_chars=chars).collect()))
        assert [t.strip() for t in clean] == [" ".join(words[40:])] * 3 + ["other words than those"]


def test_items_inside_longer_matches_of_others(spark):
    long = [f"b{k}" for k in range(100)]
    short = long[40:46]
    d = frame(spark, [(1, "before it " + " ".join(long[38:48]) + " after it", "en", "a", 0), (2, " ".join(long[:60]), "en", "a", 0), (3, " ".join(long[10:19]), "en", "a", 0)])
    b = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    got = {x["doc_id"]: (x["items"], x["removed"]) for x in decontaminate.contaminated(d, b).collect()}
    assert got == {1: ([2], 6), 2: ([1, 2], 60)}


def test_items_of_equal_words(spark):
    d = frame(spark, [(1, "same " * 9 + "other " + "same " * 30_000, "en", "a", 0)])
    b = spark.createDataFrame([(1, "same " * 20_000)], "item_id long, text string")
    (x,) = decontaminate.contaminated(d, b).collect()
    assert (x["longest"], x["coverage"], x["words"], x["removed"]) == (20_000, 1.0, 30_010, 30_009)


# 5


def test_license_scan(spark, corpus):
    rows, _ = corpus
    text = rows[0][1]
    notice = "Licensed under the Apache License, Version 2.0."
    grant = license_scan._MIT_GRANT
    broken = " ".join(w for k, w in enumerate(grant.split()) if k % 13)
    docs = [(0, text), (1, text + "\n" + notice + "\n" + text), (2, "é " + grant + "\n" + license_scan._MIT_WARRANTY), (3, broken), (4, grant[: len(grant) // 2]), (5, (notice + " ") * 3)]
    got = license_scan.scanned(frame(spark, [(i, t, "en", "a", 0) for i, t in docs])).orderBy("doc_id", "start").collect()
    by = defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x)
    assert set(by) == {1, 2, 3, 5}
    (one,) = by[1]
    assert one["license"] == "Apache-2.0" and docs[1][1][one["start"] : one["end"]] == notice[:-1] and one["coverage"] == 1
    assert [x["license"] for x in by[2]] == ["MIT", "MIT"] and all(x["coverage"] == 1 for x in by[2])
    assert docs[2][1][by[2][0]["start"] :].startswith("Permission")
    assert [x["license"] for x in by[3]] == ["MIT"] and 0.8 <= by[3][0]["coverage"] < 1
    assert len(by[5]) == 3


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("own", "all of these words have to be here"), ("own", "all of these words have to be here"), (None, "x"), ("none", " ! "), ("null", None)], "license string, text string")
    templates = license_scan.templates_of(table)
    assert templates == [("own", "all of these words have to be here")]
    (found,) = license_scan.scanned(frame(spark, [(1, "Yes: all of these words have to be here.", "en", "a", 0)]), templates).collect()
    assert (found["license"], found["start"], found["end"], found["coverage"]) == ("own", 5, 39, 1.0)


def test_templates_inside_longer_matches_of_others():
    t = license_scan.Templates(license_scan.TEMPLATES)
    short = license_scan.TEMPLATES.index(("Apache-2.0", "Licensed under the Apache License, Version 2.0"))
    first = license_scan._APACHE.split(";")[0]
    for text in (first, license_scan._APACHE[: license_scan._APACHE.index("Unless")], "some words " + first + " and more"):
        ((k, a, b, matched),) = t.chains(common.hashes_of(text))
        assert (k, b - a, matched) == (short, 8, 8)
    ((k, _, _, matched),) = t.chains(common.hashes_of(license_scan._APACHE))
    assert k == license_scan.TEMPLATES.index(("Apache-2.0", license_scan._APACHE)) and matched == t.sizes[k]


def test_every_template_is_found_as_its_own_license():
    t = license_scan.Templates(license_scan.TEMPLATES)
    for name, template in license_scan.TEMPLATES:
        assert {t.names[k] for k, *_ in t.chains(common.hashes_of("Some text. " + template))} == {name}, template
    for name, notice in (("all-rights-reserved", "Copyright 2020. All rights reserved."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2")):
        assert [t.names[k] for k, *_ in t.chains(common.hashes_of(notice))] == [name]


def test_own_matches_of_each_sequence():
    r = random.Random(9)
    for _ in range(80):
        sequences = [[r.choice("ab") for _ in range(r.randint(0, 9))] for _ in range(3)]
        text, want = [r.choice("abc") for _ in range(12)], {}
        for q, s in enumerate(sequences):
            n = {e: max((n for n in range(2, e + 1) if any(s[k : k + n] == text[e - n : e] for k in range(len(s) - n + 1))), default=0) for e in range(13)} | {13: 0}
            if found := {(e - n[e], e, k, k + n[e]) for e in range(13) if n[e] and n[e + 1] <= n[e] for k in range(len(s) - n[e] + 1) if s[k : k + n[e]] == text[e - n[e] : e]}:
                want[q] = found
        assert {q: set(x) for q, x in SuffixAutomaton(sequences, least=2).own(text).items()} == want


def test_scans_against_brute_force(spark):
    """Own maximal matches by comparing words, every chain by recursion, then the best chains that don't overlap."""
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(40)]
    templates = [(name, " ".join(r.choices(vocabulary, k=n))) for name, n in (("a", 12), ("b", 16), ("a", 9))]
    templates.append(("c", " ".join(templates[0][1].split()[:7] + r.choices(vocabulary, k=8))))
    least, gap, coverage = 3, 4, 0.6
    docs = []
    for i in range(60):
        t = r.choices(vocabulary, k=r.randint(0, 12))
        for _ in range(r.randint(0, 3)):
            t += [w if r.random() < 0.93 else r.choice(vocabulary) for w in r.choice(templates)[1].split() if r.random() < 0.97] + r.choices(vocabulary, k=r.randint(0, 5))
        docs.append((i, ". ".join(t)))

    def brute(t):
        found = []
        for k, (_, template) in enumerate(templates):
            q = template.split()
            n = {e: max((n for n in range(least, e + 1) if any(q[s : s + n] == t[e - n : e] for s in range(len(q) - n + 1))), default=0) for e in range(len(t) + 1)} | {len(t) + 1: 0}
            matches = sorted({(e - n[e], e, s, s + n[e]) for e in range(len(t) + 1) if n[e] and n[e + 1] <= n[e] for s in range(len(q) - n[e] + 1) if q[s : s + n[e]] == t[e - n[e] : e]})

            def best(j, matches=matches):
                a, b, s, e = matches[j]
                ways = [(b - a, 0, [j])]
                for i in range(j):
                    a2, b2, s2, e2 = matches[i]
                    if a2 < a and b2 < b and s2 < s and e2 < e and a - b2 <= gap and s - e2 <= gap:
                        score, _, path = best(i)
                        ways.append((score + b - a - max(0, b2 - a, e2 - s), -i, [*path, j]))
                top = max(w[0] for w in ways)
                return max((w for w in ways if w[0] == top), key=lambda w: (len(w[2]) == 1, w[1]))

            used = set()
            for score, _, path in sorted((best(j) for j in range(len(matches))), key=lambda w: (-w[0], w[2][-1])):
                if not used & set(path):
                    used |= set(path)
                    if score >= coverage * len(q):
                        found.append((-score, -score / len(q), matches[path[0]][0], k, matches[path[-1]][1]))
        taken = []
        for score, _, a, k, b in sorted(found):
            if all(b <= x or a >= y for _, x, y, _ in taken):
                taken.append((k, a, b, -score))
        return taken

    want = {(i, k, a, b, n) for i, text in docs for k, a, b, n in brute(text.split(". ") if text else [])}
    got = license_scan.scanned(frame(spark, [(i, t, "en", "a", 0) for i, t in docs]), templates, least=least, gap=gap, coverage=coverage).collect()
    text = dict(docs)
    assert {(x["doc_id"], x["template"], len(tokens(text[x["doc_id"]][: x["start"]])), len(tokens(text[x["doc_id"]][: x["end"]])), x["matched"]) for x in got} == want and len(want) > 30
    assert all(x["license"] == templates[x["template"]][0] for x in got)


def test_license_chains_are_best():
    """One chain per document and template scores what a full search over match sequences finds."""
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(6)]
    for _ in range(60):
        template = " ".join(r.choices(vocabulary, k=10))
        t = license_scan.Templates([("x", template)], coverage=0.01)
        doc = common.hashes_of(" ".join(r.choices(vocabulary, k=16)))
        matches = sorted(set(t.automaton.own(doc).get(0, [])))
        if not matches:
            continue

        def best(j):
            a, b, s, e = matches[j]
            out = b - a
            for i in range(j):
                a2, b2, s2, e2 = matches[i]
                if a2 < a and b2 < b and s2 < s and e2 < e and a - b2 <= t.gap and s - e2 <= t.gap:
                    out = max(out, best(i) + b - a - max(0, b2 - a, e2 - s))
            return out

        assert next(t._chained(matches))[2] == max(best(j) for j in range(len(matches)))


# 6


def brute_signature(text):
    t = tokens(text)
    h = dict(zip(t, words_of(text).hash.tolist(), strict=True))
    if not t:
        return None
    if len(t) == 1:
        features = {h[t[0]]}
    else:
        features = {int(common.mix(common.join(np.array([h[a], h[b]], np.uint64), 2))[0]) for a, b in itertools.pairwise(t)}
    total = np.zeros(256)
    for f in features:
        f = np.array([f], np.uint64)
        total += np.unpackbits(np.concatenate([common.mix(f ^ s).view(np.uint8) for s in simhash_forest._SALT])) * 2.0 - 1
    return np.packbits(total > 0).tobytes()


def test_signatures(corpus):
    rows, _ = corpus
    for text in [r[1] for r in rows[:8]] + ["", "one", "one one", "one two"]:
        got = simhash_forest.signatures(words_of(text))[0].tobytes()
        assert got == (brute_signature(text) or bytes(32))


def test_signatures_do_not_depend_on_the_batch(corpus):
    rows, _ = corpus
    texts = [rows[0][1], "one", "same same same", "", rows[1][1]]
    for n in (1, 200, 600):
        data = "".join([*texts, *["x y"] * n]).encode()
        offsets = np.cumsum([0, *[len(t.encode()) for t in texts], *[3] * n])
        got = simhash_forest.signatures(common.Words(np.frombuffer(data, np.uint8), offsets))
        assert [x.tobytes() for x in got[: len(texts)]] == [brute_signature(t) or bytes(32) for t in texts]


def near_copies(corpus, groups=12, copies=9, rate=0.02):
    rows, words = corpus
    r = random.Random(4)
    out = [(i, t) for i, t, *_ in rows]
    for g in range(groups):
        base = max((words("en", 120), words("fr", 150)), key=lambda _: r.random()).split()
        for _ in range(copies):
            t = [words("en", 1) if r.random() < rate else w for w in base]
            out.append((1000 + len(out), " ".join(t)))
    return out


SMALL = [{}, {"node": 8, "piece": 64}, {"node": 4, "piece": 2}, {"node": 4, "piece": 32, "rounds": 1, "block": 16}, {"rounds": 0, "block": 20}]


@pytest.mark.parametrize("sizes", SMALL)
def test_near_duplicates(spark, corpus, sizes):
    rows = near_copies(corpus)
    d = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    sign = {x["i"]: np.frombuffer(x["s"], np.uint64) for x in simhash_forest.signed(d).collect()}
    got = {x["doc_id"]: x for x in simhash_forest.groups(d, **sizes).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sign, 2) if np.bitwise_count(sign[a] ^ sign[b]).sum() <= simhash_forest.FARTHEST]
    assert len(pairs) > 300
    found = sum(got[a]["group_id"] == got[b]["group_id"] for a, b in pairs)
    assert found / len(pairs) >= 0.9
    root = {i: i for i in sign}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    if not sizes:
        assert {i: x["group_id"] for i, x in got.items()} == {i: find(i) for i in sign}
        kept = [x["doc_id"] for x in simhash_forest.deduplicated(d).collect()]
        assert sorted(kept) == sorted(i for i, x in got.items() if x["kept"])
    for i, x in got.items():
        assert x["kept"] == (x["group_id"] == i) and find(x["group_id"]) == find(i)
    assert all(got[i]["kept"] for i, *_ in corpus[0])


def test_copies_in_any_layout_of_files(spark, corpus, tmp_path):
    rows, _ = corpus
    text = rows[0][1]
    for name, lo, n in (("a", 0, 300), ("b", 1000, 30)):
        frame(spark, [(lo + k, rows[1 + k % 150][1] + f" w{lo + k}" if k else text, "en", "a", 0) for k in range(n)]).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    got = {x["doc_id"]: x["group_id"] for x in simhash_forest.groups(spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b")).collect()}
    assert got[0] == got[1000] == 0


def test_ids_with_several_texts_join_them(spark, corpus):
    rows, words = corpus
    a, b, c = (words("en", 80) for _ in range(3))
    d = frame(spark, [(i, t, "en", "a", 0) for i, t in [(1, a), (5, a), (5, b), (3, b), (7, c), (7, words("fr", 60)), (7, None), (9, c)]])
    got = {(x["doc_id"], x["group_id"]) for x in simhash_forest.groups(d).collect()}
    assert got == {(1, 1), (5, 1), (3, 1), (7, 7), (9, 7)}


def test_depths_of_sorted_keys():
    r = np.random.default_rng(3)
    key = np.sort(np.concatenate([r.integers(0, 1 << 48, 300), r.integers(0, 1 << 20, 200), np.full(9, 77)]))
    for top, most in ((0, 5), (3, 20), (0, 1000)):
        for k, d in zip(key.tolist(), simhash_forest.depths(key, top, most).tolist(), strict=True):
            size = {x: int((key >> (48 - x) == k >> (48 - x)).sum()) for x in range(top, 49)}
            assert d == next((x for x in range(top, 48) if size[x] <= most), 48)


def test_nodes_of_any_size_are_joined_like_all_pairs(corpus):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, (40, 4)).astype(np.uint64)
    noise = np.packbits(r.random((2000, 256)) < 0.06, axis=1).view(np.uint64)
    sign = base[r.integers(0, 40, 2000)] ^ noise
    a, b = simhash_forest.joined(sign, 46), simhash_forest.linked(sign, 46)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))
    for part in (sign[:1], sign[:300]):
        assert (simhash_forest.joined(part, 46) == simhash_forest.linked(part, 46)).all()


def test_shape_reaches_its_recall():
    p = 1 - simhash_forest.FARTHEST / simhash_forest.BITS
    last = 0
    for n in (1, 100, 10_000, 1_000_000, 10**8):
        depth, tries = simhash_forest.shape(n, np.log(1 - simhash_forest.RECALL))
        assert 1 - (1 - p**depth) ** tries >= simhash_forest.RECALL - 1e-9 and depth >= last
        last = depth


# 7


def test_quality_rules(spark):
    docs = [
        (0, "The quick brown fox jumps over the lazy dog and then it sleeps in the warm sun until evening comes to the quiet valley below."), (1, "a b"), (2, "### $$$ %%% the word"), (3, "\n".join(["same line"] * 6)), (4, "you are an Idiot my friend"), (5, "1234567 890 12"),
        (6, "THE WORDS ARE LOUD HERE"), (7, "x" * 40 + " " + "y" * 40 + " " + "z" * 50), (8, "word " * 30), (9, "one...\ntwo...\nthree…\nfour"),
    ]
    cjk = "これは日本語の文章です。中文也是这样写的，每个字都算作一个词。再写一句话，让它有二十个以上的字。"
    (asian,) = quality_rules.ledger(frame(spark, [(1, cjk + " word", "ja", "a", 0)]), blocked=["Word"]).collect()
    assert {n for n, b in quality_rules.BIT.items() if asian["failed"] & b} == {"blocked_words"} and asian["words"] == asian["ideographs"] + 1 > 30
    led = quality_rules.ledger(frame(spark, [(i, t, "en", "a", 0) for i, t in docs]))
    failed = {x["doc_id"]: {n for n, b in quality_rules.BIT.items() if x["failed"] & b} for x in led.collect()}
    assert failed[0] == set()
    for i, rule in {1: "few_words", 2: "symbols", 3: "repeated_lines", 4: "blocked_words", 5: "digits", 6: "capitals", 7: "long_words", 8: "few_unique_words", 9: "trailing_lines"}.items():
        assert rule in failed[i], (i, failed[i])
    for x in quality_rules.decided(led).collect():
        for version, rules in quality_rules.POLICIES.items():
            assert x[f"passes_{version}"] == (not failed[x["doc_id"]] & set(rules))
    for x in quality_rules.ablations(led).collect():
        rules = set(quality_rules.POLICIES[x["policy"]])
        assert x["fail"] == sum(x["rule"] in f for f in failed.values())
        assert x["fail_alone"] == sum(f & rules == {x["rule"]} for f in failed.values())
        assert x["pass_policy"] == sum(not f & rules for f in failed.values())


# 8


def test_network_gradients():
    r = np.random.default_rng(0)
    net = pseudo_likelihood.Network(r.integers(0, 50, pseudo_likelihood.OUTPUTS))
    for x in net.parts():
        x += r.normal(0, 0.2, x.shape).astype(np.float32)
    word = r.integers(0, 1023, 40)
    around = r.integers(0, 1024, (4, 40))
    for x, g in zip(net.parts(), net.gradients(around, word), strict=True):
        for at in [np.unravel_index(k, x.shape) for k in np.argsort(-abs(g).ravel())[:4]]:
            old, step = x[at], 1e-2
            x[at] = old + step
            up = net.score(around, word).astype(float).sum()
            x[at] = old - step
            down = net.score(around, word).astype(float).sum()
            x[at] = old
            assert g[at] == pytest.approx(-(up - down) / (2 * step), rel=0.05, abs=0.02)


def test_scores_against_a_loop(corpus):
    rows, _ = corpus
    r = np.random.default_rng(1)
    net = pseudo_likelihood.Network(r.integers(0, 50, pseudo_likelihood.OUTPUTS))
    vocabulary = pseudo_likelihood.Vocabulary(list(dict.fromkeys(words_of(rows[0][1]).hash.view(np.int64).tolist())))
    texts = [rows[0][1], "", rows[1][1], "one"]
    data = "".join(t + "\n" for t in texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])
    n, total, _ = pseudo_likelihood.document_scores(net, vocabulary, common.Words(np.frombuffer(data, np.uint8), offsets))
    for text, size, score in zip(texts, n, total, strict=True):
        ids = vocabulary.ids(words_of(text).hash)
        want = 0.0
        for k, w in enumerate(ids):
            h = net.bias.astype(float)
            for place, x in enumerate(pseudo_likelihood.PLACES):
                h = h + net.look[place][ids[k + x] if 0 <= k + x < len(ids) else pseudo_likelihood.EDGE]
            h = np.tanh(h)
            a, c = h @ net.to_class + net.class_bias, w // 32
            b = h @ net.to_word[c] + net.word_bias[c]
            want += a[c] - np.log(np.exp(a).sum()) + b[w % 32] - np.log(np.exp(b).sum())
        assert size == len(ids) and score == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_training_helps_on_held_out_text(spark, corpus):
    """Alternating words are told by their neighbours, which counts alone can't."""
    r = random.Random(6)
    cycle = [f"w{k}" for k in range(12)]

    def text(n):
        at = r.randrange(12)
        return " ".join(cycle[(at + k) % 12] for k in range(n))

    train = frame(spark, [(i, text(400), "en", "a", 0) for i in range(120)])
    vocabulary, weights = pseudo_likelihood.fitted(train)
    held = words_of(text(300))
    ids = vocabulary.ids(held.hash)
    net = pseudo_likelihood.Network(np.zeros(pseudo_likelihood.OUTPUTS)).load(weights)
    mean = net.score(pseudo_likelihood.neighbours(ids, held), ids).mean()
    assert mean > -1.2 > -np.log(12)


def test_every_document_is_trained_on(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    plain = pseudo_likelihood.Network.train

    def train(self, around, word, state, *rest):
        seen.add(len(word))
        plain(self, around, word, state, *rest)

    docs = [(i, f"text {i} has words w{i} and v{i % 7}", "en", "a", 0) for i in range(64)]
    original = pseudo_likelihood._trainer

    def trainer(*given):
        run = original(*given)

        def counting(batches):
            pseudo_likelihood.Network.train = train
            try:
                yield from run(batches)
            finally:
                pseudo_likelihood.Network.train = plain

        return counting

    monkeypatch.setattr(pseudo_likelihood, "_trainer", trainer)
    pseudo_likelihood.fitted(frame(spark, docs))
    assert seen.value == sum(len(tokens(t)) for _, t, *_ in docs)


def test_training_against_a_loop_over_partitions(spark, corpus):
    """Every partition trains from the round's weights on its documents of the round; the mean, by words, begins the next."""
    rows, _ = corpus
    d = frame(spark, rows[:48]).repartition(3, "doc_id")
    vocabulary, weights, counts, prior = pseudo_likelihood._fitted(d, "text", 2)
    n = Counter(h for _, t, *_ in rows[:48] for h in words_of(t).hash.view(np.int64).tolist())
    assert {x["w"]: x["n"] for x in counts.collect()} == n
    common_words = sorted(n, key=lambda w: (-n[w], w))[: vocabulary.common]
    expected = np.zeros(vocabulary.edge + 1)
    again = pseudo_likelihood.Vocabulary(common_words, vocabulary.edge + 1)
    for w, k in n.items():
        expected[again.ids(np.array([w]).view(np.uint64))[0]] += k
    assert (expected == prior).all()
    parts = d.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("k")).rdd.glom().collect()
    now = pseudo_likelihood.Network(expected).flat()
    for k in range(2):
        trained = []
        for part in parts:
            if texts := [x["text"] for x in part if x["k"] == k]:
                net = pseudo_likelihood.Network(np.zeros(len(expected))).load(now)
                data = "".join(texts).encode()
                words = common.Words(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
                ids = again.ids(words.hash)
                net.train(pseudo_likelihood.neighbours(ids, words, again.edge), ids, [np.zeros_like(x) for x in net.parts()])
                trained.append((len(ids), net.flat()))
        total = sum(m for m, _ in trained)
        now = sum(m / total * x for m, x in trained).astype(np.float32)
    assert np.allclose(now, weights, atol=2e-4)


def test_words_in_buckets_have_their_own_probability(spark):
    r = random.Random(5)
    often = ["a" * (k % 50 + 1) + "b" * (k // 50) for k in range(600)] + ["c" * (k % 50 + 1) + "d" * (k // 50) for k in range(600)]
    docs = [(i, " ".join(r.choice(often) if r.random() < 0.9 else "r" + "s" * i + "t" * (k // 3) for k in range(60)), "en", "a", 0) for i in range(40)]
    vocabulary, weights, counts, prior = pseudo_likelihood._fitted(frame(spark, docs), "text", 1)
    n = {x["w"]: x["n"] for x in counts.collect()}
    net = pseudo_likelihood.Network(np.zeros(len(prior))).load(weights)
    want = {}
    for i, t, *_ in docs:
        words = words_of(t)
        ids = vocabulary.ids(words.hash)
        own = [np.log(n[w] / prior[k]) if k >= vocabulary.common else 0.0 for w, k in zip(words.hash.view(np.int64).tolist(), ids, strict=True)]
        want[i] = net.score(pseudo_likelihood.neighbours(ids, words), ids).astype(float).sum() + sum(own)
        assert min(own) < -0.5
    for known in (1 << 20, 50):
        got = pseudo_likelihood.scored(frame(spark, docs), rounds=1, known=known).collect()
        assert {x["doc_id"]: x["log_likelihood"] for x in got} == pytest.approx(want, abs=0.05)
        assert all(x["words"] == 60 and x["mean"] == pytest.approx(x["log_likelihood"] / 60, abs=1e-5) for x in got)


def test_outputs_grow_with_the_corpus():
    sizes = [pseudo_likelihood.width(n) for n in (0, 10**6, 10**8, 10**10)]
    assert sizes[:2] == [32, 32] and sizes[1] < sizes[2] < sizes[3]
    net = pseudo_likelihood.Network(np.ones(40 * 40))
    everything = net.score(np.zeros((4, 1600), np.int64), np.arange(1600))
    assert np.exp(everything.astype(float)).sum() == pytest.approx(1, abs=1e-4)


# 9


def test_mixing(spark, corpus):
    rows, _ = corpus
    d = frame(spark, rows)
    shares = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    langs = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    got = source_mixing.mixed(d, by_source=shares, by_lang=langs).collect()
    n = {i: len(t.split()) for i, t, *_ in rows}
    assert {x["doc_id"]: x["tokens"] for x in got} == n
    total = sum(x["tokens"] * x["rate"] for x in got)
    for column, goal in (("source", shares), ("lang", langs)):
        for k, share in goal.items():
            assert sum(x["tokens"] * x["rate"] for x in got if x[column] == k) / total == pytest.approx(share, abs=1e-6)
    # brute force: iterative proportional fitting has the same limit
    cells = defaultdict(float)
    for i, _, lang, source, _ in rows:
        cells[source, lang] += n[i]
    rate = dict.fromkeys(cells, 1.0)
    everything = sum(cells.values())
    for _ in range(500):
        for side, goal in ((0, shares), (1, langs)):
            for k, share in goal.items():
                now = sum(cells[c] * rate[c] for c in cells if c[side] == k)
                for c in cells:
                    if c[side] == k:
                        rate[c] *= share * everything / now
    low = min(rate.values())
    for x in got:
        assert x["rate"] == pytest.approx(rate[x["source"], x["lang"]] / low, abs=1e-5)
        assert x["copies"] in (int(x["rate"]), int(x["rate"]) + 1) and x["rate"] >= 1
    assert sum(x["copies"] for x in got) == pytest.approx(sum(x["rate"] for x in got), rel=0.15)
    stage = source_mixing.weighted(d, by_source=shares, by_lang=langs).collect()
    assert {x["doc_id"]: x["mix_copies"] for x in stage} == {x["doc_id"]: x["copies"] for x in got if x["copies"]}


def test_targets_that_contradict_each_other(spark):
    d = frame(spark, [(1, "a b", "en", "a", 0), (2, "c d", "de", "b", 0)])
    with pytest.raises(ValueError):
        source_mixing.mixed(d, by_source={"a": 0.9, "b": 0.1}, by_lang={"en": 0.1, "de": 0.9})


# 10


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, corpus, rule):
    rows, _ = corpus
    docs = [(i, t.replace(" ", " \n\n ", 3) + "\n") for i, t, *_ in rows[:20]] + [(500, "\n\n\n\n"), (501, ""), (502, "no line feed"), (503, "a\n \n\n  b é\n")]
    encoding, sizes = token_counts.encoder()
    want = []
    for i, t in docs:
        raw = t.encode()
        edge = [0] + [k + 1 for k, c in enumerate(raw) if c == 10 and k + 1 < len(raw)] + [len(raw)] if raw else [0, 0]
        own, share = [0] * (len(edge) - 1), [0.0] * (len(edge) - 1)
        at = 0
        for x in encoding.encode_ordinary(t):
            part = [sum(edge[k] <= b < edge[k + 1] for b in range(at, at + sizes[x])) for k in range(len(own))]
            inside = [k for k, n in enumerate(part) if n]
            own[inside[0] if rule == "first" else inside[-1] if rule == "last" else part.index(max(part))] += 1
            share = [s + n / sizes[x] for s, n in zip(share, part, strict=True)]
            at += sizes[x]
        want += [(i, k, edge[k], edge[k + 1], own[k], round(share[k], 6)) for k in range(len(own))]
    got = token_counts.counted(frame(spark, [(i, t, "en", "a", 0) for i, t in docs]), rule=rule).collect()
    assert sorted((x["doc_id"], x["section"], x["start"], x["end"], x["tokens"], pytest.approx(x["share"], abs=1e-5)) for x in got) == sorted(want)
    sums = defaultdict(int)
    for x in got:
        sums[x["doc_id"]] += x["tokens"]
    assert sums == {i: len(encoding.encode_ordinary(t)) for i, t in docs}


def test_long_runs_of_white_space():
    encoding, _ = token_counts.encoder()
    r = random.Random(3)
    texts = ["".join(r.choice([" ", "\n", "\t", "a", "é", "1", "\u2003", "'s", "\x1c", "!"]) * r.choice([1, 1, 2, 9]) for _ in range(40)) for _ in range(200)] + ["", " " * 9, "a" + " " * 9, " " * 9 + "a"]
    for long in (2, 3, 8):
        assert token_counts.encoded(encoding, texts, long) == [encoding.encode_ordinary(t) for t in texts]
    middle = 5_000_000
    (got,) = token_counts.encoded(encoding, ["x" + " " * middle + "y"])
    assert encoding.decode(got) == "x" + " " * middle + "y"


def test_token_counts_of_fields(spark):
    d = spark.createDataFrame([(1, "Title here", "body text.\nmore"), (2, None, ""), (None, "é", None)], "doc_id long, title string, body string")
    encoding, _ = token_counts.encoder()
    got = {(x["doc_id"], x["section"]): (x["start"], x["end"], x["tokens"]) for x in token_counts.counted(d, fields=["title", "body"]).collect()}
    for i, title, body in ((1, "Title here", "body text.\nmore"), (2, "", ""), (None, "é", "")):
        a, b = len(title.encode()) + 1, len(body.encode()) + 1
        assert got[i, 0][:2] == (0, a) and got[i, 1][:2] == (a, a + b)
        assert got[i, 0][2] + got[i, 1][2] == len(encoding.encode_ordinary(f"{title}\n{body}\n"))
    assert got[1, 0][2] == len(encoding.encode_ordinary("Title here\n"))
