"""Lexical search, runs and decontamination against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.llm import decontamination, lexical, periodic_runs
from starledger.llm.plainwords import STRETCH, numbers
from starledger.llm.queries import QUERIES, with_periods

SMALL = "/root/testdata/sf0.001"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score double, item int, row string"
ITEMS = "item_id long, text string, score double"


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def texts(seed, n=300):
    """Short vocabularies, so that terms and windows meet often, and odd rows."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "aAéß漢x1" for b in ("", "b", "ö", "2", "Z")]
    rows = [(i, rng.choice([" ", "-", "\n", "_"]).join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 12, 60]))), 1.0, 2, "r") for i in range(n)]
    rows += [(n, None, 1.0, 2, "r"), (n + 1, "", 1.0, 2, "r"), (n + 2, " .!?", 1.0, 2, "r"), (None, "ab ab aö 1z", 1.0, 2, "r"), (None, None, 1.0, 2, "r")]
    rows += [rows[3], rows[3], (5, "xb Xb 12", 1.0, 2, "r"), (-9, rows[7][1], 1.0, 2, "r"), (n + 4, "ab " * 30_000 + "xb", 1.0, 2, "r"), (n + 5, "a" * 70_000, 1.0, 2, "r")]
    return rows


def passages(rows):
    """Items: passages of texts, short ones, repeated ids, equal rows, nulls."""
    own = [terms(t) for _, t, *_ in rows]
    items = [(i, " ".join(own[i][3 : 3 + n]), 0.1) for i, n in enumerate([11, 40, 25, 10, 9, 1, 2, 30, 12, 15] * 3) if len(own[i]) > 12]
    return items + [
        items[0], (items[1][0], "xb ab", 0.1), (900, None, 0.1), (901, "", 0.1), (None, " ".join(own[items[2][0]][:12]), 0.1), (902, "neverseen words", 0.1), (1000, "ab XB ab", 0.1),
    ]


def brute_ranks(rows, items, k):
    counts = [Counter(terms(t)) for _, t, *_ in rows]
    lengths = [sum(c.values()) for c in counts]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for c in counts for t in c)
    bags = {}
    for i, t, *_ in dict.fromkeys((i, t) for i, t, *_ in items if t is not None):
        bags.setdefault(i, []).extend(terms(t))
    out = []
    for i, bag in bags.items():
        scored = []
        for (d, *_), c, n in zip(rows, counts, lengths, strict=True):
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in bag if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, part", [(20, lexical.PART), (3, 700), (500, lexical.PART)])
def test_ranks(spark, k, part):
    rows = texts(1)
    items = passages(rows)
    got = lexical.ranked(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), k=k, part=part)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(rows, items, k)


def test_ranks_over_windows_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 8)
    rows = texts(2)
    known = {}
    for _, t, *_ in passages(rows):
        for w in terms(t):
            known.setdefault(w.encode(), len(known) + 1)
    ranker = lexical.Ranker([(0, {known[b"ab"] - 1: 2, known[b"xb"] - 1: 1})], [1000] * len(known), 100, 1000, 20)
    for a in range(0, len(rows), 8):
        ranker.add(lexical._window([r[0] for r in rows[a : a + 8]], [r[1] for r in rows[a : a + 8]], known))
    scored = []
    for d, t, *_ in rows:
        c = Counter(terms(t))
        m = 75 + 25 * sum(c.values()) * 100 // 1000
        s = sum(n * 1000 * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in (("ab", 2), ("xb", 1)))
        if s:
            scored.append((-s, d is None, d or 0))
    assert sorted((-s, d is None, d or 0) for _, d, s in ranker.found()) == sorted(scored)[:20]


def test_ranks_of_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame(passages(texts(3)), ITEMS)
    assert lexical.ranked(none, items).count() == 0
    assert lexical.ranked(spark.createDataFrame(texts(3), DOCS), items.limit(0)).count() == 0


def brute_matches(rows, items, k):
    windows = {}
    for i, t, *_ in items:
        w = terms(t)
        for a in range(max(0, len(w) - k + 1) or bool(w)):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t, *_ in rows:
        w = terms(t)
        hit, named = set(), set()
        for m in {len(x) for x in windows}:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in windows:
                    hit |= set(range(a, a + m))
                    named |= windows[tuple(w[a : a + m])]
        spans = [(a, next(z for z in range(a, len(w) + 1) if z not in hit)) for a in sorted(hit) if a - 1 not in hit]
        out.append((d, len(w), spans, sorted(str(i) for i in named if i is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("k, part", [(10, decontamination.PART), (10, 900), (1, decontamination.PART), (3, decontamination.PART)])
def test_matches(spark, k, part):
    rows = [r for r in texts(4, 120) if len(r[1] or "") < 50_000]
    items = passages(rows)
    rows.append((777, f"xb {items[1][1]} unseen {items[1][1]} {items[1][1]}", 1.0, 2, "r"))
    got = decontamination.matches(spark.createDataFrame(rows, DOCS).repartition(3).drop("item"), spark.createDataFrame(items, ITEMS), k=k, part=part)
    assert got.columns == ["doc_id", "text", "score", "row", "n_words", "hits", "items"]
    mine = sorted(((r["doc_id"], r["n_words"], [tuple(h) for h in r["hits"]], r["items"]) for r in got.collect()), key=str)
    assert mine == brute_matches(rows, items, k)
    assert any(len(m[2]) > 1 for m in mine)


def test_matches_in_long_texts(spark):
    passage = [f"w{i}" for i in range(40)]
    filler = [f"f{i % 977}" for i in range(400_000)]
    rows = [(1, " ".join(filler[:150_000] + passage + filler), 1.0, 1, "r"), (2, " ".join(filler), 1.0, 1, "r")]
    got = {r["doc_id"]: r for r in decontamination.matches(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, " ".join(passage), 0.1)], ITEMS)).collect()}
    assert [tuple(h) for h in got[1]["hits"]] == [(150_000, 150_040)] and got[1]["items"] == ["7"] and got[1]["n_words"] == 550_040
    assert got[2]["hits"] == [] and got[2]["items"] == []


def test_matches_of_empty_tables_and_clashing_names(spark):
    docs, items = spark.createDataFrame(texts(5, 5), DOCS), spark.createDataFrame(passages(texts(3)), ITEMS)
    assert decontamination.matches(docs.limit(0), items).count() == 0
    assert decontamination.matches(docs, items.limit(0)).where("size(hits) > 0 or size(items) > 0").count() == 0
    with pytest.raises(ValueError, match="hits"):
        decontamination.matches(docs.withColumn("hits", F.lit(1)), items)


def test_skips_are_safe():
    """Every window is found wherever it stands, in stretches of any cursor."""
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 10):
        windows = np.unique(rng.integers(1, 4, (20, m)).astype(np.int32), axis=0)
        ids = rng.integers(0, 4, 3000).astype(np.int32)
        ends, which = decontamination.Windows(windows).found(ids)
        want = {(a + m - 1, w) for a in range(len(ids) - m + 1) for w in range(len(windows)) if (ids[a : a + m] == windows[w]).all()}
        assert set(zip(ends.tolist(), which.tolist(), strict=True)) == want and len(ends) == len(want)


def test_numbers_of_long_texts():
    text = ("Abc é9-" * 5 + " ") * (STRETCH // 20)
    known = {"abc".encode(): 1, "é9".encode(): 2}
    assert numbers(text, known).tolist() == [1, 2] * (5 * (STRETCH // 20))
    assert numbers(None, known).tolist() == []


def brute_runs(words, least):
    """Stretches of equal words a period apart whose period is their smallest."""
    known = {}
    w = np.array([known.setdefault(x, len(known)) for x in words])
    out = []
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        turns = np.flatnonzero(np.diff(same))
        for a, z in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            length = z - a + q
            part = w[a : a + length]
            if length >= max(least, 2 * q) and not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_planted(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def repeating(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size, kinds = rng.choice([0, 1, 12, 13, 40, 150]), rng.choice([1, 2, 3, 40])
        words = [f"w{rng.randrange(kinds)}é" for _ in range(size)]
        if rng.random() < 0.5 and size:
            a, p = rng.randrange(size), rng.randrange(1, size + 1)
            words = [words[a + (j - a) % p] if j >= a else words[j] for j in range(size)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words) + rng.choice(["", " "]), 1.0, 2, "r"))
    rows += [(n, None, 1.0, 2, "r"), (n + 1, " \x0b ", 1.0, 2, "r"), (None, "a b " * 20, 1.0, 2, "r"), rows[3], rows[3], (n + 2, "a" * 100_000, 1.0, 2, "r"), (n + 3, "x y z " * 3000, 1.0, 2, "r")]
    return rows


@pytest.mark.parametrize("least", [2, 12])
def test_runs(spark, least):
    rows = repeating(least)
    got = periodic_runs.find_runs(spark.createDataFrame(rows, DOCS).repartition(3), least=least)
    assert got.columns == ["doc_id", "text", "score", "item", "row", "runs", "collapsed"]
    mine = sorted(((r["doc_id"], r["text"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()), key=str)
    want = []
    for d, t, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        runs = brute_runs(words, least) if len(words) < 5000 else [(0, len(words), 2)]
        want.append((d, t, runs, brute_collapsed(words, runs)))
    assert mine == sorted(want, key=str)


def test_runs_of_long_texts_and_empty_tables(spark):
    n = periodic_runs._STRETCH // 8
    unlike = " ".join(f"u{i}" for i in range(n)) + " p q r s" * 10
    rows = [(1, unlike, 1.0, 1, "r"), (2, " ".join(f"v{i}" for i in range(300)) + " " + " ".join(f"v{i}" for i in range(300)), 1.0, 1, "r")]
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(spark.createDataFrame(rows, DOCS)).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(n, 40, 4)] and got[1]["collapsed"] == unlike.removesuffix(" p q r s" * 9)
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 600, 300)]
    empty = spark.createDataFrame([], DOCS)
    assert periodic_runs.find_runs(empty).count() == 0
    assert periodic_runs.find_runs(spark.createDataFrame(rows, DOCS), collapse=False).columns[-1] == "runs"
    with pytest.raises(ValueError, match="runs"):
        periodic_runs.find_runs(empty.withColumn("runs", F.lit(1)))


def test_planted_periods(spark):
    rows = [(d, t, 1.0, 1, "r") for d, t, *_ in repeating(9)]
    got = with_periods(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").split()) for r in got) == sorted((str(d), " ".join(brute_planted(d, t)).split()) for d, t, *_ in rows)


def test_op12_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in docs:
        words = brute_planted(d, t)
        runs = brute_runs(words, 12)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((d, len(runs), *first, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(brute_collapsed(words, runs))))
    got = QUERIES["op12_periodic_run_detection"](spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {dict(got.dtypes)[c] for c in got.columns[:6]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 20


@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op13_benchmark_decontamination"])
def test_equals_sql(spark, name):
    from compare import differences

    from starledger.llm.queries import ORACLE_SQL

    assert differences(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL) == []
