"""Host rules, periodic runs and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives, hosts, periodic, queries

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# -- op11 --------------------------------------------------------------------------------------------


def slow_counts(text):
    text = text or ""
    words = SPLIT.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def slow_rates(hosts_):
    """Shrunk rates from {host: (documents, failures)}."""
    rates = [f / n for n, f in hosts_.values()]
    mean, total = sum(rates) / len(rates), sum(n for n, _ in hosts_.values())
    more = sum((r - mean) ** 2 for r in rates) / len(rates) - mean * (1 - mean) * sum(1 / n for n, _ in hosts_.values()) / len(rates)
    strength = min(max(mean * (1 - mean) / more - 1, 0), total) if more > 0 and 0 < mean < 1 else total
    return {h: (f + mean * strength) / (n + strength) for h, (n, f) in hosts_.items()}


def hosted():
    draw = random.Random(8)
    prose = lambda n: " ".join(f"word{draw.randrange(5000)}" for _ in range(n))
    rows = [(i, prose(draw.choice([20, 80, 90, 100])), "big") for i in range(120)]
    rows += [(1000 + i, prose(90 if i % 10 == 0 else 12), "thin") for i in range(40)]
    rows += [(2000 + i, ("same line of a menu\n" * 5) + prose(70), "menus") for i in range(20)]
    rows += [(3000 + i, "\n".join([prose(70), *["$ # % & price | list"] * 6]), "shop") for i in range(9)]
    rows += [(4000, prose(5), "single"), (4001, prose(300), "other")]
    return [(*r, 1, "x") for r in rows]


def test_host_rules_against_brute_force(spark, texts, docs, nothing):
    more = spark.createDataFrame(hosted(), "doc_id long, text string, source string, host int, failed string")
    rows = [(r[0], r[1], r[2]) for r in hosted()]
    check(hosts.judged(more, F.col("source")).collect(), rows)
    check(hosts.judged(docs, F.col("source")).collect(), [r[:3] for r in texts])
    assert hosts.judged(nothing, F.col("source")).count() == 0
    verdict = {r.host: r.host_rejected for r in hosts.judged(more, F.col("source")).collect()}
    assert verdict["thin"] and verdict["menus"] and verdict["shop"] and not verdict["big"] and not verdict["other"]


def slow_failed(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines):
    checks = [n_words < 50, n_repeat_words > 0.5 * n_words, n_symbols > 0.1 * n_words, 10 * n_dup_lines > 3 * n_lines]
    checks.append(word_chars < 3 * n_words or word_chars > 10 * n_words)
    return [name for name, bad in zip(["short", "repeats", "symbols", "lines", "lengths"], checks, strict=True) if bad]


def check(got, rows):
    want, by = [], defaultdict(list)
    for i, text, host in rows:
        counts = slow_counts(text)
        failed = slow_failed(*counts)
        want.append((str(i), str(host), counts, failed))
        by[host].append(failed)
    rates = [slow_rates({h: (len(f), sum(r in x for x in f)) for h, f in by.items()}) for r in hosts.RULES]
    bad = {str(h): max(rate[h] for rate in rates) > hosts.LIMIT for h in by}
    mine = [(str(r.doc_id), str(r.host), tuple(r[c] for c in hosts.COUNTS), list(r.failed), r.host_rejected) for r in got]
    assert sorted(mine) == sorted((*w, bad[w[1]]) for w in want)


def test_few_documents_stay_near_the_mean(spark):
    rows = [(f"h{i}", 100, 10 + i % 3) for i in range(20)] + [("one", 1, 1), ("many", 100, 90)]
    rates = {r.host: r.rate_bad for r in hosts.shrunk(spark.createDataFrame(rows, "host string, n long, bad long"), ["bad"]).collect()}
    assert rates == pytest.approx(slow_rates({h: (n, f) for h, n, f in rows}))
    assert rates["one"] < 0.7 and 0.7 < rates["many"] < 0.9


# -- op12 --------------------------------------------------------------------------------------------


def slow_runs(w, least=12):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s = w[i : j + p]
            if len(s) >= max(least, 2 * p) and not any(s[q:] == s[:-q] for q in range(1, p)):
                out.append((i, len(s), p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [4, 7, 12])
def test_runs_against_brute_force(least):
    draw = random.Random(least)
    for _ in range(1500):
        n, kinds = draw.randint(0, 90), draw.choice([1, 2, 2, 3, 5])
        w = [draw.randrange(kinds) for _ in range(n)]
        if draw.random() < 0.5 and n > 20:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert periodic.runs_in(w, least) == slow_runs(w, least)


def test_runs_of_fibonacci_words_and_long_periods():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    assert periodic.runs_in(list(b)) == slow_runs(list(b))
    draw = random.Random(2)
    w = [draw.randrange(10**6) for _ in range(40_000)]
    assert periodic.runs_in(w[:5] + w * 2 + w[:7]) == [(5, 80_007, 40_000)]
    assert periodic.runs_in(["x"] * 50_000) == [(0, 50_000, 1)]


def slow_digest(doc_id, text):
    words = SPLIT.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (str(doc_id), len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digest_against_brute_force(spark, texts, docs, nothing):
    draw = random.Random(6)
    rows = [r[:2] for r in texts if len(r[1] or "") < 60_000 and r[0] != 300]
    rows += [(10_000 + i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 200)))) for i in range(300)]
    frame = spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, text string, runs int, _n int")
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periodic.digest(periodic.marked(periodic.with_planted_runs(frame))).select(*columns).collect()
    mine = sorted((str(r[0]), *r[1:]) for r in got)
    assert sorted(mine, key=str) == sorted((slow_digest(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in mine) >= 20
    assert periodic.marked(nothing).count() == 0 and periodic.marked(docs).count() == len(texts)


# -- op13 --------------------------------------------------------------------------------------------


def negatives_rows():
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((6, 16))
    rows = []
    for i in range(400):
        x = centres[i % 6] * draw.choice([0.5, 1.0, 3.0]) + 0.4 * draw.standard_normal(16)
        rows.append((i, [float(np.float32(v)) for v in x], int((i % 6 if draw.random() < 0.7 else i) % 5)))
    rows += [rows[3], rows[10], (10, rows[11][1], 4)]
    rows += [(500 + i, rows[20][1], i % 3) for i in range(12)]
    x = [1.0] * 16
    rows += [(900, None, 1), (910, [math.nan, *x[1:]], 1), (920, [None, *x[1:]], 1), (930, [math.inf, *x[1:]], 1), (940, x, None), (None, x, 1), (950, [], 2), (960, [1.0, 2.0], 2), (970, [1e308, *x[1:]], 0)]
    return rows


def slow_mined(rows, every):
    best = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) or not math.isfinite(256 * v) for v in x):
            continue
        best[i] = min(best.get(i, (label, x)), (label, x))
    whole = {i: (label, [math.floor(256 * v) for v in x]) for i, (label, x) in best.items()}
    out = []
    for a, (label, x) in whole.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y) in whole.items() if i != a and len(x) == len(y))
        for p, pos, _ in [s for s in scores if s[2] == label][:5]:
            hit = [(-s, i) for s, i, other in scores if other != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, pos, rank, i, -p, s) for rank, (s, i) in enumerate(hit[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [32, 4096])
def test_hard_negatives_against_brute_force(spark, block):
    rows = negatives_rows()
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, dim int").repartition(4)
    got = hard_negatives.mined(frame, lambda c: c % 10 == 0, block=block).collect()
    want = slow_mined(rows, 10)
    assert sorted(map(tuple, got)) == want and len(want) > 200
    assert hard_negatives.mined(frame.limit(0), lambda c: c % 10 == 0).count() == 0
    assert hard_negatives.mined(frame, lambda c: c == -1).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = [2.0**20, 1.0, 3.0]
    rows = [(0, big, 0), (1, [2.0**20, 1.0, 2.0], 0)] + [(2 + i, [0.9 * 2.0**20 + i / 256, 1.0, 2.0], 1) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.mined(frame, lambda c: c == 0).collect())) == [r for r in slow_mined(rows, 1) if r[0] == 0]
    huge = [(0, [1e30], 0), (1, [1e30], 0), (2, [-1e30], 1)]
    assert hard_negatives.mined(spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int"), lambda c: c == 0).count() == 0


def test_bounds_save_measuring():
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((12, 32)) * 100
    x = np.floor(np.repeat(centres, 100, 0) + draw.standard_normal((1200, 32)))
    rows = hard_negatives.Candidates(np.arange(1200), np.repeat(np.arange(12), 100), x)
    anchors = x[::30]
    for node, at, score in hard_negatives.walked(anchors, rows, lambda n, low, high: high >= 0.8 * (anchors[n] ** 2).sum()):
        exact = x @ anchors[node]
        assert set(np.flatnonzero(exact >= 0.8 * (anchors[node] ** 2).sum())) <= set(at.tolist()) and (exact[at] == score).all()
    assert rows.measured < 0.4 * len(anchors) * len(x)


def test_registered_queries_keep_their_columns(spark):
    root = "/root/testdata/sf0.001"
    assert queries.op12_periodic_runs(spark, root).count() == spark.read.parquet(f"{root}/documents.parquet").count()
