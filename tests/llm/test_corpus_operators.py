"""Neighbours, language model, mixing and vector duplicates against brute force; the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import katz, mixing, multi_index, rotated_codes
from corpusloom.llm.components import connected

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, score int, n string"


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    x = draw.standard_normal((260, 24))
    x[200:240] = x[:40] + 0.08 * draw.standard_normal((40, 24))
    x[240:250] = x[0]
    x[250:260] = 3 * x[1]
    rows = [(i, [float(np.float32(v)) for v in row], 0, "") for i, row in enumerate(x)]
    rows += [rows[7], (900, None, 0, ""), (901, [0.0] * 24, 0, ""), (902, [math.nan] * 24, 0, ""), (903, [None] + [1.0] * 23, 0, "")]
    return [*rows, (904, [math.inf] * 24, 0, ""), (905, [], 0, ""), (906, [1.0, 2.0], 0, ""), (None, [1.0] * 24, 0, "")]


def usable(rows):
    found = {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[0] < 900}
    ids = np.array(sorted(found))
    return ids, np.stack([found[i] for i in ids])


@pytest.mark.parametrize("block", [32, 4096])
def test_nearest_against_brute_force(spark, vectors, block):
    ids, x = usable(vectors)
    got = defaultdict(list)
    frame = spark.createDataFrame(vectors, VECTORS)
    for r in rotated_codes.nearest(frame, lambda c: F.col(c) % 10 == 0, k=5, block=block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in [i for i in ids if i % 10 == 0]:
        scores = rotated_codes.cosine(np.repeat(x[ids == q], len(ids), 0), x)
        want = sorted(((-s, i) for s, i in zip(scores, ids, strict=True) if i != q))[:5]
        mine = got[q]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(m[2] - scores[ids == m[1]][0]) < 1e-12 for m in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits += len({m[1] for m in mine} & {i for _, i in want})
        total += 5
    assert hits >= 0.97 * total
    assert rotated_codes.nearest(frame.limit(0), lambda c: F.col(c) % 10 == 0).count() == 0


def test_few_candidates_and_error_bounds(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rotated_codes.nearest(frame, lambda c: F.col(c) == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(1, 0.894427), (2, -1.0)]
    draw = np.random.default_rng(1)
    x, q = draw.standard_normal((4000, 64)), draw.standard_normal((20, 64))
    bits, fit = rotated_codes.encode(x, 11)
    guess, off = rotated_codes.Planes(q, 11).estimates(slice(0, 20), bits, fit, 2.5)
    true = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    assert abs((guess - true).mean()) < 2e-3 and np.mean(np.abs(guess - true) <= off) > 0.97


def test_vectors_of_extreme_length(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [1e-310, 0.0]), (3, [-1e300, 1e300]), (50, [3.0, 6.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rotated_codes.nearest(frame, lambda c: F.col(c) == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 50, 2, 3] or [r.vec_id for r in got] == [1, 50, 3, 2]
    assert [round(r.score, 6) for r in got] == [1.0, 1.0, 0.447214, 0.316228]


def test_vector_duplicates_against_brute_force(spark, vectors):
    ids, x = usable(vectors)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    label = np.arange(len(ids))
    for _ in ids:
        label = np.array([label[n].min() for n in near])
    want = [(int(i), int(near[k].sum() - 1), int(ids[label[k]]), bool(label[k] == k)) for k, i in enumerate(ids)]
    want += [(i, 0, i, True) for i in range(900, 907)]
    frame = spark.createDataFrame(vectors, VECTORS)
    out = multi_index.near_duplicates(frame).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None)
    assert got == want
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)]
    assert multi_index.near_duplicates(frame.limit(0)).count() == 0


def test_traversal_visits_every_cell_that_can_hold_a_link():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((800, 16))
    x[400:] = x[:400] + 0.05 * draw.standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = multi_index.codebook(x[:, :8], 12), multi_index.codebook(x[:, 8:], 12)
    own1, near1 = multi_index.least_squares(x[:, :8], books[0])
    own2, near2 = multi_index.least_squares(x[:, 8:], books[1])
    visits = [set(multi_index.traversal(a, b, 0.1).tolist()) for a, b in zip(near1, near2, strict=True)]
    cell = own1 * len(books[1]) + own2
    for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True):
        assert cell[j] in visits[i]
    sums = [near1[0][v // len(books[1])] + near2[0][v % len(books[1])] for v in multi_index.traversal(near1[0], near2[0], 0.1)]
    assert sums == sorted(sums)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(60)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(60)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# -- op6 ---------------------------------------------------------------------------------------------


def slow_katz(rows, cutoff=katz.CUTOFF):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    split = [[*SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")), "</s>"] for r in rows]
    train = [s for s, h in zip(split, held, strict=True) if not h]
    uni, pairs = Counter(w for s in train for w in s), Counter(p for s in train for p in zip(["<s>", *s], s, strict=False))
    total = sum(uni.values())
    d1, d2 = (katz.discounts([0] + [sum(n == r for n in c.values()) for r in range(1, cutoff + 2)]) for c in (uni, pairs))
    d = lambda f, n: f[min(n, cutoff + 1)]
    unknown = 1 - sum(d(d1, n) * n for n in uni.values()) / total
    p1 = lambda w: d(d1, uni[w]) * uni[w] / total if uni[w] else unknown
    after = defaultdict(dict)
    for (a, b), n in pairs.items():
        after[a][b] = n
    base_of = {}
    for a, f in after.items():
        n = sum(f.values())
        base_of[a] = n + 1 if all(x > cutoff for x in f.values()) else n

    def p2(a, b):
        if a not in after:
            return p1(b)
        if b in after[a]:
            return d(d2, after[a][b]) * after[a][b] / base_of[a]
        free = 1 - sum(d(d2, n) * n for n in after[a].values()) / base_of[a]
        return free / (1 - sum(p1(w) for w in after[a])) * p1(b)

    for a in list(after)[:5]:
        assert abs(sum(p2(a, w) for w in uni) + p2(a, "never seen") - 1) < 1e-9
    out = []
    for r, h, s in zip(rows, held, split, strict=True):
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in s)
        score = sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *s], s, strict=False))
        out.append((str(r[0]), h, len(s), sum(uni[w] > 0 for w in s), total, base, score))
    return sorted(out)


@pytest.mark.parametrize("head", [4, katz.HEAD])
def test_katz_against_brute_force(docs, nothing, texts, head):
    more = [(1000 + i, f"{r[1][::-1]} {r[1]} rare{i} rare{i // 2}") for i, r in enumerate(texts[:40])]
    rows = [r[:2] for r in texts] + more
    frame = docs.select("doc_id", "text", "score", "key").union(docs.sparkSession.createDataFrame([(*m, 1, 1) for m in more], "doc_id long, text string, score int, key int"))
    held = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 1
    got = katz.scored(frame, held, katz.train(frame, held, head=head)).collect()
    mine = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for g, w in zip(mine, slow_katz(rows), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6)
    if head == 4:
        assert katz.scored(nothing, held, katz.train(nothing, held)).count() == 0
        alone = katz.scored(frame, held, katz.train(nothing, held))
        assert alone.where("n_known > 0 OR score IS NULL").count() == 0


def test_packing():
    a, b = np.arange(1000, dtype=np.uint64), np.array([1 << 63, 5], np.uint64)
    x, y, z = katz.unpacked(katz.packed(a, b, np.zeros(0)))
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist() and len(z) == 0


# -- op7 ---------------------------------------------------------------------------------------------


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight, full = {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in full]
        left, total = sum(sizes.values()) - sum(full.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in free}
        full |= {s: 3.0 * sizes[s] for s in over}


def check_mix(out, rows):
    """Sizes, targets, and that no unused document would bring a source nearer to its target."""
    words = lambda t: len(SPLIT.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += words(r[1])
    want = slow_targets(dict(sizes))
    by_size = defaultdict(list)
    for s in sizes:
        by_size[sizes[s]].append(want[s])
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r[0]), words(r[1])) for r in rows)
    assert all(any(r.target == pytest.approx(t) for t in by_size[r.source_size]) for r in out)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in out)
    groups = defaultdict(list)
    for r in out:
        groups[r.source_size, r.target].append(r)
    for (size, target), docs in groups.items():
        if len(by_size[size]) > 1:
            continue
        short = target - sum(r.taken for r in docs)
        least = min(r.taken // r.size for r in docs if r.size) if size else 0
        units = Counter((r.doc_id, r.size) for r in docs if r.size and r.taken // r.size == least)
        assert all(abs(short) <= abs(short - n * many) + 1 for (_, n), many in units.items())


def test_mixing_meets_its_targets(docs, nothing, texts):
    out = mixing.mixed(docs).collect()
    again = sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))
    assert sorted(map(str, out)) == again
    check_mix(out, texts)
    assert mixing.mixed(nothing).count() == 0
    clash = docs.withColumns({c: F.lit(77) for c in ("_words", "words", "order", "row", "p", "times", "turn", "segments")})
    mix = mixing.repeated(clash).collect()
    assert list(mix[0].asDict()) == clash.columns and len(mix) == sum(r.taken // r.size for r in out if r.size)
    assert all(r["_words"] == r["words"] == r["order"] == r["turn"] == r["segments"] == 77 for r in mix)
    turns = mixing.repeated(docs, turn="copy").groupBy("doc_id", "text", "copy").count()
    assert turns.agg(F.max("copy")).first()[0] <= 3


@pytest.mark.parametrize("seed", range(4))
def test_long_documents_do_not_leave_a_source_short(spark, seed):
    draw = random.Random(seed)
    rows = [(1, "w " * 4000, "a"), *[(i, "w " * 10, "a") for i in range(2, 602)], (5000, "v " * 9000, "b"), (5001, "v " * 300, "b")]
    rows += [(6000 + i, "u " * draw.choice([1, 3, 50, 700, 2000]), "c") for i in range(60)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=seed).collect()
    check_mix(out, rows)
    small = [r for r in out if r.doc_id < 5000]
    assert abs(sum(r.taken for r in small) - small[0].target) <= 5


def test_targets_stop_at_three_times_a_source(spark):
    rows = spark.createDataFrame([("a", 10, 3), ("b", 1000, 1), ("c", 0, 2)], "source string, size long, weight long")
    assert {r.source: r.target for r in mixing.targets(rows, 1010).collect()} == {"a": 30.0, "b": 980.0, "c": 0.0}


def test_overlapping_sources_are_routed_by_parts(spark):
    rows = [(i, "w " * 10, [["a"], ["b"], ["a", "b"], ["c"]][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    weights = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "source string, weight long")
    takes, wanted = mixing.plan(docs, F.col("m"), weights)
    target = {r.source: r.target for r in wanted.collect()}
    assert target == {"a": 1000.0, "b": 2000.0, "c": 1000.0}
    out = mixing._taken(docs, F.col("m"), takes, 7).groupBy("pattern").agg(F.sum(F.col("words") * F.col("times")).alias("n"))
    taken = {tuple(r.pattern): r.n for r in out.collect()}
    assert taken["c",] == 1000 and sum(taken.values()) == 4000 and taken["a",] <= 1000 <= taken["b",] <= 2000


def test_flow_shares_overlapping_documents_at_least_cost():
    flow = mixing.routed({("a",): 10, ("b",): 10, ("a", "b"): 10}, {"a": 12, "b": 18})
    assert sum(f.get("a", 0) for f in flow.values()) == 12 and sum(f.get("b", 0) for f in flow.values()) == 18
    assert {p: sum(f.values()) for p, f in flow.items()} == {("a",): 10, ("b",): 10, ("a", "b"): 10}


def test_mixing_at_scale_of_one_source(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', cast(id % 37 + 1 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    by = mixing.mixed(rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 1.5 for r in by)


# -- pipeline ----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, nothing, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for first in (docs, nothing):
        stage = first
        for _, run in corpus_pipeline.STAGES[:-1]:
            before, stage = stage.columns, run(spark, stage, str(tmp_path))
            assert stage.columns == before
        last = corpus_pipeline.STAGES[-1][1](spark, stage, str(tmp_path))
        assert last.count() == stage.count()
