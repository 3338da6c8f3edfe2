"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern offers its
words once for each pass, and every further pass costs more (0, 1, 2, ...: convex). The cheapest flow
from patterns to source quotas says how many words each pattern gives. A pattern that shares its only source with no
other is a flow of one edge, found in closed form; patterns that overlap are solved in their connected parts, one part
in a task (its size is that of the patterns, not of the documents).

Documents are then taken in the order of a seeded hash: whole passes over the pattern, then one pass in which a
document that no longer fits is skipped and the next ones go on. What is short in the end is less than any unused
document, and one further document is taken if it brings the pattern nearer. The places where a document is skipped
are found from histograms of the hash in two levels, so no pattern is ordered in one task; near its target the next few
hundred documents of a pattern are tried one by one.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, words_in
from corpusloom.llm.components import connected
from corpusloom.scale import running_sum, salted_join, top_k

PASSES = 3
_LEVELS = (12, 24)
_NEXT = 512
_END = (1 << 63) - 1
_SEGMENTS = "array<struct<after:long,before:long,most:long>>"


class Network:
    """Successive shortest paths on a small graph with integer capacities and costs."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.out)
        while True:
            dist, via = {source: 0}, {}
            heap = [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] and (n := d + self.cost[e] + height[x] - height[y]) < dist.get(y, n + 1):
                        dist[y], via[y] = n, e
                        heapq.heappush(heap, (n, y))
            if sink not in dist:
                return
            far = max(dist.values())
            height = [h + dist.get(x, far) for x, h in enumerate(height)]
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step


def routed(
    patterns: dict[tuple, int], quotas: dict, passes: int = PASSES, members: Callable[[tuple], tuple] = tuple
) -> dict[tuple, dict]:
    """pattern -> {source: words} of the cheapest flow that fills the quotas as far as it can.

    ``members`` gives a pattern's sources (by default the pattern itself).
    """
    names, spots = list(patterns), {s: i for i, s in enumerate(quotas)}
    base = 1 + len(names)
    sink = base + len(spots)
    net = Network(sink + 1)
    arcs: dict[tuple, dict] = defaultdict(dict)
    for i, pattern in enumerate(names, 1):
        for k in range(passes):
            net.edge(0, i, patterns[pattern], k)
        for s in members(pattern):
            arcs[pattern][s] = net.edge(i, base + spots[s], passes * patterns[pattern], 0)
    for s, i in spots.items():
        net.edge(base + i, sink, round(quotas[s]), 0)
    net.run(0, sink)
    return {p: {s: net.room[e ^ 1] for s, e in arcs[p].items()} for p in names}


def repeating_weights(sources: DataFrame) -> DataFrame:
    """``sources`` with weight: in code point order, null last, they weigh 1, 2, 3, 1, ..."""
    ranked = running_sum(sources.withColumns({"_null": F.col("source").isNull(), "_one": F.lit(1)}), [], ["_null", "source"], "_one", "_rank")
    return ranked.withColumn("weight", F.col("_rank") % 3 + 1).drop("_null", "_one", "_rank")


def targets(sources: DataFrame, total: float, most: float = PASSES) -> DataFrame:
    """``sources`` (size, weight) with target: shares of ``total`` by weight, none above ``most`` times its size.

    What a full source can't take is shared again by weight among the others. Only sums reach the driver.
    """
    level, full = 0.0, F.col("size") * most < F.col("weight") * F.lit(0.0)
    while True:
        row = sources.agg(F.sum(F.when(full, F.col("size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[1]:
            break
        now = (total - float(row[0] or 0)) / float(row[1])
        if now <= level:
            break
        level = now
        full = F.col("size") * most < F.col("weight") * level
    return sources.withColumn("target", F.least(F.col("size") * float(most), F.col("weight") * F.lit(level)))


def _hashed(value: Column) -> Column:
    """A long that stands for a source or a pattern; null is a value of its own."""
    return F.xxhash64(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))


def _prepared(docs: DataFrame, members: Column, seed: int) -> DataFrame:
    """(row: the input row, pattern, p, words, order) for every row of ``docs``; order is the seeded hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.array_sort(F.array_distinct(members)).alias("pattern"), words_in(text).alias("words"), order.alias("order"))
    return rows.withColumn("p", _hashed(F.col("pattern")))


def flows(patterns: DataFrame, sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """(p, n, flow) of the cheapest flow from ``patterns`` (p, pattern, n) to ``sources`` (s, target)."""
    edges = patterns.select("p", "pattern", "n", F.explode("pattern").alias("source")).withColumn("s", _hashed(F.col("source")))
    degree = edges.groupBy("s").agg(F.count("*").alias("degree"))
    edges = stored(edges.join(sources.select("s", "target"), "s").join(degree, "s"), "mix-edges")
    alone = (F.size("pattern") == 1) & (F.col("degree") == 1)
    single = edges.where(alone).select("p", "n", F.least(F.round("target").cast("long"), F.col("n") * passes).alias("flow"))
    shared = edges.where(~alone)
    if shared.isEmpty():
        return single

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        offers = {(p, n): tuple(g) for (p, n), g in part.groupby(["p", "n"])["s"]}
        by_name = {tuple([p, *members]): n for (p, n), members in offers.items()}
        quotas = dict(zip(part["s"].tolist(), part["target"].tolist(), strict=True))
        flow = routed(by_name, quotas, passes, members=lambda name: name[1:])
        return pd.DataFrame([(k[0], n, sum(flow[k].values())) for k, n in by_name.items()], columns=["p", "n", "flow"])

    parts = connected(shared.select(F.col("p").alias("a"), F.col("s").alias("b")))
    shared = shared.join(parts, F.col("p") == F.col("node")).select("component", "p", "n", "s", "target")
    return single.union(shared.groupBy("component").applyInPandas(solve, "p long, n long, flow long"))


def plan(docs: DataFrame, members: Column, weights: DataFrame | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(p, passes, segments, extra of each pattern; source, s, size, weight, target of each source).

    A document is taken ``passes`` times, once more if its hash lies between ``after`` and ``before`` of a segment and it
    has ``most`` words or fewer, and once more if its hash is ``extra``. Rows that repeat a document share a hash and
    are taken alike. ``weights`` (source, weight) replaces the repeating weights 1, 2, 3.
    """
    prepared = _prepared(docs.select("doc_id", "text", members.alias("_members")), F.col("_members"), seed)
    units = prepared.groupBy("p", "order").agg(F.first("pattern").alias("pattern"), F.sum("words").alias("n"), F.max("words").alias("words"))
    units = stored(units, "mix-units")
    patterns = stored(units.groupBy("p").agg(F.first("pattern").alias("pattern"), F.sum("n").alias("n")), "mix-patterns")
    sources = patterns.select(F.explode("pattern").alias("source"), "n").groupBy("source").agg(F.sum("n").alias("size"))
    if weights is None:
        weighed = repeating_weights(sources)
    else:
        weighed = sources.join(weights.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    weighed = stored(weighed.withColumn("s", _hashed(F.col("source"))), "mix-weights")
    total = patterns.agg(F.sum("n")).first()[0] or 0
    wanted = stored(targets(weighed, total), "mix-targets")
    spread = flows(patterns, wanted).where("n > 0")
    spread = spread.select("p", F.floor(F.col("flow") / F.col("n")).alias("passes"), (F.col("flow") % F.col("n")).alias("need"))
    return _chosen(units.where("n > 0").select("p", "order", "n", "words"), stored(spread, "mix-flows")), wanted


def _chosen(units: DataFrame, spread: DataFrame) -> DataFrame:
    """The segments and the extra document of each pattern: ``need`` words in hash order, skipping what doesn't fit."""
    state = spread.select("p", "passes", F.col("need").alias("left"), F.lit(None).cast("long").alias("at"), F.array().cast(_SEGMENTS).alias("segments"))
    state = stored(state, "mix-state")
    while True:
        ahead = stored(_ahead(units, state), "mix-ahead")
        if ahead.isEmpty():
            break
        moved = state.join(_stops(ahead), "p", "left")
        segment = F.struct(F.col("at").alias("after"), F.col("stop").alias("before"), F.col("left").alias("most"))
        moved = moved.withColumn("segments", F.when(F.col("got").isNotNull(), F.concat("segments", F.array(segment))).otherwise(F.col("segments")))
        # Without a stop the whole rest was taken: nothing is ahead, so the place is the end.
        at = F.when(F.col("got").isNotNull(), F.coalesce("stop", F.lit(_END))).otherwise(F.col("at"))
        moved = moved.select("p", "passes", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"), at.alias("at"), "segments")
        state = stored(moved, "mix-state")
        next_ones = top_k(_ahead(units, state), ["p"], [F.col("order")], _NEXT).withColumnsRenamed({"left": "room"})
        moved = state.join(next_ones.groupBy("p").applyInPandas(_one_by_one, f"p long, now_left long, now_at long, more {_SEGMENTS}"), "p", "left")
        none = F.array().cast(_SEGMENTS)
        moved = moved.select("p", "passes", F.coalesce("now_left", "left").alias("left"), F.coalesce("now_at", "at").alias("at"), F.concat("segments", F.coalesce("more", none)).alias("segments"))
        state = stored(moved, "mix-state")
    taken = salted_join(units, state.where("left > 0"), ["p"]).where(~_inside(F.col("segments"), F.col("order"), F.col("words")))
    miss = F.abs(F.col("n") - F.col("left"))
    best = taken.where(miss < F.col("left")).groupBy("p").agg(F.min_by("order", F.struct(miss, "order")).alias("extra"))
    return stored(state.join(best, "p", "left").select("p", "passes", "segments", "extra"), "mix-plan")


def _ahead(units: DataFrame, state: DataFrame) -> DataFrame:
    """The units that come after the place reached by their pattern and aren't larger than what it has left."""
    open_ = state.where("left > 0").select("p", "left", "at")
    found = salted_join(units, open_, ["p"]).where("words <= left AND (at IS NULL OR order > at)")
    return found.select("p", "order", "n", "words", "left", "at")


def _one_by_one(part: pd.DataFrame) -> pd.DataFrame:
    """The next units of one pattern in their order: take what fits, skip the others."""
    part = part.sort_values("order")
    left, start, segments = int(part["room"].iloc[0]), part["at"].iloc[0], []
    after, most, last, rows = None if pd.isna(start) else int(start), left, len(part) - 1, part[["order", "n", "words"]].to_numpy()
    for i, (order, n, words) in enumerate(rows.tolist()):
        if words > most:
            continue
        if n > left:
            segments.append((after, order, most))
            after, most = order, left
        else:
            left -= n
        if i == last or not left:
            break
    end = int(rows[i][0])
    if after != end:
        segments.append((after, end + 1, most))
    return pd.DataFrame({"p": [part["p"].iloc[0]], "now_left": [left], "now_at": [end], "more": [[dict(zip(("after", "before", "most"), x, strict=True)) for x in segments]]})


def _stops(ahead: DataFrame) -> DataFrame:
    """(p, got, stop): words before the first unit that doesn't fit into ``left``, and its hash (null: all fit).

    ``ahead`` has units in the order of their hash.
    """
    whole = ahead.groupBy("p").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    fitting = whole.where("n <= left").select("p", F.col("n").alias("got"), F.lit(None).cast("long").alias("stop"))
    rows = salted_join(ahead, whole.where("n > left").select("p", F.lit(0).cast("long").alias("sure")), ["p"])
    for bits in _LEVELS:
        cell = F.shiftright("order", 64 - bits).alias("cell")
        cells = rows.groupBy("p", cell).agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("sure").alias("sure"))
        along = Window.partitionBy("p").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("upto", F.col("sure") + F.sum("n").over(along))
        edge = cells.where("upto > left").groupBy("p").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("n")).alias("sure")), "cell").alias("e"))
        edge = edge.select("p", F.col("e.cell").alias("_cell"), F.col("e.sure").alias("_sure"))
        rows = salted_join(rows, edge, ["p"]).where(F.shiftright("order", 64 - bits) == F.col("_cell"))
        rows = rows.select("p", "order", "n", "left", F.col("_sure").alias("sure"))
    along = Window.partitionBy("p").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.col("sure") + F.sum("n").over(along)).where("upto > left")
    stop = rows.groupBy("p").agg(F.min_by(F.struct((F.col("upto") - F.col("n")).alias("got"), F.col("order").alias("stop")), "order").alias("r"))
    return stored(fitting.union(stop.select("p", "r.got", "r.stop")), "mix-stops")


def _inside(segments: Column, order: Column, words: Column) -> Column:
    def one(s: Column) -> Column:
        low = s["after"].isNull() | (order > s["after"])
        return low & (s["before"].isNull() | (order < s["before"])) & (words <= s["most"])

    return F.exists(segments, one)


def _taken(docs: DataFrame, members: Column, takes: DataFrame, seed: int) -> DataFrame:
    """(row, pattern, words, times: how often the mix takes the row) for every row of ``docs``."""
    again = _inside(F.col("segments"), F.col("order"), F.col("words")) | (F.col("order") == F.col("extra"))
    times = F.coalesce("passes", F.lit(0)) + F.coalesce(again, F.lit(False)).cast("long")
    joined = salted_join(_prepared(docs, members, seed), takes, ["p"], "left", ["order"])
    return joined.select("row", "pattern", "words", F.when(F.col("words") > 0, times).otherwise(0).alias("times"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken for documents with one source each.

    A null text has size 0 and nothing is taken of it; a null source is a source of its own. Repeated rows are
    counted and taken each, all or none of them in a pass. A source without words has target 0. An empty table gives no row.
    No unused document would bring a source nearer to its target.
    """
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    takes, wanted = plan(rows, F.array("source"), weights, seed)
    out = _taken(rows, F.array("source"), takes, seed).withColumn("s", _hashed(F.col("pattern")[0]))
    facts = wanted.select("s", F.col("size").alias("source_size"), "target")
    out = salted_join(out, facts, ["s"], spread_by=["words", "row"])
    doc_id, taken = F.col("row.doc_id").cast("long").alias("doc_id"), (F.col("words") * F.col("times")).alias("taken")
    return out.select(doc_id, F.col("words").alias("size"), "source_size", "target", taken)


def repeated(docs: DataFrame, weights: DataFrame | None = None, seed: int = 7, turn: str | None = None) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken (not at all, or up to three times).

    Columns of any name pass through unchanged; ``turn`` adds a column that numbers the copies of a row from 1 on.
    """
    source = F.array(F.col("source").cast("string"))
    takes, _ = plan(docs, source, weights, seed)
    out = _taken(docs, source, takes, seed).where("times > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("turn"))
    return out.select("row.*", *([F.col("turn").alias(turn)] if turn else []))
