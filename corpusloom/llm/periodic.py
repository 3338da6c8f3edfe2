"""Periodic runs of words: a suffix automaton with link-cut access over each whole text.

The automaton of a word sequence has a tree of suffix links: the path from prefix ``i`` to the root holds every
string that ends at word ``i``. Appending word ``i`` is an access to this path. It is cut into segments of nodes that
last occurred at the same earlier end ``j``; all of them then get the colour ``i``. The longest string of a segment has
``high`` words, so if ``i - j <= high`` the ``high + i - j`` words up to ``i`` repeat with period ``i - j``, and this
period is the smallest one (a smaller one would have left a later end). Every square with a primitive root is seen this
way at its last word; it is extended to the right as long as words repeat, and gives each maximal run once.

Segments are kept as stacks on the heavy chains of the tree: an access colours the upper part of each chain it meets,
so it pops what lies above and pushes one segment. All accesses together touch O(n log^2 n) segments.

Texts with few repeats don't need all of that. In a run of length L >= max(least, 2 * period) every word lies in a
window of ``least / 2`` words that occurs again in the same run. So an automaton is built only for stretches covered by
windows that occur twice in the stretch; the rest of the text can't belong to a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, documents_of, mix64, slices_of, words_in

LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """The suffix automaton of a sequence: link and longest length of each state, and the state of each prefix."""

    def __init__(self, words: list[int]) -> None:
        step: list[dict[int, int]] = [{}]
        self.link, self.length, self.prefix = [-1], [0], []
        link, length = self.link, self.length
        last = 0
        for w in words:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            p = last
            while p >= 0 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p >= 0:
                q = step[p][w]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    step.append(dict(step[q]))
                    while p >= 0 and step[p].get(w) == q:
                        step[p][w] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            self.prefix.append(new)
            last = new

    def chains(self) -> list[int]:
        """The head of each state's heavy chain in the tree of links."""
        link, count = self.link, len(self.link)
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        size, heavy, most = [1] * count, [0] * count, [0] * count
        for v in reversed(order[1:]):
            up, mine = link[v], size[v]
            size[up] += mine
            if mine > most[up]:
                most[up], heavy[up] = mine, v
        head = list(range(count))
        for v in order[1:]:
            if heavy[link[v]] == v:
                head[v] = head[link[v]]
        return head


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, period, start) of repetitions, those of one run once: at least the first time its period has passed twice."""
    tree = Automaton(words)
    head, link, length = tree.chains(), tree.link, tree.length
    stacks: dict[int, list[tuple[int, int]]] = {}
    reach: dict[int, int] = {}
    n = len(words)
    for i, state in enumerate(tree.prefix):
        while state > 0:
            top, depth = head[state], length[state]
            stack = stacks.setdefault(top, [])
            high = 0
            while stack and high < depth:
                high, j = stack[-1]
                if high > depth:
                    high = depth
                else:
                    stack.pop()
                period = i - j
                if period <= high and reach.get(period, -1) < i:
                    end = i + 1
                    while end < n and words[end] == words[end - period]:
                        end += 1
                    reach[period] = end - 1
                    yield end, period, j - high + 1
            stack.append((depth, i))
            state = link[top]


def stretches(ids: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Spans (from, to) that hold every run whose words all lie in windows of ``width`` that occur again in it."""
    n = len(ids) - width + 1
    if n < 2:
        return []
    value, key = mix64((ids + 1).astype(np.uint64) * _FACTOR), np.zeros(n, np.uint64)
    for k in range(width):
        key = key * _FACTOR + value[k : n + k]
    _, kind = np.unique(key, return_inverse=True)
    at = np.flatnonzero(np.bincount(kind)[kind] > 1)
    while len(at):
        first = np.ones(len(at), bool)
        first[1:] = at[1:] > at[:-1] + width
        part = np.cumsum(first) - 1
        _, back = np.unique(kind[at] * np.int64(len(at) + 1) + part, return_inverse=True)
        again = np.bincount(back)[back] > 1
        if again.all():
            starts = at[first]
            ends = at[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)] + width
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        at = at[again]
    return []


def runs_in(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least`` words and two periods, in this order."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return []
    found = []
    for start, end in stretches(ids, (least + 1) // 2):
        if end - start >= least:
            for stop, period, at in squares(ids[start:end].tolist()):
                if stop - at >= least:
                    found.append((start + at, stop - at, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    free = np.cumsum(step[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(free).tolist()])


def marked(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed text for every row of ``docs``.

    A null text counts as empty: no runs, an empty text. Words are cut at ASCII white space and compared as they are.
    A null doc_id is kept, repeated rows are returned each, other columns are left out; an empty table gives no row.
    Texts are read whole; memory follows the longest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            spans, texts, sizes = [], [], []
            for t in batch.column("text").cast(pa.binary()):
                words = t.as_py().split()
                found = runs_in(words, least)
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found))
                sizes.append(len(words))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return documents_of(docs).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def repeated_tail(text: Column, n: Column, start: Column, period: Column) -> Column:
    """The words of ``text`` joined by a space, those from ``start`` on replaced by repeats of the ``period`` there."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    times = F.ceil((n - start) / period).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, (start + 1).cast("int"), period.cast("int")), times))
    return F.array_join(F.concat(F.slice(words, 1, start.cast("int")), F.slice(tail, 1, (n - start).cast("int"))), " ")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, where one document in ten (by the checksum of its id) ends in a periodic run.

    A null doc_id has no checksum: its text stays. So does a text without words.
    """
    rows = documents_of(docs).withColumns({"_h": F.crc32(F.col("doc_id").cast("string").cast("binary")), "_n": words_in(F.col("text"))})
    some = (F.col("_h") % 10 == 0) & (F.col("_n") > 0)
    g, n = F.floor(F.col("_h") / 10), F.col("_n")
    start = g % n
    period = 1 + F.floor((n - start) / (3 + g % 8))
    return rows.select("doc_id", F.when(some, repeated_tail(F.col("text"), n, start, period)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and hashes of all runs and of the collapsed text (from ``marked``)."""
    order = lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int")
    rows = found.withColumn("_best", F.get(F.array_sort("runs", order), F.lit(0)))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = [F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli")
    hashes = [F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")]
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, *hashes)
