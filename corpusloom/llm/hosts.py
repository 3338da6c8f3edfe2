"""Host-level quality rules: failures of document rules by host, rates shrunk by an empirical beta prior.

1. Each document gets counts (``measured``) and the rules it fails (``RULES``, conditions on the counts).
2. By host: documents, and failures of each rule.
3. For each rule a beta prior is fitted to the rates of all hosts by moments: ``m`` is their mean, and what their
   variance holds beyond the binomial one gives the prior's strength ``s``. A host's rate is
   ``(failures + m * s) / (documents + s)``, so a host with few documents stays near the mean of all hosts.
4. A host is rejected if one of its shrunk rates is above ``limit``; the verdict is joined back to its documents.

Only one row of moments reaches the driver. Hosts are aggregated before they are shuffled, and the join back is salted,
so a host with a third of all documents isn't one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import documents_of, slices_of, stored
from corpusloom.scale import salted_join

LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
# Conditions on the counts; a document fails a rule whose condition holds. The first two make the base.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "lengths": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
BASE = ("short", "repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOLS = np.isin(np.arange(256), list(SYMBOLS.encode()))
_INNER = (np.arange(256) & 0xC0) == 0x80  # bytes inside a code point


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, its first place included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    window = ids[:n]
    for k in range(1, width):
        _, window = np.unique(window * len(number) + ids[k : n + k], return_inverse=True)
    twice = np.bincount(window)[window] > 1
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text in UTF-8."""
    data = np.frombuffer(text, np.uint8)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars = len(data) - int(_INNER[data].sum()) - int(_SPACES[data].sum())
    return len(words), chars, int(_SYMBOLS[data].sum()), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, ``more`` and the counts for every row of ``docs``; a null text counts as empty."""
    rows = documents_of(docs, *more)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            texts = batch.column("text").cast(pa.binary())
            found = np.array([counts_of(t.as_py()) for t in texts], np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(c) for c in kept] + [pa.array(found[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *COUNTS])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema]
    return rows.mapInArrow(run, ", ".join([*types, *(f"{c} long" for c in COUNTS)]))


def shrunk(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """``hosts`` (n, and failures of each rule) with ``rate_<rule>``, shrunk by the prior of all hosts.

    Without a variance beyond the binomial one hosts can't be told apart: the strength is then the number of all
    documents, and every rate lies near the mean.
    """
    rate = {r: F.col(r) / F.col("n") for r in rules}
    moments = [F.avg(1 / F.col("n")).alias("inverse"), F.sum("n").alias("total")]
    moments += [m for r in rules for m in (F.avg(rate[r]).alias(f"m_{r}"), F.var_pop(rate[r]).alias(f"v_{r}"))]
    seen = hosts.agg(*moments).first()
    out = hosts
    for r in rules:
        mean, more = seen[f"m_{r}"] or 0.0, 0.0
        if mean not in (0.0, 1.0):
            more = seen[f"v_{r}"] - mean * (1 - mean) * seen["inverse"]
        most = float(seen["total"] or 0)
        strength = min(max(mean * (1 - mean) / more - 1, 0.0), most) if more > 0 else most
        out = out.withColumn(f"rate_{r}", (F.col(r) + mean * strength) / (F.col("n") + strength))
    return out


def judged(docs: DataFrame, host: Column, rules: dict[str, str] | None = None, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, the counts, failed (names of rules), host_rejected.

    Null and empty texts have no words and fail the rules on counts below a bound only; a null host is a host of its
    own, as is the empty one. A null doc_id is kept. Repeated rows are counted and returned each. Columns of ``docs``
    whose names clash with those here go no further. An empty table gives no row.
    """
    rules = RULES if rules is None else rules
    names = list(rules)
    rows = docs.select("doc_id", "text", host.cast("string").alias("host"))
    failed = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in rules.items()]))
    rows = stored(measured(rows, "host").withColumn("failed", failed), "hosts-documents")
    sums = [F.sum(F.array_contains("failed", r).cast("long")).alias(r) for r in names]
    verdicts = shrunk(rows.groupBy("host").agg(F.count("*").alias("n"), *sums), names)
    verdicts = verdicts.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in names], F.lit(0.0)) > limit)
    key = [F.col("host").isNull().alias("no_host"), F.coalesce("host", F.lit("")).alias("host_key")]
    found = salted_join(rows.select("*", *key), verdicts.select(*key, "host_rejected"), ["no_host", "host_key"])
    return found.select("doc_id", "host", *COUNTS, "failed", "host_rejected")


def verdicts_sql(rules: dict[str, str] | None = None, limit: float = LIMIT) -> str:
    """The same in SQL, for documents with their source as host: what ``op11_host_rules`` returns."""
    rules = RULES if rules is None else rules
    word = "'[^\\x20\\x09-\\x0D]+'"
    fails = ", ".join(f"CAST({c} AS INT) AS {r}" for r, c in rules.items())
    sums = ", ".join(f"sum({r}) AS {r}" for r in rules)
    moments = ", ".join(f"avg({r} / n) AS m_{r}, var_pop({r} / n) - avg({r} / n) * (1 - avg({r} / n)) * avg(1.0 / n) AS x_{r}" for r in rules)
    strength = "CASE WHEN x_{0} > 0 AND m_{0} > 0 AND m_{0} < 1 THEN least(greatest(m_{0} * (1 - m_{0}) / x_{0} - 1, 0), total) ELSE total END"
    strengths = ", ".join(f"{strength.format(r)} AS s_{r}" for r in rules)
    bad = " OR ".join(f"({r} + m_{r} * s_{r}) / (n + s_{r}) > {limit}" for r in rules)
    base = " OR ".join(f"f.{r} = 1" for r in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT k, i, w FROM (SELECT k, unnest(regexp_extract_all(text, {word})) AS w, generate_subscripts(regexp_extract_all(text, {word}), 1) AS i FROM d)),
 t AS (SELECT k, i, count(*) OVER (PARTITION BY k, w, w2, w3) AS c FROM (SELECT k, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE w3 IS NOT NULL),
 p AS (SELECT k, count(DISTINCT i + s) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS s) WHERE c > 1 GROUP BY k),
 l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {word}) GROUP BY k),
 c AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, {word})) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN p USING (k) LEFT JOIN l USING (k)),
 f AS (SELECT *, {fails} FROM c),
 h AS (SELECT source, count(*) AS n, {sums} FROM f GROUP BY source),
 m AS (SELECT sum(n) AS total, {moments} FROM h),
 s AS (SELECT *, {strengths} FROM m),
 v AS (SELECT source, {bad} AS rejected FROM h, s)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT ({base}) AND NOT rejected AS kept, rejected AS host_rejected
 FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
