"""Cutting files into chunks: line windows, symbol units, class members, size-bounded parts.

All work on one file stays inside its row (arrays of lines and spans), so chunking a corpus is a
map over files: no shuffle, and one exploded row per finished chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as X

SPAN = "struct<start:int,end:int>"
PIECE = "struct<start:int,end:int,symbol:string,kind:string>"
SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int,parent:string>"


@dataclass(frozen=True)
class ChunkLimits:
    max_lines: int = fixed.MAX_CHUNK_LINES
    max_chars: int = fixed.MAX_CHUNK_CHARS
    split_overlap: int = fixed.SPLIT_OVERLAP_LINES
    window: int = fixed.WINDOW_LINES
    window_overlap: int = fixed.WINDOW_OVERLAP_LINES


def _int(value: int) -> Column:
    return F.lit(value).cast("int")


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _piece(start: Column, end: Column, symbol: Column, kind: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        symbol.cast("string").alias("symbol"),
        kind.cast("string").alias("kind"),
    )


def _empty(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``repo_id, path, line_no, line``."""
    return files.select("repo_id", "path", F.posexplode(X.lines(F.col("text")))).select(
        "repo_id", "path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line")
    )


def windows(start: Column, end: Column, size: int, overlap: int) -> Column:
    """Overlapping line windows of a span, in closed form."""
    step = max(1, size - overlap)
    last = F.greatest(F.ceil((end - start + 1 - size) / step), F.lit(0)).cast("int")
    spans = F.transform(
        F.sequence(_int(0), last),
        lambda i: _span(start + i * step, F.least(end, start + i * step + (size - 1))),
    )
    return F.when(end < start, _empty(SPAN)).otherwise(spans)


def cut(lines: Column, start: Column, end: Column) -> Column:
    """Text of a line span."""
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, _int(0))), "\n")


def fits(lines: Column, start: Column, end: Column, limits: ChunkLimits) -> Column:
    few = end - start + 1 <= limits.max_lines
    # The text is built only for spans that already have few lines.
    return F.when(few, F.length(cut(lines, start, end)) <= limits.max_chars).otherwise(F.lit(False))


def char_bounded(lines: Column, start: Column, end: Column, limits: ChunkLimits) -> Column:
    """Line windows, each packed greedily up to the character limit.

    One line longer than the limit stays whole.
    """
    state = f"struct<spans:array<{SPAN}>,start:int,size:int>"

    def packed(window: Column) -> Column:
        first = window["start"]
        zero = F.struct(
            _empty(SPAN).alias("spans"),
            first.alias("start"),
            F.length(F.get(lines, first - 1)).alias("size"),
        ).cast(state)

        def step(acc: Column, n: Column) -> Column:
            width = F.length(F.get(lines, n - 1))
            joined = acc["size"] + width + 1
            grow = F.struct(acc["spans"].alias("spans"), acc["start"].alias("start"), joined.alias("size"))
            close = F.struct(
                F.array_append(acc["spans"], _span(acc["start"], n - 1)).alias("spans"),
                n.alias("start"),
                width.alias("size"),
            )
            return F.when(joined <= limits.max_chars, grow).otherwise(close).cast(state)

        rest = F.when(window["end"] > first, F.sequence(first + 1, window["end"])).otherwise(_empty("int"))
        return F.aggregate(
            rest, zero, step, lambda acc: F.array_append(acc["spans"], _span(acc["start"], window["end"]))
        )

    return F.flatten(F.transform(windows(start, end, limits.max_lines, limits.split_overlap), packed))


def units(symbols: Column) -> Column:
    """Top-level symbols in file order without those nested in another one."""
    top = F.filter(symbols, lambda s: s["parent"].isNull())
    ordered = F.array_sort(
        F.transform(
            top,
            lambda s, i: F.struct(s["start_line"].alias("a"), (-s["end_line"]).alias("b"), i.alias("i"), s.alias("s")),
        )
    )
    plain = F.transform(ordered, lambda x: x["s"]).cast(f"array<{SYMBOL}>")

    def step(acc: Column, s: Column) -> Column:
        inside = (F.size(acc) > 0) & (s["end_line"] <= F.try_element_at(acc, _int(-1))["end_line"])
        return F.when(inside, acc).otherwise(F.array_append(acc, s)).cast(f"array<{SYMBOL}>")

    return F.aggregate(plain, _empty(SYMBOL), step)


def member_pieces(unit: Column, symbols: Column) -> Column:
    """Pieces of a large unit: its members, and the code between them under the unit's name.

    Members are taken greedily in file order; one that starts inside an earlier one is skipped
    and does not move the cursor.
    """
    mine = F.filter(
        symbols,
        lambda s: (s["parent"] == unit["name"])
        & (s["start_line"] >= unit["start_line"])
        & (s["start_line"] <= s["end_line"])
        & (s["end_line"] <= unit["end_line"]),
    )
    ordered = F.transform(
        F.array_sort(F.transform(mine, lambda s, i: F.struct(s["start_line"].alias("a"), i.alias("i"), s.alias("s")))),
        lambda x: x["s"],
    )
    state = f"struct<cursor:int,pieces:array<{PIECE}>>"
    zero = F.struct(unit["start_line"].alias("cursor"), _empty(PIECE).alias("pieces")).cast(state)

    def step(acc: Column, m: Column) -> Column:
        before = _piece(acc["cursor"], m["start_line"] - 1, unit["name"], unit["kind"])
        itself = _piece(
            m["start_line"], m["end_line"], F.concat(unit["name"], F.lit("."), m["name"]), m["kind"]
        )
        taken = F.struct(
            (m["end_line"] + 1).alias("cursor"),
            F.concat(acc["pieces"], F.array(before, itself)).alias("pieces"),
        )
        return F.when(m["start_line"] < acc["cursor"], acc).otherwise(taken).cast(state)

    return F.aggregate(
        ordered,
        zero,
        step,
        lambda acc: F.array_append(
            acc["pieces"], _piece(acc["cursor"], unit["end_line"], unit["name"], unit["kind"])
        ),
    )


def gap_pieces(lines: Column, start: Column, end: Column, limits: ChunkLimits) -> Column:
    """Module-level code between units; windows when it is too large for one piece."""
    none = F.lit(None).cast("string")
    whole = F.array(_piece(start, end, none, F.lit("module")))
    parts = F.transform(
        windows(start, end, limits.window, limits.window_overlap),
        lambda w: _piece(w["start"], w["end"], none, F.lit("module")),
    )
    return (
        F.when(end < start, _empty(PIECE))
        .when(fits(lines, start, end, limits), whole)
        .otherwise(parts)
        .cast(f"array<{PIECE}>")
    )


def _unit_pieces(lines: Column, unit: Column, symbols: Column, limits: ChunkLimits) -> Column:
    whole = F.array(_piece(unit["start_line"], unit["end_line"], unit["name"], unit["kind"]))
    split_up = member_pieces(unit, symbols)
    return (
        F.when(fits(lines, unit["start_line"], unit["end_line"], limits), whole)
        .otherwise(split_up)
        .cast(f"array<{PIECE}>")
    )


def pieces(lines: Column, symbols: Column, unit_list: Column, limits: ChunkLimits) -> Column:
    """All pieces of a file in emission order."""
    n = F.size(lines)
    none = F.lit(None).cast("string")
    unparsed = F.transform(
        windows(_int(1), n, limits.window, limits.window_overlap),
        lambda w: _piece(w["start"], w["end"], none, F.lit("file")),
    )

    def after(i: Column) -> Column:
        return F.when(i == 0, _int(1)).otherwise(F.get(unit_list, i - 1)["end_line"] + 1)

    parsed = F.flatten(
        F.transform(
            unit_list,
            lambda u, i: F.concat(
                gap_pieces(lines, after(i), u["start_line"] - 1, limits),
                _unit_pieces(lines, u, symbols, limits),
            ),
        )
    )
    tail = gap_pieces(lines, after(F.size(unit_list)), n, limits)
    return F.when(F.coalesce(F.size(symbols), F.lit(0)) <= 0, unparsed).otherwise(F.concat(parsed, tail))


def emitted(lines: Column, piece: Column, limits: ChunkLimits) -> Column:
    """Finished chunks of one piece: clamped, blank text dropped, oversized ones split and labelled."""
    start = F.greatest(piece["start"], _int(1))
    end = F.least(piece["end"], F.size(lines))

    def chunk(s: Column, e: Column, symbol: Column) -> Column:
        return F.struct(
            symbol.alias("symbol"),
            piece["kind"].alias("kind"),
            s.alias("start_line"),
            e.alias("end_line"),
            cut(lines, s, e).alias("content"),
        )

    spans = char_bounded(lines, start, end, limits)
    labelled = F.transform(
        spans,
        lambda s, i: chunk(
            s["start"],
            s["end"],
            F.concat(
                piece["symbol"], F.lit(" (part "), (i + 1).cast("string"), F.lit("/"),
                F.size(spans).cast("string"), F.lit(")"),
            ),
        ),
    )
    whole = F.array(chunk(start, end, piece["symbol"]))
    kept = F.when(fits(lines, start, end, limits), whole).otherwise(labelled)
    shape = "array<struct<symbol:string,kind:string,start_line:int,end_line:int,content:string>>"
    return F.when(end < start, F.array().cast(shape)).otherwise(
        F.filter(kept, lambda c: c["content"].rlike(r"(?U)\S"))
    )


def chunked(files: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """Chunks of files with ``repo_id, path, language, text`` and optionally ``symbols``."""
    base = files if "symbols" in files.columns else files.withColumn("symbols", _empty(SYMBOL))
    rows = base.select(
        "repo_id",
        "path",
        "language",
        X.lines(F.col("text")).alias("_lines"),
        F.coalesce("symbols", _empty(SYMBOL)).cast(f"array<{SYMBOL}>").alias("_symbols"),
    ).where(F.size("_lines") > 0)
    rows = rows.withColumn("_units", units(F.col("_symbols")))
    lines = F.col("_lines")
    rows = rows.withColumn("_pieces", pieces(lines, F.col("_symbols"), F.col("_units"), limits))
    chunks = F.flatten(F.transform("_pieces", lambda p: emitted(lines, p, limits)))
    return rows.select("repo_id", "path", "language", F.inline(chunks)).select(
        "repo_id", "path", "language", "symbol", "kind", "start_line", "end_line", "content"
    )


def top_level_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (``start_line, end_line``) of each file that are not nested in an earlier, larger one."""
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("start_line", F.desc("end_line"), "span_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        spans.withColumn("_reach", F.max("end_line").over(earlier))
        .where("_reach IS NULL OR end_line > _reach")
        .drop("_reach")
    )


def gaps(spans: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Line spans of each file that no top-level span covers (``start_line, end_line``)."""
    tops = top_level_spans(spans, keys)
    by_start = Window.partitionBy(*keys).orderBy("start_line")
    before = tops.select(
        *keys,
        (F.coalesce(F.lag("end_line").over(by_start), F.lit(0)) + 1).alias("a"),
        (F.col("start_line") - 1).alias("b"),
    )
    ends = tops.groupBy(*keys).agg(F.max("end_line").alias("_end"))
    after = totals.join(ends, keys, "left").select(
        *keys, (F.coalesce("_end", F.lit(0)) + 1).alias("a"), F.col("n_lines").alias("b")
    )
    both = before.unionByName(after).where("a <= b")
    return both.withColumnsRenamed({"a": "start_line", "b": "end_line"})
