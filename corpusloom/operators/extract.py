"""Symbols, imports and packages of source files: one pass over each text, in the row it comes in.

Nothing is shuffled and every text is read once. What a file declares is found from its tokens and their bracket pairs
(``operators/lexer.py``); Python files that parse go through the standard library's parser.

Differences from a full grammar: ``parse_errors`` tells for languages with brackets only whether these balance, quotes in
JSX text are taken for strings if they pair up on a line, and a statement of JavaScript that ends without a semicolon ends
where a new line can't go on with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.operators.lexer import Facts, facts_of

FILE = ["repo_id", "path"]
JS_FAMILY = ["javascript", "typescript", "tsx"]
SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int,parent:string>"
IMPORT = "struct<module:string,line:int,level:int,names:array<string>>"

Extractor = Callable[[str, str], Facts]


def parsed(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """One row per parseable file: ``symbols`` in file order, ``imports``, ``package``, ``parse_errors``.

    ``extractors`` adds languages or replaces the built-in extraction of one: a function of (language, text). A null
    text counts as empty. A file that can't be read has no symbols, and its ``parse_errors`` is true.
    """
    own = dict(extractors or {})
    rows = files.where(F.col("language").isin([*fixed.PARSEABLE, *own])).select(
        *[F.col(c).cast("string").alias(c) for c in (*FILE, "language")], F.coalesce("text", F.lit("")).alias("text")
    )
    symbol = pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("parent", pa.string())])
    imported = pa.struct([("module", pa.string()), ("line", pa.int32()), ("level", pa.int32()), ("names", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, texts = batch.column("language").to_pylist(), batch.column("text")
            found = [own.get(x, facts_of)(x, t.as_py()) for x, t in zip(languages, texts, strict=True)]
            columns = [batch.column(c) for c in (*FILE, "language")]
            columns.append(pa.array([[dict(zip(symbol.names, s, strict=True)) for s in f.symbols] for f in found], pa.list_(symbol)))
            columns.append(pa.array([[dict(zip(imported.names, i, strict=True)) for i in f.imports] for f in found], pa.list_(imported)))
            columns += [pa.array([f.package for f in found], pa.string()), pa.array([f.errors for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*FILE, "language", "symbols", "imports", "package", "parse_errors"])

    schema = f"repo_id string, path string, language string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, package string, parse_errors boolean"
    return rows.mapInArrow(run, schema)


def symbols_of(facts: DataFrame) -> DataFrame:
    """A row per symbol of ``parsed`` files: name, kind, start_line, end_line, parent."""
    return facts.select(*FILE, F.inline("symbols"))


def imports_of(facts: DataFrame) -> DataFrame:
    """A row per import of ``parsed`` files: module, line, level, names."""
    return facts.select(*FILE, F.inline("imports"))


def file_facts(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """One row per parseable file: ``package``, ``parse_errors``, ``symbols`` (null if there are none)."""
    symbols = F.when(F.size("symbols") > 0, F.col("symbols")).alias("symbols")
    return parsed(files, extractors).select(*FILE, "package", "parse_errors", symbols)
