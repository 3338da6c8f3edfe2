"""Line search, tool calls in text, and validation of JSON arguments and sections."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.scale import running_sum, salted_join, top_k


def grep(
    files: DataFrame, pattern: str, path_glob: str | None = None, ignore_case: bool = False, max_results: int = 50,
    scan_chars: int | None = None, line_chars: int | None = None,
) -> DataFrame:
    """Matching lines per repository in path and line order, at most ``max_results`` each.

    ``files``: ``repo_id, path, text``. All files are searched. With ``scan_chars`` a repository is read up to so
    many characters in path order; the running total is only computed for repositories above that. Lines come whole,
    unless ``line_chars`` cuts them.
    """
    rows = files.select("repo_id", "path", "text", F.length("text").alias("chars"))
    if path_glob:
        rows = rows.where(P.glob_matches(F.col("path"), path_glob))
    if scan_chars is not None:
        large = rows.groupBy("repo_id").agg(F.sum("chars").alias("n")).where(F.col("n") > scan_chars).select("repo_id")
        sizes = salted_join(rows.select("repo_id", "path", "chars"), large, ["repo_id"], "left_semi", spread_by=["path"])
        if not large.isEmpty():
            beyond = running_sum(sizes, ["repo_id"], ["path"], "chars", "before").where(F.col("before") + F.col("chars") > scan_chars)
            rows = rows.join(beyond.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    regex = f"(?i){pattern}" if ignore_case else pattern
    hits = F.filter(
        F.transform(X.lines(F.col("text")), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"))),
        lambda x: x["line"].rlike(regex),
    )
    # No file can contribute more lines than the whole result may have.
    found = rows.select("repo_id", "path", F.inline(F.slice(hits, 1, max_results)))
    best = top_k(found, ["repo_id"], [F.col("path"), F.col("line_no")], max_results)
    line = F.trim("line")
    return best.withColumn("line", line if line_chars is None else F.left(line, F.lit(line_chars)))


def objects_in(text: str) -> list[str]:
    """The JSON objects in a text, outermost ones that parse; a brace that opens none is passed over."""
    parse, found, end = json.JSONDecoder().raw_decode, [], 0
    for brace in re.finditer(r"\{", text):
        if brace.start() >= end:
            try:
                end = parse(text, brace.start())[1]
            except (ValueError, RecursionError):
                continue
            found.append(text[brace.start() : end])
    return found


def text_tool_calls(replies: DataFrame, known: list[str]) -> DataFrame:
    """Tool calls written as text (``reply_id, text``): tagged ones, else fenced ones, else bare JSON.

    Only known names count. Arguments come out as JSON text, nested to any depth; broken JSON is passed over.
    """
    tagged = F.regexp_extract_all("text", F.lit(fixed.TAGGED_CALL), 1)
    fenced = F.regexp_extract_all("text", F.lit(fixed.FENCED_CALL), 1)
    bodies = F.when(F.size(tagged) > 0, tagged).when(F.size(fenced) > 0, fenced).otherwise(F.array("text"))

    @F.pandas_udf("array<string>")
    def listed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda parts: [o for t in ([] if parts is None else parts) if t is not None for o in objects_in(t)])

    rows = replies.select("reply_id", listed(bodies).alias("objects")).select("reply_id", F.posexplode("objects").alias("pos", "raw"))
    inner = F.get_json_object("raw", "$.function")
    call = F.when(F.startswith(inner, F.lit("{")), inner).otherwise(F.col("raw"))
    rows = rows.withColumn("_call", call)

    def field(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object("_call", f"$.{n}") for n in names])

    name = F.coalesce(F.nullif(field("name"), F.lit("")), field("tool"))
    rows = rows.select("reply_id", "pos", name.alias("name"), F.coalesce(field("arguments", "parameters", "args"), F.lit("{}")).alias("arguments"))
    kept = rows.where(F.col("name").isin(known))
    return top_k(kept, ["reply_id"], [F.col("pos")], 1 << 30, "call_no").drop("pos")


def without_tool_markup(text: Column) -> Column:
    return P.strip_chars(F.regexp_replace(text, fixed.TAGGED_CALL, ""), r"\s")


# --- tool arguments ---------------------------------------------------------------------------

# Per tool the fields, as (type, required, least, most); lengths for strings.
TOOL_FIELDS: dict[str, dict[str, tuple[str, bool, int | None, int | None]]] = {
    "list_directory": {"path": ("string", False, None, 500)},
    "read_file": {"path": ("string", True, 1, 500), "start_line": ("int", False, 1, None), "end_line": ("int", False, 1, None)},
    "search_code": {"query": ("string", True, 2, 300), "limit": ("int", False, 1, 15)},
    "grep": {
        "pattern": ("string", True, 1, 200), "path_glob": ("string", False, None, 200),
        "ignore_case": ("bool", False, None, None), "max_results": ("int", False, 1, 200),
    },
    "get_symbol": {"name": ("string", True, 1, 200)},
    "get_dependencies": {"module": ("string", True, 1, 500)},
    "get_repo_metadata": {},
}


def tool_argument_errors(calls: DataFrame) -> DataFrame:
    """Adds ``error_type`` (unknown_tool, invalid_json, invalid_arguments or NULL) and ``problems``."""
    raw = F.trim(F.coalesce("arguments", F.lit("")))
    text = F.when(raw == "", F.lit("{}")).otherwise(raw)
    args = F.from_json(text, "map<string,string>")
    is_object = F.startswith(text, F.lit("{")) & F.try_parse_json(text).isNotNull() & F.endswith(text, F.lit("}"))
    by_tool = []
    for tool, fields in TOOL_FIELDS.items():
        checks = []
        for name, (kind, required, low, high) in fields.items():
            value = F.try_element_at(F.col("_args"), F.lit(name))
            if kind == "string":
                length = F.length(F.trim(value))
                bad = [(length < low, "too short")] if low else []
                bad += [(length > high, "too long")] if high else []
            elif kind == "int":
                number = F.expr(f"try_cast(_args['{name}'] AS bigint)")
                bad = [(value.isNotNull() & number.isNull(), "not an integer")]
                bad += [(number < low, "too small")] if low else []
                bad += [(number > high, "too large")] if high else []
            else:
                bad = [(~F.lower(value).isin("true", "false"), "not a boolean")]
            if required:
                bad = [(value.isNull(), "missing"), *bad]
            found = F.coalesce(*[F.when(test, F.lit(f"{name}: {word}")) for test, word in bad])
            checks.append(found)
        extra = F.transform(
            F.array_sort(F.array_except(F.map_keys("_args"), F.array(*[F.lit(n) for n in fields]).cast("array<string>"))),
            lambda k: F.concat(k, F.lit(": not allowed")),
        )
        problems = F.concat(F.array_compact(F.array(*checks)) if checks else P.no_strings(), extra)
        by_tool.append(F.when(F.col("tool") == tool, problems))
    rows = calls.withColumns({"_args": args, "_object": F.coalesce(is_object, F.lit(False))})
    problems = F.coalesce(*by_tool)
    rows = rows.withColumn("problems", F.when(F.col("_object"), problems))
    error = (
        F.when(~F.col("tool").isin(list(TOOL_FIELDS)), "unknown_tool")
        .when(~F.col("_object"), "invalid_json")
        .when(F.size("problems") > 0, "invalid_arguments")
    )
    return rows.withColumn("error_type", error).drop("_args", "_object")


# --- sections ---------------------------------------------------------------------------------

# Bounds per section. Strings: (least, most) characters; arrays: (least, most) items.
_LINE = {"start_line": "line", "end_line": "line"}
SECTION_RULES: dict[str, dict] = {
    "overview": {
        "fields": {"summary": (40, 1500)},
        "texts": {"prerequisites": (0, 10, False), "starter_questions": (3, 6, True)},
        "items": {
            "tech_stack": (1, 15, True, {"name": (1, 60), "role": (3, 200)}),
            "structure": (1, 15, True, {"path": (1, None), "description": (3, 300)}),
            "how_to_run": (0, 12, False, {"description": (3, 300), "command?": (None, 300)}),
            "entry_points": (0, 8, False, {"path": (1, None), "description": (3, 300), **_LINE}),
        },
    },
    "start_here": {"fields": {}, "texts": {}, "items": {"files": (1, 15, True, {"path": (1, None), "reason": (10, 300), **_LINE})}},
    "glossary": {
        "fields": {},
        "texts": {},
        "items": {"terms": (3, 40, True, {"term": (1, 80), "definition": (10, 500), "path?": (None, None), "kind?": "glossary_kind", **_LINE})},
    },
    "architecture": {
        "fields": {"summary": (30, 1200)},
        "texts": {},
        "items": {
            "modules": (2, 14, True, {"id": (1, 40), "name": (1, 60), "description": (3, 300)}),
            "edges": (0, 30, False, {"source": (1, None), "target": (1, None), "label?": (None, 60)}),
        },
    },
    "tour": {
        "fields": {"intro": (20, 800)},
        "texts": {},
        "items": {"steps": (3, 14, True, {"title": (3, 100), "path": (1, None), "symbol?": (None, 120), "explanation": (20, 1500), **_LINE})},
    },
}


def _text_problem(value: Column, label: Column, low: int | None, high: int | None, required: bool) -> Column:
    length = F.length(F.trim(value))
    tests = []
    if required:
        tests.append((value.isNull(), "missing"))
    if low:
        tests.append((length < low, "too short"))
    if high:
        tests.append((length > high, "too long"))
    if not tests:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(test, F.concat(label, F.lit(f": {word}"))) for test, word in tests])


def section_problems(rows: DataFrame, section: str) -> DataFrame:
    """Adds ``problems`` (the first 15) for JSON texts of one kind of section; unknown keys are ignored."""
    rules = SECTION_RULES[section]
    ddl = [f"{f} string" for f in rules["fields"]] + [f"{f} array<string>" for f in rules["texts"]]
    for name, (_, _, _, fields) in rules["items"].items():
        inner = ", ".join(f"{f.rstrip('?')}: {'int' if r == 'line' else 'string'}" for f, r in fields.items())
        ddl.append(f"{name} array<struct<{inner}>>")
    parsed = rows.withColumn("_j", F.from_json("data", ", ".join(ddl)))
    found: list[Column] = []
    for name, (low, high) in rules["fields"].items():
        found.append(F.array(_text_problem(F.col(f"_j.{name}"), F.lit(name), low, high, True)))

    def counted(name: str, low: int, high: int, required: bool) -> Column:
        n = F.size(F.col(f"_j.{name}"))
        value = F.col(f"_j.{name}")
        missing = F.when(value.isNull(), F.lit(f"{name}: missing")) if required else F.lit(None).cast("string")
        few = F.when(value.isNotNull() & (n < low), F.lit(f"{name}: too few"))
        many = F.when(value.isNotNull() & (n > high), F.lit(f"{name}: too many"))
        return F.array(F.coalesce(missing, few, many))

    for name, (low, high, required) in rules["texts"].items():
        found.append(counted(name, low, high, required))
    for name, (low, high, required, fields) in rules["items"].items():
        found.append(counted(name, low, high, required))

        def item(x: Column, i: Column, name: str, fields: dict) -> Column:
            out = []
            for field, rule in fields.items():
                key = field.rstrip("?")
                label = F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(f".{key}"))
                if rule == "line":
                    out.append(F.when(x[key] < 1, F.concat(label, F.lit(": too small"))))
                elif rule == "glossary_kind":
                    out.append(F.when(~x[key].isin(fixed.GLOSSARY_KINDS), F.concat(label, F.lit(": not allowed"))))
                else:
                    out.append(_text_problem(x[key], label, *rule, not field.endswith("?")))
            return F.array(*out)

        found.append(F.coalesce(F.flatten(F.transform(f"_j.{name}", _bound(item, name, fields))), P.no_strings()))
    every = F.array_compact(F.concat(*found))
    problems = F.when(F.col("_j").isNull(), F.array(F.lit("(root): not an object"))).otherwise(F.slice(every, 1, fixed.MAX_PROBLEMS))
    return parsed.withColumn("problems", problems).drop("_j")


def _bound(item, name: str, fields: dict):
    return lambda x, i: item(x, i, name, fields)


# --- nested arrays ----------------------------------------------------------------------------


def exploded_symbols(files: DataFrame) -> DataFrame:
    """One row per symbol of files with a ``symbols`` array."""
    return files.select("repo_id", "path", F.inline("symbols"))


def nested_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols back in one array per file, in file order (a file bounds its list)."""
    cols = ["start_line", "end_line", "name", "kind", "parent"]
    return symbols.groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("symbols"))
