"""Column functions on text: lines, hashes, tokens, redaction, JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed

# Every line boundary that counts when lines are numbered.
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def line_count(text: Column) -> Column:
    """Stored line count: newlines + 1."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1


def lines(text: Column) -> Column:
    """Lines without their breaks; a trailing break adds no empty line, '' has no lines."""
    parts = F.split(text, LINE_BREAK, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.slice(parts, F.lit(1), F.size(parts) - last_empty.cast("int"))


def numbered(line_array: Column, start: Column) -> Column:
    """Lines as ``  7 | text``, numbers right-aligned to the widest."""
    width = F.length((start + F.size(line_array) - 1).cast("string"))
    return F.array_join(
        F.transform(
            line_array,
            lambda line, i: F.concat(F.lpad((start + i).cast("string"), width, F.lit(" ")), F.lit(" | "), line),
        ),
        "\n",
    )


def blob_sha(content: Column) -> Column:
    """The identifier git gives a blob: sha1 over ``blob <size>\\0`` and the bytes."""
    raw = content.cast("binary")
    header = F.concat(F.lit("blob "), F.octet_length(raw).cast("string"), F.lit("\x00"))
    return F.sha1(F.concat(header.cast("binary"), raw))


def embedding_text(path: Column, symbol: Column, content: Column) -> Column:
    header = F.concat(
        F.lit("File: "),
        path,
        F.lit("\n"),
        F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit("Symbol: "), symbol, F.lit("\n"))).otherwise(""),
    )
    return F.concat(header, F.coalesce(content, F.lit("")))


def embed_hash(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\x00"), text).cast("binary"), 256)




def code_tokens(text: Column) -> Column:
    """Distinct lower-case identifier tokens: whole words and their camel-case and digit parts."""
    words = F.regexp_extract_all(text, F.lit(fixed.WORD), 0)
    parts = F.regexp_extract_all(text, F.lit(fixed.WORD_PART), 0)
    # Parts never cross a word boundary, so they can be taken from the whole text at once.
    return F.array_distinct(F.transform(F.concat(words, parts), F.lower))


# A word is simple if it is "abc", "Abc", "ABC" or "123"; possessive runs tell that in one step each, whatever its length.
_SIMPLE = "(?:[A-Z]?+[a-z]*+|[A-Z]++|[0-9]++)(?![A-Za-z0-9_])"
_COMPOUND_WORD = f"(?<![A-Za-z0-9_])(?!{_SIMPLE})[A-Za-z0-9_]++"


def indexed_tokens(text: Column) -> Column:
    """Tokens with repeats for term frequencies; an original word may contain ``_``."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    compound = F.array_join(F.regexp_extract_all(text, F.lit(_COMPOUND_WORD), F.lit(0)), " ")
    parts = F.regexp_extract_all(compound, F.lit(fixed.WORD_PART), F.lit(0))
    every = F.concat(words, parts)
    # One pass over the joined words is cheaper than a call per word; they are ASCII by now and hold no space.
    return F.when(F.size(every) == 0, every).otherwise(F.split(F.lower(F.array_join(every, " ")), " "))


def squeezed(text: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clipped(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends with an ellipsis."""
    flat = squeezed(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))
    )


def safe_label(text: Column, limit: int = fixed.LABEL_CHARS) -> Column:
    """A diagram label: double quotes become single, markup characters are removed."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("'"))
    flat = squeezed(F.regexp_replace(plain, r"[\"<>{}\[\]|`#;&\\]", ""))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.regexp_replace(F.left(flat, F.lit(limit - 1)), r"\s+$", ""), F.lit("…"))
    )


def escaped_content(text: Column) -> Column:
    """Closing content tags inside repository text cannot end the wrapper."""
    return F.replace(text, F.lit("</repo_content"), F.lit("<\\/repo_content"))


def wrapped(source: str, body: Column, path: Column | None = None) -> Column:
    """Repository text between content tags, cut at the output limit."""
    cut = F.when(
        F.length(body) > fixed.MAX_OUTPUT_CHARS,
        F.concat(F.left(body, F.lit(fixed.MAX_OUTPUT_CHARS)), F.lit("\n… [output truncated]")),
    ).otherwise(body)
    attrs = F.lit(f'source="{source}"')
    if path is not None:
        with_path = F.concat(attrs, F.lit(' path="'), path, F.lit('"'))
        attrs = F.when(F.coalesce(path, F.lit("")) != "", with_path).otherwise(attrs)
    return F.concat(
        F.lit("<repo_content "), attrs, F.lit(">\n"), escaped_content(cut), F.lit("\n</repo_content>")
    )


def citation(path: Column, start: Column, end: Column) -> Column:
    """``[path]``, ``[path:7]`` or ``[path:7-9]``."""
    return F.concat(
        F.lit("["),
        path,
        F.when(start.isNull(), F.lit(""))
        .when(end.isNull() | (end == start), F.concat(F.lit(":"), start.cast("string")))
        .otherwise(F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))),
        F.lit("]"),
    )


def blob_link(repo_url: Column, sha: Column, path: Column, start: Column, end: Column, total: Column) -> Column:
    """Link to a file at a commit, with a line anchor unless the whole file is meant."""
    encoded = F.array_join(
        F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/"
    )
    anchor = F.when(start == end, F.concat(F.lit("#L"), start.cast("string"))).otherwise(
        F.concat(F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    )
    whole = (start == 1) & (end == total)
    return F.concat(repo_url, F.lit("/blob/"), sha, F.lit("/"), encoded, F.when(whole, "").otherwise(anchor))


def scrubbed(text: Column) -> Column:
    """Token-shaped substrings replaced by a marker."""
    return F.regexp_replace(text, fixed.SENSITIVE_VALUE, fixed.REDACTED)


def scrubbed_map(pairs: Column) -> Column:
    """A string map with values under sensitive keys masked, numbers and booleans kept."""
    harmless = r"^(-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false)$"
    return F.transform_values(
        pairs,
        lambda k, v: F.when(v.isNull() | v.rlike(harmless), v)
        .when(k.rlike(fixed.SENSITIVE_KEY), F.lit(fixed.REDACTED))
        .otherwise(scrubbed(v)),
    )


def cost(prompt_tokens: Column, completion_tokens: Column, per_1k_in: float, per_1k_out: float) -> Column:
    return F.round(prompt_tokens / 1000 * per_1k_in + completion_tokens / 1000 * per_1k_out, 6)


def display_name(language: Column) -> Column:
    """Human name of a language id."""
    other = F.replace(language, F.lit("cpp"), F.lit("C++"))
    other = F.concat(F.upper(F.left(other, F.lit(1))), F.lower(F.substring(other, 2, 200)))
    return F.coalesce(_lookup(fixed.DISPLAY_NAMES, language), other)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


lookup = _lookup


def term_key(name: Column, keep_case: bool = False) -> Column:
    """``Command.parse()`` becomes ``parse``."""
    last = F.substring_index(name, ".", -1)
    key = F.trim(F.substring_index(last, "(", 1))
    return key if keep_case else F.lower(key)


def slug(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    cut = F.left(F.regexp_replace(flat, "^_+|_+$", ""), F.lit(30))
    return F.when(cut == "", F.lit("module")).otherwise(cut)


def coerced_kind(value: Column, allowed: list[str]) -> Column:
    """``Flow-Trace`` becomes ``flow_trace``; unknown kinds become ``other``."""
    kind = F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_")
    return F.when(value.isNull(), value).when(kind.isin(allowed), kind).otherwise(F.lit("other"))


def kind_hint(words: Column) -> Column:
    """The first kind whose word pattern occurs in lower-case words."""
    return F.coalesce(*[F.when(words.rlike(rx), F.lit(kind)) for kind, rx in fixed.KIND_HINTS.items()])


def tool_summary(name: Column, arguments: Column, ok: Column, error_type: Column) -> Column:
    """What a tool call does, from its name and JSON arguments."""
    target = F.coalesce(
        *[F.nullif(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in fixed.TOOL_TARGET_KEYS]
    )
    verb = F.coalesce(_lookup(fixed.TOOL_VERBS, name), F.concat(F.lit("Calling "), name))
    text = F.when(target.isNull(), verb).otherwise(F.concat(verb, F.lit(" '"), target, F.lit("'")))
    failed = F.concat(text, F.lit(" (failed: "), F.coalesce(error_type, F.lit("None")), F.lit(")"))
    return F.when(ok, text).otherwise(failed)


def first_json(text: Column) -> Column:
    """The first JSON object in model output: think blocks dropped, a fence preferred."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", ""))
    fenced = F.trim(F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)```", 1))
    body = F.when(plain.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(plain)
    start = F.instr(body, "{")
    return F.when(start > 0, F.try_parse_json(F.substring(body, start, F.length(body))))


def rounded_minutes(seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(seconds / 60, 0).cast("bigint"))


def percent(fraction: Column) -> Column:
    return F.floor(F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * 100)


def elapsed(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds))
    minutes = F.floor(s / 60)
    rest = F.lpad((s - minutes * 60).cast("string"), 2, "0")
    return F.concat(minutes.cast("string"), F.lit(":"), rest)
