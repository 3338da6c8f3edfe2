"""Checking claimed paths, line ranges and symbols against the file index, and repairing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.operators import graph
from corpusloom.operators.files import entry_points
from corpusloom.operators.nearest import near_words
from corpusloom.session import checkpointed
from corpusloom.scale import computed_once, first_per_key, salted_join, skewed_join, top_k

MATCHES = ["exact", "exact", "ignoring_case", "suffix", "name"]
# Files up to which those of one base name are compared path by path.
SHARED_NAME = 64


# --- paths ------------------------------------------------------------------------------------


def reference_index(files: DataFrame) -> DataFrame:
    """Keys under which a file may be meant: full path, lower case, unique suffix, unique name."""
    path = F.col("path")
    parts = F.split(path, "/")
    suffixes = F.filter(graph._suffixes(parts, "/"), lambda s: s != path)
    keys = F.concat(
        F.array(
            F.struct(F.lit("exact").alias("space"), path.alias("key")),
            F.struct(F.lit("lower").alias("space"), F.lower(path).alias("key")),
            F.struct(F.lit("name").alias("space"), F.lower(P.basename(path)).alias("key")),
        ),
        F.transform(suffixes, lambda s: F.struct(F.lit("suffix").alias("space"), s.alias("key"))),
    )
    rows = files.select("repo_id", "path", F.inline(keys))
    grouped = rows.groupBy("repo_id", "space", "key").agg(F.max("path").alias("target"), F.count("*").alias("n"))
    return grouped.where("n = 1 OR space IN ('exact', 'lower')").drop("n")


def resolved(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``path``, ``matched_by`` and written lines ``ref_start, ref_end`` to ``repo_id, raw``.

    Steps: exact, ignoring case, unique suffix, unique base name. An optional ``repo_name`` column
    lets a leading repository name be dropped. Each distinct spelling is resolved once.
    """
    if "repo_name" not in refs.columns:
        return resolved(refs.withColumn("repo_name", F.lit("")), files).drop("repo_name")
    start, end = P.reference_lines(F.col("raw"))
    plain = F.coalesce(P.reference_path(F.col("raw")), F.lit(""))
    rows = refs.withColumns({"_plain": plain, "ref_start": start, "ref_end": end})
    rows = rows.withColumn("_short", P.without_repo_prefix(F.col("_plain"), F.col("repo_name")))
    on = ["repo_id", "_plain", "_short"]
    spelled = rows.select(*on).where("_plain <> ''").distinct()
    ladder = [("exact", F.col("_plain")), ("exact", F.col("_short")), ("lower", F.lower("_short")), ("suffix", F.col("_short")), ("name", F.lower(P.basename(F.col("_short"))))]
    keys = F.array(*[F.struct(F.lit(space).alias("space"), key.alias("key")) for space, key in ladder])
    spread = spelled.select(*on, F.posexplode(keys).alias("pos", "k")).select(*on, "pos", "k.space", "k.key")
    hits = spread.join(reference_index(files), ["repo_id", "space", "key"])
    best = hits.groupBy(*on).agg(F.min_by(F.struct("target", "pos"), "pos").alias("hit"))
    names = F.array(*[F.lit(m) for m in MATCHES])
    out = skewed_join(rows, best, on, "left")
    return out.withColumn("path", F.col("hit.target")).withColumn("matched_by", F.get(names, F.col("hit.pos"))).drop("_plain", "_short", "hit")


def resolved_dirs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``dir`` to ``repo_id, raw``: a directory or ancestor directory, exact then ignoring case."""
    dirs = files.select("repo_id", F.explode(P.ancestors(F.col("path"))).alias("d")).distinct()
    keys = F.array(
        F.struct(F.lit("exact").alias("space"), F.col("d").alias("key")),
        F.struct(F.lit("lower").alias("space"), F.lower("d").alias("key")),
    )
    index = dirs.select("repo_id", "d", F.inline(keys)).groupBy("repo_id", "space", "key").agg(F.max("d").alias("d"))
    rows = refs.withColumn("_plain", F.coalesce(P.reference_path(F.regexp_replace("raw", "/+$", "")), F.lit("")))
    spelled = rows.select("repo_id", "_plain").where("_plain <> ''").distinct()
    wanted = F.array(
        F.struct(F.lit("exact").alias("space"), F.col("_plain").alias("key")),
        F.struct(F.lit("lower").alias("space"), F.lower("_plain").alias("key")),
    )
    hits = spelled.select("repo_id", "_plain", F.inline(wanted)).join(index, ["repo_id", "space", "key"])
    best = hits.groupBy("repo_id", "_plain").agg(F.min_by("d", "space").alias("dir"))
    return skewed_join(rows, best, ["repo_id", "_plain"], "left").drop("_plain")


def clamped(start: Column, end: Column, total: Column) -> Column:
    """Range as ``struct(s, e)``: swapped if reversed, cut at the end, NULL for a senseless one."""
    a = F.coalesce(F.nullif(start, F.lit(0)), F.nullif(end, F.lit(0)), F.lit(1))
    b = F.coalesce(F.nullif(end, F.lit(0)), a)
    low, high = F.least(a, b), F.greatest(a, b)
    none = (start.isNull() & end.isNull()) | (low > total) | ((low == 1) & (high == 1) & (total > 1))
    return F.when(~none, F.struct(F.greatest(low, F.lit(1)).alias("s"), F.least(high, total).alias("e")))


def repaired_refs(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims (``repo_id, raw, start_line, end_line``) with path and lines repaired.

    Adds ``path``, new lines and ``outcome``: ok, repaired or dropped.
    """
    rows = resolved(claims, files)
    sizes = files.select("repo_id", "path", F.greatest(F.col("line_count"), F.lit(1)).cast("int").alias("_total"))
    rows = skewed_join(rows, sizes, ["repo_id", "path"], "left")
    span = clamped(F.coalesce("start_line", "ref_start"), F.coalesce("end_line", "ref_end"), F.col("_total"))
    rows = rows.withColumn("_span", span)
    same = (
        (F.col("path") == F.col("raw"))
        & F.col("_span.s").eqNullSafe(F.col("start_line"))
        & F.col("_span.e").eqNullSafe(F.col("end_line"))
    )
    outcome = F.when(F.col("path").isNull(), "dropped").when(same, "ok").otherwise("repaired")
    return rows.withColumn("outcome", outcome).withColumns(
        {"start_line": F.col("_span.s"), "end_line": F.col("_span.e")}
    ).drop("_span", "_total", "ref_start", "ref_end")


def reference_report(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Checked, repaired and dropped counts, and the first dropped spellings in order of ``pos``."""
    counts = checked.groupBy(*keys).agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("outcome") == "repaired").alias("repaired"),
        F.count_if(F.col("outcome") == "dropped").alias("dropped"),
    )
    first = top_k(checked.where("outcome = 'dropped'"), keys, [F.col("pos")], fixed.MAX_DROPPED_PATHS, "_n")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "raw"))), lambda x: x["raw"])
    return counts.join(first.groupBy(*keys).agg(listed.alias("dropped_paths")), keys, "left")


# --- symbols ----------------------------------------------------------------------------------


def symbol_ranges(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``sym_start, sym_end``: the claimed ``name`` in the claimed file, exact case preferred."""
    rows = claims.withColumn("_exact", X.term_key(F.col("name"), keep_case=True))
    rows = rows.withColumn("_key", F.lower("_exact"))
    asked = rows.select("repo_id", "path", "_key", "_exact").where("path IS NOT NULL").distinct()
    index = symbols.select(
        "repo_id", "path", F.lower("name").alias("_key"), F.col("name").alias("_name"), F.col("start_line").alias("s"), F.col("end_line").alias("e")
    )
    best = asked.join(index, ["repo_id", "path", "_key"]).groupBy("repo_id", "path", "_key", "_exact").agg(
        F.min_by(F.struct("s", "e"), F.struct(F.col("_name") != F.col("_exact"), F.col("s"), -F.col("e"))).alias("_range")
    )
    out = skewed_join(rows, best, ["repo_id", "path", "_key", "_exact"], "left")
    return out.withColumns({"sym_start": F.col("_range.s"), "sym_end": F.col("_range.e")}).drop("_range", "_key", "_exact")


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """Names defined exactly once in their repository (ignoring case): where they are."""
    return symbols.groupBy("repo_id", F.lower("name").alias("key")).agg(
        F.count("*").alias("n"), F.min(F.struct("path", "start_line", "end_line")).alias("at")
    ).where("n = 1").select("repo_id", "key", "at.path", "at.start_line", "at.end_line")


def symbol_lookup(requests: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """Definitions for ``request_id, repo_id, name`` (``Class.method`` works), functions first.

    Exact-case matches hide looser ones; the parent counts only for exact matches. A request shows at most ``limit``
    definitions, so only the first ``limit`` of each name (in any case, exact, exact with its parent) meet the requests.
    """
    name = F.substring_index("name", ".", -1)
    parent = F.nullif(F.regexp_extract("name", r"^(.*)\.[^.]*$", 1), F.lit(""))
    asked = requests.select("request_id", "repo_id", name.alias("_name"), parent.alias("_parent"), F.lower(name).alias("key"))
    place = [F.col("kind") == "method", F.col("path"), F.col("start_line"), F.col("end_line")]
    known = symbols.select("repo_id", "kind", "name", "parent", "path", "start_line", "end_line").withColumn("key", F.lower("name"))

    def found(some: DataFrame, on: dict[str, str]) -> DataFrame:
        """``some`` of the requests with the first definitions under the columns ``on`` (of a symbol: of a request)."""
        index = top_k(known, ["repo_id", *on], place, limit, "_n").drop("_n")
        index = index.withColumnsRenamed({"key": "_k"}).withColumns({f"_on_{a}": F.col("_k" if a == "key" else a) for a in on}).drop("_k")
        some = some.withColumns({f"_on_{a}": F.col(b) for a, b in on.items()})
        return salted_join(some, index, ["repo_id", *[f"_on_{a}" for a in on]], spread_by=["request_id"]).drop(*[f"_on_{a}" for a in on])

    exact = (F.col("name") == F.col("_name")) & (F.col("_parent").isNull() | F.col("parent").eqNullSafe(F.col("_parent")))
    whole = found(asked.where("_parent IS NULL"), {"name": "_name"}).unionByName(
        found(asked.where("_parent IS NOT NULL"), {"name": "_name", "parent": "_parent"})
    )
    loose = found(asked, {"key": "key"}).where(~exact)
    rows = whole.unionByName(loose).withColumn("exact", exact)
    order = [F.desc("exact"), *place]
    best = top_k(rows, ["request_id"], order, limit)
    # At most ``limit`` rows per request are left, so this window is small.
    lead = F.first("exact").over(Window.partitionBy("request_id").orderBy("rank"))
    return best.withColumn("_lead", lead).where("exact = _lead").select(
        "request_id", "repo_id", "rank", "kind", "name", "parent", "path", "start_line", "end_line", "exact"
    )


def within_edits(asked: DataFrame, words: DataFrame, edits: int) -> DataFrame:
    """Words (``repo_id, word``) at most ``edits`` single-character changes away from ``repo_id, asked``: exact.

    Words that share a folder or a stem share the way through a trie, so a pair is looked at only as far as its
    beginnings are near. Rows: ``repo_id, asked, word, distance``, each pair once.
    """
    return near_words(asked, words, ["repo_id"], edits)


def suggestions(unknown: DataFrame, files: DataFrame, limit: int = 3, edits: int = 1) -> DataFrame:
    """Files whose base name is within ``edits`` changes of an unknown path's (any case), nearest full path first.

    A name of few files is compared path by path; the files of a more frequent one are searched for the nearest paths.
    """
    name = F.lower(P.basename(F.col("path")))
    lost = unknown.select("repo_id", F.col("path").alias("asked"), name.alias("_lost")).distinct()
    known = files.select("repo_id", "path", name.alias("_name"))
    near = within_edits(lost.select("repo_id", F.col("_lost").alias("asked")), known.select("repo_id", F.col("_name").alias("word")), edits)
    near = near.select("repo_id", F.col("asked").alias("_lost"), F.col("word").alias("_name"))
    wanted = salted_join(lost, near.hint("merge"), ["repo_id", "_lost"], spread_by=["asked"]).drop("_lost")
    counts = known.groupBy("repo_id", "_name").agg((F.count("*") > SHARED_NAME).alias("_hot"))
    wanted = checkpointed(salted_join(wanted, counts.hint("merge"), ["repo_id", "_name"], spread_by=["asked"]))
    few = salted_join(known, wanted.where("NOT _hot").drop("_hot").hint("merge"), ["repo_id", "_name"], spread_by=["path"])
    few = few.select("repo_id", "asked", "path", F.levenshtein("asked", "path").alias("distance"))
    paths = known.select("repo_id", "_name", F.col("path").alias("word"), F.col("path").alias("first"))
    many = near_words(wanted.where("_hot"), paths, ["repo_id", "_name"], None, limit)
    many = many.withColumnRenamed("word", "path").drop("_name")
    many = salted_join(known.select("repo_id", "path"), many.hint("merge"), ["repo_id", "path"], spread_by=["path"])
    return top_k(few.unionByName(many), ["repo_id", "asked"], [F.col("distance"), F.col("path")], limit)


def similar_symbols(unknown: DataFrame, symbols: DataFrame, limit: int = 5, edits: int = 3) -> DataFrame:
    """Names of symbols (``repo_id, name``) nearest to an unknown name, in any case; ties by name."""
    lost = unknown.select("repo_id", F.col("name").alias("asked"), F.lower("name").alias("_lost")).distinct()
    known = symbols.select("repo_id", "name", F.lower("name").alias("word")).distinct()
    near = near_words(lost.select("repo_id", F.col("_lost").alias("asked")), known.withColumnRenamed("name", "first"), ["repo_id"], edits, limit)
    near = near.select("repo_id", F.col("asked").alias("_lost"), "word", "distance")
    # An asked word has few rows in ``near``, and a name one for each way to write it.
    pairs = skewed_join(skewed_join(near, lost, ["repo_id", "_lost"], shuffled=True), known, ["repo_id", "word"], shuffled=True)
    return top_k(pairs.select("repo_id", "asked", "name", "distance"), ["repo_id", "asked"], [F.col("distance"), F.col("name")], limit)


def with_mentions(claims: DataFrame, texts: DataFrame, slack: int = 2) -> DataFrame:
    """Adds ``mentioned``: ``name`` occurs within ``slack`` lines of ``start_line..end_line``.

    ``texts``: ``repo_id, path, text``. NULL when the file's text is unknown. A text is lowered and cut into lines
    once, before the join, not once per claim.
    """
    lines = computed_once(texts.select("repo_id", "path", F.lower("text").alias("_text")), "_lines", X.lines(F.col("_text"))).drop("_text")
    rows = skewed_join(claims, lines, ["repo_id", "path"], "left")
    first = F.greatest(F.col("start_line") - slack, F.lit(1))
    count = F.greatest(F.coalesce("end_line", "start_line") + slack - first + 1, F.lit(0))
    window = F.array_join(F.slice("_lines", first, count), "\n")
    hit = F.contains(window, X.term_key(F.col("name")))
    return rows.withColumn("mentioned", F.when(F.col("start_line").isNotNull(), hit)).drop("_lines")


def definition_lines(claims: DataFrame, symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines of ``name``: the symbol index beats the claim; an unmentioned guess is removed."""
    rows = with_mentions(symbol_ranges(claims, symbols), texts)
    named = F.coalesce("name", F.lit("")) != ""
    found = named & F.col("sym_start").isNotNull()
    wrong = named & F.col("start_line").isNotNull() & (F.col("mentioned") == F.lit(False))
    moved = ~(F.col("sym_start").eqNullSafe(F.col("start_line")) & F.col("sym_end").eqNullSafe(F.col("end_line")))
    fixed_lines = F.when(found, moved).otherwise(F.coalesce(wrong, F.lit(False)))

    def line(symbol: str, claimed: str) -> Column:
        return F.when(found, F.col(symbol)).when(F.coalesce(wrong, F.lit(False)), F.lit(None)).otherwise(F.col(claimed))

    return rows.withColumn("lines_fixed", fixed_lines).withColumns(
        {"start_line": line("sym_start", "start_line"), "end_line": line("sym_end", "end_line")}
    ).drop("sym_start", "sym_end", "mentioned")


# --- sections ---------------------------------------------------------------------------------


def overview_items(items: DataFrame, files: DataFrame) -> DataFrame:
    """Structure entries (``repo_id, pos, raw``): a directory with a slash, else a file, else dropped."""
    base = items.withColumns({"start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int")})
    rows = repaired_refs(resolved_dirs(base, files), files)
    slashed = F.concat("dir", F.lit("/"))
    outcome = F.when(F.col("dir").isNotNull(), F.when(slashed == F.col("raw"), "ok").otherwise("repaired")).otherwise(F.col("outcome"))
    return rows.withColumn("outcome", outcome).withColumn("path", F.coalesce(slashed, "path")).drop("dir", "start_line", "end_line")


def first_seen(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row per key in order of appearance."""
    return first_per_key(rows, keys, [order])


def start_here_items(items: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved files, each once, in order."""
    kept = repaired_refs(items, files).where("outcome <> 'dropped'")
    return first_seen(kept, ["repo_id", "path"])


def glossary_terms(terms: DataFrame, files: DataFrame, symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """Unique terms (``repo_id, pos, term, raw, start_line, end_line``) with verified locations.

    A term whose file never mentions it is looked up among the unique symbols instead; a term
    without a path is looked up too. Terms are kept also without a location.
    """
    unique = first_seen(terms.withColumn("_t", F.lower("term")), ["repo_id", "_t"]).drop("_t")
    asked = F.coalesce("raw", F.lit("")) == ""
    fixed_refs = repaired_refs(unique, files).withColumn("name", F.col("term"))
    fixed_refs = fixed_refs.withColumnsRenamed({"start_line": "_s", "end_line": "_e"})
    whole = fixed_refs.withColumns({"start_line": F.lit(1), "end_line": F.lit(1_000_000_000)})
    whole = with_mentions(whole, texts).withColumnRenamed("mentioned", "_in_file").drop("start_line", "end_line")
    rows = whole.withColumnsRenamed({"_s": "start_line", "_e": "end_line"})
    absent = F.coalesce(~F.col("_in_file"), F.lit(False)) & F.col("path").isNotNull()
    rows = rows.withColumn("_absent", absent).withColumn("_look", asked | absent)
    rows = rows.withColumn("path", F.when(F.col("_absent"), F.lit(None)).otherwise(F.col("path")))
    for line in ("start_line", "end_line"):
        rows = rows.withColumn(line, F.when(F.col("_absent"), F.lit(None)).otherwise(F.col(line)))
    rows = definition_lines(rows, symbols, texts)
    known = unique_symbols(symbols).select("repo_id", F.col("key").alias("_key"), F.struct("path", "start_line", "end_line").alias("at"))
    rows = rows.withColumn("_key", F.when(F.col("_look"), X.term_key(F.col("term"))))
    rows = skewed_join(rows, known, ["repo_id", "_key"], "left")
    out = {c: F.coalesce(F.col(c), F.col(f"at.{c}")) for c in ("path", "start_line", "end_line")}
    looked = F.col("at").isNotNull()
    return rows.withColumn("looked_up", looked).withColumns(out).select(
        "repo_id", "pos", "term", "path", "start_line", "end_line", "looked_up"
    )


def focused(steps: DataFrame, symbols: DataFrame, max_lines: int = fixed.FOCUS_LINES) -> DataFrame:
    """Narrows long spans (``repo_id, path, start_line, end_line``): class header and constructor,
    the lines before the first member, or the first lines."""
    long = F.col("end_line") - F.col("start_line") + 1 > max_lines
    spans = steps.where(long).select("repo_id", "path", "start_line", "end_line").distinct()
    mine = symbols.select("repo_id", "path", "name", "parent", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    owner = spans.join(
        mine.select("repo_id", "path", F.col("name").alias("owner"), F.col("s").alias("start_line"), F.col("e").alias("end_line")),
        ["repo_id", "path", "start_line", "end_line"],
    ).groupBy("repo_id", "path", "start_line", "end_line").agg(F.min("owner").alias("owner"))
    inner = owner.join(mine.where("parent IS NOT NULL"), ["repo_id", "path"]).where("parent = owner AND s > start_line AND s <= end_line")
    ctor = F.col("name").isin("constructor", "__init__") | (F.col("name") == F.col("owner"))
    heads = inner.groupBy("repo_id", "path", "start_line", "end_line").agg(
        F.min_by("e", F.when(ctor, F.struct("s", "e"))).alias("_ctor_end"), F.min("s").alias("_first")
    )
    rows = skewed_join(steps, heads, ["repo_id", "path", "start_line", "end_line"], "left")
    start = F.col("start_line")
    by_ctor = F.col("_ctor_end").isNotNull() & (F.col("_ctor_end") - start + 1 <= max_lines)
    end = (
        F.when(~long, F.col("end_line"))
        .when(by_ctor, F.col("_ctor_end"))
        .when(F.col("_first") - start > 1, F.least(F.col("_first") - 1, start + max_lines - 1))
        .otherwise(start + max_lines - 1)
    )
    return rows.withColumn("end_line", F.when(start.isNotNull(), end)).drop("_ctor_end", "_first")


def tour_steps(steps: DataFrame, files: DataFrame, symbols: DataFrame, texts: DataFrame, max_lines: int = fixed.FOCUS_LINES) -> DataFrame:
    """Tour stops (``repo_id, pos, title, raw, start_line, end_line, symbol``) pinned and narrowed."""
    rows = repaired_refs(steps, files).where("outcome <> 'dropped'").withColumn("name", F.col("symbol"))
    title = F.regexp_replace("title", fixed.KIND_PREFIX, "")
    rows = rows.withColumn("title", F.when(title == "", F.col("title")).otherwise(title))
    rows = focused(definition_lines(rows, symbols, texts), symbols, max_lines)
    keyed = rows.withColumns({"_s": F.coalesce("start_line", F.lit(-1)), "_e": F.coalesce("end_line", F.lit(-1))})
    return first_seen(keyed, ["repo_id", "path", "_s", "_e"]).drop("_s", "_e", "name", "lines_fixed")


# --- architecture -----------------------------------------------------------------------------


def module_paths(modules: DataFrame, files: DataFrame) -> DataFrame:
    """One row per claimed module path: resolved directory (with slash) or file, ``outcome``."""
    items = modules.select("repo_id", "ord", F.posexplode("paths").alias("pos", "raw"))
    return overview_items(items, files)


def unique_ids(modules: DataFrame) -> DataFrame:
    """Adds ``module_id``: slug of id or name, numbered when taken. A repo lists few modules."""
    base = X.slug(F.coalesce(F.nullif("id", F.lit("")), F.col("name")))
    listed = modules.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("ord", base.alias("base")))).alias("m"))

    def step(acc: Column, m: Column) -> Column:
        tries = F.transform(
            F.sequence(F.lit(1), F.size(acc) + 1),
            lambda n: F.when(n == 1, m["base"]).otherwise(F.concat(m["base"], F.lit("_"), n.cast("string"))),
        )
        return F.array_append(acc, F.get(F.filter(tries, lambda x: ~F.array_contains(acc, x)), 0))

    ids = F.aggregate("m", P.no_strings(), step)
    given = listed.select("repo_id", F.inline(F.zip_with("m", ids, lambda m, i: F.struct(m["ord"].alias("ord"), i.alias("module_id")))))
    return modules.join(given, ["repo_id", "ord"])


def architecture(
    modules: DataFrame, edges: DataFrame, files: DataFrame, imports: DataFrame, max_edges: int = fixed.MAX_MODULE_EDGES
) -> tuple[DataFrame, DataFrame]:
    """Verified modules and edges of a claimed architecture.

    ``modules``: ``repo_id, ord, id, name, kind, paths``; ``edges``: ``repo_id, ord, source, target,
    label``; ``imports``: internal file pairs. Claimed edges win over edges derived from imports.
    """
    found = module_paths(modules, files).where("outcome <> 'dropped'")
    # Claimed paths per module are bounded by the section schema.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"])
    kept_paths = found.groupBy("repo_id", "ord").agg(F.array_distinct(ordered).alias("real"))
    rows = modules.join(kept_paths, ["repo_id", "ord"], "left").where("real IS NOT NULL OR kind = 'external'")
    rows = unique_ids(rows.withColumn("real", F.coalesce("real", P.no_strings())))
    # Modules and ownership feed every later step: store them once instead of planning them again.
    rows = checkpointed(rows)
    owned = rows.select("repo_id", "module_id", "ord", F.explode("real").alias("owned"))
    ownership = checkpointed(graph.owners(files, owned))
    rows = checkpointed(graph.owning_modules(rows, ownership))
    aliases = rows.select(
        "repo_id", "module_id", "ord", F.posexplode(F.filter(F.array("id", "name"), lambda k: F.coalesce(k, F.lit("")) != "")).alias("n", "key")
    )
    aliases = aliases.select(
        "repo_id", "module_id", "ord", (F.col("n") * 2).alias("n"), F.explode(F.array(F.lower(F.trim("key")), X.slug(F.col("key")))).alias("alias")
    )
    aliases = first_per_key(aliases, ["repo_id", "alias"], ["ord", "n"]).select("repo_id", "alias", "module_id")
    rows = inferred_kinds(rows, files, ownership)
    counts = checkpointed(graph.module_imports(imports, ownership))

    def end(df: DataFrame, column: str) -> DataFrame:
        plain = aliases.withColumnsRenamed({"alias": "_k", "module_id": f"_{column}_a"})
        slugged = aliases.withColumnsRenamed({"alias": "_q", "module_id": f"_{column}_b"})
        keyed = df.withColumns({"_k": F.lower(F.trim(column)), "_q": X.slug(F.col(column))})
        out = keyed.join(plain, ["repo_id", "_k"], "left").join(slugged, ["repo_id", "_q"], "left")
        return out.withColumn(column, F.coalesce(f"_{column}_a", f"_{column}_b")).drop("_k", "_q", f"_{column}_a", f"_{column}_b")

    claimed = end(end(edges, "source"), "target").where("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    claimed = claimed.join(counts, ["repo_id", "source", "target"], "left").select(
        "repo_id", "source", "target", "label", F.lit(False).alias("derived"), F.coalesce("imports", F.lit(0)).alias("imports"), "ord"
    )
    derived = counts.select(
        "repo_id", "source", "target", F.lit(None).cast("string").alias("label"), F.lit(True).alias("derived"), "imports", F.lit(0).alias("ord")
    )
    links = checkpointed(merged_edges(claimed, derived, max_edges))
    return graph.linked_modules(rows, links), links


def merged_edges(claimed: DataFrame, derived: DataFrame, max_edges: int = fixed.MAX_MODULE_EDGES) -> DataFrame:
    """Claimed edges in order, then derived ones by import count; one edge per pair, at most ``max_edges``."""
    both = claimed.unionByName(derived)
    one = first_per_key(both, ["repo_id", "source", "target"], ["derived", "ord"])
    order = [F.col("derived"), F.col("ord"), F.desc(F.when(F.col("derived"), F.col("imports"))), F.col("source"), F.col("target")]
    return top_k(one, ["repo_id"], order, max_edges, "position").drop("ord")


def inferred_kinds(modules: DataFrame, files: DataFrame, ownership: DataFrame) -> DataFrame:
    """Default kinds replaced by a hint from the module's words, or ``entry`` for the main entry point."""
    main = entry_points(files, 1).select("repo_id", "path").join(ownership, ["repo_id", "path"])
    main = main.select("repo_id", "module_id", F.lit(True).alias("_main")).where("module_id IS NOT NULL")
    rows = modules.join(main, ["repo_id", "module_id"], "left")
    words = F.regexp_replace(F.lower(F.concat("module_id", F.lit(" "), F.coalesce("name", F.lit("")))), "[^a-z0-9]+", " ")
    hint = X.kind_hint(words)
    plain = F.col("kind").isin("core", "other")
    kind = F.when(plain & hint.isNotNull(), hint).when(plain & F.coalesce("_main", F.lit(False)), F.lit("entry")).otherwise(F.col("kind"))
    return rows.withColumn("kind", kind).drop("_main")


# --- acceptance -------------------------------------------------------------------------------

PROBLEMS = {
    "start_here": "no suggested file was found",
    "overview": "the structure names no path that exists",
    "architecture": "needs two modules with existing paths",
    "tour_few": "needs three steps with existing files",
    "tour_flow": "no traced step names an existing file",
}


def acceptance(items: DataFrame) -> DataFrame:
    """Problem per section from its kept items (``repo_id, section, item_kind, kept``); NULL if usable."""
    n = F.count_if("kept")
    flows = F.count_if(F.col("kept") & (F.col("item_kind") == "flow_trace"))
    counts = items.groupBy("repo_id", "section").agg(n.alias("kept"), flows.alias("flows"))
    section, kept = F.col("section"), F.col("kept")
    problem = (
        F.when((section == "start_here") & (kept < 1), PROBLEMS["start_here"])
        .when((section == "overview") & (kept < 1), PROBLEMS["overview"])
        .when((section == "architecture") & (kept < 2), PROBLEMS["architecture"])
        .when((section == "tour") & (kept < 3), PROBLEMS["tour_few"])
        .when((section == "tour") & (F.col("flows") < 1), PROBLEMS["tour_flow"])
    )
    return counts.select("repo_id", "section", "kept", problem.alias("problem"))


def section_bounds(files: DataFrame) -> DataFrame:
    """How many files and steps a repository's sections may have, from its file count."""
    n = files.groupBy("repo_id").agg(F.count("*").alias("n"))
    size = F.col("n")

    def within(low: int, high: int) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), size))

    return n.select(
        "repo_id",
        within(1, 8).alias("min_files"),
        within(1, 15).alias("max_files"),
        within(3, 8).alias("min_steps"),
        within(3, 12).alias("max_steps"),
    )


# --- citations in answers -----------------------------------------------------------------------

_CITED = r"\[" + fixed.REFERENCE + r"\](?!\()|`" + fixed.REFERENCE + "`"


def answer_tokens(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Bracketed and back-ticked references outside fenced code: ``message_id, part, pos``, the
    resolved citation, its replacement text, and whether it was ``stripped``."""
    parts = messages.select("message_id", "repo_id", F.posexplode(F.split("text", fixed.FENCE, -1)).alias("part", "body"))
    rows = parts.select("message_id", "repo_id", "part", F.posexplode(F.regexp_extract_all("body", F.lit(_CITED), 0)).alias("pos", "token"))
    bracketed = F.startswith("token", F.lit("["))
    inner = F.expr("substring(token, 2, length(token) - 2)")
    whole = "^" + fixed.REFERENCE + "$"
    rows = rows.withColumns(
        {
            "bracketed": bracketed,
            "raw": F.regexp_extract(inner, whole, 1),
            "_s": F.nullif(F.regexp_extract(inner, whole, 2), F.lit("")).cast("int"),
            "_e": F.nullif(F.regexp_extract(inner, whole, 3), F.lit("")).cast("int"),
        }
    )
    rows = rows.withColumn("path_like", F.col("raw").rlike(fixed.PATH_LIKE))
    rows = resolved(rows, files)
    usable = F.col("path").isNotNull() & (F.col("bracketed") | F.col("path_like"))
    sizes = files.select("repo_id", "path", F.greatest(F.col("line_count"), F.lit(1)).cast("int").alias("_total"))
    rows = skewed_join(rows, sizes, ["repo_id", "path"], "left")
    rows = rows.withColumn("_span", clamped(F.col("_s"), F.col("_e"), F.col("_total"))).withColumn("usable", usable)
    stripped = F.col("bracketed") & F.col("path").isNull() & F.col("path_like")
    new = F.when(F.col("usable"), X.citation(F.col("path"), F.col("_span.s"), F.col("_span.e"))).when(stripped, "").otherwise(F.col("token"))
    return rows.select(
        "message_id", "repo_id", "part", "pos", "token", "bracketed", stripped.alias("stripped"), "usable", "path",
        F.col("_span.s").alias("start_line"), F.col("_span.e").alias("end_line"), new.alias("replacement"),
    )


def answer_citations(tokens: DataFrame) -> DataFrame:
    """Citations of each answer without repeats, in reading order."""
    used = tokens.where("usable").withColumns(
        {"at": F.struct("part", ~F.col("bracketed"), "pos"), "_s": F.coalesce("start_line", F.lit(-1)), "_e": F.coalesce("end_line", F.lit(-1))}
    )
    first = used.groupBy("message_id", "path", "_s", "_e").agg(F.min("at").alias("at"))
    return first.select(
        "message_id", "path", F.nullif("_s", F.lit(-1)).alias("start_line"), F.nullif("_e", F.lit(-1)).alias("end_line"), "at"
    )


def repaired_answers(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Answer texts with references replaced and gaps left by removed ones tidied up."""
    changes = tokens.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "replacement", "stripped"))).alias("c"))
    shape = "array<struct<part:int,pos:int,replacement:string,stripped:boolean>>"
    rows = messages.join(changes, "message_id", "left").withColumn("c", F.coalesce("c", F.array().cast(shape)))
    first_cut = F.array_min(F.transform(F.filter("c", lambda x: x["stripped"]), lambda x: x["part"]))
    rows = rows.withColumn("_cut", first_cut)

    def rebuilt(body: Column, part: Column) -> Column:
        mine = F.transform(F.filter("c", lambda x: x["part"] == part), lambda x: x["replacement"])
        joined = F.array_join(
            F.zip_with(F.split(body, _CITED, -1), mine, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
        )
        tidy = F.regexp_replace(joined, fixed.EMPTY_BRACKETS, "")
        tidy = F.regexp_replace(tidy, fixed.WIDE_GAP, " ")
        tidy = F.regexp_replace(tidy, fixed.GAP_BEFORE_MARK, "$1")
        return F.when(F.col("_cut") <= part, tidy).otherwise(joined)

    outside = F.transform(F.split("text", fixed.FENCE, -1), rebuilt)
    fences = F.regexp_extract_all("text", F.lit(fixed.FENCE), 0)
    text = F.array_join(F.zip_with(outside, fences, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.select("message_id", P.strip_chars(text, r"\s").alias("text"))
