"""Which files are worth indexing: pruned directories, ignore rules, skip reasons, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.scale import first_per_key, salted_join, top_k

KEY = ["repo_id", "path"]


# --- directories ------------------------------------------------------------------------------


def ignored_dir_name(name: Column) -> Column:
    return (
        name.isin(fixed.IGNORED_DIRS)
        | F.lower(name).isin(fixed.IGNORED_DIRS)
        | F.endswith(name, F.lit(".egg-info"))
    )


def vendored_dir_name(name: Column) -> Column:
    return F.lower(name).isin(fixed.VENDORED_DIRS)


def in_ignored_dir(path: Column) -> Column:
    return F.exists(F.split(P.dirname(path), "/"), ignored_dir_name)


def in_vendored_dir(path: Column) -> Column:
    return F.exists(F.split(P.dirname(path), "/"), vendored_dir_name)


def _dir_reason(directory: Column) -> Column:
    name = P.basename(directory)
    return F.when(ignored_dir_name(name), F.lit("ignored_dir")).when(
        vendored_dir_name(name), F.lit("vendored")
    )


def with_pruned_dir(files: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Adds ``prune_dir`` and ``prune_reason``: the topmost directory the walk would not enter.

    ``ignored`` holds the directories hidden by ignore rules (``repo_id, dir``).
    """
    hits = F.filter(
        F.transform(
            P.ancestors(F.col("path")), lambda d: F.struct(d.alias("dir"), _dir_reason(d).alias("reason"))
        ),
        lambda x: x["reason"].isNotNull(),
    )
    out = files.withColumn("_static", F.get(hits, 0))
    if ignored is None:
        return out.select("*", "_static.dir", "_static.reason").withColumnsRenamed(
            {"dir": "prune_dir", "reason": "prune_reason"}
        ).drop("_static")
    # The topmost ignored ancestor per directory is found once per directory, not per file.
    dirs = files.select("repo_id", P.dirname(F.col("path")).alias("_dir")).distinct()
    spread = dirs.select("repo_id", "_dir", F.explode(P.ancestors(F.concat("_dir", F.lit("/x")))).alias("dir"))
    topmost = (
        salted_join(spread, ignored.select("repo_id", "dir"), ["repo_id", "dir"], spread_by=["_dir"])
        .groupBy("repo_id", "_dir")
        .agg(F.min_by("dir", F.length("dir")).alias("_ignored"))
    )
    out = out.withColumn("_dir", P.dirname(F.col("path")))
    out = salted_join(out, topmost, ["repo_id", "_dir"], "left", spread_by=["path"])
    # A directory that is both is counted under the static reason.
    use_static = F.col("_static").isNotNull() & (
        F.col("_ignored").isNull() | (F.length("_static.dir") <= F.length("_ignored"))
    )
    return (
        out.withColumn("prune_dir", F.when(use_static, F.col("_static.dir")).otherwise(F.col("_ignored")))
        .withColumn(
            "prune_reason",
            F.when(use_static, F.col("_static.reason")).when(
                F.col("_ignored").isNotNull(), F.lit("gitignored")
            ),
        )
        .drop("_static", "_dir", "_ignored")
    )


def pruned_dir_counts(files: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Pruned directories per repo and reason, each topmost directory counted once."""
    pruned = with_pruned_dir(files, ignored).where("prune_dir IS NOT NULL")
    return (
        pruned.select("repo_id", "prune_reason", "prune_dir")
        .distinct()
        .groupBy("repo_id", F.col("prune_reason").alias("reason"))
        .agg(F.count("*").alias("dirs"))
    )


# --- ignore rules -----------------------------------------------------------------------------


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Ignore-file lines (``repo_id, dir, ordinal, pattern``) as one ordered list per rule file.

    A rule file is one small file, so its list is bounded by the file itself.
    """
    p = F.regexp_replace("pattern", r"\s+$", "")
    kept = rules.withColumn("p", p).where("p <> '' AND NOT startswith(p, '#')")
    negated = F.startswith(F.col("p"), F.lit("!"))
    body = F.regexp_replace(F.regexp_replace("p", "^!", ""), r"^\\([#!])", "$1")
    dir_only = F.endswith(body, F.lit("/"))
    trimmed = F.regexp_replace(body, "/$", "")
    anchored = F.contains(trimmed, F.lit("/"))
    g = F.regexp_replace(trimmed, "^/", "")
    g = F.regexp_replace(g, r"([.+^$(){}|])", r"\\$1")
    g = F.regexp_replace(g, r"\[!", "[^")
    # Markers keep the wildcard forms apart while single stars are rewritten.
    for glob, marker in ((r"^\*\*/", "\x01"), (r"/\*\*/", "\x02"), (r"/\*\*$", "\x03")):
        g = F.regexp_replace(g, glob, marker)
    g = F.regexp_replace(F.regexp_replace(g, r"\*+", "[^/]*"), r"\?", "[^/]")
    for marker, rx in (("\x01", "(?:.+/)?"), ("\x02", "(?:/.+)?/"), ("\x03", "/.*")):
        g = F.replace(g, F.lit(marker), F.lit(rx))
    rx = F.concat(
        F.lit("^"),
        F.when(anchored, F.lit("")).otherwise(F.lit("(?:.+/)?")),
        g,
        F.when(dir_only, F.lit("/.*")).otherwise(F.lit("(?:/.*)?")),
        F.lit("$"),
    )
    rows = kept.where(g != "").select("repo_id", F.col("dir").alias("scope"), "ordinal", negated.alias("negated"), rx.alias("rx"))
    return rows.groupBy("repo_id", "scope").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "negated", "rx"))).alias("rules")
    )


def _ignored_candidates(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates (``repo_id, name``; directories end with '/') hidden by some rule file."""
    scopes = F.array_append(P.ancestors(F.regexp_replace("name", "/$", "")), F.lit(""))
    spread = candidates.withColumn("scope", F.explode(scopes))
    joined = salted_join(spread, rules, ["repo_id", "scope"], spread_by=["name"])
    local = F.when(F.col("scope") == "", F.col("name")).otherwise(
        F.expr("substring(name, length(scope) + 2)")
    )
    last = F.try_element_at(F.filter("rules", lambda r: F.rlike(local, r["rx"])), F.lit(-1))
    return joined.where(~last["negated"]).select("repo_id", "name").distinct()


def ignored_dirs(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Directories of the corpus hidden by ignore rules."""
    dirs = files.select("repo_id", F.explode(P.ancestors(F.col("path"))).alias("d")).distinct()
    hidden = _ignored_candidates(
        dirs.select("repo_id", F.concat("d", F.lit("/")).alias("name")), compiled_rules(rules)
    )
    return hidden.select("repo_id", F.regexp_replace("name", "/$", "").alias("dir"))


def ignored_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files whose own path is hidden by ignore rules."""
    hidden = _ignored_candidates(
        files.select("repo_id", F.col("path").alias("name")), compiled_rules(rules)
    )
    return hidden.select("repo_id", F.col("name").alias("path"))


# --- skip reasons -----------------------------------------------------------------------------


def minified(path: Column, content: Column) -> Column:
    """``.min.`` in the name, or script or style text with very long lines."""
    name = F.lower(P.basename(path))
    head = F.decode(content.cast("binary"), "ISO-8859-1")
    parts = F.split(head, "\r\n|\n|\r", -1)
    n = F.greatest(F.size(parts) - (F.element_at(parts, -1) == "").cast("int"), F.lit(1))
    longest = F.array_max(F.transform(parts, F.length))
    return F.contains(name, F.lit(".min.")) | (
        P.suffix(name).isin(fixed.MINIFIED_CHECK_EXTENSIONS)
        & (longest > fixed.MINIFIED_LONGEST_LINE)
        & (F.length(head) / n > fixed.MINIFIED_MEAN_LINE)
    )


def binary_content(content: Column) -> Column:
    """A NUL byte anywhere."""
    return F.contains(content.cast("string"), F.lit("\x00"))


def skip_reason(path: Column, size: Column, content: Column, max_bytes: int | None = None) -> Column:
    """Why a file is left out, or NULL. Name tests come first; content is read last.

    No size is too large unless the caller sets ``max_bytes``.
    """
    too_large = F.lit(False) if max_bytes is None else size > max_bytes
    name = F.lower(P.basename(path))
    ext = P.suffix(name)
    generated = name.rlike("(" + "|".join(s.replace(".", r"\.") for s in fixed.GENERATED_SUFFIXES) + ")$")
    return (
        F.when(name.isin(fixed.LOCKFILES), F.lit("lockfile"))
        .when(ext.isin(fixed.BINARY_EXTENSIONS), F.lit("binary"))
        .when(generated, F.lit("generated"))
        .when(size == 0, F.lit("empty"))
        .when(too_large, F.lit("too_large"))
        .when(minified(path, content), F.lit("minified"))
        .when(binary_content(content), F.lit("binary"))
    )


def classified(files: DataFrame, rules: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """Adds ``prune_dir``, ``skip_reason`` and ``language`` to ``repo_id, path, size, is_symlink, text``.

    ``skip_reason`` of a file below a pruned directory is that directory's reason.
    """
    # Content is judged before any join, so a caller that drops ``text`` never shuffles it.
    own = files.withColumn("_own", skip_reason(F.col("path"), F.col("size"), F.col("text"), max_bytes))
    out = with_pruned_dir(own, ignored_dirs(files, rules) if rules is not None else None)
    ignored = F.lit(False)
    if rules is not None:
        hidden = ignored_files(files, rules).withColumn("_hidden", F.lit(True))
        out = out.join(hidden, KEY, "left")
        ignored = F.coalesce("_hidden", F.lit(False))
    reason = (
        F.when(F.col("prune_reason").isNotNull(), F.col("prune_reason"))
        .when(F.col("is_symlink"), F.lit("symlink"))
        .when(ignored, F.lit("gitignored"))
        .otherwise(F.col("_own"))
    )
    return (
        out.withColumn("skip_reason", reason)
        .withColumn("language", language(F.col("path")))
        .drop("_hidden", "_own", "prune_reason")
    )


def kept_files(files: DataFrame, rules: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    return classified(files, rules, max_bytes).where("skip_reason IS NULL").drop("skip_reason", "prune_dir")


def skip_histogram(classified_files: DataFrame) -> DataFrame:
    """Skips per repo and reason; a pruned directory counts once, its files never."""
    units = (
        classified_files.where("skip_reason IS NOT NULL")
        .select("repo_id", F.col("skip_reason").alias("reason"), F.coalesce("prune_dir", "path").alias("unit"))
        .distinct()
    )
    return units.groupBy("repo_id", "reason").agg(F.count("*").alias("skipped"))


def too_large_paths(classified_files: DataFrame) -> DataFrame:
    return classified_files.where("skip_reason = 'too_large'").select("repo_id", "path", "size")


def repo_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def rejected_repos(
    files: DataFrame, max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Repositories above the file-count or size limit, with the reason; none without a limit."""
    many = F.lit(False) if max_files is None else F.col("files") > max_files
    large = F.lit(False) if max_bytes is None else F.col("bytes") > max_bytes
    reason = F.when(many, "too_many_files").otherwise("repo_too_large")
    return repo_sizes(files).where(many | large).withColumn("reason", reason)


def within_limits(files: DataFrame, **limits: int) -> DataFrame:
    """The files of repositories that are inside the limits."""
    rejected = rejected_repos(files, **limits).select("repo_id")
    return salted_join(files, rejected, ["repo_id"], "left_anti", spread_by=["path"])


# --- languages, manifests, choice of files ----------------------------------------------------


def language(path: Column) -> Column:
    """Language id from the file name, a ``Dockerfile`` prefix, or the extension."""
    name = F.lower(P.basename(path))
    return F.coalesce(
        X.lookup(fixed.LANGUAGE_OF_NAME, name),
        F.when(F.startswith(name, F.lit("dockerfile")), F.lit("dockerfile")),
        X.lookup(fixed.LANGUAGE_OF_EXTENSION, P.suffix(name)),
        F.lit("text"),
    )


def is_manifest(path: Column) -> Column:
    name = F.lower(P.basename(path))
    return name.isin(fixed.MANIFEST_NAMES) | (
        F.startswith(name, F.lit("requirements")) & F.endswith(name, F.lit(".txt"))
    )


def is_entry_point(path: Column) -> Column:
    return path.rlike("|".join(fixed.ENTRY_PATTERNS))


def entry_points(files: DataFrame, limit: int = 12) -> DataFrame:
    """Likely entry points per repo: shallow first, tests and examples last."""
    path = F.col("path")
    lower = F.lower(path)
    demo = F.contains(lower, F.lit("test")) | F.contains(lower, F.lit("example"))
    hits = files.where(is_entry_point(path)).select("repo_id", "path")
    return top_k(hits, ["repo_id"], [P.depth(path), demo, path], limit)


def readmes(files: DataFrame) -> DataFrame:
    """One README per repo (shallowest, then shortest path) with its text."""
    hits = files.where(F.lower(P.basename(F.col("path"))).isin(fixed.README_NAMES)).select(
        "repo_id",
        "path",
        F.col("text").alias("excerpt"),
        P.depth(F.col("path")).alias("_depth"),
        F.length("path").alias("_len"),
    )
    return first_per_key(hits, ["repo_id"], ["_depth", "_len", "path"]).drop("_depth", "_len")
