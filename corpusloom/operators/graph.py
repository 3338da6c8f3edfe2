"""Imports resolved to files, and questions about the resulting dependency graph.

Resolution never scans for suffixes: the file index is exploded to the keys a specifier may match,
each specifier to its ordered candidates, and one equi join finds them all, for every language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import paths as P
from corpusloom.scale import SALTS, computed_once, salted_join, skewed_join, top_k
from corpusloom.session import slice_count

JS = ["javascript", "typescript", "tsx"]
CANDIDATE = "array<struct<space:string,key:string>>"
SIGNATURE = ["repo_id", "family", "base", "module", "level", "names"]


def _suffixes(parts: Column, sep: str) -> Column:
    """Every trailing run of ``parts`` joined by ``sep``, longest first."""
    return F.transform(
        parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), sep)
    )


def _keys(space: str, keys: Column, target: Column) -> Column:
    return F.transform(
        keys, lambda k: F.struct(F.lit(space).alias("space"), k.alias("key"), target.alias("target"))
    )


def _extension(path: Column) -> Column:
    """What ``path`` ends with from its last dot on, also where nothing comes before the dot."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def resolution_index(files: DataFrame) -> DataFrame:
    """What a specifier may match, one row per key: ``repo_id, space, key, target``.

    Spaces: ``path`` (exact), ``py`` (dotted suffixes of modules, shallowest file wins), ``java``
    (path suffixes), ``js`` (paths without an extension that may be left out, the first extension wins), ``index``
    (the same for ``/index`` files), ``dir`` (directories), ``dirs`` (directory suffixes).
    """
    path = F.col("path")
    python = path.rlike(r"\.pyi?$")
    parts = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    init = F.element_at(parts, -1) == "__init__"
    module = F.slice(parts, F.lit(1), F.size(parts) - init.cast("int"))
    none = F.array().cast("array<struct<space:string,key:string,target:string>>")
    stem, js = F.regexp_replace(path, r"\.[^./]*$", ""), _extension(path).isin(fixed.JS_RESOLVE_EXTENSIONS)
    per_file = F.concat(
        F.array(F.struct(F.lit("path").alias("space"), path.alias("key"), path.alias("target"))),
        F.when(python, _keys("py", _suffixes(module, "."), path)).otherwise(none),
        F.when(F.endswith(path, F.lit(".java")), _keys("java", _suffixes(F.split(path, "/"), "/"), path)).otherwise(none),
        F.when(js, _keys("js", F.array(stem), path)).otherwise(none),
        F.when(js & F.endswith(stem, F.lit("/index")), _keys("index", F.array(F.regexp_replace(stem, "/index$", "")), path)).otherwise(none),
    )
    rows = files.select("repo_id", F.inline(per_file))
    dirs = files.select("repo_id", P.module_of(path).alias("d")).distinct()
    per_dir = F.concat(
        F.array(F.struct(F.lit("dir").alias("space"), F.col("d").alias("key"), F.col("d").alias("target"))),
        _keys("dirs", _suffixes(F.split("d", "/"), "/"), F.col("d")),
    )
    rows = rows.unionByName(dirs.select("repo_id", F.inline(per_dir)))
    ends = F.array(*[F.lit(e) for e in fixed.JS_RESOLVE_EXTENSIONS])
    turn = F.array_position(ends, _extension(F.col("target"))).cast("int")
    depth = F.when(F.col("space") == "py", P.depth(F.col("target"))).when(F.col("space").isin("js", "index"), turn).otherwise(0)
    return rows.groupBy("repo_id", "space", "key").agg(
        F.min_by("target", F.struct(depth, F.col("target"))).alias("target")
    )


def _as_candidates(space: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(space).alias("space"), k.alias("key"))).cast(CANDIDATE)


def _joined(*parts: Column) -> Column:
    """Path of the non-empty parts."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def python_stem(base: Column, module: Column, level: Column) -> Column:
    """Path that a relative module means, without its extension."""
    up = F.split(base, "/")
    root = F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - (level - 1), F.lit(0))), "/")
    return F.when(level > 0, _joined(root, F.replace(module, F.lit("."), F.lit("/"))))


def js_target(base: Column, module: Column) -> Column:
    """Path that a specifier names; NULL for a package."""
    return F.when(F.startswith(module, F.lit(".")), P.normalised(_joined(base, module))).when(
        module.rlike("^[@~]/"), P.normalised(F.concat(F.lit("src/"), F.substring(module, 3, 1 << 20)))
    )


def python_candidates(stem: Column, module: Column, level: Column, names: Column) -> Column:
    """Absolute: the module, then its names as modules, then its parent. Relative: files in order."""
    parent = F.regexp_extract(module, r"^(.*)\.[^.]*$", 1)
    absolute = F.concat(
        F.array(module),
        F.transform(names, lambda n: F.concat(module, F.lit("."), n)),
        F.when(parent != "", F.array(parent)).otherwise(P.no_strings()),
    )
    in_package = F.flatten(
        F.transform(names, lambda n: F.array(_joined(stem, F.concat(n, F.lit(".py"))), _joined(stem, n, F.lit("__init__.py"))))
    )
    of_module = F.when(
        module != "", F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))
    ).otherwise(P.no_strings())
    own = F.when(module == "", F.array(_joined(stem, F.lit("__init__.py")))).otherwise(P.no_strings())
    relative = F.concat(of_module, in_package, own)
    return F.when(level > 0, _as_candidates("path", relative)).otherwise(_as_candidates("py", absolute))


def js_candidates(target: Column) -> Column:
    """The path itself, TypeScript sources behind a script suffix, added extensions, index files.

    One key stands for all extensions; the index holds the file that comes first in their order.
    """
    ext = P.suffix(P.basename(target))
    stem = F.regexp_replace(target, r"\.[^./]*$", "")
    none = F.array().cast(CANDIDATE)
    swapped = F.when(ext.isin(fixed.JS_SOURCE_EXTENSIONS), _as_candidates("js", F.array(stem))).otherwise(none)
    keys = F.concat(_as_candidates("path", F.array(target)), swapped, _as_candidates("js", F.array(target)), _as_candidates("index", F.array(target)))
    return F.when(target.isNotNull(), keys).otherwise(none)


def java_candidates(module: Column) -> Column:
    """Type by path suffix, then without the static member; a wildcard names a package directory."""
    path = F.replace(module, F.lit("."), F.lit("/"))
    package = F.regexp_replace(path, r"/\*$", "")
    owner = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    types = F.array(F.concat(path, F.lit(".java")), F.concat(owner, F.lit(".java")))
    return F.when(F.endswith(module, F.lit(".*")), _as_candidates("dirs", F.array(package))).otherwise(
        _as_candidates("java", types)
    )


def go_candidates(module: Column, go_module: Column) -> Column:
    rest = F.substring(module, F.length(go_module) + 1, F.length(module))
    key = F.coalesce(F.nullif(P.strip_chars(rest, "/"), F.lit("")), F.lit("."))
    return F.when(_inside_go_module(module, go_module), _as_candidates("dir", F.array(key))).otherwise(
        F.array().cast(CANDIDATE)
    )


def _inside_go_module(module: Column, go_module: Column) -> Column:
    inside = (module == go_module) | F.startswith(module, F.concat(go_module, F.lit("/")))
    return F.coalesce(inside, F.lit(False))


def with_signature(refs: DataFrame) -> DataFrame:
    """Adds the columns a resolution depends on; the directory only where it matters."""
    language, module = F.col("language"), F.col("module")
    family = F.when(language.isin(JS), F.lit("js")).otherwise(language)
    relative = ((language == "python") & (F.col("level") > 0)) | (language.isin(JS) & F.startswith(module, F.lit(".")))
    return refs.withColumns(
        {
            "family": family,
            "base": F.when(relative, P.dirname(F.col("path"))).otherwise(F.lit("")),
            "names": F.array_join(F.coalesce("names", P.no_strings()), ","),
        }
    )


def resolved_signatures(signatures: DataFrame, files: DataFrame, go_modules: DataFrame) -> DataFrame:
    """Target of every distinct specifier that matches something in its repository.

    The path that a specifier means is folded once per specifier; its candidates are built from that.
    """
    base, module, level = F.col("base"), F.col("module"), F.col("level")
    names = F.filter(F.split("names", ","), lambda n: n != "")
    rows = salted_join(signatures, go_modules, ["repo_id"], "left")
    meant = F.when(F.col("family") == "python", python_stem(base, module, level)).when(F.col("family") == "js", js_target(base, module))
    rows = computed_once(rows, "_meant", meant)
    candidates = (
        F.when(F.col("family") == "python", python_candidates(F.col("_meant"), module, level, names))
        .when(F.col("family") == "js", js_candidates(F.col("_meant")))
        .when(F.col("family") == "java", java_candidates(module))
        .when(F.col("family") == "go", go_candidates(module, F.col("go_module")))
    )
    spread = rows.select(*SIGNATURE, "go_module", F.posexplode(candidates).alias("pos", "c"))
    spread = spread.select(*SIGNATURE, "pos", "c.space", "c.key")
    hits = spread.join(resolution_index(files), ["repo_id", "space", "key"])
    return hits.groupBy(*SIGNATURE).agg(
        F.min_by(F.struct("target", F.col("space").isin("dir", "dirs").alias("is_dir")), "pos").alias("hit")
    )


def build_edges(refs: DataFrame, files: DataFrame, go_modules: DataFrame) -> DataFrame:
    """Distinct dependency edges from import references.

    ``refs``: ``repo_id, path, language, module, level, names``. A specifier is resolved once per
    repository however many files use it; popular ones are spread out when joined back.
    """
    used = with_signature(refs).select(*SIGNATURE, "path").distinct()
    signatures = used.select(*SIGNATURE).distinct()
    found = resolved_signatures(signatures, files, go_modules)
    rows = skewed_join(used, found, SIGNATURE, "left")
    rows = salted_join(rows, go_modules, ["repo_id"], "left", spread_by=["path", "module"])
    family, module, target = F.col("family"), F.col("module"), F.col("hit.target")
    own = F.when(family == "go", P.module_of(F.col("path"))).otherwise(F.col("path"))
    internal = target.isNotNull() & (target != own)
    parts = F.split(module, r"\.")
    slashes = F.split(module, "/")
    js_package = F.when(
        F.startswith(module, F.lit("@")) & (F.size(slashes) > 1), F.array_join(F.slice(slashes, 1, 2), "/")
    ).otherwise(F.get(slashes, 0))
    outside = (
        F.when((family == "python") & (F.col("level") == 0) & (module != ""), F.get(parts, 0))
        .when((family == "js") & ~module.rlike("^[./]"), js_package)
        .when(family == "java", F.array_join(F.slice(parts, 1, 2), "."))
        .when((family == "go") & ~_inside_go_module(module, F.col("go_module")), module)
    )
    written = F.when(
        (family == "python") & (module == ""), F.expr("repeat('.', level)")
    ).otherwise(module)
    return (
        rows.select(
            "repo_id",
            F.col("path").alias("src"),
            F.when(internal, target).otherwise(outside).alias("dst"),
            (~internal).alias("external"),
            F.coalesce(internal & F.col("hit.is_dir"), F.lit(False)).alias("dst_is_dir"),
            written.alias("specifier"),
            P.dirname(F.col("path")).alias("src_dir"),
        )
        .where("dst IS NOT NULL")
        .distinct()
    )


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("repo_id", "src", "dst", "specifier")


# --- questions about the graph ------------------------------------------------------------------


def internal_pairs(edges: DataFrame) -> DataFrame:
    """Importer and imported inside the repository, with the number of edges between them."""
    inner = edges.where("NOT external AND src <> dst")
    return inner.groupBy("repo_id", "src", "dst").agg(F.count("*").alias("imports"))


def most_imported(edges: DataFrame, limit: int = 12) -> DataFrame:
    """Files with the highest in-degree; ``importers`` counts each importing file once."""
    pairs = internal_pairs(edges)
    degree = pairs.groupBy("repo_id", "dst").agg(
        F.sum("imports").alias("imports"), F.count("*").alias("importers")
    )
    return top_k(degree, ["repo_id"], [F.desc("imports"), F.col("dst")], limit)


def directory_imports(edges: DataFrame, limit: int = 20, min_groups: int = 3) -> DataFrame:
    """Imports between directories; between files where fewer than ``min_groups`` pairs exist."""
    pairs = internal_pairs(edges)
    groups = (
        pairs.select("repo_id", P.group_of(F.col("src")).alias("src"), P.group_of(F.col("dst")).alias("dst"), "imports")
        .where("src <> dst")
        .groupBy("repo_id", "src", "dst")
        .agg(F.sum("imports").alias("imports"))
    )
    rich = groups.groupBy("repo_id").count().where(F.col("count") >= min_groups).select("repo_id")
    chosen = groups.join(rich, "repo_id", "left_semi").unionByName(
        salted_join(pairs, rich, ["repo_id"], "left_anti")
    )
    return top_k(chosen, ["repo_id"], [F.desc("imports"), F.col("src"), F.col("dst")], limit)


def owners(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Module owning each file: an exact path, else the longest directory prefix.

    ``modules``: ``repo_id, module_id, ord, owned`` with directories ending in '/'. Prefixes are
    found once per directory by equi join on its ancestors.
    """
    by_dir = modules.where("owned LIKE '%/'").groupBy("repo_id", "owned").agg(
        F.min(F.struct("ord", "module_id")).alias("m")
    )
    by_file = modules.where("owned NOT LIKE '%/'").groupBy("repo_id", F.col("owned").alias("path")).agg(
        F.min(F.struct("ord", "module_id")).alias("exact")
    )
    rows = files.select("repo_id", "path", P.dirname(F.col("path")).alias("dir"))
    dirs = rows.select("repo_id", "dir").distinct()
    above = F.transform(P.ancestors(F.concat("dir", F.lit("/x"))), lambda d: F.concat(d, F.lit("/")))
    spread = dirs.select("repo_id", "dir", F.explode(above).alias("owned"))
    longest = (
        salted_join(spread, by_dir, ["repo_id", "owned"], spread_by=["dir"])
        .groupBy("repo_id", "dir")
        .agg(F.max_by("m", F.length("owned")).alias("prefix"))
    )
    rows = rows.join(by_file, ["repo_id", "path"], "left")
    rows = salted_join(rows, longest, ["repo_id", "dir"], "left", spread_by=["path"])
    owner = F.coalesce("exact.module_id", "prefix.module_id")
    return rows.select("repo_id", "path", owner.alias("module_id"))


def module_imports(edges: DataFrame, ownership: DataFrame) -> DataFrame:
    """Imports between modules, self edges left out. ``edges`` may be pairs with ``imports``."""
    pairs = edges if "imports" in edges.columns else internal_pairs(edges)
    src = ownership.select("repo_id", F.col("path").alias("src"), F.col("module_id").alias("source"))
    dst = ownership.select("repo_id", F.col("path").alias("dst"), F.col("module_id").alias("target"))
    return (
        skewed_join(skewed_join(pairs, src, ["repo_id", "src"]), dst, ["repo_id", "dst"])
        .where("source <> target")
        .groupBy("repo_id", "source", "target")
        .agg(F.sum("imports").alias("imports"))
    )


def owning_modules(modules: DataFrame, ownership: DataFrame) -> DataFrame:
    """Modules that own at least one file, or are external."""
    used = ownership.where("module_id IS NOT NULL").select("repo_id", "module_id").distinct()
    owned = modules.where("kind <> 'external'").join(used, ["repo_id", "module_id"], "left_semi")
    return owned.unionByName(modules.where("kind = 'external'"))


def linked_modules(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Drops external modules that no edge touches."""
    ends = edges.select("repo_id", F.explode(F.array("source", "target")).alias("module_id")).distinct()
    kept = modules.where("kind = 'external'").join(ends, ["repo_id", "module_id"], "left_semi")
    return modules.where("kind <> 'external'").unionByName(kept)


def dependencies_of(targets: DataFrame, edges: DataFrame, with_directory: bool = True) -> DataFrame:
    """What each target imports and what imports it.

    ``targets``: ``repo_id, module, is_file``. Rows: ``relation`` is internal, external or users.
    A directory's inner edges are left out. A file's users include importers of its directory, unless
    ``with_directory`` is off: these are the same for all of its files, so their rows are files times importers.
    They are made last, by a join whose rows are distinct already: nothing of that size is sorted or shuffled.
    """
    module = F.col("module")

    def inside(path: Column) -> Column:
        return (path == module) | F.startswith(path, F.concat(module, F.lit("/")))

    cols = ["repo_id", "src", "dst", "external"]
    asked = ["repo_id", "module", "is_file", "_dir"]
    targets = targets.select("repo_id", "module", "is_file").distinct()
    # ``_dir`` is set where the module is asked for as a file (it may be asked for as a folder, too).
    files = targets.where("is_file").withColumn("_dir", P.module_of(module))
    folders = targets.where("NOT is_file").join(files.drop("is_file"), ["repo_id", "module"], "left").select(*asked)

    def at(edges: DataFrame, end: str, rows: DataFrame, place: Column) -> DataFrame:
        """Edges whose ``end`` is the place itself."""
        return salted_join(edges, rows.withColumn(end, place).select(*asked, end), ["repo_id", end]).select(*asked, *cols[1:])

    def below(edges: DataFrame, end: str) -> DataFrame:
        """Edges whose ``end`` lies under an asked folder. Only distinct folders are expanded to their ancestors."""
        rows = edges.withColumn("_of", P.dirname(F.col(end)))
        dirs = rows.select("repo_id", "_of").distinct()
        above = dirs.select("repo_id", "_of", F.explode(P.ancestors(F.concat("_of", F.lit("/x")))).alias("module"))
        met = salted_join(above, folders, ["repo_id", "module"], spread_by=["_of"])
        return salted_join(rows, met, ["repo_id", "_of"]).select(*asked, *cols[1:])

    edges = edges.select(*cols)
    out = at(edges, "src", files, module).unionByName(below(edges, "src"))
    out = out.where(F.col("is_file") | F.col("external") | ~inside(F.col("dst"))).select(
        "repo_id", "module", F.when(F.col("external"), "external").otherwise("internal").alias("relation"), F.col("dst").alias("path")
    )
    inner = edges.where("NOT external")
    into = at(inner, "dst", files, module).unionByName(at(inner, "dst", folders, module)).unionByName(below(inner, "dst"))
    into = into.where(F.when(F.col("is_file"), F.col("src") != module).otherwise(~inside(F.col("src"))))
    into = into.select("repo_id", "module", F.lit("users").alias("relation"), F.col("src").alias("path"), "_dir")
    if not with_directory:
        return out.unionByName(into.drop("_dir")).distinct()
    users = _users_of_directories(files, inner)
    into = into.join(users.withColumnsRenamed({"dir": "_dir", "src": "path"}), ["repo_id", "_dir", "path"], "left_anti")
    shared = _paired(users, files.select("repo_id", F.col("_dir").alias("dir"), "module"), ["repo_id", "dir"], "src").where(F.col("src") != module)
    shared = shared.select("repo_id", "module", F.lit("users").alias("relation"), F.col("src").alias("path"))
    return out.unionByName(into.select(*out.columns)).distinct().unionByName(shared)


def _users_of_directories(files: DataFrame, inner: DataFrame) -> DataFrame:
    """Distinct importers (``repo_id, dir, src``) of the directories (``_dir``) of ``files``."""
    dirs = files.select("repo_id", F.col("_dir").alias("dir")).distinct()
    users = inner.where("src IS NOT NULL").select("repo_id", F.col("dst").alias("dir"), "src").distinct()
    return salted_join(users, dirs, ["repo_id", "dir"], "left_semi")


def _paired(left: DataFrame, right: DataFrame, on: list[str], spread_by: str) -> DataFrame:
    """Join with far more rows than its sides have: cut by number, as adaptive execution would go by the sides' size.

    The rows of a key on the left are spread; those on the right are repeated and held for one key at a time.
    """
    n = max(slice_count(left.sparkSession), left.sparkSession.sparkContext.defaultParallelism)
    keys = [*on, "_salt"]
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), keys).drop("_salt")


def _directory_users(targets: DataFrame, edges: DataFrame, own: DataFrame, shown: int) -> DataFrame:
    """Importers of each target file's directory: how many are neither the file itself nor in ``own``, and the first names.

    They are counted and listed once per directory; a file only takes away what it has in common with them.
    """
    files = targets.where("is_file").select("repo_id", "module").distinct().withColumn("dir", P.module_of(F.col("module")))
    users = _users_of_directories(files.withColumnRenamed("dir", "_dir"), edges.where("NOT external"))
    counts = users.groupBy("repo_id", "dir").agg(F.count("*").alias("n"))
    first = top_k(users, ["repo_id", "dir"], [F.col("src")], shown + 1)
    counts = counts.join(first.groupBy("repo_id", "dir").agg(F.collect_list("src").alias("names")), ["repo_id", "dir"])
    known = own.join(files, ["repo_id", "module"]).select("repo_id", "module", "dir", F.col("path").alias("src"))
    known = known.unionByName(files.withColumn("src", F.col("module")))
    common = known.join(users, ["repo_id", "dir", "src"]).groupBy("repo_id", "module").agg(F.count("*").alias("common"))
    out = salted_join(files, counts, ["repo_id", "dir"], spread_by=["module"]).join(common, ["repo_id", "module"], "left")
    return out.select(
        "repo_id", "module", (F.col("n") - F.coalesce("common", F.lit(0))).alias("dir_users"),
        F.filter("names", lambda x: x != F.col("module")).alias("dir_list"),
    )


def dependency_report(targets: DataFrame, edges: DataFrame, shown: int = 60) -> DataFrame:
    """One text per target; each list shows its first ``shown`` names, the user count is complete."""
    rows = dependencies_of(targets, edges, with_directory=False)
    keys = ["repo_id", "module"]
    totals = rows.groupBy(*keys).agg(F.count_if(F.col("relation") == "users").alias("own_users"))
    first = top_k(rows, [*keys, "relation"], [F.col("path")], shown)

    def names(relation: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("relation") == relation, F.col("path"))))

    lists = first.groupBy(*keys).agg(
        *[F.array_join(names(r), ", ").alias(r) for r in ("internal", "external")], names("users").alias("own_list")
    )
    shared = _directory_users(targets, edges, rows.where("relation = 'users'"), shown)
    out = targets.join(lists, keys, "left").join(totals, keys, "left").join(shared, keys, "left")
    both = F.concat(F.coalesce("own_list", P.no_strings()), F.coalesce("dir_list", P.no_strings()))
    listed = F.array_join(F.slice(F.array_sort(F.array_distinct(both)), 1, shown), ", ")
    users = F.coalesce("own_users", F.lit(0)) + F.coalesce("dir_users", F.lit(0))
    out = out.withColumns({"user_list": listed, "users": users})

    def or_else(column: str, word: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(word))

    slash = F.when(F.col("is_file"), "").otherwise("/")
    text = F.concat(
        F.lit("Dependencies of "), "module", slash, F.lit(":\nImports (in this repo): "), or_else("internal", "none"),
        F.lit("\nExternal packages: "), or_else("external", "none"),
        F.lit("\nImported by ("), F.col("users").cast("string"), F.lit("): "), or_else("user_list", "nothing"),
    )
    return out.select(*keys, text.alias("report"))
