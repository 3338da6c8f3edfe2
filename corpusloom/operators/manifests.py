"""Dependencies, frameworks, package managers and run scripts from manifest files."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.operators.files import is_manifest
from corpusloom.scale import first_per_key, top_k

_PYPROJECT = "names array<string>, scripts array<struct<name:string,command:string>>, poetry boolean"


def _pyproject(text: str) -> Column:
    """Declared names and scripts of pyproject files; a broken file gives nothing.

    The functions are local so that they travel to the workers by value.
    """

    def facts(text: str) -> tuple:
        try:
            data = tomllib.loads(text)
            project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
            groups = [project.get("dependencies"), *(project.get("optional-dependencies") or {}).values()]
            names = [str(n) for g in groups for n in g or []] + list(poetry.get("dependencies") or {})
            scripts = [
                {"name": n, "command": str(v)} for n, v in (project.get("scripts") or {}).items()
            ]
            return names, scripts, bool(poetry)
        except (ValueError, AttributeError, TypeError):
            return None, None, None

    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([facts(t) for t in batch], columns=["names", "scripts", "poetry"])

    parse.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(parse, _PYPROJECT)(text)


def manifests_of(files: DataFrame) -> DataFrame:
    """Manifest files with their lower-case ``name`` and directory ``depth``."""
    path = F.col("path")
    return files.where(is_manifest(path)).select(
        "repo_id", "path", "text", F.lower(P.basename(path)).alias("name"), P.depth(path).alias("depth")
    )


_ORDER = ["repo_id", "path", "depth"]
_PACKAGE_JSON = (
    "dependencies map<string,string>, devDependencies map<string,string>, "
    "peerDependencies map<string,string>, scripts map<string,string>"
)


def _python_name(raw: Column) -> Column:
    name = F.regexp_extract(raw, r"^\s*([A-Za-z0-9_.\-\[\]]+)", 1)
    return F.replace(F.lower(F.substring_index(name, "[", 1)), F.lit("_"), F.lit("-"))


def _listed(rows: DataFrame, names: Column, ecosystem: str) -> DataFrame:
    out = rows.select(*_ORDER, F.posexplode(names).alias("pos", "dependency"))
    return out.where("dependency <> ''").withColumn("ecosystem", F.lit(ecosystem))


def dependencies(files: DataFrame) -> DataFrame:
    """One row per declared dependency, in file order: ``repo_id, path, depth, pos, dependency, ecosystem``."""
    rows = manifests_of(files)
    name = F.col("name")
    package = rows.where(name == "package.json").withColumn("j", F.from_json("text", _PACKAGE_JSON))
    sections = [F.coalesce(F.map_keys(f"j.{k}"), P.no_strings()) for k in ("dependencies", "devDependencies", "peerDependencies")]
    js = _listed(package, F.array_distinct(F.concat(*sections)), "js")
    toml = rows.where(name == "pyproject.toml").withColumn("t", _pyproject("text"))
    toml = _listed(toml, F.transform("t.names", _python_name), "python")
    plain = rows.where(F.startswith(name, F.lit("requirements")) | (name == "pipfile"))
    plain = _listed(plain, F.transform(X.lines(F.col("text")), _python_name), "python")
    setup = rows.where(name.isin("setup.py", "setup.cfg"))
    quoted = F.regexp_extract_all("text", F.lit(r"""['"]([A-Za-z0-9_.\-]+)[<>=~! ]"""), 1)
    setup = _listed(setup, F.transform(quoted, _python_name), "python")
    return js.unionByName(toml).unionByName(plain).unionByName(setup)


def markers(files: DataFrame) -> DataFrame:
    """Framework labels from marker texts and file names: ``repo_id, path, depth, pos, label``."""
    rows = manifests_of(files)
    name = F.col("name")

    def found(table: dict[str, str], text: Column) -> Column:
        # The label tables are small and fixed: one containment test per entry, no join.
        hits = [F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table.items()]
        return F.array(*hits)

    go_lines = F.transform(X.lines(F.col("text")), lambda line: found(fixed.GO_FRAMEWORKS, line))
    labels = (
        F.when(name == "go.mod", F.flatten(go_lines))
        .when(name.isin("pom.xml", "build.gradle", "build.gradle.kts"), found(fixed.JVM_MARKERS, F.lower("text")))
        .when((name == "gemfile") & F.contains("text", F.lit("rails")), F.array(F.lit("Ruby on Rails")))
        .when((name == "composer.json") & F.contains("text", F.lit("laravel/framework")), F.array(F.lit("Laravel")))
        .when(name == "dockerfile", F.array(F.lit("Docker")))
        .when(
            name.isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"),
            F.array(F.lit("Docker Compose")),
        )
        .when(name == "manage.py", F.array(F.lit("Django")))
    )
    return rows.select(*_ORDER, F.posexplode(labels).alias("pos", "label")).where("label IS NOT NULL")


def workflow_labels(files: DataFrame) -> DataFrame:
    """A label for repositories with workflow files, after every manifest label."""
    hits = files.where(F.startswith("path", F.lit(".github/workflows/")))
    return hits.select("repo_id").distinct().select(
        "repo_id",
        F.lit("~").alias("path"),
        F.lit(1_000_000).alias("depth"),
        F.lit(0).alias("pos"),
        F.lit("GitHub Actions").alias("label"),
    )


def frameworks(files: DataFrame) -> DataFrame:
    """Framework labels per repo in first-seen order (depth, path, position in the file)."""
    label = F.when(F.col("ecosystem") == "js", X.lookup(fixed.JS_FRAMEWORKS, F.lower("dependency"))).otherwise(
        X.lookup(fixed.PY_FRAMEWORKS, F.col("dependency"))
    )
    named = dependencies(files).withColumn("label", label).where("label IS NOT NULL")
    rows = (
        named.select(*_ORDER, "pos", "label")
        .unionByName(markers(files))
        .unionByName(workflow_labels(files))
    )
    first = rows.groupBy("repo_id", "label").agg(F.min(F.struct("depth", "path", "pos")).alias("first"))
    # At most one row per label of the fixed tables, so ranking a repository is bounded.
    return top_k(first, ["repo_id"], [F.col("first")], 1000, "position").select("repo_id", "label", "position")


def package_managers(files: DataFrame) -> DataFrame:
    rows = manifests_of(files)
    name = F.col("name")
    fixed_label = (
        F.when(name == "package.json", F.when(F.from_json("text", "x int").isNotNull(), F.lit("npm")))
        .when(F.startswith(name, F.lit("requirements")) | (name == "pipfile"), F.lit("pip"))
        .when(name == "go.mod", F.lit("go modules"))
        .when(name == "pom.xml", F.lit("Maven"))
        .when(name.isin("build.gradle", "build.gradle.kts"), F.lit("Gradle"))
        .when(name == "cargo.toml", F.lit("Cargo"))
        .when(name == "gemfile", F.lit("Bundler"))
        .when(name == "composer.json", F.lit("Composer"))
    )
    toml = rows.where(name == "pyproject.toml").withColumn("t", _pyproject("text")).where("t.names IS NOT NULL")
    by_toml = toml.select(*_ORDER, F.when(F.col("t.poetry"), "poetry").otherwise("pip").alias("manager"))
    both = rows.select(*_ORDER, fixed_label.alias("manager")).where("manager IS NOT NULL").unionByName(by_toml)
    first = both.groupBy("repo_id", "manager").agg(F.min(F.struct("depth", "path")).alias("first"))
    return top_k(first, ["repo_id"], [F.col("first")], 100, "position").select("repo_id", "manager", "position")


def go_modules(files: DataFrame) -> DataFrame:
    """Go module path per repo; the last ``module`` line of the last go.mod counts."""
    rows = manifests_of(files).where("name = 'go.mod'")
    found = F.transform(X.lines(F.col("text")), lambda line: F.regexp_extract(line, r"^\s*module\s+(\S+)", 1))
    module = F.try_element_at(F.filter(found, lambda m: m != ""), F.lit(-1))
    rows = rows.withColumn("go_module", module).where("go_module IS NOT NULL")
    return rows.groupBy("repo_id").agg(F.max_by("go_module", F.struct("depth", "path")).alias("go_module"))


def run_scripts(
    files: DataFrame, npm_scripts: int | None = None, max_scripts: int | None = None, command_chars: int | None = None
) -> DataFrame:
    """Run scripts per repo in first-seen order, first definition wins.

    All scripts and whole commands by default; the limits are for a package.json, a repository and a command.
    """
    rows = manifests_of(files)

    def cut(command: Column) -> Column:
        return (command if command_chars is None else F.left(command, F.lit(command_chars))).alias("command")

    npm = (
        rows.where("name = 'package.json'")
        .select(*_ORDER, F.posexplode(F.from_json("text", _PACKAGE_JSON)["scripts"]).alias("pos", "script", "command"))
        .where(F.lit(True) if npm_scripts is None else F.col("pos") < npm_scripts)
        .select(*_ORDER, "pos", F.concat(F.lit("npm run "), "script").alias("script"), cut(F.col("command")))
    )
    toml = (
        rows.where("name = 'pyproject.toml'")
        .select(*_ORDER, F.posexplode(_pyproject("text")["scripts"]).alias("pos", "s"))
        .select(*_ORDER, "pos", F.col("s.name").alias("script"), cut(F.col("s.command")))
    )
    target = F.transform(X.lines(F.col("text")), lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_\-][A-Za-z0-9_.\-]*):(?!=)", 1))
    make = (
        rows.where("name = 'makefile' AND depth = 0")
        .select(*_ORDER, F.posexplode(target).alias("pos", "target"))
        .where("target <> ''")
        .select(*_ORDER, "pos", F.concat(F.lit("make "), "target").alias("script"), F.lit("").alias("command"))
    )
    every = npm.unionByName(toml).unionByName(make)
    first = first_per_key(every, ["repo_id", "script"], ["depth", "path", "pos"])
    order = [F.col("depth"), F.col("path"), F.col("pos"), F.col("script")]
    return top_k(first, ["repo_id"], order, 1 << 30 if max_scripts is None else max_scripts, "position").select(
        "repo_id", "script", "command", "position"
    )


def manifest_paths(files: DataFrame) -> DataFrame:
    """Manifest paths per repo, shallow first."""
    return manifests_of(files).select("repo_id", "path", "depth")
