"""Repository statistics: languages, snapshot totals, layout, listings, digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.scale import salted_join, top_k


def language_stats(files: DataFrame) -> DataFrame:
    """Files, bytes and lines per repository and language."""
    return files.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("line_count").alias("lines")
    )


def language_shares(stats: DataFrame) -> DataFrame:
    """Percent of code bytes per programming language, largest first; other files do not count."""
    code = stats.where(F.col("language").isin(fixed.PROGRAMMING))
    repo = Window.partitionBy("repo_id")  # a few dozen languages at most per repository
    total = F.sum("bytes").over(repo)
    share = F.bround(F.col("bytes") * 100 / F.when(total == 0, F.lit(1)).otherwise(total), 1)
    order = repo.orderBy(F.desc("bytes"), "language")
    return code.withColumn("percent", share).withColumn("position", F.row_number().over(order)).select(
        "repo_id", "language", "percent", "position"
    )


def primary_language(stats: DataFrame) -> DataFrame:
    shares = language_shares(stats)
    return shares.where("position = 1").select("repo_id", F.col("language").alias("primary_language"))


def snapshot_stats(files: DataFrame, chunks: DataFrame, edges: DataFrame, skipped: DataFrame) -> DataFrame:
    """Totals per repository. Every input is reduced to one row per repository before the join."""
    base = files.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.sum("size").alias("bytes"), F.sum("n_symbols").alias("symbols")
    )
    parts = chunks.groupBy("repo_id").agg(F.count("*").alias("chunks"))
    links = edges.groupBy("repo_id").agg(
        F.count_if(~F.col("external")).alias("dependency_edges"),
        F.countDistinct(F.when(F.col("external"), F.col("dst"))).alias("external_dependencies"),
    )
    # One entry per reason of the fixed ladder.
    reasons = skipped.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "skipped")))).alias("skipped"))
    out = base.join(parts, "repo_id", "left").join(links, "repo_id", "left").join(reasons, "repo_id", "left")
    return out.fillna(0, ["chunks", "dependency_edges", "external_dependencies"])


def symbol_rich_files(files: DataFrame, limit: int = 10) -> DataFrame:
    """Files with the most symbols (``repo_id, path, symbols``)."""
    rows = files.select("repo_id", "path", F.size("symbols").alias("n")).where("n > 0")
    return top_k(rows, ["repo_id"], [F.desc("n"), F.col("path")], limit)


def top_level(files: DataFrame, limit: int = 25) -> DataFrame:
    """Top-level entries with file counts: directories first, then by count and name."""
    path = F.col("path")
    head = F.substring_index(path, "/", 1)
    name = F.when(F.contains(path, F.lit("/")), F.concat(head, F.lit("/"))).otherwise(head)
    counts = files.groupBy("repo_id", name.alias("name")).agg(F.count("*").alias("files"))
    order = [~F.endswith("name", F.lit("/")), F.desc("files"), F.col("name")]
    return top_k(counts, ["repo_id"], order, limit, "position")


def list_directory(requests: DataFrame, files: DataFrame, limit: int = 200) -> DataFrame:
    """Entries of directories (``repo_id, dir``, '' is the root): sub-directories with file counts,
    then files with lines; the first ``limit`` of each listing."""
    dirs = F.array_append(P.ancestors(F.col("path")), F.lit(""))
    spread = files.select("repo_id", "path", "line_count", F.explode(dirs).alias("dir"))
    rows = salted_join(spread, requests.select("repo_id", "dir").distinct(), ["repo_id", "dir"], spread_by=["path"])
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    is_dir = F.contains(rest, F.lit("/"))
    entries = rows.groupBy("repo_id", "dir", is_dir.alias("is_dir"), F.substring_index(rest, "/", 1).alias("name")).agg(
        F.count("*").alias("files"), F.max(F.when(~is_dir, F.col("line_count"))).alias("lines")
    )
    return top_k(entries, ["repo_id", "dir"], [F.desc("is_dir"), F.col("name")], limit, "position")


def tree_nodes(files: DataFrame) -> DataFrame:
    """Tree view: directories and files with their parent; sort by parent, type, name."""
    dirs = files.select("repo_id", F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    nodes = dirs.withColumn("type", F.lit("dir")).unionByName(files.select("repo_id", "path").withColumn("type", F.lit("file")))
    path = F.col("path")
    return nodes.select("repo_id", P.dirname(path).alias("parent"), P.basename(path).alias("name"), "path", "type")


def digest(
    repos: DataFrame, shares: DataFrame, layout: DataFrame, entries: DataFrame, central: DataFrame, rich: DataFrame, readmes: DataFrame
) -> DataFrame:
    """One text per repository from small ranked tables (each already cut to its own top-k)."""

    def block(df: DataFrame, line, order: str, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
        return df.groupBy("repo_id").agg(F.transform(rows, lambda x: x["l"]).alias(name))

    text = F.concat
    parts = [
        block(shares.where("position <= 6"), text("language", F.lit(" "), F.col("percent").cast("string"), F.lit("%")), "position", "langs"),
        block(layout.where("position <= 20"), text(F.lit("  - "), "name", F.lit(" ("), F.col("files").cast("string"), F.lit(" files)")), "position", "layout"),
        block(entries, F.col("path"), "rank", "entries"),
        block(central, text(F.lit("  - "), "dst", F.lit(" ("), F.col("imports").cast("string"), F.lit(")")), "rank", "central"),
        block(rich, text(F.lit("  - "), "path", F.lit(" ("), F.col("n").cast("string"), F.lit(" symbols)")), "rank", "rich"),
        readmes.select("repo_id", F.col("path").alias("readme"), "excerpt"),
    ]
    out = repos
    for part in parts:
        out = out.join(part, "repo_id", "left")

    def listed(title: str, column: str, sep: str):
        body = text(F.lit(title), F.array_join(column, sep))
        return F.when(F.size(column) > 0, body)

    lines = F.concat_ws(
        "\n",
        text(F.lit("Repository: "), "repo_id"),
        text(F.lit("Size: "), F.col("files").cast("string"), F.lit(" files, "), F.col("lines").cast("string"), F.lit(" lines")),
        listed("Languages: ", "langs", ", "),
        listed("Top-level layout:\n", "layout", "\n"),
        listed("Likely entry points: ", "entries", ", "),
        listed("Most imported files (imported by N files):\n", "central", "\n"),
        listed("Files defining the most functions/classes:\n", "rich", "\n"),
    )
    readme = F.when(F.col("readme").isNotNull(), text(F.lit("\n\n"), X.wrapped("readme_excerpt", F.col("excerpt"), F.col("readme"))))
    return out.select("repo_id", text(lines, F.coalesce(readme, F.lit(""))).alias("digest"))
