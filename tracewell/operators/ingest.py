"""Files of repositories: classification, significance, coverage, import centrality, README choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pycode
from ..functions.paths import MAX_BYTES, exclusion, language, module_name
from ..functions.text import bound, count_loc, round4, safe_div

TOP_K, MAX_FILES = 40, 5000
READMES = ("README.md", "README.rst", "README.txt", "README", "readme.md")


def classified(contents: DataFrame, most_files: int | None = MAX_FILES) -> DataFrame:
    """repo_id, path, length, content (binary) to files: language, exclude_reason (path first, then size, then encoding), text, loc.

    The first `most_files` paths of each repository outside .git count (None: all, as for candidates). Content is only decoded where the path allows it.
    """
    inside = contents.where(~F.array_contains(F.split("path", "/"), ".git"))
    rows = inside
    if most_files is not None:
        order = Window.partitionBy("repo_id").orderBy("path")
        rows = inside.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_files).drop("_n")
    size = F.when(F.col("length") > MAX_BYTES, "too_large").otherwise("")
    rows = rows.withColumn("_why", bound(exclusion(F.col("path")), lambda w: F.when(w != "", w).otherwise(size)))
    # what was read: the reason, the text where there is none, and its lines of code
    read = bound(F.struct(F.col("_why").alias("w"), F.when(F.col("_why") == "", F.try_validate_utf8(F.col("content").cast("string"))).alias("t")), lambda r: F.struct(F.when((r["w"] == "") & r["t"].isNull(), "binary").otherwise(r["w"]).alias("why"), r["t"].alias("text"), F.when(r["t"].isNull(), 0).otherwise(count_loc(r["t"])).cast("long").alias("loc")))
    rows = rows.select("repo_id", "path", language(F.col("path")).alias("language"), read.alias("r"))
    return rows.select("repo_id", "path", "language", F.col("r.why").alias("exclude_reason"), (F.col("r.why") != "").alias("excluded"), "r.text", "r.loc")


def import_edges(files: DataFrame) -> DataFrame:
    """repo_id, importer, path: which Python file imports which. A target means its module, else the longest known prefix, else every file of its last name."""
    py = files.where(F.col("path").endswith(".py") & F.col("text").isNotNull()).withColumn("module", module_name(F.col("path")))
    modules = py.where("module is not null").groupBy("repo_id", "module").agg(F.max("path").alias("path"))
    targets = py.select("repo_id", F.col("path").alias("importer"), F.explode(pycode.import_targets("text")).alias("target")).distinct()
    parts = F.split("target", r"\.")
    prefixes = targets.select("repo_id", "importer", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), ".").alias("module")))).alias("p")).select("repo_id", "importer", "target", "p.*")
    by_module = prefixes.join(modules, ["repo_id", "module"]).groupBy("repo_id", "importer", "target").agg(F.max_by("path", "n").alias("path"))
    stems = py.where("module is not null").select("repo_id", F.element_at(F.split("module", r"\."), -1).alias("stem"), "path")
    rest = targets.join(by_module.select("repo_id", "importer", "target"), ["repo_id", "importer", "target"], "left_anti")
    by_stem = rest.withColumn("stem", F.element_at(F.split("target", r"\."), -1)).join(stems, ["repo_id", "stem"]).select("repo_id", "importer", "path")
    return by_module.select("repo_id", "importer", "path").unionByName(by_stem).where("importer <> path").distinct()


def centrality(files: DataFrame) -> DataFrame:
    """repo_id, path, import_centrality: importers over the other Python files."""
    py = files.where(F.col("path").endswith(".py") & F.col("text").isNotNull()).select("repo_id", "path")
    count = py.groupBy("repo_id").agg(F.count("*").alias("n"))
    by = import_edges(files).groupBy("repo_id", "path").agg(F.countDistinct("importer").alias("k"))
    return py.join(count, "repo_id").join(by, ["repo_id", "path"], "left").select("repo_id", "path", round4(F.coalesce("k", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("import_centrality"))


def ranked(files: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """files (repo_id, path, loc, excluded, import_centrality) with significance_score and significance_rank (0: not among the first top_k)."""
    repo = Window.partitionBy("repo_id")
    kept = F.when(~F.col("excluded"), F.col("loc"))
    most = F.greatest(F.coalesce(F.max(kept).over(repo), F.lit(0)), F.lit(1))
    score = F.when(~F.col("excluded"), round4(0.6 * F.col("loc") / most + 0.4 * F.coalesce("import_centrality", F.lit(0.0))))
    out = files.withColumn("significance_score", score)
    order = Window.partitionBy("repo_id").orderBy(F.col("excluded"), F.col("significance_score").desc(), "path")
    n = F.row_number().over(order)
    return out.withColumn("significance_rank", F.when(~F.col("excluded") & (n <= top_k), n).otherwise(0))


def coverage(files: DataFrame) -> DataFrame:
    """total_loc and compared_loc of files that aren't excluded, and their ratio."""
    kept = files.where(~F.col("excluded")).groupBy("repo_id").agg(F.sum("loc").alias("total_loc"), F.sum(F.when(F.col("significance_rank") > 0, F.col("loc")).otherwise(0)).alias("compared_loc"))
    return kept.withColumn("coverage_ratio", round4(safe_div(F.col("compared_loc"), F.col("total_loc"))))


def readme(contents: DataFrame) -> DataFrame:
    """repo_id, readme_text: the first of READMES in the root folder."""
    order = F.array_position(F.array(*map(F.lit, READMES)), F.col("path"))
    return contents.where(F.col("path").isin(*READMES)).groupBy("repo_id").agg(F.min_by(F.col("content").cast("string"), order).alias("readme_text"))


def created_at(repos: DataFrame, commits: DataFrame) -> DataFrame:
    """repos (repo_id, created_at) with a missing date filled by the first commit's."""
    first = commits.groupBy("repo_id").agg(F.min("ts").alias("_first"))
    return repos.join(first, "repo_id", "left").withColumn("created_at", F.coalesce("created_at", "_first")).drop("_first")
