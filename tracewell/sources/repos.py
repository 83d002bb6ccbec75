"""Repositories as tables: trees of files, commit logs."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import subprocess
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from ..functions.paths import _REPO, MAX_BYTES, repo_parts, slug

MAX_COMMITS = 2000


def resolve(urls: DataFrame) -> DataFrame:
    """urls (url) with host, owner, repo_name and slug; a url that is neither https nor git@ has nulls."""
    p = repo_parts(F.col("url"))
    return urls.withColumn("_p", p).select("*", "_p.host", "_p.owner", F.col("_p.name").alias("repo_name")).drop("_p").withColumn("slug", slug(F.col("owner"), F.col("repo_name")))


def named(repo_id: str) -> tuple[str, str]:
    """Owner (empty if there is none) and name of an id such as owner/name."""
    owner, _, name = repo_id.rstrip("/").rpartition("/")
    return owner.rpartition("/")[2], name


@dataclass(frozen=True)
class Target:
    """What an analysis is asked about: a folder, and the address it came from if there is one."""

    url: str
    owner: str
    name: str
    folder: Path

    @property
    def slug(self) -> str:
        return f"{self.owner}/{self.name}" if self.owner else self.name


Run = Callable[[list[str]], object]


def target(given: str, cache: Path, run: Run | None = None) -> Target:
    """A folder as it is; an address as its copy in the cache, made by git where there is none yet. Anything else is an error."""
    if Path(given).is_dir():
        folder = Path(given).resolve()
        return Target(str(folder), "", folder.name, folder)
    found = re.match(_REPO, given)
    if not found:
        raise ValueError(f"neither a folder nor an address of a repository: {given}")
    host, owner, name = found.groups()
    folder = cache / host / owner / name
    if not (folder / ".git").exists():
        folder.parent.mkdir(parents=True, exist_ok=True)
        (run or _git)(["git", "clone", "--quiet", given, str(folder)])
    return Target(given, owner, name, folder)


def _git(command: list[str]) -> None:
    subprocess.run(command, check=True, capture_output=True)


def metadata(at: Target, fetch: Callable[[str, float], dict], seconds: float = 10.0) -> dict:
    """Default branch and date of creation as a host tells them; nothing if that fails in any way."""
    try:
        got = fetch(f"https://api.{at.url.split('/')[2]}/repos/{at.owner}/{at.name}", seconds)
        return {k: got[v] for k, v in (("default_branch", "default_branch"), ("repo_created_at", "created_at"), ("is_fork", "fork")) if got.get(v) is not None}
    except Exception:  # noqa: BLE001  metadata is extra: an analysis does without
        return {}


def fetched(url: str, seconds: float) -> dict:
    """A JSON object from an address."""
    with urllib.request.urlopen(url, timeout=seconds) as answer:  # noqa: S310  the address is made above
        return json.load(answer)


def created(at: Target, fetch: Callable[[str, float], dict] = fetched) -> dt.datetime | None:
    """When the host says that a repository was made; None for a folder, or if it doesn't say."""
    told = metadata(at, fetch).get("repo_created_at") if "://" in at.url else None
    try:
        return dt.datetime.fromisoformat(told) if told else None
    except (TypeError, ValueError):
        return None


def tree(spark: SparkSession, repo_id: str, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files under a folder: repo_id, path (from the folder), length, content (null above max_bytes); the filter on length is pushed to the scan."""
    base = root if "://" in root else f"file:{root}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    tail = F.regexp_replace(F.col("path"), f"^{base.replace('file:', 'file:/*').rstrip('/')}/", "")
    tail = F.regexp_replace(tail, "^/+" + base.removeprefix("file:").strip("/") + "/", "")
    small = files.where(F.col("length") <= max_bytes).select(tail.alias("path"), "length", "content")
    large = files.where(F.col("length") > max_bytes).select(tail.alias("path"), "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).select(F.lit(repo_id).alias("repo_id"), "path", "length", "content")


class RepoFiles(DataSource):
    """spark.read.format("repo_files").option("roots", JSON of {id: folder}): files of any number of repositories in one scan.

    repo_id, path (from its folder), length, content (null above the option max_bytes, and then never read); .git is left out. A
    partition is a range of REPOS repositories, so folders must be where all executors see them. Filters on repo_id, path and length are
    pushed: a repository that isn't asked for isn't walked, a file that isn't asked for isn't opened.
    """

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "repo_id string, path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FilesReader(json.loads(self.options["roots"]), int(self.options.get("max_bytes", MAX_BYTES)))


#: Repositories of a partition.
REPOS = 16
_TESTS = {
    EqualTo: lambda x, f: x == f.value, In: lambda x, f: x in f.value, LessThan: lambda x, f: x < f.value, LessThanOrEqual: lambda x, f: x <= f.value, GreaterThan: lambda x, f: x > f.value,
    GreaterThanOrEqual: lambda x, f: x >= f.value, StringStartsWith: lambda x, f: x.startswith(f.value), StringEndsWith: lambda x, f: x.endswith(f.value), IsNotNull: lambda x, f: True,
}


class _FilesReader(DataSourceReader):
    def __init__(self, roots: dict[str, str], max_bytes: int):
        self.roots, self.max_bytes, self.asked = roots, max_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("repo_id",), ("path",), ("length",)):
                self.asked.append(f)
            else:
                yield f

    def _fits(self, column: str, x: object) -> bool:
        return all(_TESTS[type(f)](x, f) for f in self.asked if f.attribute == (column,))

    def partitions(self) -> list[InputPartition]:
        some = sorted(kv for kv in self.roots.items() if self._fits("repo_id", kv[0]))
        return [InputPartition(some[i : i + REPOS]) for i in range(0, len(some), REPOS)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for repo_id, root in partition.value:
            for folder, inner, names in os.walk(root):
                inner[:] = sorted(d for d in inner if d != ".git")
                for name in sorted(names):
                    full = os.path.join(folder, name)
                    path = os.path.relpath(full, root).replace(os.sep, "/")
                    if not self._fits("path", path) or os.path.islink(full) or not os.path.isfile(full):
                        continue
                    length = os.path.getsize(full)
                    if self._fits("length", length):
                        yield repo_id, path, length, Path(full).read_bytes() if length <= self.max_bytes else None


def trees(spark: SparkSession, roots: dict[str, str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files of many repositories: folders in one scan, addresses of other file systems one by one."""
    spark.dataSource.register(RepoFiles)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "false":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    near = {k: v for k, v in roots.items() if "://" not in v}
    out = spark.read.format("repo_files").option("roots", json.dumps(near)).option("max_bytes", max_bytes).load()
    for k, v in roots.items():
        if k not in near:
            out = out.unionByName(tree(spark, k, v, max_bytes))
    return out


_COMMITS = "repo_id string, sha string, ts timestamp, local timestamp_ntz, message string, author_email string, additions int, deletions int, files_changed int"


class GitLog(DataSource):
    """spark.read.format("git_log").option("roots", "id=path;id=path"): a partition per repository, its newest commits first."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return _COMMITS

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(dict(r.split("=", 1) for r in self.options["roots"].split(";") if r))


class _GitReader(DataSourceReader):
    def __init__(self, roots: dict[str, str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(kv) for kv in self.roots.items()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repo_id, root = partition.value
        form = "%x1e%H%x1f%aI%x1f%ae%x1f%B%x1f"
        done = subprocess.run(["git", "-C", root, "log", f"--max-count={MAX_COMMITS}", "--numstat", f"--format={form}"], capture_output=True)
        if done.returncode:
            return
        for entry in done.stdout.decode("utf-8", "replace").split("\x1e")[1:]:
            sha, when, email, message, stats = entry.split("\x1f")
            counts = [x.split("\t")[:2] for x in stats.strip().splitlines() if x.count("\t") >= 2]
            number = lambda i: sum(int(c[i]) for c in counts if c[i].isdigit())  # noqa: E731, B023
            at = dt.datetime.fromisoformat(when)
            yield repo_id, sha, at.astimezone(dt.UTC), at.replace(tzinfo=None), message.strip("\n"), email, number(0), number(1), len(counts)


def commits(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").option("roots", ";".join(f"{k}={v}" for k, v in roots.items())).load()
