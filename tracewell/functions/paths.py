"""What paths and addresses tell: language, reason for exclusion, repository, module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Languages by suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".rb": "ruby", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp",
    ".php": "php", ".kt": "kotlin", ".swift": "swift", ".scala": "scala", ".sh": "shell",
}
# Folders of code that isn't the author's, lock files, folders of tests.
VENDOR_FOLDERS = (
    "node_modules", "vendor", "third_party", "thirdparty", "external", "deps", "dist", "build", "out", "target", ".next", ".nuxt", "site-packages",
    "__pycache__", ".venv", "venv", "env", ".git", "migrations", "generated", "gen", "bower_components", ".gradle", "coverage", "htmlcov",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "composer.lock", "cargo.lock", "go.sum", "gemfile.lock")
TEST_FOLDERS = ("test", "tests", "spec", "specs", "__tests__", "testdata")
# Names of generated files and of tests.
GENERATED = r"(?i)(\.min\.(js|css)|\.bundle\.js|_pb2\.py|\.pb\.go|\.g\.dart|\.freezed\.dart|\.designer\.cs)$|\.generated\."
TESTS = r"(?i)(^|/)test_[^/]+\.py$|_test\.(py|go|js|ts)$|\.(test|spec)\.(js|jsx|ts|tsx)$"
TESTS_BY_CASE = r"Test\.(java|kt|scala)$"
MAX_BYTES = 1_000_000


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """Language of a path's last suffix; names that only begin with a dot have none."""
    suffix = F.lower(F.regexp_extract(_name(path), r"^.+(\.[^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("unknown"))


def exclusion(path: Column) -> Column:
    """The first reason that holds: vendor, lockfile, generated, test, non_code; empty if the file stays."""

    def reason(p: Column) -> Column:
        folders = F.split(F.lower(p), "/")
        return (
            F.when(F.arrays_overlap(folders, F.array(*map(F.lit, VENDOR_FOLDERS))), "vendor")
            .when(F.lower(_name(p)).isin(*LOCK_FILES), "lockfile")
            .when(p.rlike(GENERATED), "generated")
            .when(F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | p.rlike(TESTS) | p.rlike(TESTS_BY_CASE), "test")
            .when(language(p) == "unknown", "non_code")
            .otherwise("")
        )

    return bound(F.regexp_replace(path, r"\\", "/"), reason)


_REPO = r"^(?:https?://|git@)([^/:]+)[/:]([^/]+)/(.+?)(?:\.git)?/?$"


def repo_parts(url: Column) -> Column:
    """struct(host, owner, name) of an https or git@ address; null parts if it is neither."""
    part = lambda i: F.when(url.rlike(_REPO), F.regexp_extract(url, _REPO, i))
    return F.struct(part(1).alias("host"), part(2).alias("owner"), part(3).alias("name"))


def slug(owner: Column, name: Column) -> Column:
    return F.when(F.coalesce(owner, F.lit("")) != "", F.concat_ws("/", owner, name)).otherwise(name)


def module_name(path: Column) -> Column:
    """Dotted module of a Python path; a package for its __init__.py; null for others and for a root __init__.py."""
    m = F.regexp_replace(F.regexp_replace(path, r"(^|/)__init__\.py$", ""), r"\.py$", "")
    m = F.regexp_replace(m, "/", ".")
    return F.when(path.endswith(".py") & (m != ""), m)
