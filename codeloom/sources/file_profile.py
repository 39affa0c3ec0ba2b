"""Which files of a listing are indexed: folders, suffix, size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx

# Folders that are never indexed.
SKIP_DIRS = (
    ".git __pycache__ node_modules venv env .venv tests __tests__ .pytest_cache dist build "
    "coverage .tox .next .nuxt target bin obj .svelte-kit .cache out .turbo .vercel "
    "storybook-static .storybook .codeloom"
).split()

# Indexed suffixes and their language.
SUFFIX_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".jsx": "javascript",
    ".java": "java",
    ".go": "go",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "csharp",
    ".rs": "rust",
    ".c": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".h": "c",
    ".hh": "cpp",
    ".hpp": "cpp",
    ".hxx": "cpp",
    ".md": "markdown",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".json": "json",
}

# Suffixes and manifests the service graph reads, and folders it skips.
SERVICE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rb")
SERVICE_SKIP_DIRS = (
    ".git __pycache__ node_modules venv env .venv tests .pytest_cache dist build .next .nuxt "
    "target bin obj coverage .tox"
).split()

# Files that tell a project's language, in order of precedence.
LANGUAGE_MARKERS = (
    ("typescript", ("package.json", "tsconfig.json")),
    ("python", ("requirements.txt", "pyproject.toml", "Pipfile", "setup.py")),
    ("go", ("go.mod",)),
    ("java", ("pom.xml", "build.gradle")),
    ("rust", ("Cargo.toml",)),
)


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def in_skipped_dir(path: Column, skip_dirs: Iterable[str]) -> Column:
    return F.arrays_overlap(_parts(path), F.array(*[F.lit(d) for d in skip_dirs]))


def in_hidden_dir(path: Column) -> Column:
    """Some folder of the path starts with a dot (the file itself may)."""
    folders = F.slice(_parts(path), F.lit(1), F.size(_parts(path)) - 1)
    return F.exists(folders, lambda part: part.startswith("."))


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), tx.suffix(path))


def indexed_files(
    listing: DataFrame, max_bytes: int = 1024 * 1024, extra_skip_dirs: Iterable[str] = ()
) -> DataFrame:
    """Rows of a listing (``file_path, size``) that are indexed, with their ``language``."""
    path = F.col("file_path")
    return listing.where(
        ~in_skipped_dir(path, [*SKIP_DIRS, *extra_skip_dirs])
        & ~in_hidden_dir(path)
        & (F.col("size") <= max_bytes)
    ).withColumn("language", language_of(path)).where(F.col("language").isNotNull())


def service_files(listing: DataFrame, manifests: Iterable[str]) -> DataFrame:
    """Rows the service graph reads: source files and manifests, tests left out."""
    path = F.col("file_path")
    name = tx.base_name(path)
    return listing.where(
        ~in_skipped_dir(path, SERVICE_SKIP_DIRS)
        & ~in_hidden_dir(path)
        & ~name.startswith("test_")
        & ~name.endswith("_test.py")
        & (name.isin(list(manifests)) | tx.suffix(path).isin(list(SERVICE_SUFFIXES)))
    )


def repo_languages(listing: DataFrame, fallback: str = "python") -> DataFrame:
    """``repo_id, language`` by the marker files in each repository's root."""
    rank = F.lit(None).cast("int")
    for at, (_, names) in enumerate(LANGUAGE_MARKERS):
        rank = F.coalesce(rank, F.when(F.col("file_path").isin(list(names)), F.lit(at)))
    order = F.array(*[F.lit(language) for language, _ in LANGUAGE_MARKERS])
    best = listing.groupBy("repo_id").agg(F.min(rank).alias("_r"))
    return best.select(
        "repo_id", F.coalesce(F.get(order, F.col("_r")), F.lit(fallback)).alias("language")
    )
