"""Change detection between the tracked and the current state of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MTIME_TOLERANCE = 0.001


def file_changes(
    tracked: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("repo_id", "file_path")
) -> DataFrame:
    """``keys, change_type`` for added, modified and deleted files; unchanged ones are absent."""
    before = tracked.select(*keys, F.col("mtime").alias("_before"))
    after = current.select(*keys, F.col("mtime").alias("_after"))
    kind = (
        F.when(F.col("_before").isNull(), "added")
        .when(F.col("_after").isNull(), "deleted")
        .when(F.abs(F.col("_after") - F.col("_before")) > MTIME_TOLERANCE, "modified")
    )
    joined = before.join(after, list(keys), "full_outer")
    return joined.select(*keys, kind.alias("change_type")).where(F.col("change_type").isNotNull())


def changed_repos(changes: DataFrame) -> DataFrame:
    return changes.select("repo_id").distinct()


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: how many files were added, modified and deleted, in how many repositories."""
    def n(kind: str):
        return F.count(F.when(F.col("change_type") == kind, 1)).alias(f"files_{kind}")

    return changes.agg(
        n("added"), n("modified"), n("deleted"), F.countDistinct("repo_id").alias("repos_changed")
    )
