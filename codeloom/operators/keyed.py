"""Keep-one-per-key operators and table mutations by key.

All of them are aggregations with a map-side half, never a window over the key: a key that
holds a third of the rows reaches its reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    if not values:
        return rows.distinct()
    best = F.max_by(F.struct(*values), order).alias("_row")
    return rows.groupBy(*keys).agg(best).select(
        *keys, *[F.col(f"_row.{v}").alias(v) for v in values]
    ).select(*rows.columns)


def keep_last(rows: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The row of each key that is last in ``order`` (an upsert's outcome)."""
    return _pick(rows, keys, F.struct(*order))


def keep_best(
    rows: DataFrame, keys: Sequence[str], score: str = "score", ordinal: str | None = None
) -> DataFrame:
    """The highest score of each key; the earlier row (lower ordinal) wins a tie."""
    order = [F.col(score)] + ([-F.col(ordinal)] if ordinal else [])
    return _pick(rows, keys, F.struct(*order))


#: Rows a task holds while it combines texts by key.
COMBINED_ROWS = 100_000


def largest_text(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value`` with the largest text ``value`` (in byte order) of each key; all are strings.

    Spark sorts all rows of a task before it aggregates texts. Each task first combines its
    rows by key in Arrow, a bounded number at a time, so that only the rest is sorted.
    """
    names = [*keys, value]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= COMBINED_ROWS:
                yield from combined(held)
                held, size = [], 0
        if held:
            yield from combined(held)

    def combined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        best = pa.Table.from_batches(batches).group_by(list(keys)).aggregate([(value, "max")])
        return best.rename_columns(names).to_batches()

    layout = ", ".join(f"`{n}` string" for n in names)
    few = rows.select(*names).mapInArrow(combine, layout)
    return few.groupBy(*keys).agg(F.max(value).alias(value))


def upsert(
    table: DataFrame, changes: DataFrame, keys: Sequence[str], *order: str | Column
) -> DataFrame:
    """Table after replacing rows by key; among changes of one key the last in ``order`` wins."""
    newest = keep_last(changes, keys, *order) if order else changes
    newest = newest.select(*table.columns)
    return table.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def delete_keys(table: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table without the rows whose key occurs in ``doomed``."""
    return table.join(doomed.select(*keys), list(keys), "left_anti")


def delete_service(
    services: DataFrame, methods: DataFrame, edges: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph tables without the services in ``doomed(service_id)``.

    Goes: the service rows, their methods and every edge that leaves them or one of their
    methods. Stays: incoming edges and shared datastore, queue and flow nodes. The owner of
    an edge is the text before ``::``, compared exactly, so no character acts as a wildcard.
    """
    owner = F.substring_index("source_id", "::", 1)
    gone = doomed.select("service_id").distinct()
    return (
        services.join(gone, "service_id", "left_anti"),
        methods.join(gone, "service_id", "left_anti"),
        edges.withColumn("service_id", owner).join(gone, "service_id", "left_anti").drop("service_id"),
    )
