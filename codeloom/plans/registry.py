"""Registry of the queries over the given tables, each with its SQL counterpart.

Documents stand in for source files, embeddings for chunk vectors, line items for call sites
and call edges, events for snapshots of a file tree. Texts in code form are composed by Spark
from table columns, so the work of every query grows with its tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work that is heavy per row (parsing, pattern matching, encoding), dealt out by its key."""
    rows = table(spark, sf, name)
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.columns[0])


def wide_ints(df: DataFrame) -> DataFrame:
    """Integers as bigint, the type the SQL side returns."""
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() == "integer" else F.col(f.name)
            for f in df.schema
        ]
    )
