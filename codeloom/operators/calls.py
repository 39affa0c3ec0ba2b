"""Call sites to call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control words that never name a callee.
CONTROL_WORDS = "if for while return try except catch with else elif".split()


def drop_builtins(calls: DataFrame, builtins: DataFrame) -> DataFrame:
    """Calls without the names in ``builtins(parser, callee_name)``; calls carry ``parser``."""
    return calls.join(builtins, ["parser", "callee_name"], "left_anti")


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges ``service_id, source_id, target_id, line`` from each call to every method it may mean.

    A call means each method of its own service with that plain or full name, itself excepted;
    of several call sites the first line is kept. Repeated sites collapse before the join, so
    what meets a common name is one row per caller, and both aggregations combine map-side.
    """
    sites = (
        calls.where(~F.col("callee_name").isin(CONTROL_WORDS))
        .groupBy("service_id", "caller_id", "callee_name")
        .agg(F.min("line").alias("line"))
    )
    targets = methods.select(
        "service_id",
        F.col("method_id").alias("target_id"),
        F.explode(F.array_distinct(F.array("name", "full_name"))).alias("callee_name"),
    ).where(F.col("callee_name").isNotNull())
    return (
        sites.join(targets, ["service_id", "callee_name"])
        .where(F.col("caller_id") != F.col("target_id"))
        .groupBy("service_id", F.col("caller_id").alias("source_id"), "target_id")
        .agg(F.min("line").alias("line"))
    )


def call_edges(resolved: DataFrame) -> DataFrame:
    """Resolved calls in the layout of the edge table."""
    return resolved.select(
        "source_id",
        "target_id",
        F.lit("method_call").alias("kind"),
        F.create_map(F.lit("line"), F.col("line").cast("string")).alias("metadata"),
    )
