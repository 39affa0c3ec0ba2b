"""Look-ups, paths and summaries over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.expansion import Settle, matching_methods, unsettled


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing edges of ``nodes(source_id)``."""
    return edges.join(nodes.select("source_id"), "source_id", "left_semi")


def dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Incoming edges of ``nodes(target_id)``."""
    return edges.join(nodes.select("target_id"), "target_id", "left_semi")


def callers(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Calling method of every ``method_call`` edge, with its node; edges from anything that
    is no method are dropped."""
    calls = edges.where(F.col("kind") == "method_call")
    return calls.select(
        F.col("target_id").alias("callee_id"), F.col("source_id").alias("method_id")
    ).join(methods, "method_id")


def degrees(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """``method_id, callers, callees`` per method; callers count methods only."""
    calls = edges.where(F.col("kind") == "method_call")
    ids = methods.select("method_id")
    incoming = (
        calls.join(ids, calls["source_id"] == ids["method_id"], "left_semi")
        .groupBy(F.col("target_id").alias("method_id"))
        .agg(F.count(F.lit(1)).alias("callers"))
    )
    outgoing = calls.groupBy(F.col("source_id").alias("method_id")).agg(
        F.count(F.lit(1)).alias("callees")
    )
    return (
        ids.join(incoming, "method_id", "left")
        .join(outgoing, "method_id", "left")
        .select(
            "method_id",
            F.coalesce("callers", F.lit(0)).alias("callers"),
            F.coalesce("callees", F.lit(0)).alias("callees"),
        )
    )


def call_paths(
    edges: DataFrame, source: str, target: str, max_nodes: int = 5, settle: Settle = unsettled
) -> DataFrame:
    """All simple call paths from ``source`` to ``target`` with at most ``max_nodes`` nodes.

    ``path`` is an array of ids; ``edges`` holds each call once. First the nodes that can still
    reach the target within the hops left are found backwards, one distinct set per distance;
    a path then only grows into those, so dead ends are never carried along. Settled, every set
    and every level of paths is computed once, and the edges are only scanned against it.
    """
    spark = edges.sparkSession
    if source == target:
        return spark.range(1).select(F.array(F.lit(source)).alias("path"))
    calls = edges.where(
        (F.col("kind") == "method_call") & (F.col("source_id") != target) & (F.col("target_id") != source)
    ).select("source_id", "target_id")
    at_target = spark.range(1).select(F.lit(target).alias("node"))
    useful = [at_target]
    for distance in range(1, max_nodes - 1):
        before = calls.join(useful[-1], calls["target_id"] == F.col("node"), "left_semi")
        nodes = before.select(F.col("source_id").alias("node")).unionByName(at_target).distinct()
        useful.append(settle(nodes, f"useful{distance}"))
    paths = spark.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(source).alias("last"))
    found = paths.select("path").where(F.lit(False))
    for hop, open_nodes in enumerate(reversed(useful)):
        steps = calls.join(open_nodes, calls["target_id"] == F.col("node"), "left_semi")
        onward = steps.join(paths, paths["last"] == steps["source_id"]).where(
            ~F.array_contains("path", F.col("target_id"))
        )
        grown = settle(
            onward.select(
                F.concat("path", F.array("target_id")).alias("path"), F.col("target_id").alias("last")
            ),
            f"paths{hop}",
        )
        found = found.unionByName(grown.where(F.col("last") == target).select("path"))
        paths = grown.where(F.col("last") != target)
    return found


def flows_of_methods(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows that contain a method as a step: ``method_id, flow_id, flow_name, step, entry``."""
    steps = edges.where(F.col("kind") == "flow_step").select(
        F.col("target_id").alias("method_id"),
        F.col("source_id").alias("flow_id"),
        F.coalesce(F.try_element_at("metadata", F.lit("step")).cast("int"), F.lit(0)).alias("step"),
    )
    names = flows.select(
        "flow_id",
        F.coalesce("name", F.lit("")).alias("flow_name"),
        F.coalesce("entry_method_id", F.lit("")).alias("entry_method_id"),
    )
    return steps.join(names, "flow_id")


def annotate_hits(
    hits: DataFrame,
    methods: DataFrame,
    edges: DataFrame,
    flows: DataFrame | None = None,
    settle: Settle = unsettled,
) -> DataFrame:
    """Per hit the callers and callees of all methods it overlaps, and the first flow.

    Hits without a method are absent. Degrees are needed for the matched methods only, so
    the edges are cut down to those before they are counted; settled, the few matched methods
    are broadcast to the edges and the few edges left to the methods.
    """
    pairs = settle(matching_methods(hits, methods).select("chunk_id", "method_id"), "matched")
    wanted = pairs.select("method_id").distinct()
    calls = edges.where(F.col("kind") == "method_call").select("source_id", "target_id")
    near = settle(
        calls.join(wanted, calls["target_id"] == wanted["method_id"], "left_semi"), "incoming"
    )
    ids = methods.select(F.col("method_id").alias("source_id"))
    incoming = (
        ids.join(near, "source_id")
        .groupBy(F.col("target_id").alias("method_id"))
        .agg(F.count(F.lit(1)).alias("_in"))
    )
    outgoing = (
        calls.join(wanted, calls["source_id"] == wanted["method_id"], "left_semi")
        .groupBy(F.col("source_id").alias("method_id"))
        .agg(F.count(F.lit(1)).alias("_out"))
    )
    counted = pairs.join(incoming, "method_id", "left").join(outgoing, "method_id", "left")
    if flows is None:
        counted = counted.withColumn("_flow", F.lit(None).cast("string"))
    else:
        first = (
            flows_of_methods(edges, flows)
            .where(F.col("flow_name") != "")
            .groupBy("method_id")
            .agg(F.min_by("flow_name", F.struct("step", "flow_id")).alias("_flow"))
        )
        counted = counted.join(first, "method_id", "left")
    return counted.groupBy("chunk_id").agg(
        F.sum(F.coalesce("_in", F.lit(0))).alias("callers"),
        F.sum(F.coalesce("_out", F.lit(0))).alias("callees"),
        F.min_by("_flow", F.when(F.col("_flow").isNotNull(), F.col("method_id"))).alias("flow"),
    )


def node_summary(**tables: DataFrame) -> DataFrame:
    """``node_type, count`` over the given node tables; each is counted where it lies."""
    counts = [
        rows.agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("node_type"), "count")
        for kind, rows in tables.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def methods_per_service(services: DataFrame, methods: DataFrame) -> DataFrame:
    """Method count of every service, 0 where it has none."""
    counted = methods.groupBy("service_id").agg(F.count(F.lit(1)).alias("_n"))
    return services.select("service_id").join(counted, "service_id", "left").select(
        "service_id", F.coalesce("_n", F.lit(0)).alias("method_count")
    )
