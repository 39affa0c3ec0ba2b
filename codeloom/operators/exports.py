"""Graph exports, one line or object per row so that a large graph is written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import methods_per_service
from codeloom.operators.keyed import keep_last

# Arrow of each edge kind in the diagram; others get a plain arrow.
ARROWS = {
    "http_call": "-- HTTP -->",
    "rpc_call": "-- RPC/Edge Function -->",
    "db_read": "-- Reads -->",
    "db_write": "-- Writes -->",
    "queue_publish": "-- Publishes -->",
    "queue_consume": "-- Consumes -->",
    "library_dependency": "-. Import/Library .->",
}
NOT_DRAWN = ("method_call", "flow_step", "git_coupling", "flow_link")
NOT_EXPORTED = ("method_call", "flow_step")

# Shape of a node and style of its class, in section order.
SECTIONS = (
    ("service", "  %% Services", '["', '"]', "fill:#161b22,stroke:#39d353,stroke-width:2px,color:#c9d1d9;"),
    ("datastore", "  %% Data Stores", '[("', '")]', "fill:#161b22,stroke:#ffa657,stroke-width:2px,color:#c9d1d9;"),
    ("queue", "  %% Queues", '>"', '"]', "fill:#161b22,stroke:#bc8cff,stroke-width:2px,color:#c9d1d9;"),
)


def diagram_id(node_id: Column) -> Column:
    return F.translate(node_id, "-.:", "___")


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Diagram source as ``section, sort_key, line``; ordered by these it is the file.

    ``nodes`` has ``node_id, node_type, name``. Edges that look alike after cleaning the ids
    are drawn once.
    """
    spark = nodes.sparkSession
    fixed, parts = [(0, "", "graph LR")], []
    drawn = nodes.select(
        "node_type",
        diagram_id(F.col("node_id")).alias("id"),
        F.replace(F.coalesce("name", "node_id"), F.lit('"'), F.lit("'")).alias("label"),
    )
    for at, (kind, title, left, right, style) in enumerate(SECTIONS, 1):
        mine = drawn.where(F.col("node_type") == kind)
        if kind == "service":
            fixed.append((10 * at, "", title))
        else:
            parts.append(
                mine.limit(1).select(
                    F.lit(10 * at).alias("section"), F.lit("").alias("sort_key"), F.lit(title).alias("line")
                )
            )
        parts.append(
            mine.select(
                F.lit(10 * at + 1).alias("section"),
                F.col("id").alias("sort_key"),
                F.concat(F.lit("  "), "id", F.lit(left), "label", F.lit(right)).alias("line"),
            )
        )
        parts.append(
            mine.select(
                F.lit(60 + at).alias("section"),
                F.col("id").alias("sort_key"),
                F.concat(F.lit("  class "), "id", F.lit(f" {kind}")).alias("line"),
            )
        )
        fixed.append((50, f"{at}", f"  classDef {kind} {style}"))
    fixed += [(40, "", "  %% Edges"), (50, "", "  %% Styling")]
    arrow = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for pair in ARROWS.items() for x in pair]), F.col("kind")),
        F.lit("-->"),
    )
    links = (
        edges.where(~F.col("kind").isin(list(NOT_DRAWN)))
        .select(
            diagram_id(F.col("source_id")).alias("s"), diagram_id(F.col("target_id")).alias("t"), "kind"
        )
        .distinct()
        .select(
            F.lit(41).alias("section"),
            F.concat_ws("|", "s", "t", "kind").alias("sort_key"),
            F.concat(F.lit("  "), "s", F.lit(" "), arrow, F.lit(" "), "t").alias("line"),
        )
    )
    out = spark.createDataFrame(fixed, "section int, sort_key string, line string")
    for part in [*parts, links]:
        out = out.unionByName(part)
    return out


def json_objects(
    services: DataFrame,
    resources: DataFrame,
    flows: DataFrame,
    methods: DataFrame,
    edges: DataFrame,
) -> DataFrame:
    """Service-level graph as ``part`` (nodes or edges), ``id`` and one JSON object per row.

    Services carry their method count, every flow adds a ``flow_link`` edge from its service,
    call and step edges stay out, and a triple is exported once.
    """
    counts = methods_per_service(services, methods)
    service_rows = services.join(counts, "service_id").select(
        F.col("service_id").alias("id"),
        F.to_json(
            F.struct(
                F.col("service_id").alias("id"),
                F.lit("service").alias("type"),
                F.coalesce("name", "service_id").alias("label"),
                F.coalesce("language", F.lit("")).alias("language"),
                F.coalesce("service_type", F.lit("api")).alias("service_type"),
                F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
                "method_count",
            )
        ).alias("object"),
    )
    resource_rows = resources.select(
        F.col("node_id").alias("id"),
        F.to_json(
            F.struct(
                F.col("node_id").alias("id"),
                F.col("node_type").alias("type"),
                F.coalesce("name", "node_id").alias("label"),
                F.coalesce("kind", F.lit("")).alias("kind"),
            )
        ).alias("object"),
    )
    flow_rows = flows.select(
        F.col("flow_id").alias("id"),
        F.to_json(
            F.struct(
                F.col("flow_id").alias("id"),
                F.lit("flow").alias("type"),
                F.coalesce("name", "flow_id").alias("label"),
                F.coalesce("service_id", F.lit("")).alias("service_id"),
                F.coalesce("step_count", F.lit(0)).alias("step_count"),
            )
        ).alias("object"),
    )
    nodes = service_rows.unionByName(resource_rows).unionByName(flow_rows)
    kept = edges.where(~F.col("kind").isin(list(NOT_EXPORTED)))
    links = flows.select(
        F.coalesce("service_id", F.lit("")).alias("source_id"),
        F.col("flow_id").alias("target_id"),
        F.lit("flow_link").alias("kind"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    once = keep_last(
        kept.withColumn("_meta", F.to_json("metadata")).drop("metadata"),
        ["source_id", "target_id", "kind"],
        "_meta",
    ).withColumn("metadata", F.from_json("_meta", "map<string,string>")).drop("_meta")
    edge_rows = once.unionByName(links).select(
        F.concat_ws("|", "source_id", "target_id", "kind").alias("id"),
        F.to_json(
            F.struct(
                F.col("source_id").alias("source"),
                F.col("target_id").alias("target"),
                "kind",
                F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("meta"),
            )
        ).alias("object"),
    )
    return nodes.select(F.lit("nodes").alias("part"), "*").unionByName(
        edge_rows.select(F.lit("edges").alias("part"), "*")
    )
