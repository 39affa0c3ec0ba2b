"""From hits to result blocks: merge neighbours, drop covered blocks, fill the quota."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_MERGED_LINES = 60


def with_ordinal(hits: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Arrival order of a bounded hit list: score descending, then id."""
    return hits.withColumn(
        "ordinal", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id_col)))
    )


def merge_neighbours(
    hits: DataFrame,
    max_lines: int = MAX_MERGED_LINES,
    file_cols: tuple[str, ...] = ("file_path",),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Merge hits of a file that touch or overlap while the block stays within ``max_lines``.

    Input ``file_cols, chunk_id, start_line, end_line, score, ordinal`` plus ``carry`` columns,
    which keep the value of a block's first hit. The length test looks at the next hit's end,
    so a block that is already longer still absorbs what lies inside it.

    A hit that starts beyond everything before it opens an island, which a running maximum
    finds. Which hit a block absorbs depends on the block so far, so a task walks over its hits
    in order and numbers the blocks; it holds one block's range, however many hits a file has.
    """
    order = ("start_line", "ordinal", "end_line", "chunk_id")
    in_file = Window.partitionBy(*file_cols).orderBy(*order)
    reach = F.max("end_line").over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col("start_line") > reach + 1)
    # The window leaves its rows in this order already, so the sort costs nothing.
    walked = (
        hits.select(*file_cols, *order, "score", *carry, opens.alias("_opens"))
        .sortWithinPartitions(*file_cols, *order)
    )
    numbered = walked.mapInArrow(
        _number_blocks(max_lines), T.StructType([*walked.schema.fields, T.StructField("_block", T.LongType())])
    )
    place = F.struct(*order)
    ids = F.array_sort(F.collect_list(F.struct(*order)))
    return (
        numbered.groupBy(*file_cols, "_block")
        .agg(
            F.min("start_line").alias("start_line"),
            F.max("end_line").alias("end_line"),
            F.max("score").alias("score"),
            F.min_by(F.struct("ordinal", *carry), place).alias("_first"),
            F.transform(ids, lambda x: x["chunk_id"]).alias("part_ids"),
        )
        .select(
            *file_cols, "start_line", "end_line", "score",
            F.col("_first.ordinal").alias("ordinal"),
            "part_ids",
            *[F.col(f"_first.{c}").alias(c) for c in carry],
        )
    )


def _number_blocks(max_lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``_block``, the block a hit falls into, counted over the task's ordered hits."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first = last = 0
        for batch in batches:
            numbers = []
            rows = (batch.column(c).to_pylist() for c in ("_opens", "start_line", "end_line"))
            for opens, start, end in zip(*rows):
                if opens or start > last + 1 or end - first + 1 > max_lines:
                    block, first, last = block + 1, start, end
                else:
                    last = max(last, end)
                numbers.append(block)
            yield batch.append_column("_block", pa.array(numbers, pa.int64()))

    return number


def drop_covered(blocks: DataFrame, file_cols: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Drop blocks whose range lies inside another block of the file.

    Sorted by start and then widest first, a block is covered exactly when some earlier one
    reaches at least as far, so a running maximum decides and no pair is ever built. Of equal
    ranges the higher score stays, then the earlier block.
    """
    seen = (
        Window.partitionBy(*file_cols)
        .orderBy("start_line", F.desc("end_line"), F.desc("score"), "ordinal")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.max("end_line").over(seen)
    return (
        blocks.withColumn("_reach", reach)
        .where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end_line")))
        .drop("_reach")
    )


def quota_topk(blocks: DataFrame, k: int, graph_col: str = "graph_only") -> DataFrame:
    """Best ``k`` blocks with up to 30 % of the places kept for blocks found by graph only.

    Applies when there are more than ``k`` blocks; unused places of the other class are not
    refilled. Both classes pass an ordered limit first, so the ranking sees at most 2(k+1) rows.
    """
    order = [F.desc("score"), F.asc("ordinal")]
    graph = blocks.where(F.col(graph_col)).orderBy(*order).limit(k + 1)
    rest = blocks.where(~F.col(graph_col)).orderBy(*order).limit(k + 1)
    short = graph.unionByName(rest)
    everything = Window.partitionBy(F.lit(0))
    per_class = Window.partitionBy(graph_col).orderBy(*order)
    ranked = (
        short.withColumn("_n", F.count(F.lit(1)).over(everything))
        .withColumn("_g", F.count(F.when(F.col(graph_col), 1)).over(everything))
        .withColumn("_r", F.row_number().over(per_class))
    )
    graph_places = F.least(F.col("_g"), F.lit(k * 3 // 10))
    places = F.when(F.col("_n") <= k, F.col("_n")).otherwise(
        F.when(F.col(graph_col), graph_places).otherwise(k - graph_places)
    )
    return ranked.where(F.col("_r") <= places).drop("_n", "_g", "_r")


def found_by(blocks: DataFrame, graph_ids: DataFrame) -> DataFrame:
    """``source`` label (embedding, graph, embedding+graph) and ``graph_only`` per block.

    ``graph_ids(chunk_id)`` are the ids the expansion contributed.
    """
    parts = blocks.select("*", F.posexplode("part_ids").alias("_p", "chunk_id"))
    marked = parts.join(
        graph_ids.select("chunk_id").distinct().withColumn("_g", F.lit(1)), "chunk_id", "left"
    )
    keys = [c for c in blocks.columns if c != "part_ids"]
    from_graph = F.count("_g")
    total = F.count(F.lit(1))
    out = marked.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_p", "chunk_id"))), lambda x: x["chunk_id"]
        ).alias("part_ids"),
        from_graph.alias("_n"),
        total.alias("_t"),
    )
    source = (
        F.when(F.col("_n") == F.col("_t"), "graph")
        .when(F.col("_n") > 0, "embedding+graph")
        .otherwise("embedding")
    )
    return out.select(
        *blocks.columns,
        source.alias("source"),
        (F.col("_n") == F.col("_t")).alias("graph_only"),
    )
