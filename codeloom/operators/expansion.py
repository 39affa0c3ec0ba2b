"""Spread hit scores along call edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators.overlap import overlap_join

Settle = Callable[[DataFrame, str], DataFrame]
#: The rows of a table that belong to the given files, ``(repo_id, file_path)``.
Lookup = Callable[[DataFrame], DataFrame]
FILE_KEY = ("repo_id", "file_path")


def unsettled(rows: DataFrame, name: str) -> DataFrame:
    """Leave an intermediate result in the plan instead of writing it."""
    return rows


CALLER_WEIGHT = 0.6
CALLEE_WEIGHT = 0.5
SCORE_FLOOR = 0.15


def neighbours(edges: DataFrame, kind: str = "method_call") -> DataFrame:
    """``node, next, weight``: callers and callees of every method."""
    calls = edges.where(F.col("kind") == kind)
    callers = calls.select(
        F.col("target_id").alias("node"), F.col("source_id").alias("next"),
        F.lit(CALLER_WEIGHT).alias("weight"),
    )
    callees = calls.select(
        F.col("source_id").alias("node"), F.col("target_id").alias("next"),
        F.lit(CALLEE_WEIGHT).alias("weight"),
    )
    return callers.unionByName(callees)


@dataclass
class Spread:
    """Scores of the methods reached, and the callees that no method node stands for."""

    scores: DataFrame
    unknown: DataFrame


def spread(
    seeds: DataFrame,
    edges: DataFrame,
    known: DataFrame,
    depth: int = 2,
    floor: float = SCORE_FLOOR,
    settle: Settle = unsettled,
) -> Spread:
    """Follow call edges from ``seeds(method_id, score)`` for ``depth`` hops.

    Every hop multiplies by the edge's weight and drops what falls below ``floor``; a method
    keeps its best score over all paths, and seeds are left out. Only methods in
    ``known(method_id)`` carry the spread on. Each level is reduced to one row per method
    before it is joined again, so paths never multiply. With ``settle`` a level is written
    before it is joined: Spark then knows its size and scans the edges against a broadcast
    level while that is small, and shuffles when a hub makes it large.
    """
    around = neighbours(edges)
    known = known.select("method_id")
    level = settle(seeds.groupBy("method_id").agg(F.max("score").alias("score")), "seeds")
    start = level.select("method_id")
    reached, unknown = level.where(F.lit(False)), start.where(F.lit(False))
    for hop in range(depth):
        onward = level.join(around, level["method_id"] == around["node"]).select(
            F.col("next").alias("method_id"),
            (F.col("score") * F.col("weight")).alias("score"),
            (F.col("weight") == CALLEE_WEIGHT).alias("callee"),
        )
        step = settle(
            onward.where(F.col("score") >= floor)
            .groupBy("method_id")
            .agg(F.max("score").alias("score"), F.max("callee").alias("callee")),
            f"step{hop}",
        )
        level = settle(known.join(step.drop("callee"), "method_id"), f"level{hop}")
        missing = step.where(F.col("callee")).join(level, "method_id", "left_anti")
        reached = reached.unionByName(level)
        unknown = unknown.unionByName(missing.select("method_id"))
    best = reached.groupBy("method_id").agg(F.max("score").alias("score"))
    return Spread(best.join(start, "method_id", "left_anti"), unknown.distinct())


def spread_scores(
    seeds: DataFrame,
    edges: DataFrame,
    known: DataFrame,
    depth: int = 2,
    floor: float = SCORE_FLOOR,
    settle: Settle = unsettled,
) -> DataFrame:
    """The scores of :func:`spread` as ``method_id, score``."""
    return spread(seeds, edges, known, depth, floor, settle).scores


def matching_methods(hits: DataFrame, methods: DataFrame) -> DataFrame:
    """Pairs of hit and method whose lines overlap in the same file of the same repository."""
    spans = methods.select(
        F.col("service_id").alias("repo_id"), "file_path", "method_id", "line_start", "line_end"
    )
    return overlap_join(hits, spans, ["repo_id", "file_path"])


@dataclass
class Expansion:
    """Bonus chunks, and one row with the methods and files the expansion had to skip."""

    bonus: DataFrame
    gaps: DataFrame


def expand_hits(
    hits: DataFrame,
    methods: DataFrame,
    edges: DataFrame,
    files: DataFrame,
    depth: int = 2,
    max_chunks: int = 30,
    settle: Settle = unsettled,
    methods_of: Lookup | None = None,
    files_of: Lookup | None = None,
) -> Expansion:
    """Chunks for the methods around the hits, best ``max_chunks``.

    ``files(repo_id, file_path, content)`` supplies the text; a method whose file is gone
    yields nothing. ``methods_of`` and ``files_of`` read the methods and texts of a few files
    where the tables can be pruned; without them the whole tables are scanned.
    """
    file_key = list(FILE_KEY)
    near = methods_of(hits.select(*file_key).distinct()) if methods_of else methods
    seeds = matching_methods(hits, near).select("method_id", "score")
    found = spread(seeds, edges, methods, depth, settle=settle)
    nodes = methods.withColumnRenamed("service_id", "repo_id")
    reached = settle(nodes.join(found.scores, "method_id"), "reached")
    # Files are unique by their key, so an inner join tests for the file; unlike a semi join it
    # lets Spark broadcast the reached methods instead of moving the file table.
    present = settle(reached.join(files.select(*file_key), file_key), "present")
    bonus = present.orderBy(F.desc("score"), F.asc("method_id")).limit(max_chunks)
    if files_of:
        bonus = settle(bonus, "best_bonus")
    texts = files_of(bonus.select(*file_key).distinct()) if files_of else files
    text = F.broadcast(bonus).join(
        texts.select(*file_key, F.col("content").alias("_file")), file_key
    )
    chunks = text.select(
        F.col("method_id").alias("chunk_id"),
        "score",
        "file_path",
        F.col("line_start").alias("start_line"),
        F.col("line_end").alias("end_line"),
        tx.text_range(F.col("_file"), F.col("line_start"), F.col("line_end")).alias("content"),
        "repo_id",
        F.col("name").alias("symbol"),
        F.lit("method").alias("chunk_type"),
        F.lit("python").alias("language"),
    )
    lost = reached.join(present, "method_id", "left_anti").select(F.lit("files").alias("what"))
    counted = lost.unionByName(found.unknown.select(F.lit("methods").alias("what"))).agg(
        F.count(F.when(F.col("what") == "methods", 1)).alias("skipped_methods"),
        F.count(F.when(F.col("what") == "files", 1)).alias("skipped_files"),
    )
    return Expansion(chunks, counted)
