"""Files to chunks: overlapping line windows and Python definitions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import text as tx

_SPAN = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("first", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
    ]
)


def window_spans(text: Column, size: int, overlap: int) -> Column:
    """Array of window spans over a text's lines; windows of white space only are dropped.

    Steps advance by ``size - overlap``; a short tail inside the previous window is kept.
    """
    step = max(1, size - overlap)

    def cut(lines: Column) -> Column:
        count = F.size(lines)
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(step))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda at: F.struct(
                at.alias("block"),
                (at + 1).alias("first"),
                F.least(at + size, count).alias("last"),
                tx.join_lines(F.slice(lines, at + 1, F.lit(size))).alias("content"),
            ),
        )

    return F.filter(
        tx.let(tx.split_lines(text), cut), lambda span: tx.has_ink(span["content"])
    )


def line_windows(
    files: DataFrame, size: int = 32, overlap: int = 8, text_col: str = "content"
) -> DataFrame:
    """One row per window: ``block, start_line, end_line, content`` beside the file's columns."""
    keep = [c for c in files.columns if c != text_col]
    spans = tx.exploded(files, keep, window_spans(F.col(text_col), size, overlap), "w")
    return spans.select(
        *keep,
        F.col("w.block").alias("block"),
        F.col("w.first").alias("start_line"),
        F.col("w.last").alias("end_line"),
        F.col("w.content").alias("content"),
    )


def _definitions(source: str | None) -> list[dict]:
    """Classes and outermost functions of one Python text; empty when it does not parse."""
    if source is None:
        return []
    try:
        pending = [(ast.parse(source), ())]
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []
    while pending:
        node, scope = pending.pop()
        inner = scope
        is_class = isinstance(node, ast.ClassDef)
        is_function = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
        if is_class or is_function:
            found.append(
                {
                    "symbol": ".".join((*scope, node.name)),
                    "kind": "class" if is_class else ("method" if scope else "function"),
                    "first": node.lineno,
                    "last": node.end_lineno,
                }
            )
            inner = (*scope, node.name)
        if not is_function:
            children = list(ast.iter_child_nodes(node))
            pending.extend((child, inner) for child in reversed(children))
    return found


@F.pandas_udf(T.ArrayType(_SPAN))
def python_definitions(source: pd.Series) -> pd.Series:
    """Definition spans of Python texts; NULL texts pass through unread."""
    return source.map(_definitions)


# Marked so that the optimizer never copies a call into a second place of a plan.
python_definitions = python_definitions.asNondeterministic()


def extract_chunks(files: DataFrame, size: int = 32, overlap: int = 8) -> DataFrame:
    """Chunks of source files (:data:`codeloom.schema.CHUNKS` columns).

    Python files are cut at definitions, everything else, and Python files without any or
    with syntax errors, into line windows. Only Python text crosses into Python workers.
    """
    spans = files.withColumn(
        "defs", python_definitions(F.when(F.col("language") == "python", F.col("content")))
    )
    cut = tx.let(
        tx.split_lines(F.col("content")),
        lambda lines: F.transform(
            "defs",
            lambda d: F.struct(
                d["symbol"].alias("symbol"),
                d["kind"].alias("kind"),
                d["first"].alias("first"),
                d["last"].alias("last"),
                tx.join_lines(tx.line_range(lines, d["first"], d["last"])).alias("content"),
                F.lit(None).cast("int").alias("block"),
            ),
        ),
    )
    windows = F.transform(
        window_spans(F.col("content"), size, overlap),
        lambda w: F.struct(
            F.lit(None).cast("string").alias("symbol"),
            F.lit("block").alias("kind"),
            w["first"].alias("first"),
            w["last"].alias("last"),
            w["content"].alias("content"),
            w["block"].alias("block"),
        ),
    )
    either = F.when(F.size("defs") > 0, cut).otherwise(windows)
    pieces = tx.exploded(spans, ["repo_id", "file_path", "language"], either, "p")
    tail = F.coalesce(F.col("p.symbol"), F.concat(F.lit("block_"), F.col("p.block").cast("string")))
    return pieces.select(
        F.concat_ws("::", "repo_id", "file_path", tail).alias("chunk_id"),
        "repo_id",
        "file_path",
        F.col("p.first").alias("start_line"),
        F.col("p.last").alias("end_line"),
        F.col("p.content").alias("content"),
        "language",
        F.col("p.kind").alias("chunk_type"),
        F.col("p.symbol").alias("symbol"),
    )
