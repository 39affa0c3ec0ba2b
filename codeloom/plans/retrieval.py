"""Answer a question from an index: search, expand, merge, rank, format."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import expansion, formatting, graph, merging, ranking, vector_search
from codeloom.operators.encoding import EmbeddingModel, query_prompt
from codeloom.operators.keyed import keep_best
from codeloom.plans.index_build import Index, build
from codeloom.settings import Settings
from codeloom.sources.tables import Scratch

FILES_MISSING_LIMIT = 3
METHODS_SKIPPED_LIMIT = 5


@dataclass
class Diagnostics:
    """Counters and timings of one search."""

    skipped_files: int = 0
    skipped_methods: int = 0
    timing: dict[str, float] = field(default_factory=dict)
    blocks: list[Row] = field(default_factory=list)
    ranking: ranking.Ranking | None = None

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timing[name] = time.perf_counter() - began

    def warning(self) -> str | None:
        parts = []
        if self.skipped_files >= FILES_MISSING_LIMIT:
            parts.append(f"{self.skipped_files} files missing (index may be stale)")
        if self.skipped_methods >= METHODS_SKIPPED_LIMIT:
            parts.append(f"{self.skipped_methods} methods skipped")
        return "; ".join(parts) or None


@dataclass
class DebugResult:
    output: str
    diagnostics: Diagnostics
    error: str | None = None


def nearest(
    chunks: DataFrame, vectors: list[list[float]], top_k: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Ids and scores of the best chunks over all query vectors; at most ``top_k`` per vector."""
    found = [vector_search.cosine_topk(chunks, vector, top_k, carry=carry) for vector in vectors]
    return found[0] if len(found) == 1 else vector_search.best_of(*found, carry=carry)


def search_hits(
    chunks: DataFrame, vectors: list[list[float]], top_k: int
) -> DataFrame:
    """The rows of :func:`nearest` with all columns of their chunks."""
    return vector_search.hydrate(nearest(chunks, vectors, top_k), chunks.drop("embedding"))


def result_blocks(
    hits: DataFrame,
    bonus: DataFrame,
    files: DataFrame,
    top_k: int,
    settle: expansion.Settle = expansion.unsettled,
    files_of: expansion.Lookup | None = None,
) -> DataFrame:
    """Hits and bonus chunks merged per file, covered blocks dropped, at most ``top_k`` left.

    Input is bounded by the search limits, so the arrival order is one small window. The text
    of a block that grew is cut from the file again, not glued from its parts; ``files_of``
    reads only the files of such blocks.
    """
    columns = [
        "chunk_id", "score", "repo_id", "file_path", "start_line", "end_line",
        "content", "symbol", "chunk_type", "language",
    ]
    both = hits.select(*columns).unionByName(bonus.select(*columns))
    ordered = merging.with_ordinal(keep_best(both, ["chunk_id"]))
    file_cols = ("repo_id", "file_path")
    merged = merging.merge_neighbours(
        ordered, file_cols=file_cols, carry=("symbol", "chunk_type", "language", "content")
    )
    labelled = merging.found_by(merging.drop_covered(merged, file_cols), bonus)
    best = settle(merging.quota_topk(labelled, top_k), "best")
    grown_files = best.where(F.size("part_ids") > 1).select(*file_cols).distinct()
    text = (files_of(grown_files) if files_of else files).select(*file_cols, F.col("content").alias("_file"))
    # The semi join reduces the file table where it is scanned; an outer join could not.
    needed = text.join(F.broadcast(grown_files), list(file_cols), "left_semi")
    whole = best.join(needed, list(file_cols), "left")
    grown = tx.text_range(F.col("_file"), F.col("start_line"), F.col("end_line"))
    ranked = merging.with_ordinal(
        whole.withColumn("content", F.when(F.size("part_ids") > 1, F.coalesce(grown, "content")).otherwise(F.col("content")))
        .withColumn("chunk_id", F.array_join("part_ids", "+"))
        .drop("_file", "ordinal"),
        "chunk_id",
    )
    return ranked.withColumnRenamed("ordinal", "rank")


def search_blocks(
    index: Index,
    vectors: list[list[float]],
    top_k: int,
    diagnostics: Diagnostics,
    scratch: Scratch,
) -> DataFrame:
    """Ranked blocks of a search; hits, bonus chunks and blocks are settled one after another.

    The vectors are scanned whole. Texts, and the methods that overlap a hit, are then read
    from the buckets of the few files found, so their cost doesn't grow with the index.
    """
    settings = index.settings

    def methods_of(keys: DataFrame) -> DataFrame:
        return index.methods.rows_of(keys.withColumnRenamed("repo_id", "service_id"))

    files, methods, edges = index.files.read(), index.methods.read(), index.call_edges()
    with diagnostics.phase("embedding_search"):
        found = scratch.settle(nearest(index.chunks.read(), vectors, top_k, expansion.FILE_KEY), "found")
        near = index.chunks.rows_of(found.select(*expansion.FILE_KEY).distinct()).drop("embedding")
        hits = scratch.settle(vector_search.hydrate(found.select("chunk_id", "score"), near), "hits")
    with diagnostics.phase("graph_expansion"):
        around = expansion.expand_hits(
            hits, methods, edges, files, settings.expand_depth, settings.expand_max_chunks, scratch.settle,
            methods_of, index.files.rows_of,
        )
        bonus = scratch.settle(around.bonus, "bonus")
        gaps = around.gaps.head()
        diagnostics.skipped_methods, diagnostics.skipped_files = gaps
    with diagnostics.phase("merge_dedup"):
        blocks = result_blocks(hits, bonus, files, top_k, scratch.settle, index.files.rows_of)
        return scratch.settle(blocks, "blocks")


def refresh(
    spark: SparkSession, path: str, settings: Settings, model: EmbeddingModel
) -> None:
    """Build what is missing or stale, unless the last build is only seconds old."""
    meta = Index(spark, path, settings).meta()
    last = meta.get("last_build_at")
    if last is None:
        build(spark, path, settings, model, rebuild=True)
    elif time.time() - float(last) >= settings.fresh_seconds:
        build(spark, path, settings, model)


def retrieve_debug(
    spark: SparkSession,
    path: str,
    settings: Settings,
    model: EmbeddingModel,
    query: str,
    top_k: int = 50,
    ask: ranking.Ask | None = None,
    expand: bool = False,
) -> DebugResult:
    """Search with all internals: blocks before ranking, prompts, timings, warnings."""
    diagnostics = Diagnostics()
    try:
        refresh(spark, path, settings, model)
        with Scratch(spark) as scratch:
            output = _answer(
                Index(spark, path, settings), model, query, top_k, ask, expand, diagnostics, scratch
            )
    except Exception as error:
        return DebugResult("", diagnostics, f"{type(error).__name__}: {error}")
    if not output:
        return DebugResult("", diagnostics, "No relevant code found for the given query.")
    warning = diagnostics.warning()
    return DebugResult(f"[warnings: {warning}]\n\n{output}" if warning else output, diagnostics)


def _answer(
    index: Index,
    model: EmbeddingModel,
    query: str,
    top_k: int,
    ask: ranking.Ask | None,
    expand: bool,
    diagnostics: Diagnostics,
    scratch: Scratch,
) -> str:
    asked = ranking.expand_query(query, ask) if expand else [query]
    texts = [query_prompt(model.name, text) for text in asked]
    blocks = search_blocks(index, model.encode(texts, "query"), top_k, diagnostics, scratch)
    # A result has at most top_k blocks; these, and the prompt made of them, fit the driver.
    diagnostics.blocks = blocks.orderBy("rank").collect()
    with diagnostics.phase("rerank"):
        if ask is not None and index.settings.rerank:
            notes = graph.annotate_hits(
                blocks, index.methods.read(), index.call_edges(), index.flows.read(), scratch.settle
            )
            located = _located(index, blocks).withColumn("file_path", F.col("path"))
            entries = ranking.prompt_entries(located.join(notes, "chunk_id", "left"))
            listed = [row.entry for row in entries.orderBy("rank").collect()]
            diagnostics.ranking = ranking.rank_entries(query, listed, ask)
            blocks = ranking.reorder(blocks, diagnostics.ranking.order)
    with diagnostics.phase("format"):
        rendered = formatting.render_blocks(_located(index, blocks))
        return formatting.format_results(rendered).head().output


def _located(index: Index, blocks: DataFrame) -> DataFrame:
    """Blocks with ``path``, absolute below the repository's root."""
    roots = index.services.read().select(F.col("service_id").alias("repo_id"), F.col("repo").alias("root"))
    return blocks.join(roots, "repo_id", "left").withColumn(
        "path", tx.absolute_path(F.col("file_path"), F.col("root"))
    )


def retrieve(
    spark: SparkSession,
    path: str,
    settings: Settings,
    model: EmbeddingModel,
    query: str,
    top_k: int = 50,
    ask: ranking.Ask | None = None,
) -> str:
    """Formatted blocks for a question; a failure comes back as a text starting with 'Error:'."""
    result = retrieve_debug(spark, path, settings, model, query, top_k, ask)
    if result.error is None:
        return result.output
    return result.error if result.error.startswith("No ") else f"Error: {result.error}"
