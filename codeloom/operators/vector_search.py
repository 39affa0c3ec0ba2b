"""Nearest chunks to a query vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import vectors


def _batch_matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as one matrix."""
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError("vectors of one index must share one dimension")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), lengths["min"]).astype(np.float64)


def cosine_scores(
    vectors_df: DataFrame,
    query: Sequence[float],
    id_cols: Sequence[str],
    vector_col: str = "embedding",
    epsilon: float = 0.0,
    keep: int | None = None,
) -> DataFrame:
    """Cosine of every vector with ``query`` beside ``id_cols``; one matrix product per batch.

    With ``epsilon`` the denominator is ``|q||v| + epsilon``, otherwise a zero row scores 0.
    With ``keep`` a task hands on only its best ``keep`` rows (ties by ``id_cols``).
    """
    target = np.asarray(query, dtype=np.float64)
    length = float(np.linalg.norm(target))
    names = list(id_cols)
    scan = vectors_df.select(*names, vector_col).where(F.col(vector_col).isNotNull())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scan.schema[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = _batch_matrix(batch.column(len(names)))
            scale = length * np.linalg.norm(matrix, axis=1) + epsilon
            scores = (matrix @ target) / np.where(scale > 0, scale, 1.0)
            found = batch.select(names).append_column("score", pa.array(scores))
            if keep is None:
                yield found
                continue
            table = pa.Table.from_batches([found])
            best = table if best is None else pa.concat_tables([best, table])
            order = [("score", "descending"), *((name, "ascending") for name in names)]
            best = best.sort_by(order).slice(0, keep)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return scan.mapInArrow(score, f"{schema}, score double")


def cosine_topk(
    vectors_df: DataFrame,
    query: Sequence[float],
    k: int,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    carry: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` rows nearest to ``query`` as ``(id, *carry, score)``.

    Only id, ``carry`` and vector are read, and each task hands on at most ``k`` rows to the final
    ordered limit. Rows without a vector are left out and a zero query finds nothing.
    """
    if not any(query) or k <= 0:
        scan = vectors_df.select(id_col, *carry, F.lit(0.0).alias("score"))
        return scan.where(F.lit(False))
    scored = cosine_scores(vectors_df, query, [id_col, *carry], vector_col, keep=k)
    return scored.orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def cosine_topk_columns(
    vectors_df: DataFrame,
    query: Column,
    k: int,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Same search with built-in expressions only, for a query vector held in a column."""
    return (
        vectors_df.where(F.col(vector_col).isNotNull())
        .select(id_col, vectors.cosine(F.col(vector_col), query).alias("score"))
        .orderBy(F.desc("score"), F.asc(id_col))
        .limit(k)
    )


def cosine_topk_per_group(
    vectors_df: DataFrame,
    query: Sequence[float],
    k: int,
    group_col: str,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    groups: Sequence | None = None,
) -> DataFrame:
    """The ``k`` nearest rows of each group (service), scored as the store-side search does.

    Spark trims every task to ``k`` rows per group before the shuffle (window group limit),
    so one very large group sends no more rows than any other.
    """
    rows = vectors_df.where(F.col(vector_col).isNotNull())
    if groups is not None:
        rows = rows.where(F.col(group_col).isin(list(groups)))
    scored = cosine_scores(rows, query, [group_col, id_col], vector_col, epsilon=1e-10)
    order = Window.partitionBy(group_col).orderBy(F.desc("score"), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hydrate(hits: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Full chunk rows of the hits. ``hits`` is a top-k result, so its size bound is ``k`` rows."""
    return chunks.join(F.broadcast(hits), id_col, "inner")


def best_of(*results: DataFrame, id_col: str = "chunk_id", carry: Sequence[str] = ()) -> DataFrame:
    """Union of several searches, highest score per id; ``carry`` are columns the id decides."""
    union = results[0]
    for other in results[1:]:
        union = union.unionByName(other)
    return union.groupBy(id_col, *carry).agg(F.max("score").alias("score"))
