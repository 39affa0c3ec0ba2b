"""Keep tables and indexes current from a stream of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.encoding import EmbeddingModel
from codeloom.operators.keyed import keep_last
from codeloom.plans.index_build import build
from codeloom.settings import Settings
from codeloom.sources.tables import Scratch, Table


def upsert_stream(
    changes: DataFrame,
    table: Table,
    keys: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
) -> StreamingQuery:
    """Apply a stream of row versions to a table: per key the version last in ``order`` stays.

    A micro-batch is first cut to one row per key. Stored versions take part in the choice, so
    a batch that is replayed after a failure, or arrives late, changes nothing it should not.
    ``table`` must be split by columns among ``keys``.
    """

    def apply(batch: DataFrame, _: int) -> None:
        with Scratch(table.spark) as scratch:
            newest = scratch.settle(keep_last(batch.select(*table.schema.names), keys, *order), "newest")
            touched = newest.select(*keys)
            versions = table.rows_of(touched).unionByName(newest)
            table.replace(touched, keep_last(versions, keys, *order))

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rebuild_on_change(
    notices: DataFrame,
    spark: SparkSession,
    path: str,
    settings: Settings,
    model: EmbeddingModel,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Run an incremental build whenever change notices arrive.

    A notice only says that something changed; the build compares the trees with what it
    tracks, so lost or doubled notices do no harm. Without an interval the query stops after
    the notices at hand.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            build(spark, path, settings, model)

    writer = notices.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
