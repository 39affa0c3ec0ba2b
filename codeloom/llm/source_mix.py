"""Mixing sources to target weights by distributed prefix sums over hash-random order.

1. Each source's words are summed. Sources are ranked by name, weighted, and their targets
   found by filling up to a limit of ``max_epochs`` times the source's size.
2. Every document gets a random but fixed key, the hash of its id and a seed. The range of keys
   is cut into buckets, as many per source as its rows need, so a source with a third of all
   rows spreads over as many tasks as its size asks for.
3. Bucket sums are added up within each source (one row per bucket, not per document); each
   document's prefix sum is its bucket's start plus a running sum inside the bucket.
4. A source repeats whole as often as its budget holds it; the rest of the budget is cut
   exactly: documents before the cut are taken once more, the one at the cut in part.

All steps are functions of the rows, so a lost executor or a second run gives the same mix.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source
of its own, ordered last; repeated rows each count and are taken on their own; an empty table
gives no rows. A document's own columns are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.base import Scratch, query, table

#: Documents of one source whose running sum one task adds up, on average.
BUCKET_ROWS = 2_000
#: Sources up to this number are broadcast to their documents (one short row each).
BROADCAST_SOURCES = 50_000
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
_KEYS = 2**60


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weighted_sources(sizes: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``sizes`` with ``weight``: the weights repeat over the sources by code point, null last.

    The rank of a source is the rows in the ranges before its own plus its place in its range.
    """
    ranged = sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    ranged = scratch.settle("sources", ranged)
    ranges = ranged.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    rank = F.col("earlier") + place - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    return ranged.join(ranges, "part").withColumn("weight", weight.cast("long")).drop("part", "earlier")


def with_targets(weighted: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``weighted`` with ``target``: ``level * weight``, at most ``max_epochs`` times the size.

    The level spends exactly the sum of all sizes. It is found by rounds of one aggregation over
    the sources; each round fixes the sources that the last level would overfill. Only the sums
    reach the driver.
    """
    most = F.col("source_size") * max_epochs
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, 0
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= most
        fixed, n, left = weighted.agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0)),
            F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        if not left or (level is not None and n == full):
            break
        level, full = (total - fixed) / left, n
    share = F.lit(float(level or 0.0)) * F.col("weight")
    return weighted.withColumn("target", F.when(share >= most, most.cast("double")).otherwise(share))


def mix(docs: DataFrame, seed: str = SEED, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words of each document that the mix takes."""
    scratch = Scratch(docs.sparkSession, "source-mix")
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 15)
    sized = scratch.settle(
        "sized",
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.conv(digits, 16, 10).cast("long").alias("key")),
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = scratch.settle("targets", with_targets(scratch.settle("weighted", weighted_sources(sizes, scratch, weights)), max_epochs))
    sources = sources.withColumnRenamed("source", "of_source")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)

    width = (F.lit(_KEYS) / F.ceil(F.col("source_rows") / BUCKET_ROWS)).cast("long") + 1
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).withColumn(
        "bucket", F.floor(F.col("key") / width).cast("long")
    )
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("inside")).join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    )
    budget = F.floor(F.col("target") + 0.5)
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / size)
    cut = F.least(F.greatest(budget - epochs * size - F.col("start") - F.col("inside"), F.lit(0)), F.col("size"))
    return running.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken")
    )


SQL = rf"""
WITH d AS (SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id)), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS most,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER
      (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS own,
    row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS place FROM s),
f AS (SELECT min(place) AS place FROM l WHERE own * w < most),
v AS (SELECT (SELECT own FROM l WHERE place = (SELECT place FROM f)) AS level),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * w >= most THEN most ELSE level * w END::DOUBLE AS target
    FROM l, v),
b AS (SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS budget, greatest(source_size, 1) AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (budget // whole * size + least(greatest(budget % whole - before, 0), size))::BIGINT AS taken FROM b
"""


@query(SQL)
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
