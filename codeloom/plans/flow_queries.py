"""Whole flows over the given tables: search, encoding, streamed upserts, project facts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import vectors
from codeloom.operators import calls, encoding, expansion, formatting
from codeloom.plans.registry import query, table, wide_ints
from codeloom.plans.retrieval import result_blocks, search_hits
from codeloom.plans.table_queries import _COSINE, _LINES, _windows_sql, query_vector, spans
from codeloom.session import shared_dir
from codeloom.sources import file_profile
from codeloom.sources.tables import Scratch, Table
from codeloom.streaming.change_feed import upsert_stream


def _search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files whose first seven lines carry the vector with their number; every
    seven-line method calls the next one of its file."""
    scratch = Scratch(spark)  # stays: the result is read from it after this function returns
    windows = spans(spark, sf, 7, 0).withColumn("path", F.col("doc_id").cast("string"))
    rows = scratch.settle(windows.drop("content"), "windows")
    methods = rows.select(
        F.concat_ws("::", "doc_id", "block").alias("method_id"),
        F.col("repo_id").alias("service_id"),
        F.col("path").alias("file_path"),
        F.lit("m").alias("name"),
        F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"),
    )
    edges = rows.where(F.col("block") >= 7).select(
        F.concat_ws("::", F.col("doc_id"), F.col("block") - 7).alias("source_id"),
        F.concat_ws("::", "doc_id", "block").alias("target_id"),
        F.lit("method_call").alias("kind"),
    )
    chunks = windows.where(F.col("block") == 0).join(
        table(spark, sf, "embeddings"), F.col("vec_id") == F.col("doc_id")
    ).select(
        F.concat_ws("::", "doc_id", "block").alias("chunk_id"), "repo_id", F.col("path").alias("file_path"),
        "start_line", "end_line", "content", F.lit("text").alias("language"),
        F.lit("block").alias("chunk_type"), F.lit(None).cast("string").alias("symbol"), "embedding",
    )
    files = table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("file_path"),
        F.col("text").alias("content"),
    )
    hits = scratch.settle(search_hits(chunks, [query_vector(spark, sf)], 24), "hits")
    around = expansion.expand_hits(hits, methods, edges, files, settle=scratch.settle)
    bonus = scratch.settle(around.bonus, "bonus")
    return result_blocks(hits, bonus, files, 24, scratch.settle)


@query(
    f"""WITH {_LINES}, {_windows_sql('m', 7, 7)},
    hits AS (SELECT e.vec_id AS doc_id, {_COSINE} AS s FROM embeddings e,
               (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q
             WHERE e.vec_id IN (SELECT doc_id FROM m WHERE block = 0) ORDER BY s DESC, 1 LIMIT 24),
    n AS (SELECT doc_id, s, len(lines) AS n FROM hits JOIN ln USING (doc_id)),
    x AS (SELECT doc_id, s, CASE WHEN s * 0.5::DOUBLE < 0.15::DOUBLE OR n <= 7 THEN least(n, 7)
            WHEN s * 0.5::DOUBLE * 0.5::DOUBLE < 0.15::DOUBLE OR n <= 14 THEN least(n, 14) ELSE least(n, 21) END AS e
          FROM n)
    SELECT doc_id::VARCHAR AS file_path, 1::BIGINT AS start_line, e AS end_line, round(s, 6) AS score,
           row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM x"""
)
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    return wide_ints(
        _search(spark, sf).select(
            "file_path", "start_line", "end_line", F.round("score", 6).alias("score"), "rank"
        )
    )


@query()
def search_output(spark: SparkSession, sf: str) -> DataFrame:
    """The formatted answer of the same search."""
    located = _search(spark, sf).withColumn("path", F.concat_ws("/", F.lit("/repos"), "repo_id", "file_path"))
    return formatting.format_results(formatting.render_blocks(located))


@query(
    f"""WITH {_LINES}, {_windows_sql('w', 32, 24)}
    SELECT doc_id, block, 16::BIGINT AS dimension, 1.0::DOUBLE AS norm FROM w"""
)
def encode_windows(spark: SparkSession, sf: str) -> DataFrame:
    chunks = spans(spark, sf, 32, 8).select(
        "doc_id", "block", F.col("doc_id").cast("string").alias("file_path"),
        F.lit(None).cast("string").alias("symbol"), "start_line", "end_line", "content",
    )
    encoded = encoding.encode_chunks(chunks, encoding.HashModel(16))
    return wide_ints(
        encoded.select(
            "doc_id", "block", F.size("embedding").alias("dimension"),
            F.round(vectors.norm(F.col("embedding")), 5).alias("norm"),
        )
    )


_EVENT_STATE = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)


@query(
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
               FROM events)
    SELECT user_id, event_id, event_type, round(value, 6) AS value FROM r WHERE n = 1"""
)
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream that keeps a table of each user's last event current."""
    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    state = Table(spark, f"{place}/state", _EVENT_STATE, ["user_id"], 8)
    events = (
        spark.readStream.schema(table(spark, sf, "events").schema)
        .parquet(f"{sf.rstrip('/')}/{{events}}.parquet")  # a pattern, so that one file serves as well as a folder
        .select(*_EVENT_STATE.names)
    )
    upsert_stream(events, state, ["user_id"], ["ts", "event_id"], f"{place}/progress").awaitTermination()
    return state.read().select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query(
    """
    WITH f AS (SELECT 'proj' || p_partkey AS repo_id, p_type AS t, p_size AS n FROM part)
    SELECT repo_id, CASE WHEN t = 'LARGE' THEN 'typescript' WHEN t = 'STANDARD' THEN 'python'
      WHEN t = 'SMALL' OR n > 25 THEN 'go' WHEN t = 'PROMO' THEN 'java' WHEN t = 'MEDIUM' THEN 'rust'
      ELSE 'python' END AS language FROM f"""
)
def repo_languages(spark: SparkSession, sf: str) -> DataFrame:
    marker = (
        F.when(F.col("p_type") == "LARGE", "package.json").when(F.col("p_type") == "STANDARD", "setup.py")
        .when(F.col("p_type") == "SMALL", "go.mod").when(F.col("p_type") == "PROMO", "pom.xml")
        .when(F.col("p_type") == "MEDIUM", "Cargo.toml").otherwise("notes.txt")
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("proj"), F.col("p_partkey").cast("string")).alias("repo_id"), marker.alias("marker"), "p_size"
    )
    second = F.when(F.col("p_size") > 25, "go.mod").otherwise("src/package.json")
    listing = parts.select("repo_id", F.col("marker").alias("file_path")).unionByName(
        parts.select("repo_id", second.alias("file_path"))
    )
    return file_profile.repo_languages(listing)


@query(
    """
    SELECT 'O' || l_orderkey AS caller_id, 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS callee_name,
           l_linenumber::BIGINT AS line
    FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 0)"""
)
def builtin_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in debt stand for the built-in names that are no call targets."""
    sites = table(spark, sf, "lineitem").select(
        F.lit("go").alias("parser"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("caller_id"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("callee_name"),
        F.col("l_linenumber").alias("line"),
    )
    builtins = table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(
        F.lit("go").alias("parser"), F.col("s_name").alias("callee_name")
    )
    return wide_ints(calls.drop_builtins(sites, builtins).select("caller_id", "callee_name", "line"))
