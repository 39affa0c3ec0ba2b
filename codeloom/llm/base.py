"""What the operators share: their registry, input tables, scratch tables and word expressions.

Inputs may have null in any column, repeated rows and extra columns; an operator reads the
columns it names and carries none of the others unless it says so.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space between words, as a regular expression and as a list of characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine, where it is unset, gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="codeloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


class Scratch:
    """Tables and files of one operator run, below one folder of the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def settle(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` written once and read back, so that a lost executor never recomputes them."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def local_folder(self, name: str) -> str:
        """A folder for memory-mapped files, as a path that every worker can open.

        Needs a shared root that is mounted on all machines (``file:`` or a plain path).
        """
        path = self.root.removeprefix("file://").removeprefix("file:")
        if "://" in path:
            raise RuntimeError(f"memory-mapped files need a mounted spark.checkpoint.dir, not {path}")
        os.makedirs(f"{path}/{name}", exist_ok=True)
        return f"{path}/{name}"

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all other characters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def row_key(*columns: str) -> list[Column]:
    """Key of a document row: its id and a hash of its text, so that repeated ids stay apart."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash"), *map(F.col, columns)]
