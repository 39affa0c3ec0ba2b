"""Index tables: Parquet folders split into buckets of files or repositories.

A change rewrites only the buckets it touches, with Spark's dynamic partition overwrite: new
files are staged and swapped in when the job commits, so a lost executor costs a retry and a
failed job leaves the old files in place.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import shared_dir


def bucket_of(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _filesystem(spark, path)
    return fs.exists(at)


def modified_at(spark: SparkSession, path: str) -> float:
    fs, at = _filesystem(spark, path)
    return fs.getFileStatus(at).getModificationTime() / 1000.0


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = _filesystem(spark, path)
    fs.delete(at, True)


class Table:
    """One table of the index. ``split_by`` are the columns whose hash picks the bucket."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, split_by: Sequence[str], buckets: int
    ):
        self.spark, self.path, self.schema = spark, path, schema
        self.split_by, self.buckets = list(split_by), buckets

    def _stored(self) -> DataFrame:
        layout = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def _write(self, placed: DataFrame, mode: str) -> None:
        # Rebalancing gathers a bucket into few files but splits one that is far too large.
        placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").option(
            "partitionOverwriteMode", mode
        ).parquet(self.path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, bucket_of(self.split_by, self.buckets).alias("bucket"))

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets the keys fall into; at most one number per bucket comes to the driver."""
        touched = keys.select(bucket_of(self.split_by, self.buckets).alias("bucket")).distinct()
        return sorted(r.bucket for r in touched.collect())

    def _buckets(self, numbers: list[int]) -> DataFrame:
        return self._stored().where(F.col("bucket").isin(numbers)).select(*self.schema.names)

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows with one of the keys; only the buckets these fall into are read."""
        return self._buckets(self._touched(keys)).join(keys, keys.columns, "left_semi")

    def overwrite(self, rows: DataFrame) -> None:
        self._write(self._placed(rows), "static")

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """Remove all rows whose key is in ``keys`` and add ``rows``, whose keys are among them.

        ``keys`` must hold the ``split_by`` columns, so that it tells which buckets change.
        The new content is written aside first: what was computed for it is safe before the old
        buckets go, and no job reads the files it replaces.
        """
        if not exists(self.spark, self.path):
            self.overwrite(rows)
            return
        numbers = self._touched(keys)
        if not numbers:
            return
        kept = self._buckets(numbers).join(keys, keys.columns, "left_anti")
        with Scratch(self.spark) as scratch:
            new = scratch.settle(self._placed(kept.unionByName(rows.select(*self.schema.names))), "bucket")
            written = {r.bucket for r in new.select("bucket").distinct().collect()}
            self._write(new, "dynamic")
        # The overwrite leaves a bucket alone that received no row: it lost all it had.
        for number in set(numbers) - written:
            drop_path(self.spark, f"{self.path}/bucket={number}")


class IndexLock:
    """One build at a time: a lock file that only one driver can create.

    The holder renews the file's time while it works, however long that takes. A lock that was
    not renewed for ``expires`` seconds belongs to a driver that died and is taken over: a waiter
    moves it to a name of its own, which only one of several waiters can do, and tries again.
    The file holds its owner's token; a holder whose lock was taken over leaves the new one alone.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        timeout: float = 300,
        poll: float = 0.25,
        expires: float = 600,
        renew: float = 60,
    ):
        self.spark, self.path = spark, path
        self.timeout, self.poll, self.expires, self.renew = timeout, poll, expires, renew
        self.done = threading.Event()
        self.token = uuid.uuid4().hex

    def _create(self) -> bool:
        """Write the lock with this owner's token, unless there is one."""
        fs, at = _filesystem(self.spark, self.path)
        if not fs.createNewFile(at):
            return False
        out = fs.create(at, True)
        out.write(bytearray(self.token, "ascii"))
        out.close()
        return True

    def _owner(self, path: str) -> str | None:
        fs, at = _filesystem(self.spark, path)
        try:
            stream = fs.open(at)
        except Py4JJavaError:
            return None
        try:
            return bytes(stream.readAllBytes()).decode("ascii")
        finally:
            stream.close()

    def _remove(self, owner: str | None) -> None:
        """Move the lock of ``owner`` away; one that another driver wrote meanwhile is put back."""
        fs, at = _filesystem(self.spark, self.path)
        aside = f"{self.path}.{uuid.uuid4().hex}"
        _, to = _filesystem(self.spark, aside)
        if self._owner(self.path) != owner or not fs.rename(at, to):
            return
        if self._owner(aside) == owner or not fs.rename(to, at):
            fs.delete(to, False)

    def _renew(self) -> None:
        fs, at = _filesystem(self.spark, self.path)
        while not self.done.wait(self.renew):
            if self._owner(self.path) != self.token:
                return
            fs.setTimes(at, int(time.time() * 1000), -1)

    def _expired(self) -> bool:
        try:
            return time.time() - modified_at(self.spark, self.path) > self.expires
        except Py4JJavaError:
            return False

    def __enter__(self) -> IndexLock:
        deadline = time.monotonic() + self.timeout
        while not self._create():
            owner = self._owner(self.path)
            if owner is not None and self._expired():
                self._remove(owner)
                continue
            if time.monotonic() >= deadline:
                raise TimeoutError(f"another build holds {self.path}")
            time.sleep(self.poll)
        threading.Thread(target=self._renew, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.done.set()
        self._remove(self.token)


class Scratch:
    """Work tables in the shared folder, gone when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"

    def settle(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written and read back: computed once, safe from lost executors, no lineage."""
        path = f"{self.path}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        drop_path(self.spark, self.path)
