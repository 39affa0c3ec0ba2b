"""Texts to vectors inside tasks, with any model."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx

MAX_TRIES = 3
BASE_DELAY = 2.0
MAX_DELAY = 60.0


class EmbeddingModel(Protocol):
    """What a model must offer. Instances are pickled to the workers, so clients and keys are
    opened lazily inside ``encode``."""

    name: str
    dimension: int

    def encode(self, texts: Sequence[str], kind: str = "document") -> list[list[float]]: ...


class HashModel:
    """Unit vectors drawn from a seed that is a hash of the text: same text, same vector."""

    def __init__(self, dimension: int = 384, name: str = "hash"):
        self.dimension, self.name = dimension, name

    def encode(self, texts: Sequence[str], kind: str = "document") -> list[list[float]]:
        return [self._vector(t) for t in texts]

    def _vector(self, text: str) -> list[float]:
        seed = int(hashlib.md5(text.encode("utf-8")).hexdigest(), 16) % 2**32
        vector = np.random.RandomState(seed).standard_normal(self.dimension)
        return (vector / np.linalg.norm(vector)).tolist()


class RateLimited(Exception):
    """Raised by a client whose key has no quota left for now."""


def _status(error: Exception) -> int | None:
    status = getattr(error, "status_code", None) or getattr(error, "code", None)
    return status if isinstance(status, int) else None


def _key_trouble(error: Exception) -> str | None:
    """'limited' or 'rejected' where the key is at fault, else None."""
    status = _status(error)
    if isinstance(error, RateLimited) or status == 429:
        return "limited"
    bad_key = status == 400 and "api key" in str(error).lower()
    return "rejected" if status in (401, 403) or bad_key else None


class KeyRing:
    """A model over several interchangeable clients, one per key.

    A client whose key is limited or rejected is passed over for the next. When all are
    limited the ring waits, longer each round, and starts again for as long as it takes; when
    the last round met a rejected key it gives up. Other errors go to the caller at once.
    """

    def __init__(
        self,
        clients: Sequence[Callable[[Sequence[str], str], list[list[float]]]],
        dimension: int,
        name: str,
        wait: Callable[[float], None] = time.sleep,
    ):
        if not clients:
            raise ValueError("a key ring needs at least one client")
        self.clients, self.dimension, self.name, self.wait = list(clients), dimension, name, wait
        self.next_client = 0

    def encode(self, texts: Sequence[str], kind: str = "document") -> list[list[float]]:
        rounds = 0
        while True:
            rejected = []
            for _ in self.clients:
                client = self.clients[self.next_client]
                self.next_client = (self.next_client + 1) % len(self.clients)
                try:
                    return client(texts, kind)
                except Exception as error:
                    trouble = _key_trouble(error)
                    if trouble is None:
                        raise
                    if trouble == "rejected":
                        rejected.append(str(error))
            if rejected:
                raise RuntimeError("no key works: " + "; ".join(rejected))
            self.wait(min(BASE_DELAY * 2**rounds, MAX_DELAY))
            rounds += 1


def takes_prompts(model_name: str) -> bool:
    """Models of the gemini embedding family from version 2 on want task prompts in the text."""
    version = model_name.removeprefix("gemini-embedding-")
    return version != model_name and version.isdigit() and int(version) >= 2


def query_prompt(model_name: str, query: str) -> str:
    return f"task: code retrieval | query: {query}" if takes_prompts(model_name) else query


def _is_transient(error: Exception) -> bool:
    return isinstance(error, OSError) or (_status(error) or 0) >= 500


def encode_with_retry(
    model: EmbeddingModel, texts: Sequence[str], wait: Callable[[float], None] = time.sleep
) -> tuple[list[list[float]], int]:
    """Vectors and the number of retries; transient errors are tried up to three times."""
    for tries in range(MAX_TRIES):
        try:
            return model.encode(texts), tries
        except Exception as error:
            if not _is_transient(error) or tries == MAX_TRIES - 1:
                raise
            wait(BASE_DELAY * 2**tries)
    raise AssertionError("unreachable")


def encode_chunks(
    chunks: DataFrame, model: EmbeddingModel, batch: int = 100, titled: bool = False
) -> DataFrame:
    """Chunks with ``embedding``, and ``encode_seconds``/``encode_retries`` of each batch on its
    first row (see :func:`encode_summary`).

    Partitions replace a thread pool and Arrow batches replace super-batches: a task holds one
    batch of texts at a time. ``titled`` puts path and symbol before the text, as models with a
    title prompt want it.
    """
    title = tx.document_title(
        F.col("file_path"), F.col("symbol"), F.col("start_line"), F.col("end_line")
    )
    text = tx.document_prompt(F.col("content"), title) if titled else F.col("content")
    rows = chunks.withColumn("_text", text)
    names = chunks.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrived in batches:
            for start in range(0, arrived.num_rows, batch):
                part = arrived.slice(start, batch)
                began = time.perf_counter()
                vectors, retries = encode_with_retry(model, part.column(len(names)).to_pylist())
                took = time.perf_counter() - began
                blank = [None] * (part.num_rows - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(names)],
                        pa.array(vectors, pa.list_(pa.float32())),
                        pa.array([took, *blank], pa.float64()),
                        pa.array([retries, *blank], pa.int32()),
                    ],
                    names=[*names, "embedding", "encode_seconds", "encode_retries"],
                )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return rows.mapInArrow(
        encode, f"{schema}, embedding array<float>, encode_seconds double, encode_retries int"
    )


def encode_summary(encoded: DataFrame) -> DataFrame:
    """One row of call counts, latencies and throughput over an encoded table."""
    calls = F.count("encode_seconds")
    total = F.coalesce(F.sum("encode_seconds"), F.lit(0.0))
    return encoded.agg(
        calls.alias("api_calls"),
        total.alias("api_total_latency"),
        F.coalesce(F.min("encode_seconds"), F.lit(0.0)).alias("api_min_latency"),
        F.coalesce(F.max("encode_seconds"), F.lit(0.0)).alias("api_max_latency"),
        F.coalesce(F.avg("encode_seconds"), F.lit(0.0)).alias("api_avg_latency"),
        F.count(F.lit(1)).alias("api_total_texts"),
        F.coalesce(F.sum("encode_retries"), F.lit(0)).alias("api_retries"),
        F.when(total > 0, F.count(F.lit(1)) / total).otherwise(0.0).alias("api_texts_per_second"),
    )
