"""Counts of 64-bit keys over a corpus, kept as sorted arrays that workers map into memory.

Tasks count their own keys in blocks and hand on each block cut by key range, as differences of
sorted keys, byte plane by byte plane, compressed. Spark groups the cuts by range; each range is
summed in one task and written as one file of sorted keys and counts. Keys are hashes, or ids
whose ranges were made even beforehand, so ranges are of like size whatever the data.

A file is written under a name of its own and then renamed, so that a repeated task is harmless.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CUT = "range int, keys binary, counts binary, n long"
RANGE_FILE = "range int, n long, total long"


def _planes(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T), asbytes=True)


def _values(blob: bytes, n: int, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = pa.Codec("zstd").decompress(blob, n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).ravel()


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.uint64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)
    return keys[first], np.add.reduceat(counts.astype(np.uint64), first)


def cuts(keys: np.ndarray, counts: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[int, bytes, bytes, int]]:
    """Rows of CUT for sorted distinct keys whose ``ranges`` ascend with them."""
    edges = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(keys) else []
    for low, high in zip(edges, [*edges[1:], len(keys)]):
        part = np.diff(keys[low:high], prepend=np.uint64(0)).astype(np.uint64)
        yield int(ranges[low]), _planes(part), _planes(counts[low:high].astype(np.uint64)), int(high - low)


def batch_of_cuts(rows: list[tuple[int, bytes, bytes, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    types = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["range", "keys", "counts", "n"])


def uncut(keys: list[bytes], counts: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the cuts of one range."""
    some = [(k, c, n) for k, c, n in zip(keys, counts, sizes) if n]
    if not some:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    parts = [np.cumsum(_values(k, n, np.uint64), dtype=np.uint64) for k, _, n in some]
    return summed(np.concatenate(parts), np.concatenate([_values(c, n, np.uint64) for _, c, n in some]))


def save(folder: str, name: str, array: np.ndarray) -> None:
    own = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(own, array)
    os.replace(own, f"{folder}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """The array, mapped into memory."""
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


class Ranges:
    """Sorted key files ``key-R`` with counts ``count-R``, looked up without reading them whole."""

    def __init__(self, folder: str, n: int):
        self.keys = [load(folder, f"key-{r}") for r in range(n)]
        self.counts = [load(folder, f"count-{r}") for r in range(n)]

    def count(self, keys: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Counts of ``keys``, which are sorted and whose ``ranges`` ascend with them; 0 if unknown."""
        out = np.zeros(len(keys), np.uint64)
        edges = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(keys) else []
        for low, high in zip(edges, [*edges[1:], len(keys)]):
            own, counts = self.keys[ranges[low]], self.counts[ranges[low]]
            if len(own):
                at = np.minimum(np.searchsorted(own, keys[low:high]), len(own) - 1)
                out[low:high] = np.where(own[at] == keys[low:high], counts[at], 0)
        return out
