"""Shared plumbing of the operators: input sizes, blocks and shards.

A *block* is a set of documents chosen by a hash of doc_id and text, small enough for one
Python worker; a *shard* is a range of keys.  Blocks send each shard the distinct
keys they hold, already summed, so a key that is hot in the corpus reaches its
shard once per block, and each shard answers once per block.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.llm.textvec import from_planes, planes
from varigrid.plans.storage import shared_dir, stored

__all__ = ["shared_dir", "stored"]

BLOCK_BYTES = 8 << 20


def bounded(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """What a Python worker takes at once: Spark's batches in slices of at most ``rows`` rows and about ``size`` bytes.

    A row larger than that is a slice of its own.
    """
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(batch.get_total_buffer_size(), 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def free_memory() -> None:
    """Give a worker's freed memory back, as idle workers stay beside the running ones."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


HASHES = 1 << 31


def hash_place(key: Column) -> Column:
    """A row's place in a sample order that doesn't depend on partitions."""
    return F.pmod(key, F.lit(HASHES))


def first_by_hash(place: Column, rows: int, wanted: int) -> Column:
    """Whether a row can be among the first ``wanted`` of ``rows`` by hash: a little more than ``wanted`` pass.

    What the driver takes so doesn't grow with the number of partitions, as it
    does where each partition sends its own first rows.
    """
    share = (wanted + 10 * math.sqrt(wanted) + 50) / max(rows, 1)
    return place < F.lit(int(min(1.0, share) * HASHES))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts, as they are in memory: the size of files says little of texts that repeat."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def n_blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    return max(2, math.ceil(text_bytes(df) / block_bytes))


def with_block(df: DataFrame, n: int) -> DataFrame:
    """doc_id and text with the block of each row: by both, so that rows of one doc_id or of one text are spread."""
    return df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"))


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes without the high planes that are all zero."""
    v = np.ascontiguousarray(values, np.uint64)
    top = int(v.max()) if len(v) else 0
    keep = max(1, (top.bit_length() + 7) // 8)
    return bytes([keep]) + planes(v)[: keep * len(v)]


def unpack(data: bytes) -> np.ndarray:
    keep = data[0]
    n = (len(data) - 1) // keep
    out = np.zeros((8, n), np.uint8)
    out[:keep] = np.frombuffer(data, np.uint8, offset=1).reshape(keep, n)
    return from_planes(out.tobytes(), np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """As pack, for ascending numbers: their differences."""
    v = np.ascontiguousarray(values, np.uint64)
    return pack(np.diff(v, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash by its high bits, so that ascending hashes have ascending shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def slices(shard: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of each shard's run in an array of ascending shard numbers."""
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
