"""Helpers of the operators here: batches by size, words and shingle hashes, task counts."""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from rankloom import runtime

# Text bytes that a Python worker handles at once; longer texts come alone.
SLICE_BYTES = 4 * 1024 * 1024
# Words of a shingle.
SHINGLE = 5
# Input bytes per group of an explicit regrouping.
GROUP_BYTES = 8 * 1024 * 1024

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most `limit` bytes of `column`, one row at least."""
    for batch in batches:
        sizes = np.diff(np.asarray(_offsets(batch.column(column))))
        start, size = 0, 0
        for row, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def _offsets(array: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], dtype=width)
    return raw[array.offset:array.offset + len(array) + 1]


def strings(array: pa.Array) -> list[str]:
    """Values of a text column; null is the empty text."""
    return [v if v is not None else "" for v in array.to_pylist()]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, `sizes` of each."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8, split at ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for every run of `size` words, in text order; fewer words are one run."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = out * _MIX + h[i:len(h) - width + 1 + i]
    return mixed(out)


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(words_of(text), size))


def group_count(df: DataFrame, least: int = 128) -> int:
    """Groups of an explicit regrouping, in proportion to the bytes scanned."""
    scanned = sum(runtime._leaf_bytes(df, scans_only=True))
    return max(least, -(-scanned // GROUP_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table written in the shared folder: the lineage ends, and so do the plan's
    statistics and constraints, which checkpoints keep and loops would pile up."""
    path = runtime.scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
