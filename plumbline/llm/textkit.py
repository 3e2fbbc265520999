"""Shared helpers: Arrow text batches as flat byte buffers, vectorised word spans and polynomial hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.shared import discard, discard_part, shared_folder, stored  # noqa: F401  the operators' intermediate tables

BATCH_BYTES = 8 << 20
#: Bytes of text that a worker holds unpacked at once; one longer text makes a slice of its own.
SLICE_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
#: Powers are made so many at a time.
_POWERS = 250_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = bytes(LOWER)


def clean(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, cast to the types that the operators use; all other columns go."""
    small_batches(df.sparkSession)
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as its bytes and its row offsets (from 0); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def cuts(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, but of one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of a bounded number of bytes: the rows, their bytes, and their offsets."""
    flat, offsets = utf8(batch.column(column))
    for a, b in cuts(offsets, most):
        yield batch.slice(a, b - a), flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n - 1), or those of its inverse, modulo 2**64."""
    key = "inverse" if inverse else "base"
    if len(have := _powers.get(key, np.ones(1, np.uint64))) < n:
        size = max(-(-n // _POWERS) * _POWERS, SLICE_BYTES + _POWERS)
        have = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i stands for the first i bytes."""
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_CODE[flat] * powers(len(flat)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes, whatever its place."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts] + (ends - starts).astype(np.uint64))


#: The modulus of the second hash, and its base.
PRIME, _PRIME_BASE = (1 << 31) - 1, 1_284_865_837
PRIME_CODE = _RNG.integers(1, PRIME, 256, dtype=np.uint64)


def prime_powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of the second hash's base, or of its inverse, modulo ``PRIME``."""
    key = "prime inverse" if inverse else "prime"
    if len(have := _powers.get(key, np.ones(1, np.uint64))) < n:
        size, step = max(-(-n // _POWERS) * _POWERS, SLICE_BYTES + _POWERS), pow(_PRIME_BASE, -1 if inverse else 1, PRIME)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate((have, have * np.uint64(pow(step, len(have), PRIME)) % np.uint64(PRIME)))
        have = have[:size].copy()
        if size <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def prime_hash(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each span of bytes a polynomial hash modulo ``PRIME`` (31 bits), independent of ``span_hash``: other codes, another base, a prime modulus."""
    prefix = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(PRIME_CODE[flat] * prime_powers(len(flat)) % np.uint64(PRIME), out=prefix[1:])
    return ((prefix[ends] - prefix[starts]) % np.uint64(PRIME) * prime_powers(len(flat) + 1, inverse=True)[starts] % np.uint64(PRIME)).astype(np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spans(flat: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``gap``, which never cross rows; and per row the index of its first run."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[flat]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[heads[1:] - 1] = inside[heads[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each pair of a start and a count, one after the other."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the number of them per row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, which gives its memory back to the system when a task ends, as workers live on and wait for other work.

    What a worker has before its first task (modules, mostly) is left out of the collections.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not gc.get_freeze_count():
            gc.freeze()
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, if the session has Spark's default: whole texts are long, and several workers share an executor's memory.

    The setting stays, as frames that the operators return are run later, with the session's settings of then.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "64m", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def training_row(doc_id: Column, modulus: int, held: int) -> Column:
    """False for the rows that are held out by the checksum of their id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus != held
