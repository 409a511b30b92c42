"""Reading, lower-casing and word helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

#: Rows that may be broadcast; anything larger is left to a shuffle join.
BROADCAST_ROWS = 500_000
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint, but only if it has been counted and found small; ``most``: rows that may be sent,
    fewer where a row is wide."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= most else df


#: Bytes of the batches that tasks hand to Python. Spark counts rows only, and ten thousand long texts are a lot.
ARROW_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def stage_in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """``stage`` with batches of ARROW_BYTES for the steps that it runs; the session's own setting comes back after."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH_SETTING, None)
    conf.set(_BATCH_SETTING, str(ARROW_BYTES))
    try:
        return stage(df, name)
    finally:
        if before is None:
            conf.unset(_BATCH_SETTING)
        else:
            conf.set(_BATCH_SETTING, before)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters kept; ASCII texts take the quick path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def partitions(spark: SparkSession) -> int:
    """Partitions of steps whose work is far larger than their bytes."""
    number = spark.conf.get("spark.sql.shuffle.partitions", "200")
    return max(int(number) if number.isdigit() else 200, spark.sparkContext.defaultParallelism)


def mix(a: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    a = (a ^ (a >> np.uint64(30))) * _C2
    a = (a ^ (a >> np.uint64(27))) * _C3
    return a ^ (a >> np.uint64(31))


def word_codes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space, A-Z lower-cased: codes of all words, words per text, and
    the distinct words that the codes stand for. Null texts have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    keep = pc.not_equal(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(parts).filter(keep)
    words = flat.filter(keep).dictionary_encode()
    lens = np.bincount(owner.to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), lens, words.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    found = words.cast(pa.large_binary()).to_pylist()
    return np.fromiter((digest(w) for w in found), dtype=np.uint64, count=len(found))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each place; the last n-1 places are missing."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    total = hashes[:size].copy()
    for k in range(1, n):
        total = total * _C1 + hashes[k : k + size]
    return mix(total + np.uint64(n))


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed byte planes of their differences."""
    steps = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    return squeeze(steps.view(np.int64))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob).view(np.uint64), dtype=np.uint64)


def pack32(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack32(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def squeeze(values: np.ndarray) -> bytes:
    """64-bit integers as compressed byte planes; small numbers cost next to nothing."""
    planes = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def hash_borders(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the ``2 ** bits`` hash ranges in a sorted array."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, tops), [len(hashes)]]).astype(np.int64)


def give_back() -> None:
    """Memory that Arrow and the C library keep for reuse goes back to the system: a worker lives on through many
    steps, and the next ones need room beside what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_batches(batches, size: int):
    """Arrow batches regrouped so that each holds about ``size`` bytes; the last column is the text."""
    held, held_bytes = [], 0
    for batch in batches:
        start = 0
        lens = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        total = held_bytes + np.cumsum(lens + 16)
        while start < batch.num_rows:
            stop = int(np.searchsorted(total, size, side="left")) + 1
            if stop > batch.num_rows:
                held.append(batch.slice(start))
                held_bytes = int(total[-1])
                break
            held.append(batch.slice(start, stop - start))
            yield pa.Table.from_batches(held).combine_chunks()
            give_back()
            held, held_bytes = [], 0
            total = total - total[stop - 1]
            start = stop
        else:
            held_bytes = 0 if not held else held_bytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    give_back()
