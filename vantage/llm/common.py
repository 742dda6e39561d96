"""What several corpus operators share: checkpoints, word hashes and slices of Arrow text columns."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text is hashed in slices of about so many bytes, so that the work arrays stay small.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on a single machine (tests), a temporary one is set once.

    On a cluster it has to be set: no executor could read another's temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_own_checkpoints", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark._own_checkpoints = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd number and of its inverse mod 2^64, as long as has been asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.zeros(0, U64), np.zeros(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(pow(self.base, -1, 2**64), n)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_STEP)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's bounds in them (n + 1); null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) and each row's bounds in them."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = bounds[1:-1][bounds[1:-1] < len(data)]
    begins[inner] = word[inner]
    ends[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes, i = np.empty(len(begins), U64), 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + SLICE_BYTES, "right")))
        a, b = int(begins[i]), int(ends[j - 1])
        up, down = _BYTE_POWERS.upto(max(b - a, 1) if b - a > SLICE_BYTES else SLICE_BYTES)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(_BYTES[data[a:b]] * up[: b - a], out=sums[1:])
        hashes[i:j] = (sums[ends[i:j] - a] - sums[begins[i:j] - a]) * down[begins[i:j] - a] + (ends[i:j] - begins[i:j]).astype(U64)
        i = j
    return mixed(hashes), np.searchsorted(begins, bounds).astype(np.int64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size`` consecutive words, across rows too; len(words) - size + 1 of them."""
    if len(words) < size:
        return np.zeros(0, U64)
    up, down = _WORD_POWERS.upto(max(len(words), 1 << 16))
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[: len(words) - size + 1])


def slices(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, one row at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def sample_hash(*columns: Column | str) -> Column:
    """62 bits of a hash of the columns, which say whether a row is in a sample."""
    return F.xxhash64(*columns, F.lit("sample")).bitwiseAND(F.lit((1 << 62) - 1))


def sample_limit(limit: int, total: int) -> Column:
    """What the hash of a row is below if about ``limit`` of ``total`` rows are chosen."""
    return F.lit((1 << 62) * limit // total)


def sampled(rows: DataFrame, limit: int, total: int, *columns: str) -> DataFrame:
    """All of ``total`` rows, or if they are more than ``limit`` about so many at most, each different one once.

    A row is chosen by a hash of ``columns`` over 2^62 values, so the share stays exact for any total;
    equal rows are chosen together and count once, so neither a common key nor copies exceed the limit.
    """
    if total <= limit:
        return rows
    return rows.where(sample_hash(*columns) < sample_limit(limit, total)).dropDuplicates(list(columns))


def string_size(df: DataFrame, column: str) -> int:
    """Characters in a column, counted over all rows."""
    return df.agg(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0]
