"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Working memory of a task follows the text it holds in numpy arrays at one time.
CHUNK_BYTES = 2 << 20

# A null doc_id stands for one document that ranks after every other.
NULL_ID = 9223372036854775807


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def id_key(doc_id: str) -> Column:
    """The document id as a never-null long (null becomes ``NULL_ID``)."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def keyed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_k`` (never null), the original ``doc_id`` and ``text`` with null as the empty text.

    Any other column is left behind, so clashing names cannot reach an operator's own columns.
    """
    return docs.select(id_key(doc_id).alias("_k"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def raw_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES,
           most: int = 4096) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Row slices of a batch of at most ``most`` rows whose texts total about ``limit`` bytes
    (one whole text at least).

    Yields the slice, the concatenated bytes and the texts' offsets in them.
    """
    data, ends = raw_strings(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, len(ends) - 1
    while row < n:
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(n, row + most, max(stop, row + 1))
        yield slice(row, stop), data[ends[row]:ends[stop]], ends[row:stop + 1] - ends[row]
        row = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that nearby values give unrelated ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``range(s, s + l)`` for every pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and text numbers of the runs of non-blank bytes of concatenated texts."""
    inside = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    first = ends[:-1][(ends[:-1] < len(data))]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = ends[1:][(ends[1:] > 0)] - 1
    after[last] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(ends, starts, side="right") - 1


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, modulo 2**64, of an odd base and of its inverse."""
    made = np.full((2, n), np.array([[_BASE], [_BACK]], np.uint64))
    made[:, :1] = 1
    made = np.cumprod(made, axis=1, dtype=np.uint64)
    return made[0], made[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as coefficients of a polynomial, then mixed.

    The sums of all words are differences of one running sum over the bytes.
    """
    forward, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=total[1:])
    return mix64((total[stops] - total[starts]) * back[starts])


def shingle_hashes(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words that stays in one text, and the first word's number."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(size):
        value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n]
    at = np.flatnonzero(owner[:n] == owner[size - 1:])
    return mix64(value[at]), at
