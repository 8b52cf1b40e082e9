"""Shared helpers of the text operators: session settings, staging, Arrow access, word hashing.

Words are runs of bytes other than space and 0x09-0x0D. All hashing is done for a whole Arrow
batch at once over its UTF-8 buffer, so no Python object is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import durable, scratch_path, tune

__all__ = [
    "Words", "arrow_map", "binary_column", "buffers", "durable", "hash_words", "mix",
    "prepare", "scratch_path", "starts_of", "window_hashes",
]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SEGMENT = 1 << 18  # bytes hashed at a time
LONG_WORD = 256  # longer words are hashed one by one
BATCH_ROWS = 256  # rows of an Arrow batch; documents can be long


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings all text operators rely on."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def arrow_map(df: DataFrame, batch_function, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch that returns a list of columns or a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_function(batch)

    return df.mapInArrow(run, schema)


def binary_column(column: pa.Array) -> pa.Array:
    """Text as bytes, nulls as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; nulls are empty."""
    column = binary_column(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    def series(x: int) -> np.ndarray:
        out = np.full(SEGMENT, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(base), series(pow(base, -1, 1 << 64))


class _Lane:
    """One polynomial hash over random byte values."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.power, self.inverse = _powers(int(rng.integers(1 << 60, 1 << 62)) * 2 + 1)

    def segment(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        terms = self.byte[raw] * self.power[: len(raw)]
        sums = np.cumsum(terms, dtype=np.uint64)
        return mix((sums[end - 1] - sums[begin] + terms[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


_LANES: list[_Lane] = []


def lanes(n: int) -> list[_Lane]:
    while len(_LANES) < n:
        _LANES.append(_Lane(7919 + len(_LANES)))
    return _LANES[:n]


class Words:
    """Words of a batch: byte ranges, hashes, and the words of row i: ``row[i]:row[i + 1]``."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, row: np.ndarray, hashes: list[np.ndarray]) -> None:
        self.begin, self.end, self.row, self.hashes = begin, end, row, hashes


def word_ranges(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, ...]:
    """Begin and end of each word, and the first word of each row."""
    solid = ~separators[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = solid[inner]  # a word does not reach into the next row
    last[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offsets)


def hash_words(raw: np.ndarray, offsets: np.ndarray, n_lanes: int = 1, separators: np.ndarray = SPACE) -> Words:
    """Words of all rows with ``n_lanes`` independent 64-bit hashes each."""
    begin, end, row = word_ranges(raw, offsets, separators)
    out = [np.zeros(len(begin), np.uint64) for _ in range(n_lanes)]
    long = np.flatnonzero(end - begin > LONG_WORD)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + SEGMENT, "right")))
        if end[b - 1] - begin[a] <= SEGMENT:
            piece = raw[begin[a] : end[b - 1]]
            for lane, hashes in zip(lanes(n_lanes), out):
                hashes[a:b] = lane.segment(piece, begin[a:b] - begin[a], end[a:b] - begin[a])
        a = b
    for i in long:
        digest = np.frombuffer(hashlib.blake2b(raw[begin[i] : end[i]].tobytes()).digest(), np.uint64)
        for k, hashes in enumerate(out):
            hashes[i] = digest[k]
    return Words(begin, end, row, out)


def starts_of(row: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the words at which a window of ``width`` words of one row starts."""
    total = int(row[-1])
    valid = np.ones(total, bool)
    for back in range(1, width):
        last = row[1:] - back
        valid[last[last >= row[:-1]]] = False
    return np.flatnonzero(valid)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window that starts at each word; the last ``width - 1`` are not windows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : n + j]
    return mix(out)


def ids_of(column: pa.Array) -> pa.Array:
    """Document ids as nullable 64-bit integers."""
    return column.cast(pa.int64())


def batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
