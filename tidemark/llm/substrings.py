"""Substring deduplication: words covered by a 13-word window that an earlier document has too.

Pass 1 sketches all windows: each task counts its windows in the cells of a two-row count-min
sketch whose counters stop at 2, and the fragments are merged cell by cell in Spark. A window's
estimate never falls below its count, so no repeated window is lost. Pass 2 hashes the windows
again and keeps those estimated at two or more; only they are grouped, by 96-bit window
fingerprint, to find the smallest document of each.

Before that shuffle each task decides what it can alone: within a task every occurrence beyond
the smallest document of its window is removed for certain, so a window sends on at most one
document per task, however many documents share it. Decided words travel as ranges.

The sketch is broadcast; its size is bounded by ``max_bits`` cells a row. A corpus with more
windows than that fills it, so that more windows reach the exact pass; the result is the same.

Defined cases: a null or empty text has no words (kept text empty, nothing removed); a text
with fewer than 13 words has no window. A null doc_id counts as larger than any other. Rows with the same doc_id
are the same document: their common windows are no repeats of each other, and each row is
returned. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import text as tx

WIDTH = 13
ROWS = 2
MIN_BITS, MAX_BITS = 18, 29  # log2 of the cells of a sketch row
BLOCK_BITS = 18  # cells merged as one record
FRAGMENT = 4_000_000  # windows held at a time
NO_ID = np.iinfo(np.int64).max
_ROW_FACTOR = (1, 0xD6E8FEB86659FD93)

FRAGMENT_SCHEMA = "block long, once binary, twice binary"
CANDIDATE_SCHEMA = "doc long, text_key long, start int, stop int, h1 long, h2 int"


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * np.uint64(_ROW_FACTOR[row])) >> np.uint64(64 - bits)).astype(np.uint32)


def _gaps(cells: np.ndarray) -> bytes:
    """Rising cell numbers as one byte for each step; 255 means 255 more to come."""
    steps = np.diff(cells.astype(np.int64), prepend=-1)
    out = np.full(len(cells) + int((steps // 255).sum()), 255, np.uint8)
    out[np.cumsum(steps // 255 + 1) - 1] = steps % 255
    return out.tobytes()


def _marked(gaps: bytes, size: int) -> np.ndarray:
    """The packed bits of the cells that ``_gaps`` wrote."""
    steps = np.frombuffer(gaps, np.uint8)
    seen = np.zeros(size, bool)
    seen[(np.cumsum(steps, dtype=np.int64) - 1)[steps != 255]] = True
    return np.packbits(seen)


def _fragment(h: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The sketch of some windows: for each block of cells the ones hit, and those hit twice."""
    block_bits = min(BLOCK_BITS, bits)
    size = 1 << block_bits
    for row in range(ROWS):
        cells = np.sort(_cells(h, row, bits))
        edges = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, size, dtype=np.uint64))
        blocks, once, twice = [], [], []
        for b in np.flatnonzero(np.diff(edges)):
            part = cells[edges[b] : edges[b + 1]] - np.uint32(b << block_bits)
            once.append(_gaps(np.unique(part)))
            twice.append(_gaps(np.unique(part[1:][part[1:] == part[:-1]])))
            blocks.append((row << (bits - block_bits)) + int(b))
        yield tx.batch([pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])


def _merge(bits: int):
    size = 1 << min(BLOCK_BITS, bits)

    def run(key: tuple[pa.Scalar, ...], frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of one block hit at least twice over all fragments, read one batch at a time."""
        once = twice = np.zeros(size // 8, np.uint8)
        for frame in frames:
            for a, b in zip(frame.column("once").to_pylist(), frame.column("twice").to_pylist()):
                a, b = _marked(a, size), _marked(b, size)
                once, twice = once | a, twice | b | (once & a)
        yield tx.batch([pa.array([key[0].as_py()], pa.int64()), pa.array([zstandard.ZstdCompressor(1).compress(twice)], pa.binary())], ["block", "twice"])

    return run


def sketch_bits(documents: DataFrame) -> int:
    """log2 of the cells of a row: about four cells for each word, within the bounds."""
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, size) / 6 * 4)))))


def _row_windows(batch: pa.RecordBatch, n_lanes: int):
    raw, offsets = tx.buffers(batch.column(batch.num_columns - 1))
    words = tx.hash_words(raw, offsets, n_lanes)
    at = tx.starts_of(words.row, WIDTH)
    return words, at, [tx.window_hashes(h, WIDTH)[at] if len(at) else np.zeros(0, np.uint64) for h in words.hashes]


def sketch(documents: DataFrame, bits: int) -> dict[int, bytes]:
    """Merged sketch: for each block the compressed bits of cells hit at least twice."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _TABLES.clear()  # of an earlier run
        held, n = [], 0
        for batch in batches:
            h = _row_windows(batch, 1)[2][0]
            held.append(h)
            n += len(h)
            if n >= FRAGMENT:
                whole, held, n = np.concatenate(held), [], 0
                yield from _fragment(whole, bits)
        if n:
            whole, held = np.concatenate(held), []
            yield from _fragment(whole, bits)

    parts = documents.select("text").mapInArrow(build, FRAGMENT_SCHEMA)
    merged = parts.groupBy("block").applyInArrow(_merge(bits), "block long, twice binary")
    return {r["block"]: bytes(r["twice"]) for r in merged.toLocalIterator()}  # bounded by MAX_BITS


_TABLES: dict[int, object] = {}  # 0: blocks of the broadcast at hand, 1: their bits


def _table(shared, bits: int) -> np.ndarray:
    """The sketch of a broadcast as packed bits, row after row; unpacked once in a worker."""
    if shared.value is not _TABLES.get(0):
        _TABLES.clear()
        size = (1 << min(BLOCK_BITS, bits)) // 8
        out = np.zeros((ROWS << bits) // 8, np.uint8)
        unpack = zstandard.ZstdDecompressor()
        for block, packed in shared.value.items():
            out[block * size : (block + 1) * size] = np.frombuffer(unpack.decompress(packed), np.uint8)
        _TABLES[0], _TABLES[1] = shared.value, out
    return _TABLES[1]


def _ranges(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join windows (sorted by row and start) that touch or overlap into word ranges of a row."""
    if not len(rows):
        return rows, starts, starts
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + WIDTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return rows[first], starts[first], starts[last] + WIDTH


class _Task:
    """Candidate windows of a task, decided as far as the task's own documents allow."""

    def __init__(self) -> None:
        self.columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        self.n = 0

    def add(self, batch: pa.RecordBatch, table: np.ndarray, bits: int) -> None:
        words, at, (h1, h2) = _row_windows(batch, 2)
        hit = np.ones(len(at), bool)
        for row in range(ROWS):
            cell = _cells(h1, row, bits).astype(np.int64) + (row << bits)
            hit &= (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        at, h1, h2 = at[hit], h1[hit], h2[hit]
        row = np.searchsorted(words.row, at, "right") - 1
        doc = np.array(batch.column(0).cast(pa.int64()).fill_null(NO_ID))
        key = np.array(batch.column(1))
        new = (doc[row], key[row], (at - words.row[row]).astype(np.int32), h1, (h2 >> np.uint64(32)).astype(np.uint32))
        for column, values in zip(self.columns, new):
            column.append(values)
        self.n += len(at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        joined = []
        for column in self.columns:  # one after the other, so that only one is held twice
            joined.append(np.concatenate(column))
            column.clear()
        doc, key, at, h1, h2 = joined
        del joined
        self.n = 0
        if not len(doc):
            return
        order = np.lexsort((doc, h2, h1))
        a, b, d = h1[order], h2[order], doc[order]
        head = np.ones(len(order), bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
        decided = np.zeros(len(order), bool)
        decided[order] = d > least
        del order, a, b, d, head, least
        # decided windows: as ranges of words of their document
        i = np.flatnonzero(decided)
        i = i[np.lexsort((at[i], key[i], doc[i]))]
        group = np.concatenate([[0], np.cumsum((doc[i][1:] != doc[i][:-1]) | (key[i][1:] != key[i][:-1]))]) if len(i) else i
        g, start, stop = _ranges(group, at[i])
        first = i[np.searchsorted(group, g)] if len(i) else i
        spread = tx.mix(doc[first].astype(np.uint64) ^ tx.mix(key[first].astype(np.uint64) + start.astype(np.uint64)))
        yield self._out(doc[first], key[first], start, pa.array(stop, pa.int32()), spread, spread.astype(np.uint32))
        j = np.flatnonzero(~decided)
        yield self._out(doc[j], key[j], at[j], pa.nulls(len(j), pa.int32()), h1[j], h2[j])

    @staticmethod
    def _out(doc, key, start, stop, h1, h2) -> pa.RecordBatch:
        return tx.batch(
            [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), stop, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32))],
            ["doc", "text_key", "start", "stop", "h1", "h2"],
        )


def with_keys(documents: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): the key tells rows with the same doc_id apart.

    It is 0 where no doc_id occurs twice. Else the rows are numbered and written, so every later
    reading gives a row the number it has.
    """
    rows = documents.select("doc_id", "text")
    if not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return rows.withColumn("text_key", F.lit(0).cast("byte"))  # held for each window: as small as can be
    return tx.durable(rows.withColumn("text_key", F.monotonically_increasing_id()), "numbered")


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """What to remove: (doc, text_key, starts of windows, word ranges). ``doc`` is never null."""
    spark = documents.sparkSession
    bits = sketch_bits(documents)
    shared = spark.sparkContext.broadcast(sketch(documents, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, table = _Task(), _table(shared, bits)
        for batch in batches:
            task.add(batch, table, bits)
            if task.n >= FRAGMENT:
                yield from task.flush()
        if task.n:
            yield from task.flush()

    keyed = documents.select("doc_id", "text_key", "text")
    found = keyed.mapInArrow(candidates, CANDIDATE_SCHEMA)
    # A decided range (it has a stop) stands alone under a random fingerprint and passes through.
    least = F.min("doc").over(Window.partitionBy("h1", "h2"))
    removed = found.withColumn("least", least).where(F.col("stop").isNotNull() | (F.col("doc") > F.col("least")))
    return removed.groupBy("doc", "text_key").agg(
        F.collect_list(F.when(F.col("stop").isNull(), F.col("start"))).alias("windows"),
        F.collect_list(F.when(F.col("stop").isNotNull(), F.struct("start", "stop"))).alias("ranges"),
    )


RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(with_text: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, removed, sha, kept_texts = [], [], [], []
        for text, windows, ranges in zip(tx.binary_column(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            parts = text.split()
            words.append(len(parts))
            if windows or ranges:
                keep = np.ones(len(parts), bool)
                for k in range(WIDTH if windows else 0):
                    keep[np.array(windows) + k] = False
                for r in ranges or ():
                    keep[r["start"] : r["stop"]] = False
                parts = [w for w, k in zip(parts, keep.tolist()) if k]
            removed.append(words[-1] - len(parts))
            kept = b" ".join(parts)
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode() if with_text else None)
        return tx.batch(
            [tx.ids_of(batch.column(0)), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    return run


def remove_repeats(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document: words, removed words, hash of the kept words and, if asked for, their text."""
    keyed = with_keys(documents)
    ranges = repeated_ranges(keyed).withColumnRenamed("text_key", "range_key")
    keyed = keyed.withColumn("doc_key", F.coalesce("doc_id", F.lit(int(NO_ID))))
    joined = keyed.join(ranges, (F.col("doc_key") == F.col("doc")) & (F.col("text_key") == F.col("range_key")), "left")
    return tx.arrow_map(joined.select("doc_id", "text", "windows", "ranges"), _cut(with_text), RESULT_SCHEMA)

