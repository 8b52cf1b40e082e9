"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared as lower-case runs of letters and digits. A document and
an item are candidates when they share a seed of ``SEED`` tokens. Tiling then marks the longest
match between unmarked tokens of both, again and again down to ``SEED`` tokens; windows of the
current length are looked up by their running hash. Because tiles may stand in any order, a
passage whose sentences were moved around is covered as well as a verbatim one. A document is
contaminated when the tiles cover at least ``COVERAGE`` of an item. Several texts under one id are
items of their own, and the best of them counts.

A benchmark of up to ``BROADCAST_BYTES`` of text goes to every task. A larger one is joined by
seed hashes instead, so neither side has to fit anywhere; results are the same.

Defined cases: a null or empty text, and an item of fewer than ``SEED`` tokens or with a null
id, match nothing. Of equally covered items the smallest item_id is named; repeated items count
once. Rows are independent: repeated rows give repeated results, a null doc_id stays null. Empty
tables give no rows, or no contaminated ones. Only the id and ``text`` columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

SEED = 5
COVERAGE = 0.5
BROADCAST_BYTES = 64 << 20
RESULT = "doc_id long, contaminated boolean, item_id long, coverage double, item_ids array<long>"

SEPARATORS = np.ones(256, bool)
SEPARATORS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = False
SEPARATORS[128:] = False


def tokens_of(column: pa.Array) -> tx.Words:
    """Token hashes of the rows of a text column."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    return tx.hash_words(*tx.buffers(lowered), 1, SEPARATORS)


class _Tokens:
    """Tokens of one side: which are unmarked, and running hashes of their windows."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.tokens, self.free = tokens, np.ones(len(tokens), bool)
        power, inverse = _powers(len(tokens))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * power, dtype=np.uint64)])
        self.inverse = inverse

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``width`` unmarked tokens follow each other, and their hashes."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[width:] == marked[: len(marked) - width])
        return at, (self.sums[at + width] - self.sums[at]) * self.inverse[at]

    def longest_run(self) -> int:
        edges = np.flatnonzero(np.concatenate([[True], ~self.free, [True]]))
        return int(np.diff(edges).max()) - 1

    def mark(self, at: int, width: int) -> None:
        self.free[at : at + width] = False


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        for x in (base, pow(base, -1, 1 << 64)):
            series = np.full(max(2 * n, 4096), x, np.uint64)
            series[0] = 1
            _POWERS.append(np.multiply.accumulate(series))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def _longest(doc: _Tokens, item: _Tokens, shortest: int, longest: int) -> int:
    """Length of the longest match of unmarked tokens, or less than ``shortest``; found by bisection."""
    low, high = shortest - 1, longest
    while low < high:
        width = (low + high + 1) // 2
        if np.isin(doc.windows(width)[1], item.windows(width)[1]).any():
            low = width
        else:
            high = width - 1
    return low


def tile(doc: np.ndarray, item: np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, length): always a longest match of unmarked
    tokens, of several the first in the document and then in the item.

    Places are never paired: matches of the greatest length are met in one walk over the
    document, and the places of a window in the item are used up from left to right.
    """
    left, right = _Tokens(doc), _Tokens(item)
    tiles: list[tuple[int, int, int]] = []
    width = min(len(doc), len(item))
    while True:
        width = _longest(left, right, shortest, min(width, left.longest_run(), right.longest_run()))
        if width < shortest:
            return tiles
        at_item, in_item = right.windows(width)
        at_doc, in_doc = left.windows(width)
        order = np.argsort(in_item, kind="stable")
        at_item, in_item = at_item[order], in_item[order]
        hit = np.isin(in_doc, in_item)
        at_doc, in_doc = at_doc[hit], in_doc[hit]
        first = np.searchsorted(in_item, in_doc, "left").tolist()
        last = np.searchsorted(in_item, in_doc, "right").tolist()
        places, used, end, marked = at_item.tolist(), {}, 0, False
        for i, a, b in zip(at_doc.tolist(), first, last):
            if i < end:
                continue  # inside the tile just made
            k = used.get(a, a)
            while k < b and not (right.free[places[k]] and right.free[places[k] + width - 1]):
                k += 1
            used[a] = k
            if k < b and (doc[i : i + width] == item[places[k] : places[k] + width]).all():
                left.mark(i, width)
                right.mark(places[k], width)
                tiles.append((i, places[k], width))
                end, marked = i + width, True
        if not marked:
            width -= 1  # equal hashes of different windows


@dataclass
class Benchmark:
    """Items as token hashes, and the items that hold each seed."""

    ids: np.ndarray
    tokens: list[np.ndarray]
    seeds: np.ndarray
    holders: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str]) -> Benchmark:
        words = tokens_of(pa.array(texts, pa.string()))
        tokens = [words.hashes[0][a:b] for a, b in zip(words.row[:-1], words.row[1:])]
        pairs = [(np.unique(tx.window_hashes(t, SEED)), k) for k, t in enumerate(tokens)]
        seeds = np.concatenate([s for s, _ in pairs] or [np.zeros(0, np.uint64)])
        holders = np.concatenate([np.full(len(s), k) for s, k in pairs] or [np.zeros(0, np.int64)])
        order = np.argsort(seeds, kind="stable")
        return Benchmark(np.array(ids, np.int64), tokens, seeds[order], holders[order])

    def holders_of(self, found: np.ndarray) -> np.ndarray:
        """Items that hold any of these seeds."""
        a, b = np.searchsorted(self.seeds, found), np.searchsorted(self.seeds, found, "right")
        return np.unique(np.concatenate([self.holders[x:y] for x, y in zip(a, b)] or [np.zeros(0, np.int64)]))


def covered(doc: np.ndarray, item: np.ndarray) -> float:
    """Part of an item's tokens that tiles cover."""
    return sum(n for _, _, n in tile(doc, item)) / len(item) if len(item) else 0.0


def _verdict(best: list[tuple[float, int]]) -> tuple:
    """contaminated, item_id, coverage and all items over the threshold, from (coverage, id) pairs."""
    if not best:
        return False, None, 0.0, []
    top = min(best, key=lambda x: (-x[0], x[1]))
    over = sorted({k for c, k in best if c >= COVERAGE})
    return bool(over), top[1], top[0], over


def _judge(shared) -> object:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bench: Benchmark = shared.value
        words = tokens_of(batch.column(1))
        seeds = tx.window_hashes(words.hashes[0], SEED)
        hit = np.flatnonzero(np.isin(seeds, bench.seeds))
        row = np.searchsorted(words.row, hit, "right") - 1
        inside = hit + SEED <= words.row[row + 1]
        hit, row = hit[inside], row[inside]
        found = [(False, None, 0.0, [])] * batch.num_rows
        for r in np.unique(row).tolist():
            doc = words.hashes[0][words.row[r] : words.row[r + 1]]
            items = bench.holders_of(np.unique(seeds[hit[row == r]]))
            found[r] = _verdict([(covered(doc, bench.tokens[k]), int(bench.ids[k])) for k in items.tolist()])
        columns = list(zip(*found))
        return tx.batch(
            [tx.ids_of(batch.column(0)), pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.list_(pa.int64()))],
            ["doc_id", "contaminated", "item_id", "coverage", "item_ids"],
        )

    return run


def _seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, seed) of each row, each seed once."""
    words = tokens_of(batch.column(1))
    keys, out = [], []
    for key, a, b in zip(batch.column(0).to_pylist(), words.row[:-1], words.row[1:]):
        found = np.unique(tx.window_hashes(words.hashes[0][a:b], SEED))
        keys.append(np.full(len(found), key))
        out.append(found)
    return tx.batch([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(out).view(np.int64))], ["key", "seed"])


def _cover_pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    docs, items = tokens_of(batch.column(2)), tokens_of(batch.column(3))
    found = [covered(docs.hashes[0][a:b], items.hashes[0][c:d]) for a, b, c, d in zip(docs.row[:-1], docs.row[1:], items.row[:-1], items.row[1:])]
    return tx.batch([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["key", "item_id", "coverage"])


def _by_join(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: seeds, candidates and texts meet in joins."""
    keyed = tx.durable(documents.withColumn("key", F.monotonically_increasing_id()), "documents")
    left = tx.arrow_map(keyed.select("key", "text"), _seeds, "key long, seed long")
    # an id may have several texts, each an item of its own
    items = tx.durable(items.withColumn("item_key", F.monotonically_increasing_id()), "items")
    right = tx.arrow_map(items.select("item_key", "item_text"), _seeds, "key long, seed long").withColumnRenamed("key", "item_key")
    pairs = left.join(right, "seed").select("key", "item_key").distinct()
    texts = pairs.join(keyed.select("key", "text"), "key").join(items, "item_key").select("key", "item_id", "text", "item_text")
    best = tx.arrow_map(texts, _cover_pairs, "key long, item_id long, coverage double").groupBy("key").agg(
        F.max(F.struct("coverage", (-F.col("item_id")).alias("neg"))).alias("top"),
        F.sort_array(F.collect_set(F.when(F.col("coverage") >= COVERAGE, F.col("item_id")))).alias("item_ids"),
    )
    return keyed.select("key", "doc_id").join(best, "key", "left").select(
        "doc_id", (F.coalesce(F.size("item_ids"), F.lit(0)) > 0).alias("contaminated"), (-F.col("top.neg")).alias("item_id"),
        F.coalesce("top.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
    )


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").alias("item_text")).distinct()


def _shared(items: DataFrame, limit: int):
    """The benchmark for every task, or None where it is larger than the limit."""
    size = items.agg(F.sum(F.octet_length("item_text") + 16).alias("n")).first()["n"] or 0
    if size > limit:
        return None
    rows = items.orderBy("item_id", "item_text").collect()  # its size was just checked
    return items.sparkSession.sparkContext.broadcast(Benchmark.of([r["item_id"] for r in rows], [r["item_text"] for r in rows]))


def check(documents: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: contaminated, the best covered item, its coverage, all items over the threshold."""
    items, documents = _items(benchmark), documents.select("doc_id", "text")
    shared = _shared(items, broadcast_bytes)
    return tx.arrow_map(documents, _judge(shared), RESULT) if shared else _by_join(documents, items)


def clean(documents: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    items = _items(benchmark)
    shared = _shared(items, broadcast_bytes)
    if shared:
        judge, names = _judge(shared), documents.columns

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = judge(tx.batch([batch.column(names.index("doc_id")), batch.column(names.index("text"))], ["doc_id", "text"]))
            return batch.filter(pc.invert(seen.column(1)))

        return tx.arrow_map(documents, run, documents.schema)
    names = documents.columns
    keyed = tx.durable(documents.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*names).alias("row")), "documents")
    bad = _by_join(keyed.select(F.col("row_key").alias("doc_id"), "row.text"), items).where("contaminated").select(F.col("doc_id").alias("row_key"))
    return keyed.join(bad, "row_key", "left_anti").select("row.*")
