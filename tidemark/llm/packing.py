"""Packing documents into sequences of bounded length, certified by lower bounds.

Documents longer than a sequence are cut into full pieces behind one shorter first piece; full
pieces are sequences of their own. All other pieces are dealt over buckets and packed there by
best-fit decreasing. Dual-feasible functions of each bucket's sizes give a number of sequences
that no packing of them can go below: a bucket that meets its bound is certified. While there is
more than one bucket, certified ones give up the documents of the sequences that are not full, whose
room adds up over the buckets; buckets with a gap give up one in ``GIVEN`` of their full
sequences as well, those of the most pieces, for small pieces fill holes. These documents are exchanged,
dealt anew over fewer buckets and packed again, until one bucket holds what is left.

Only (doc_id, length, checksum) rows are moved, never text or ids. A bucket has a
bounded number of pieces however many documents there are.

Defined cases: a null or empty text has only the end id. Repeated rows and null ids are
documents of their own. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import encoders
from tidemark.llm import text as tx

CAPACITY = 2048
# Pieces packed together in the first round; twice as many in each later one, up to the limit.
BUCKET, BUCKET_LIMIT = 4096, 1 << 19
GIVEN = 16
MAX_ROUNDS = 12
PIECE_SCHEMA = "doc_id long, pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
PACKED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, seq long, offset long"


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document: all full but the first, which may be shorter."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return [head] * bool(head) + [capacity] * (n // capacity)


def pieces(documents: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for ids in encoders.load(tokenizer, kind).encode(batch.column(1).to_pylist()):
            wide = np.frombuffer(ids + end, "<u2").astype("<u4")
            rows, at = [], 0
            for k, n in enumerate(cut_lengths(len(wide), capacity)):
                rows.append({"piece": k, "start": at, "length": n, "ids_crc32": zlib.crc32(wide[at : at + n].tobytes())})
                at += n
            out.append(rows)
        kind_of = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return tx.batch([tx.ids_of(batch.column(0)), pa.array(out, kind_of)], ["doc_id", "pieces"])

    found = tx.arrow_map(documents.select("doc_id", "text"), run, PIECE_SCHEMA)
    return found.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32")


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most sequences that some dual-feasible function proves necessary.

    Two families: thresholds t up to half a sequence (pieces above capacity - t count as a whole
    sequence, those below t as nothing), and rounding to k-th parts of a sequence.
    """
    return histogram_bound(np.bincount(sizes, minlength=capacity + 1)) if len(sizes) else 0


def histogram_bound(count: np.ndarray) -> int:
    """The same for the number of pieces of each size from 0 to the capacity."""
    capacity, count = len(count) - 1, count.astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    half = capacity // 2
    n_above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])  # pieces of at least this size
    sum_above = np.concatenate([np.cumsum((count * size)[::-1])[::-1], [0]])
    for t in np.flatnonzero(count[: half + 1]):
        top = capacity - int(t) + 1
        whole = int(n_above[top])
        weight = int(sum_above[t] - sum_above[top])
        large = int(n_above[half + 1] - n_above[max(top, half + 1)])
        best = max(best, whole + large + max(0, -(-(weight - large * capacity) // capacity)))
    for k in range(1, 33):
        parts = (k + 1) * size
        value = np.where(parts % capacity == 0, parts * k, (parts // capacity) * capacity * (k + 1))
        # in units of 1 / (capacity * k * (k + 1)); exact parts keep their own share
        best = max(best, -(-int((count * value).sum()) // (capacity * k * (k + 1))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the room left in each sequence.

    Sequences are kept by their room; bit r of a number is set while some sequence has room r, so
    the tightest that fits is the lowest set bit from the piece's size on.
    """
    seq, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, filled = 0, 0
    room_of: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            b, r = filled, capacity
            filled += 1
            room_of.append(capacity)
        seq[i], offset[i] = b, capacity - r
        room_of[b] = r - s
        by_room[r - s].append(b)
        if r - s:
            rooms |= 1 << (r - s)
    return seq, offset, np.array(room_of, np.int64)


def _pack_bucket(last: bool, capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        seq, offset, room = best_fit_decreasing(sizes, capacity)
        given_up = np.zeros(len(room), bool)
        if not last:
            given_up = room > 0
            if len(room) > lower_bound(sizes, capacity):
                full = np.flatnonzero(room == 0)
                most = np.argsort(-np.bincount(seq)[full], kind="stable")[: -(-len(full) // GIVEN)]
                given_up[full[most]] = True
        free = given_up[seq]
        ids = key[0].as_py() * (1 << 32) + seq
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.table(
            [table.column(n) for n in names] + [pa.array(ids, pa.int64(), mask=free), pa.array(offset, pa.int64(), mask=free)],
            names=[*names, "seq", "offset"],
        )

    return run


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces: adds sequence_id and offset. ``found`` is a written table of pieces."""
    spark = found.sparkSession
    row = F.monotonically_increasing_id()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = [
        found.where(F.col("length") >= capacity).withColumns({"seq": -1 - row, "offset": F.lit(0).cast("long")}).select(*columns, "seq", "offset")
    ]
    todo = found.where(F.col("length") < capacity)
    n = todo.count()
    for round_no in range(MAX_ROUNDS):
        if not n:
            break
        buckets = -(-n // min(BUCKET << round_no, BUCKET_LIMIT))
        last = buckets == 1 or round_no == MAX_ROUNDS - 1
        dealt = todo.withColumn("bucket", F.pmod(F.xxhash64(row, F.lit(round_no)), F.lit(buckets)) + F.lit(round_no << 24).cast("long"))
        packed = dealt.select("bucket", *columns).groupBy("bucket").applyInArrow(_pack_bucket(last, capacity), PACKED_SCHEMA)
        packed = tx.durable(packed, f"packed-{round_no}")
        done.append(packed.where(F.col("seq").isNotNull()))
        if last:
            break
        todo = tx.durable(packed.where(F.col("seq").isNull()).select(*columns), f"exchange-{round_no}")
        n = todo.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, F.col("seq").alias("sequence_id"), "offset")


def pack_documents(documents: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(tx.durable(pieces(documents, tokenizer, kind, end_id, capacity), "pieces"), capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Sequences used, and how many no packing of these pieces can go below.

    The bound needs the number of pieces of each length only: at most ``capacity`` rows.
    """
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        count[r["length"]] = r["n"]
    # every sequence has one piece at its start
    used = packed.where(F.col("offset") == 0).count()
    return {"sequences": used, "lower_bound": histogram_bound(count) if count.any() else 0}
