"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0: most frequent), and each rank takes one to four
bytes. Lengths sit apart in control bytes, two bits an id, so that a block is decoded without a
loop: control bytes select rows of a 256-row table of lengths, running sums give the place of
each id, and numpy gathers the bytes.

A dataset is a folder of two tables in the shared folder: ``shards`` has one record per block
(part, block, tokens before it in its part, image), in ascending doc_id order over parts and
blocks; ``ranks`` has the id of each rank. Parts are written by Spark's own committer, so a lost
task leaves nothing behind. A block image is

    b"TVB1", documents (4 bytes), ids (8), then for each document: has an id (1 byte),
    doc_id (8), ids (4); control bytes; data bytes. All little-endian.

Defined cases: a null or empty text has only the end id. A null doc_id sorts last; rows with the
same doc_id follow each other by their ids, and each keeps its own entry. An empty table gives a
dataset without blocks and no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import encoders
from tidemark.llm import text as tx

MAGIC = b"TVB1"
BLOCK_IDS = 1_000_000  # ids in a block, unless one document has more
VOCABULARY = 1 << 16
TOKENS_SCHEMA = "doc_id long, ids binary, id long, n long"
HEADER, ENTRY = struct.Struct("<4sIQ"), np.dtype([("has", "u1"), ("doc", "<i8"), ("n", "<u4")])

# Row c: the byte lengths of the four ids a control byte describes.
LENGTHS = np.stack([((np.arange(256) >> (2 * k)) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def encode_values(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes, of unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    sizes = codes[: len(values)]
    widths = [w for w in (1, 2, 3) if len(values) and int(values.max()) >> (8 * w)]
    for w in widths:
        sizes += values >= np.uint32(1 << (8 * w))
    control = codes[0::4] | (codes[1::4] << 2) | (codes[2::4] << 4) | (codes[3::4] << 6)
    begin = np.arange(len(values), dtype=np.int64)
    begin[1:] += np.cumsum(sizes[:-1], dtype=np.int64)
    data = np.empty(len(values) + int(sizes.sum(dtype=np.int64)), np.uint8)
    data[begin] = values
    for w in widths:
        longer = np.flatnonzero(sizes >= w)
        data[begin[longer] + w] = values[longer] >> np.uint32(8 * w)
    return control.tobytes() + data.tobytes()


def decode_values(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    """The ``n`` values whose control bytes start at ``at``."""
    n_control = -(-n // 4)
    control = np.frombuffer(raw, np.uint8, n_control, at)
    sizes = LENGTHS[control].reshape(-1)[:n]
    if not n:
        return np.zeros(0, np.uint32)
    begin = np.zeros(n, np.int64)
    np.cumsum(sizes[:-1], dtype=np.int64, out=begin[1:])
    data = np.frombuffer(raw, np.uint8, -1, at + n_control)
    out = data[begin].astype(np.uint32)
    for w in (1, 2, 3):
        longer = np.flatnonzero(sizes > w)
        if not len(longer):
            break
        out[longer] |= data[begin[longer] + w].astype(np.uint32) << np.uint32(8 * w)
    return out


def write_block(docs: list[int | None], ranks: list[np.ndarray]) -> bytes:
    """The image of a block."""
    entries = np.zeros(len(docs), ENTRY)
    entries["has"] = [d is not None for d in docs]
    entries["doc"] = [d or 0 for d in docs]
    entries["n"] = [len(r) for r in ranks]
    values = np.concatenate(ranks)
    return HEADER.pack(MAGIC, len(docs), len(values)) + entries.tobytes() + encode_values(values)


def read_block(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their numbers of ids, and all ranks of a block image."""
    magic, n_docs, n_ids = HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token block")
    entries = np.frombuffer(image, ENTRY, n_docs, HEADER.size)
    docs = [int(d) if has else None for has, d in zip(entries["has"], entries["doc"])]
    return docs, entries["n"].astype(np.int64), decode_values(image, n_ids, HEADER.size + n_docs * ENTRY.itemsize)


def tokenize(documents: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """``ids``: little-endian 16-bit ids of each whole text with the end id, and its ``doc_id``.

    After its documents each task adds rows with its own ``counts`` of ids, at most one for each
    id of the vocabulary.
    """
    end = np.array([end_id], "<u2").tobytes()
    names = ["doc_id", "ids", "id", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            found = [x + end for x in encoders.load(tokenizer, kind).encode(batch.column(1).to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(found), "<u2"), minlength=VOCABULARY)
            none = pa.nulls(len(found), pa.int64())
            yield tx.batch([tx.ids_of(batch.column(0)), pa.array(found, pa.binary()), none, none], names)
        seen = np.flatnonzero(total)
        yield tx.batch([pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.binary()), pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names)

    return documents.select("doc_id", "text").mapInArrow(run, TOKENS_SCHEMA)


def rank_table(counts: DataFrame) -> np.ndarray:
    """Ids by falling count, then rising id, from the tasks' counts; at most 65,536 rows."""
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(VOCABULARY).collect()
    return np.array([r["id"] for r in rows], np.int64)


def write(documents: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1) -> str:
    """Write a dataset of all documents; returns its folder."""
    spark = documents.sparkSession
    path = tx.scratch_path(spark, "token-files")
    tokens_path = f"{path}/tokens"
    tokenize(documents, tokenizer, kind, end_id).write.option("compression", "zstd").parquet(tokens_path)
    written = spark.read.schema(TOKENS_SCHEMA).parquet(tokens_path)
    by_rank = rank_table(written.where("id is not null").select("id", "n"))
    tokens = written.where("id is null").select("doc_id", "ids")
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(VOCABULARY, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        ranks: list = []
        held = 0

        def image() -> pa.RecordBatch:
            return tx.batch(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([write_block(docs, ranks)], pa.binary())],
                ["part", "block", "before", "n_ids", "image"],
            )

        for batch in batches:
            found = batch.column(1).to_pylist()
            sizes = [len(x) // 2 for x in found]
            ends = np.cumsum(sizes).tolist()
            all_ranks = rank[np.frombuffer(b"".join(found), "<u2")]
            for doc, n, at in zip(batch.column(0).to_pylist(), sizes, ends):
                docs.append(doc)
                ranks.append(all_ranks[at - n : at])
                held += n
                if held >= BLOCK_IDS:
                    yield image()
                    before, block, docs, ranks, held = before + held, block + 1, [], [], 0
        if docs:
            yield image()

    ordered = tokens.repartitionByRange(F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"), "ids")
    images = ordered.mapInArrow(pack, "part int, block int, before long, n_ids long, image binary")
    images.write.option("compression", "uncompressed").parquet(f"{path}/shards")
    return path


def read(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """Documents of a dataset: doc_id, start, n_tokens and ids_crc32, or with ``ids`` as an array.

    ``start`` adds the ids of all earlier parts: one number for each part, so the joined side is
    no larger than the number of files.
    """
    shards = spark.read.schema("part int, block int, before long, n_ids long, image binary").parquet(f"{path}/shards")
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").limit(VOCABULARY).collect()], "<u4")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(bases), F.col("part") == F.col("of_part")).select((F.col("base") + F.col("before")).alias("start"), "image")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, sizes, ranks = read_block(batch.column(1)[k].as_buffer())
                ids = by_rank[ranks] if len(ranks) else ranks
                ends = np.cumsum(sizes)
                starts = batch.column(0)[k].as_py() + ends - sizes
                cuts = list(zip((ends - sizes).tolist(), ends.tolist()))
                last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64()) if digest else pa.array([ids[a:b].astype(np.int64) for a, b in cuts], pa.list_(pa.int64()))
                yield tx.batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
