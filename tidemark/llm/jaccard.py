"""Near-duplicate join on word shingles: Jaccard similarity of five-word shingles of 0.8 or more.

1. Documents with the same words are one text from here on (the smallest doc_id stands for it).
2. 128 MinHash values a text, in 32 bands of four: texts that share a band meet. Two texts at the
   threshold miss each other with a chance below 1e-7.
3. Bayesian pruning: pairs that meet are compared 32 values at a time. After each step a pair
   goes if the posterior chance of reaching the threshold is below ``TOLERANCE`` (uniform
   prior: the chance of at most m successes in n + 1 trials). Survivors are not listed; each
   block of texts only says which of its texts hang together, and components follow from that.
4. Within each component shingle sets are compared exactly, which gives the links.

A bucket or component of any size is cut into blocks of ``BLOCK`` texts and compared block
against block, so no task holds more than two blocks, and no list of pairs is written.

Defined cases: fewer than five words make one shingle; a text without words has no shingles and
no link. Rows with a null doc_id have no class and no links. Repeated rows are copies of each
other; rows that share a doc_id but not the text fall in one class. Empty tables give no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.components import components

WIDTH = 5
HASHES, BAND, STEP = 128, 4, 32
BANDS = HASHES // BAND
NUMERATOR, DENOMINATOR = 4, 5  # similarity of at least 4 / 5
TOLERANCE = 1e-6
BLOCK = 1024
# Pairs compared at a time, rows of a matrix worked on at a time, and the shingles a text of a
# block has on average at most: longer texts make smaller blocks.
PAIRS, ROWS, SHINGLES = 65_536, 256, 2_000

_RNG = np.random.default_rng(20)
_FACTOR = (_RNG.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_ORDER = np.uint64(0xA0761D6478BD642F)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingle fingerprints of a document's word hashes, in order."""
    if 0 < len(hashes) < WIDTH:
        return tx.window_hashes(hashes, len(hashes))
    return np.unique(tx.window_hashes(hashes, WIDTH))


def minhash(found: np.ndarray) -> np.ndarray:
    """Low 16 bits of each of the MinHash values of a set."""
    values = found.astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(values), 4096):
        np.minimum(low, (values[None, i : i + 4096] * _FACTOR + _SHIFT).min(axis=1), out=low)
    return low.astype(np.uint16)


def _text_key(h: np.ndarray) -> int:
    """Fingerprint of a sequence of word hashes."""
    powers = np.multiply.accumulate(np.full(len(h), _ORDER))
    return int(tx.mix(np.array([(h * powers).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def _signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = tx.buffers(batch.column(1))
    words = tx.hash_words(raw, offsets, 2)
    k1, k2, sig = [], [], []
    for a, b in zip(words.row[:-1], words.row[1:]):
        h1, h2 = words.hashes[0][a:b], words.hashes[1][a:b]
        k1.append(_text_key(h1) if b > a else None)
        k2.append(_text_key(h2) if b > a else None)
        sig.append(minhash(shingles(h1)).tobytes() if b > a else None)
    return tx.batch(
        [tx.ids_of(batch.column(0)), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "k1", "k2", "sig"]
    )


def _bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)  # four 16-bit values
    keys = tx.mix(sig ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
    rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
    return tx.batch([pa.array(rep, pa.int64()), pa.array(keys.ravel().view(np.int64))], ["rep", "key"])


def least_matches() -> list[int]:
    """For each step, the fewest matching values with which a pair stays."""
    p = NUMERATOR / DENOMINATOR
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < TOLERANCE:
            m += 1
            chance += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


def _pairs(own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to compare in a group: all within one block, or those across two."""
    if lo == hi:
        i, j = np.triu_indices(len(own), 1)
        return i.astype(np.int32), j.astype(np.int32)
    i, j = np.flatnonzero(own == lo).astype(np.int32), np.flatnonzero(own == hi).astype(np.int32)
    return np.repeat(i, len(j)), np.tile(j, len(i))


def _surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the incremental comparison does not drop."""
    matches = np.zeros(len(i), np.int16)
    for step, fewest in enumerate(least):
        part = np.ascontiguousarray(sig[:, step * STEP : (step + 1) * STEP])
        for a in range(0, len(i), PAIRS):
            some = slice(a, a + PAIRS)
            matches[some] += (part[i[some]] == part[j[some]]).sum(axis=1, dtype=np.int16)
        keep = matches >= fewest
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` nodes is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _by_group(work, names: list[str]):
    """Run ``work(lo, hi, rows)`` for each run of rows with equal (key, lo, hi) of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, final: bool):
            key, lo, hi = (table.column(k).to_numpy() for k in ("key", "lo", "hi"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            edges = [0, *cut.tolist(), len(key)]
            whole = edges if final else edges[:-1]
            out = [work(int(lo[a]), int(hi[a]), table.slice(a, b - a)) for a, b in zip(whole[:-1], whole[1:]) if b - a > 1]
            return [x for x in out if x is not None], table.slice(whole[-1])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= BLOCK // 2:
                done, rest = groups(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                if done:
                    yield tx.batch([np.concatenate(c) for c in zip(*done)], names)
        if held:
            done, _ = groups(pa.Table.from_batches(held), True)
            if done:
                yield tx.batch([np.concatenate(c) for c in zip(*done)], names)

    return run


def _compare_block(lo: int, hi: int, rows: pa.Table):
    """Texts of a block that hang together after pruning: (rep, smallest rep)."""
    rep = rows.column("rep").to_numpy()
    order = np.argsort(rep, kind="stable")
    rep = rep[order]
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)[order]
    i, j = _surviving(sig, *_pairs(rows.column("own").to_numpy()[order], lo, hi), least_matches_once())
    if not len(i):
        return None
    root = _roots(len(rep), i, j)
    moved = root != np.arange(len(rep))
    return rep[moved], rep[root[moved]]


_LEAST: list[int] = []


def least_matches_once() -> list[int]:
    if not _LEAST:
        _LEAST.extend(least_matches())
    return _LEAST


def _verify_block(lo: int, hi: int, rows: pa.Table):
    """Exact links inside a block or across two: (rep, linked texts, linked documents, smallest linked rep)."""
    rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
    order = np.argsort(rep, kind="stable")
    rep, copies = rep[order], copies[order]
    own = rows.column("own").to_numpy()[order]
    sets = rows.column("shingles").to_pylist()
    sets = [np.frombuffer(sets[k], np.uint64) for k in order]
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], column[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    dense = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    width = 2048
    for a in range(0, int(dense[-1]) + 1 if len(dense) else 0, width):
        part = slice(*np.searchsorted(dense, [a, a + width]))
        grid = np.zeros((len(sets), width), np.float32)
        grid[row[part], dense[part] - a] = 1
        common += grid @ grid.T
    linked = np.zeros((len(sets), len(sets)), bool)
    for a in range(0, len(sets), ROWS):
        some = slice(a, a + ROWS)
        both = common[some].astype(np.int64)
        linked[some] = DENOMINATOR * both >= NUMERATOR * (size[some, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    if lo != hi:
        linked &= own[:, None] != own[None, :]
    has = linked.any(axis=1)
    if not has.any():
        return None
    docs = np.concatenate([linked[a : a + ROWS] @ copies for a in range(0, len(sets), ROWS)])
    return rep[has], linked.sum(axis=1)[has], docs[has], rep[_reached(linked)[has]]


def _reached(linked: np.ndarray) -> np.ndarray:
    """The smallest index each row of a matrix of links is connected to."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            near = np.zeros(len(linked), bool)
            for a in range(0, len(front), ROWS):
                near |= linked[front[a : a + ROWS]].any(axis=0)
            front = np.flatnonzero(near & (root < 0))
            root[front] = start
    return root


def _in_blocks(members: DataFrame, key: str, size: str, node: str) -> DataFrame:
    """Deal the members of each key over blocks and repeat each for the blocks it meets."""
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64(node), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    met = dealt.select("*", other)
    return met.select(F.col(key).alias("key"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", F.col(node).alias("rep"))


def _grouped(rows: DataFrame, work, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    keys = ["key", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_group(work, names), schema)


def _shingle_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Shingles of the rows whose words are the text's: other rows may share the doc_id."""
    root, rep, copies, key, text = batch.columns
    words = tx.hash_words(*tx.buffers(text))
    found = [words.hashes[0][a:b] for a, b in zip(words.row[:-1], words.row[1:])]
    same = [k for k, h in enumerate(found) if len(h) and _text_key(h) == key[k].as_py()]
    at = pa.array(same, pa.int64())
    sets = pa.array([shingles(found[k]).tobytes() for k in same], pa.binary())
    return tx.batch([root.take(at), rep.take(at), copies.take(at), sets], ["root", "rep", "copies", "shingles"])


def similar_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document its text key, and per text (k1, k2): rep, copies, class_id, links."""
    signed = tx.durable(tx.arrow_map(documents.select("doc_id", "text"), _signatures, "doc_id long, k1 long, k2 long, sig binary"), "signatures")
    eligible = signed.where(F.col("doc_id").isNotNull() & F.col("k1").isNotNull())
    # The signature follows from the words, so any of the copies' will do.
    texts = eligible.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig"))
    texts = tx.durable(texts, "texts")
    bands = tx.arrow_map(texts.select("rep", "sig"), _bands, "rep long, key long")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = tx.durable(bands.join(shared, "key"), "band-members")
    blocks = _in_blocks(members, "key", "n", "rep").join(texts.select("rep", "sig"), "rep")
    met = _grouped(blocks, _compare_block, "rep long, root long")
    groups = tx.durable(components(met, "rep", "root"), "candidates")
    of_text = texts.select("rep", "copies", "k1")
    with_text = (
        groups.select("root", F.col("node").alias("rep")).join(of_text, "rep")
        .join(documents.select(F.col("doc_id").alias("rep"), "text"), "rep").select("root", "rep", "copies", "k1", "text")
    )
    sets = tx.arrow_map(with_text, _shingle_sets, "root long, rep long, copies long, shingles binary")
    if signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = sets.distinct()  # repeated rows
    sets = tx.durable(sets, "shingle-sets")
    mean = F.ceil(F.sum(F.octet_length("shingles")) / F.lit(8 * SHINGLES))
    sizes = sets.groupBy("root").agg(F.greatest(F.count(F.lit(1)), mean).alias("n"))
    placed = _in_blocks(sets.select("root", "rep").join(sizes, "root"), "root", "n", "rep")
    compared = placed.join(sets.select("rep", "copies", "shingles"), "rep")
    found = tx.durable(_grouped(compared, _verify_block, "rep long, texts long, docs long, root long"), "links")
    classes = components(found, "rep", "root").withColumnsRenamed({"node": "rep", "root": "class_id"})
    counts = found.groupBy("rep").agg(F.sum("texts").alias("n_text_links"), F.sum("docs").alias("n_doc_links"))
    known = (
        texts.select("k1", "k2", "rep", "copies").join(classes, "rep", "left").join(counts, "rep", "left")
        .select(
            "k1", "k2", "rep", "copies", F.coalesce("class_id", "rep").alias("class_id"),
            F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
            (F.col("copies") - 1 + F.coalesce("n_doc_links", F.lit(0))).alias("n_links"),
        )
    )
    return signed, known


def _classed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and per document its text key, its class and its links."""
    signed, known = similar_texts(documents)
    able = F.col("doc_id").isNotNull() & F.col("k1").isNotNull()
    names = ["doc_id", "k1", "k2", "class_id"]
    rows = signed.where(able).join(known, ["k1", "k2"]).select(*names, F.col("rep").alias("copy_of"), F.col("copies").alias("n_copies"), "n_links", "n_text_links")
    zero, one, own = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("doc_id")
    alone = signed.where(~able).select(*names[:3], own.alias("class_id"), own.alias("copy_of"), one.alias("n_copies"), zero.alias("n_links"), zero.alias("n_text_links"))
    return signed, rows.unionByName(alone)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: its class (the smallest doc_id in it), the document its exact copies
    are named by, their number, linked documents, and linked texts other than its own."""
    return _classed(documents)[1].drop("k1", "k2")


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = tx.hash_words(*tx.buffers(batch.column(2)), 2)
    keys = [[_text_key(h[a:b]) if b > a else None for a, b in zip(words.row[:-1], words.row[1:])] for h in words.hashes]
    return tx.batch([batch.column(0), batch.column(1), *[pa.array(k, pa.int64()) for k in keys]], ["row", "doc_id", "k1", "k2"])


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents with one of each class left, the one with the smallest doc_id.

    Rows without a doc_id have no class and stay. Of different texts that share a doc_id only one
    that is in the class of that id stays, the one with most links; a row without words is apart."""
    signed, classed = _classed(documents)
    text = F.when(F.col("k1").isNotNull(), F.struct((-F.col("n_links")).alias("fewer"), "k1", "k2"))
    kept = classed.where(F.col("doc_id") == F.col("class_id")).groupBy("doc_id").agg(F.min(text).alias("best"))
    kept = tx.durable(kept.select("doc_id", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2")), "kept")
    # The same join at every size: a small list of ids is not broadcast.
    named = documents.where(F.col("doc_id").isNotNull()).join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        packed = named.select(F.struct(*documents.columns).alias("row"), "doc_id", "text")
        schema = packed.select("row", "doc_id", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2")).schema
        keyed = tx.arrow_map(packed, _keyed, schema).join(kept.hint("merge"), "doc_id")
        keyed = keyed.where("k1 is null or (k1 = b1 and k2 = b2)").dropDuplicates(["doc_id", "k1", "k2"])
        named = keyed.select(*[F.col("row").getField(n).alias(n) for n in documents.columns])
    return named.unionByName(documents.where(F.col("doc_id").isNull())).select(*documents.columns)
