"""Merkle manifest of a dataset: a postorder log of hash trees, and proofs out of it.

Each row of the table is a leaf; the leaves of one tree follow each other by their key. While
more than one node remains, every ``FANOUT`` consecutive ones become their parent, the hash of
their digests; the roots of all trees are the leaves of a last tree in the same way.

Builders work on aligned blocks of ``BLOCK = FANOUT ** DEPTH`` leaves and append each node when it
is complete, children first: a log in postorder. The node at level l, index i of a tree of n
leaves, over the leaves from m = i * FANOUT ** l on, stands at

    sum over j >= 0 of floor(m / FANOUT ** j)  +  sum over j <= l of ceil(c / FANOUT ** j)  -  1

where c = min(FANOUT ** l, n - m): the nodes complete before it, and its own subtree. So the place of
any sibling is computed, never searched. The tops of the blocks are the leaves of the next tier
of builders, until a tree has one block; each tier is a written table of one row a block, which also
holds the keys of its leaves. Proofs go the other way: a block's proof, a row for each block, is
joined to the block of the tier below, whose task adds the siblings inside the block. No task
holds more than a block, however many leaves a tree has, and no leaf row moves more than twice.

Defined cases: a null field is hashed as ``-``; a null key sorts first; rows of one key follow
each other by their digests; repeated rows are leaves of their own. An empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import text as tx

FANOUT, DEPTH = 16, 2
BLOCK = FANOUT**DEPTH
HEX = 64  # characters of a digest
STEP = "struct<before:string,after:string>"


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(",") if c.strip()]


def _columns(*columns: str) -> str:
    return ", ".join(c for c in columns if c)


def field(value: Column) -> Column:
    """A field as it is hashed: its UTF-8 byte count and itself, or ``-``."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def level_sizes(n: int, levels: int | None = None) -> list[int]:
    """Nodes of each level over n leaves: up to the root, or a given number of levels."""
    out = [n]
    while (out[-1] > 1) if levels is None else (len(out) <= levels):
        out.append(-(-out[-1] // FANOUT))
    return out


def position(level: int, index: np.ndarray, n: int) -> np.ndarray:
    """Places of nodes of one level in the postorder log of n leaves."""
    m = index.astype(np.int64) * FANOUT**level
    c = np.minimum(FANOUT**level, n - m)
    place = np.full(len(m), -1, np.int64)
    for j in range(max(n, 1).bit_length()):
        place += m // FANOUT**j
        if j <= level:
            place += -(-c // FANOUT**j)
    return place


class LogBuilder:
    """Appends the leaves of a block, and each parent as soon as its run is complete."""

    def __init__(self) -> None:
        self.log: list[str] = []
        self.open: list[list[str]] = [[]]  # digests of the last, unfinished run of each level

    def append(self, digest: str, level: int = 0) -> None:
        self.log.append(digest)
        run = self.open[level]
        run.append(digest)
        if len(run) == FANOUT and level < DEPTH:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        if len(self.open) == level + 1:
            self.open.append([])
        self.append(sha256("".join(run).encode()).hexdigest(), level + 1)

    def finish(self, levels: int) -> str:
        """Close the unfinished runs below the top level; the log."""
        for level in range(levels):
            if self.open[level]:
                self._close(level)
        return "".join(self.log)


def levels_of(n: int, count: int) -> int:
    """Levels above the leaves of a block of ``count`` leaves in a tree of ``n``."""
    return DEPTH if n > BLOCK else len(level_sizes(count)) - 1


def build_tier(nodes: DataFrame, carried: str) -> DataFrame:
    """One row a block out of (tree, n, index, digest) and the ``carried`` columns of its leaves.

    ``log`` is the block's postorder log as joined digests; its last one is the block's top. Each
    carried column becomes an array in the order of the leaves.
    """
    names = _names(carried)
    schema = _columns("tree string, n long, block long, log string", *(f"{c.split()[0]} array<{c.split()[1]}>" for c in carried.split(",") if c.strip()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def record() -> pa.RecordBatch:
            tree, n, block = held
            table = pa.Table.from_batches(rows)
            builder = LogBuilder()
            for digest in table.column("digest").to_pylist():
                builder.append(digest)
            log = builder.finish(levels_of(n, table.num_rows))
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in names]
            return tx.batch([pa.array([tree]), pa.array([n], pa.int64()), pa.array([block], pa.int64()), pa.array([log]), *lists], ["tree", "n", "block", "log", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("tree").to_pylist(), batch.column("n").to_pylist(), batch.column("block").to_pylist()))
            begin = 0
            for at in range(1, len(keys) + 1):
                if at < len(keys) and keys[at] == keys[begin]:
                    continue
                if rows and keys[begin] != held:
                    yield record()
                    rows = []
                held = keys[begin]
                rows.append(batch.slice(begin, at - begin))
                begin = at
        if rows:
            yield record()

    blocks = nodes.withColumn("block", F.floor(F.col("index") / BLOCK).cast("long"))
    sorted_blocks = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    return sorted_blocks.select("tree", "n", "block", "digest", *names).mapInArrow(run, schema)


def number_rows(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Adds ``n``, the rows of a tree, and ``index``, the place of a row in it.

    The rows are dealt by ranges of (tree, order) and sorted there, so a tree of any size is spread;
    only the number of rows of each (part, tree) is added up over the parts, which has no more rows
    than there are parts and trees.
    """
    keys = [F.asc_nulls_first(c) for c in (tree, *order)]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    row_id = F.monotonically_increasing_id()
    placed = tx.durable(sorted_rows.withColumns({"part": F.shiftright(row_id, 33), "row": row_id}), f"{name}-sorted")
    counts = placed.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"))
    whole = Window.partitionBy(tree)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col(tree).alias("of_tree"), F.col("part").alias("of_part"), F.sum("rows").over(whole).alias("n"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    found = placed.join(bases, (F.col(tree) == F.col("of_tree")) & (F.col("part") == F.col("of_part")))
    return found.withColumn("index", F.col("row") + F.col("shift")).drop("of_tree", "of_part", "shift", "part", "row")


class Manifest:
    """The log of a dataset: written tiers of the trees, and of the last tree over their roots."""

    def __init__(self, tiers: list[DataFrame], top: list[DataFrame], root: DataFrame) -> None:
        self.tiers, self.top, self.root = tiers, top, root


def _build_tiers(nodes: DataFrame, carried: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tiers from the leaves on, and the root of each tree as (tree, digest)."""
    tiers, roots = [], None
    while True:
        tier = tx.durable(build_tier(nodes, carried if not tiers else ""), f"{name}-{len(tiers)}")
        tiers.append(tier)
        tops = tier.select("tree", "n", F.col("block").alias("index"), F.substring("log", -HEX, HEX).alias("digest"))
        done = tops.where(F.col("n") <= BLOCK).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        nodes = tops.where(F.col("n") > BLOCK).withColumn("n", F.ceil(F.col("n") / BLOCK).cast("long"))
        if nodes.isEmpty():
            return tiers, roots


def build(leaves: DataFrame, tree: str, key: str, carried: str = "") -> Manifest:
    """Log of all ``leaves``: columns for tree, integer key and ``digest``, and the carried ones.

    ``carried`` names further columns with their types, kept beside each leaf.
    """
    # a prefix keeps the null tree apart from the empty name, and first
    marked = F.coalesce(F.concat(F.lit("="), F.col(tree)), F.lit(""))
    rows = tx.durable(leaves.select(marked.alias("tree"), F.col(key).cast("long").alias("key"), "digest", *_names(carried)), "leaves")
    numbered = number_rows(rows, "tree", ["key", "digest", *_names(carried)], "leaves")
    tiers, subroots = _build_tiers(numbered, _columns("key long", carried), "log")
    subroots = tx.durable(subroots.select(F.lit("").alias("last"), F.col("tree").alias("name"), "digest"), "subroots")
    last = number_rows(subroots, "last", ["name"], "subroots").withColumnRenamed("last", "tree")
    top, root = _build_tiers(last, "name string", "top")
    return Manifest(tiers, top, root)


def nodes(tier: DataFrame) -> DataFrame:
    """Every node of a tier's logs: (tree, n, block, position in the block's log, digest)."""
    log = F.expr(f"transform(sequence(0, length(log) div {HEX} - 1), p -> substring(log, p * {HEX} + 1, {HEX}))")
    return tier.select("tree", "n", "block", F.posexplode(log).alias("position", "digest"))


def block_proofs(log: str, count: int, levels: int) -> tuple[list[str], list[list[dict[str, str]]]]:
    """The ``count`` leaves of a block's log, and the siblings before and after each on every level."""
    sizes = level_sizes(count, levels)
    leaves: list[str] = []
    steps: list[list[dict[str, str]]] = []
    for level in range(levels + 1):
        places = position(level, np.arange(sizes[level]), count).tolist()
        digests = [log[p * HEX : p * HEX + HEX] for p in places]
        leaves = leaves or digests
        if level < levels:
            runs = ["".join(digests[a : a + FANOUT]) for a in range(0, len(digests), FANOUT)]
            steps.append([{"before": run[:k], "after": run[k + HEX :]} for run in runs for k in range(0, len(run), HEX)])
    return leaves, [[step[i // FANOUT**level] for level, step in enumerate(steps)] for i in range(count)]


def prove_tier(tier: DataFrame, above: DataFrame, carried: str) -> DataFrame:
    """(tree, index, leaf, proof, subroot, root, carried columns) of every leaf of a tier's blocks.

    ``above`` has the rest of the proof of each block: (tree, block, steps, subroot, root).
    """
    names = _names(carried)
    schema = _columns(f"tree string, index long, leaf string, proof array<{STEP}>, subroot string, root string", carried)
    step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    wanted = ["tree", "n", "block", "log", "steps", "subroot", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, n, block, log, steps, subroot, root = (batch.column(c)[row].as_py() for c in wanted)
                lists = [batch.column(c)[row].values for c in names]
                count = min(BLOCK, n - block * BLOCK)
                leaves, proofs = block_proofs(log, count, levels_of(n, count))
                index = np.arange(block * BLOCK, block * BLOCK + count)
                proofs = [p + steps for p in proofs]
                columns = [pa.array([tree] * count), pa.array(index, pa.int64()), pa.array(leaves), pa.array(proofs, step)]
                columns += [pa.array([subroot] * count, pa.string()), pa.array([root] * count)]
                yield tx.batch([*columns, *lists], ["tree", "index", "leaf", "proof", "subroot", "root", *names])

    above = above.select(F.col("tree").alias("of_tree"), F.col("block").alias("of_block"), "steps", "subroot", "root")
    found = tier.join(above, (F.col("tree") == F.col("of_tree")) & (F.col("block") == F.col("of_block")))
    return found.select(*wanted, *names).mapInArrow(run, schema)


def _prove(tiers: list[DataFrame], rest: DataFrame, carried: str, name: str) -> DataFrame:
    """Proofs of all leaves of the first tier; ``rest`` is (tree, steps, subroot, root)."""
    proofs = None
    for k in reversed(range(len(tiers))):
        done = tiers[k].where(F.col("n") <= BLOCK).select("tree", "block")
        above = done.join(rest, "tree").select("tree", "block", "steps", "subroot", "root")
        if proofs is not None:
            above = above.unionByName(proofs.select("tree", F.col("index").alias("block"), F.col("proof").alias("steps"), "subroot", "root"))
        proofs = prove_tier(tiers[k], above, "" if k else carried)
        if k:
            proofs = tx.durable(proofs, f"{name}-proofs-{k}")
    return proofs


def prove(manifest: Manifest, carried: str = "") -> DataFrame:
    """(key, leaf, proof, subroot, root, carried columns) of every leaf, from the logs alone.

    ``proof`` lists, level by level up to the root, the joined digests of the siblings before and
    after the node on the way.
    """
    none = F.array().cast(f"array<{STEP}>")
    start = manifest.root.select("tree", none.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    of_trees = _prove(manifest.top, start, "name string", "top")
    rest = of_trees.select(F.col("name").alias("tree"), F.col("proof").alias("steps"), F.col("leaf").alias("subroot"), "root")
    found = _prove(manifest.tiers, tx.durable(rest, "tree-proofs"), _columns("key long", carried), "log")
    return found.select("key", "leaf", "proof", "subroot", "root", *_names(carried))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings, level by level."""
    joined = F.transform(proof, lambda step: F.concat(step["before"], step["after"]))
    return F.sha2(F.array_join(joined, ""), 256)
