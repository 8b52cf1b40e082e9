"""Session helpers: runtime settings and durable intermediate results."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. Skewed join keys are split by AQE even
# when that costs one more exchange; a hot key otherwise ends up in one task.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


# Stored bytes of input behind one shuffle partition, before AQE merges small ones, and the
# shuffled bytes up to which it merges them: a task sorts a few times that many, whatever the input.
INPUT_BYTES_A_PARTITION = 2 << 20
SHUFFLED_BYTES_A_TASK = 16 << 20


def spread(spark: SparkSession, input_bytes: int) -> int:
    """Shuffle partitions in proportion to the input, never fewer than the session's own number.

    A fixed number makes the data of a task grow with the input, until its sorts spill. Merging to
    the default of 64 MB does so too, and leaves about as many tasks as cores: one more takes twice the time.
    """
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(fewest, math.ceil(input_bytes / INPUT_BYTES_A_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLED_BYTES_A_TASK))
    return wanted


@contextlib.contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """Joins on (key, date) keep rows where a shuffle by the key alone has put them.

    For plans whose every such key has many values: with few, all rows would meet in as few tasks.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a folder of its own; on a
    cluster a machine-local path would be lost with the machine, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage through a written table, so lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """``durable`` with the rows in ``parts`` buckets of ``key``.

    Windows, groups and (inside ``joins_in_place``) joins by the key read it without a shuffle, also with
    other tables of as many buckets. Rows that lie so already are not moved for the write.
    """
    path = scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    dealt = df.repartition(parts, key).write.format("parquet").option("path", path).option("compression", "zstd")
    dealt.bucketBy(parts, key).saveAsTable(table)
    return df.sparkSession.table(table)
