"""Lineage cutting and small session helpers. The caller owns the session."""

from __future__ import annotations

import math
import re
import tempfile
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local master may do with a folder of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pairlens-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps plans of iterative jobs short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hold(df: DataFrame) -> DataFrame:
    """Cache for reuse; lost blocks are recomputed from the (checkpointed) parents."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


FACTOR_PARTITION_BYTES = 32 << 20


def partitions_for(rows: int, columns: int) -> int:
    """Partitions of at most FACTOR_PARTITION_BYTES for rows of 8-byte columns."""
    return max(1, math.ceil(rows * 8 * (columns + 1) / FACTOR_PARTITION_BYTES))


@dataclass(frozen=True)
class Compact:
    """A held table and a view of it in no more partitions than its size needs."""

    table: DataFrame
    held: DataFrame

    def release(self) -> None:
        self.held.unpersist()


def hold_compact(df: DataFrame, rows: int) -> Compact:
    """Compute and hold ``df`` at full parallelism, then view it in few partitions.

    The narrowing sits above the held table, so it never lowers the parallelism of the aggregate
    that made it; a table that fits one partition is then aggregated without any exchange.
    """
    held = hold(df)
    held.count()
    return Compact(held.coalesce(partitions_for(rows, len(df.columns))), held)


def only_row(df: DataFrame):
    """The row of a global aggregate (no limit on top, which would add a stage)."""
    (row,) = df.collect()
    return row


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
