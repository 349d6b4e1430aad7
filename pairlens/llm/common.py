"""Helpers shared by the operators: stored tables, arrow batches, class labels, exact k-th values."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import ensure_checkpoint_dir

#: Words are runs of anything but these bytes (all ASCII, so they cannot split a UTF-8 sequence).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Arrow batches are worked through in slices of about this many text bytes.
SLICE_BYTES = 1 << 19
#: Documents without an id come after all others.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Makes Spark delete an execution's shuffle files at its end instead of at some garbage collection.
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Up to this many ids are sent to the other side of a join; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared checkpoint folder and read again.

    Cuts lineage like ``checkpoint()`` but keeps columns compressed, which matters for tables
    that grow with the corpus, and frees the shuffles that made them. Lost executors re-read the
    files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def listed(ids: DataFrame) -> DataFrame:
    """One stored column of ids, marked for broadcast only if they are counted and few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of at most ``SLICE_BYTES`` text (or one row), with null texts made empty."""
    texts = batch.column(column).fill_null("")
    sizes = np.diff(_offsets(texts))
    run = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(run)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets starting at 0)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions that yield dicts of equally long columns."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [_array(columns[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def _array(values, kind):
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One list per length, cut from ``values`` in order."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def hub_order(weight: str, id_: str) -> Column:
    """Orders rows by ``weight``, then by a hash of the id, then by the id; weights have no bound."""
    return F.struct(F.col(weight), F.xxhash64(id_), F.col(id_))


def class_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, label)``: for every vertex of the edges the smallest vertex it is connected to.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so the distance left halves; it ends when no label changes. Minima are aggregates with
    map-side combining and joins are plain equi-joins, so a hub is never gathered in one task.
    """
    both = stored(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .union(edges.select(F.col(b), F.col(a)))
        .where("u <> v")
        .distinct()
    )
    labels = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "id"))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("v"), "label"), "v")
            .groupBy("u")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("u", "id")
        )
        step = near.join(labels, "id").select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = stored(
            step.join(jump, "label", "left").select(
                "id", "old", F.least("label", F.coalesce("far", "label")).alias("label")
            )
        )
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(value, rank among its equals) of the k-th largest long, 1 <= k <= rows.

    Counts 12 bits at a time from the top, so nothing is ranked globally and only 4096 counts reach
    the driver per step. ``rows`` should be stored: it is read up to six times.
    """
    left, within = k, F.lit(True)
    for shift in (52, 40, 28, 16, 4, 0):
        slot = F.shiftright(F.col(column), shift).alias("slot")
        counts = rows.where(within).groupBy(slot).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(counts, key=lambda r: -r.slot):
            if left <= row.n:
                break
            left -= row.n
        low = row.slot << shift
        within = F.col(column).between(low, low + (1 << shift) - 1)
    return low, left


def largest(rows: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """The k rows (all, if fewer) of largest ``order``, ties to the larger ``tie``; both longs.

    Rows equal in both stay together, so repeated rows may bring more than k.
    """
    if k <= 0:
        return rows.where(F.lit(False))
    if k >= rows.count():
        return rows
    value, rank = kth_largest(rows, order, k)
    least, _ = kth_largest(rows.where(F.col(order) == value), tie, rank)
    return rows.where(
        (F.col(order) > value) | ((F.col(order) == value) & (F.col(tie) >= least))
    )
