"""Tensor sources whose rows already carry coordinates and value together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.schema import coord_names


def pair_from_facts(
    facts: DataFrame,
    bins: Mapping[str, Column] | list[Column],
    is_x: Column,
    is_y: Column,
    value: Column,
    parts: int | None = None,
) -> DataFrame:
    """Aggregate a fact table straight into both sides of the pair.

    One group-by: both sides share the scan, the map-side partial sums and the shuffle,
    and rows on neither side are filtered before any of it. A hot cell is merged map-side,
    so it reaches a reducer as at most one row per map task.

    Where cells are nearly as many as facts, partial sums merge nothing and hold all rows of a task.
    ``parts`` then deals the facts by cell to so many tasks before any sum, and the session's number
    and size of shuffle partitions do not matter.
    """
    columns = bins if isinstance(bins, list) else list(bins.values())
    keys = [c.cast("int").alias(f"i{w}") for w, c in enumerate(columns)]
    wide = facts.where(is_x | is_y).select(
        *keys,
        F.when(is_x, value.cast("double")).otherwise(F.lit(0.0)).alias("_x"),
        F.when(is_y, value.cast("double")).otherwise(F.lit(0.0)).alias("_y"),
    )
    if parts is not None:
        wide = wide.repartition(parts, *coord_names(len(keys)))
    return wide.groupBy(*coord_names(len(keys))).agg(
        F.sum("_x").alias("x"), F.sum("_y").alias("y")
    )


def read_cells(
    spark: SparkSession,
    path: str,
    ways: int,
    fmt: str = "parquet",
    value_columns: tuple[str, ...] = ("value",),
    **options: str,
) -> DataFrame:
    """One-file source: coordinates and value(s) in one row, schema stated up front."""
    fields = [f"{c} INT" for c in coord_names(ways)] + [f"{v} DOUBLE" for v in value_columns]
    return (
        spark.read.format(fmt)
        .schema(", ".join(fields))
        .options(**options)
        .load(path)
        .select(*coord_names(ways), *value_columns)
    )
