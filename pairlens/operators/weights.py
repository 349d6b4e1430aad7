"""Component weights: normalising, widening, tagging and the weight update."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.columns import FACTOR_EPS


def normalize_weights(weights: DataFrame, by: Sequence[str] = ("side",)) -> DataFrame:
    """Scale the weights of each group to sum to one; a group of zeros raises."""
    total = F.sum("w").over(Window.partitionBy(*by))
    message = F.lit("all component weights of a group are zero")
    checked = F.when(total == 0, F.raise_error(message).cast("double")).otherwise(total)
    return weights.withColumn("w", F.col("w") / checked)


def widen_weights(weights: DataFrame, rank: int, by: Sequence[str] = ()) -> DataFrame:
    """Long ``(side, r, w)`` -> one row per side with columns ``w0..wR-1`` and ``tensor``."""
    wide = (
        weights.groupBy(*by, "side")
        .pivot("r", list(range(rank)))
        .agg(F.first("w"))
    )
    return wide.select(
        *by,
        *[F.col(str(r)).alias(f"w{r}") for r in range(rank)],
        F.upper("side").alias("tensor"),
    )


def tag(df: DataFrame, **parameters: object) -> DataFrame:
    """Constant run-parameter columns."""
    return df.withColumns({name: F.lit(value) for name, value in parameters.items()})


def unit_sum(values: np.ndarray, what: str) -> np.ndarray:
    total = float(values.sum())
    if not math.isfinite(total) or total == 0.0:
        raise ValueError(f"{what}: weights sum to {total}, cannot be normalised")
    return values / total


def floored(values: np.ndarray, eps: float = FACTOR_EPS) -> np.ndarray:
    return np.where(values < eps, 0.0, values)


def next_momentum(alpha: float) -> float:
    return (1.0 + math.sqrt(4.0 * alpha * alpha + 1.0)) / 2.0
