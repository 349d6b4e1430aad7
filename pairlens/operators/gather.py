"""Attaching factor rows to cells: how each way is joined, and what that costs.

A factor has exactly ``dims[k]`` rows, so its size is known before anything runs. Small ways
are broadcast while a byte budget lasts, smallest first. Every other way is an equi-join on
``(index, salt)``: indices holding more than a target number of cells are spread over several
salts and their factor row is repeated once per salt, so no join partition holds a hot index
whole. The salt is a hash of the cell's coordinates and thus the same on every recomputation.

Rank-wide expressions are written as SQL text throughout the algebra: one string per column is
one call into the JVM, where a Column tree would be one call per operator.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.schema import SIDES, coord_names, factor_names
from pairlens.session import cut_lineage, shuffle_partitions

FACTOR_BROADCAST_BYTES = 256 << 20
TARGET_CELLS_PER_SALT = 2_000_000
# A hot-index table is broadcast up to this many rows; a larger one is joined by shuffle.
BROADCAST_HOT_ROWS = 1_000_000
# Cells a partition of a held layout should have.
CELLS_PER_PARTITION = 4_000_000


def factor_bytes(dim: int, rank: int) -> int:
    """Bytes of an unsafe-row table of ``dim`` factor rows (both sides), doubled for hashing."""
    return 2 * dim * 8 * (2 + 2 * rank)


@dataclass(frozen=True)
class JoinPlan:
    """Per way: broadcast or shuffled, and the salt counts of its hot indices.

    ``hot`` holds (idx, splits) tables; ``small_hot`` the ways whose table is known to be small.
    With ``dims``, a cell outside of them raises instead of missing its factor row.
    """

    broadcast: tuple[bool, ...]
    hot: Mapping[int, DataFrame] = field(default_factory=dict)
    dims: tuple[int, ...] | None = None
    small_hot: frozenset[int] = frozenset()

    def hot_table(self, way: int) -> DataFrame:
        return F.broadcast(self.hot[way]) if way in self.small_hot else self.hot[way]

    @property
    def shuffled(self) -> list[int]:
        return [w for w, small in enumerate(self.broadcast) if not small]

    def keys(self, way: int) -> list[str]:
        """Join columns of a way; the salt only takes part where there is a hot index."""
        return [f"i{way}", f"salt{way}"] if way in self.hot else [f"i{way}"]


def choose_broadcast(
    dims: Sequence[int], rank: int, budget: int = FACTOR_BROADCAST_BYTES
) -> tuple[bool, ...]:
    """Which ways fit into one job's broadcast budget together."""
    chosen = [False] * len(dims)
    left = budget
    for w in sorted(range(len(dims)), key=lambda k: dims[k]):
        size = factor_bytes(dims[w], rank)
        if size > left:
            break
        chosen[w] = True
        left -= size
    return tuple(chosen)


def plan_joins(
    cells: DataFrame,
    dims: Sequence[int],
    rank: int,
    budget: int = FACTOR_BROADCAST_BYTES,
    target: int = TARGET_CELLS_PER_SALT,
    n_cells: int | None = None,
) -> JoinPlan:
    """Decide the join of each way; measures index frequencies only for shuffled ways."""
    chosen = choose_broadcast(dims, rank, budget)
    hot, small = {}, set()
    for w in (w for w, fits in enumerate(chosen) if not fits):
        # Salts depend on an index's own cells only, so no index is left whole for being one of many.
        frequent = cut_lineage(
            cells.groupBy(F.col(f"i{w}").alias("idx"))
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > target)
            .select("idx", F.ceil(F.col("n") / F.lit(target)).cast("int").alias("splits"))
        )
        rows = frequent.count()
        if not rows:
            continue
        hot[w] = frequent
        if rows <= BROADCAST_HOT_ROWS:
            small.add(w)
    return JoinPlan(chosen, hot, tuple(dims), frozenset(small))


def salted_cells(
    cells: DataFrame, over: Sequence[int], plan: JoinPlan, spread_by: Sequence[str]
) -> DataFrame:
    """Add ``salt{w}`` for the ways in ``over`` with hot indices (0 for all other indices)."""
    for w in plan.hot:
        if w not in over:
            continue
        name = f"salt{w}"
        if name in cells.columns:
            continue
        hot = plan.hot_table(w).withColumnRenamed("idx", f"i{w}")
        spread = F.xxhash64(*spread_by)
        cells = (
            cells.join(hot, f"i{w}", "left")
            .withColumn(
                name, F.pmod(spread, F.coalesce("splits", F.lit(1))).cast("int")
            )
            .drop("splits")
        )
    return cells


def _factor_side(
    factor: DataFrame, way: int, rank: int, sides: Sequence[str], plan: JoinPlan
) -> DataFrame:
    renamed = [f"{n} AS f{way}_{n}" for s in sides for n in factor_names(s, rank)]
    if plan.broadcast[way]:
        return F.broadcast(factor.selectExpr(f"idx AS i{way}", *renamed))
    if way not in plan.hot:
        return factor.selectExpr(f"idx AS i{way}", *renamed)
    repeated = factor.join(plan.hot_table(way), "idx", "left")
    salts = f"explode(sequence(0, coalesce(splits, 1) - 1)) AS salt{way}"
    return repeated.selectExpr(f"idx AS i{way}", salts, *renamed)


def _inside(over: Sequence[int], dims: Sequence[int]) -> Column:
    """True for cells inside the dimensions; others raise, as they would have no factor row."""
    inside = reduce(and_, [F.col(f"i{w}").between(0, dims[w] - 1) for w in over])
    where = F.concat_ws(",", *[F.col(f"i{w}").cast("string") for w in over])
    message = F.concat(F.lit("cell outside the dimensions: "), where)
    return F.when(inside, True).otherwise(F.raise_error(message).cast("boolean"))


def gather(
    cells: DataFrame,
    factors: Sequence[DataFrame],
    rank: int,
    over: Sequence[int],
    plan: JoinPlan,
    sides: Sequence[str] = SIDES,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Cells with the factor rows of the ways in ``over`` as ``f{w}_{side}{r}`` columns.

    The largest shuffled way comes first: cells held in its layout are not moved for it. The other
    shuffled ways follow while rows are still narrow; broadcasts are then pipelined into the stage
    that follows.
    """
    out = salted_cells(cells, over, plan, spread_by or coord_names(len(factors)))
    if plan.dims is not None:
        out = out.where(_inside([w for w in range(len(plan.dims)) if f"i{w}" in cells.columns], plan.dims))
    dims = plan.dims or [0] * len(factors)
    for w in sorted(over, key=lambda k: (plan.broadcast[k], -dims[k])):
        side = _factor_side(factors[w], w, rank, sides, plan)
        out = out.join(side, plan.keys(w))
    return out


def component_products(over: Sequence[int], rank: int, side: str) -> list[str]:
    """One expression per component: the product of the gathered factor entries."""
    return [" * ".join(f"f{w}_{side}{r}" for w in over) for r in range(rank)]


def layout_for(
    cells: DataFrame, ways: int, plan: JoinPlan, lead: int | None, n_cells: int = 0
) -> DataFrame:
    """Cells hash-partitioned for the shuffled join with way ``lead``.

    Held in this layout, every later job joins that way by shuffling its factor only.
    """
    cells = salted_cells(cells, range(ways), plan, coord_names(ways))
    if lead is None:
        return cells
    parts = max(shuffle_partitions(cells.sparkSession), math.ceil(n_cells / CELLS_PER_PARTITION))
    return cells.repartition(parts, *plan.keys(lead))


def lead_way(plan: JoinPlan, dims: Sequence[int], target: int) -> int | None:
    """The largest shuffled way that a job for way ``target`` has to join, if any."""
    others = [w for w in plan.shuffled if w != target]
    if not others:
        others = plan.shuffled
    return max(others, key=lambda w: dims[w]) if others else None
