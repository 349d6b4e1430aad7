"""Naming conventions shared by every table in the package.

cells     i0..iN-1, x, y, zx, zy, s       one row per stored cell of the pair
factor k  idx, x0..xR-1, y0..yR-1         one row per index of way k, both sides
weights   side, r, w                      one row per side and component
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = ("x", "y")
SIGNALS = ("x", "y", "zx", "zy", "s")


def coord_names(ways: int) -> list[str]:
    return [f"i{w}" for w in range(ways)]


def factor_names(side: str, rank: int) -> list[str]:
    return [f"{side}{r}" for r in range(rank)]


def factor_columns(rank: int) -> list[str]:
    return ["idx", *factor_names("x", rank), *factor_names("y", rank)]


@dataclass(frozen=True)
class PairedTensor:
    """Aligned cells of two tensors over the same dimensions."""

    cells: DataFrame
    dims: tuple[int, ...]

    @property
    def ways(self) -> int:
        return len(self.dims)

    @property
    def coords(self) -> list[str]:
        return coord_names(self.ways)

    def with_cells(self, cells: DataFrame) -> PairedTensor:
        return PairedTensor(cells, self.dims)


def dims_of(cells: DataFrame, ways: int) -> tuple[int, ...]:
    """Smallest dimensions that hold every coordinate: max(i_k) + 1, in one scan."""
    row = cells.agg(*[F.max(c).alias(c) for c in coord_names(ways)]).first()
    if row is None or any(v is None for v in row):
        raise ValueError("dims_of needs at least one cell")
    return tuple(int(v) + 1 for v in row)
