"""Row-level expressions. Everything here is a built-in Column, so it stays in codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must equal those of the method being reproduced.
EQUAL_TOLERANCE = 1e-5   # |x - y| up to this counts as "unchanged"
FACTOR_EPS = 1e-16       # factor and weight entries below this are floored
CLAMP_THRESHOLD = 0.0

# Fixed values of the arithmetic start-value and split formulas (our own choice): two primes just
# below 2**31, so that a product of two residues, or the sum of two such, stays inside BIGINT.
MODULUS = 2147483647
SECOND_MODULUS = 2147483629


def sum_of(columns: Sequence[Column]) -> Column:
    return reduce(add, columns)


def number(value: float) -> str:
    """A DOUBLE literal as SQL text, parenthesised so that a sign is safe anywhere."""
    value = float(value)
    if not math.isfinite(value):
        raise ValueError(f"{value} cannot enter an expression")
    return f"({value!r}D)"


def floored_sql(expression: str, floor: float, eps: float = FACTOR_EPS) -> str:
    return f"CASE WHEN {expression} < {number(eps)} THEN {number(floor)} ELSE {expression} END"


# --- coordinates -----------------------------------------------------------

def coord_fields(line: Column, ways: int, sep: str = ",") -> list[Column]:
    """``"3,0,7"`` -> one INT column per way; a bad field raises under ANSI mode."""
    parts = F.split(line, sep)
    return [parts.getItem(w).cast("int").alias(f"i{w}") for w in range(ways)]


def encode_key(line: Column) -> Column:
    return F.concat_ws("_", F.split(line, ","))


def decode_key(key: Column) -> Column:
    return F.transform(F.split(key, "_"), lambda part: part.cast("int"))


# --- contrast signals ------------------------------------------------------

def contrast_columns(x: Column, y: Column) -> dict[str, Column]:
    """Growth towards each side and the unchanged flag, absent side read as zero."""
    zero = F.lit(0.0)
    x, y = F.coalesce(x, zero), F.coalesce(y, zero)
    return {
        "x": x,
        "y": y,
        "zx": F.greatest(x - y, zero),
        "zy": F.greatest(y - x, zero),
        "s": F.when(F.abs(x - y) <= EQUAL_TOLERANCE, 1).otherwise(0),
    }


def clamp(value: Column, threshold: float = CLAMP_THRESHOLD) -> Column:
    return F.greatest(value, F.lit(float(threshold)))


def floor_below(value: Column, floor: float, eps: float = FACTOR_EPS) -> Column:
    """Entries under ``eps`` become ``floor``; NaN sorts above every number and is kept."""
    return F.when(value < eps, F.lit(float(floor))).otherwise(value)


# --- deterministic pseudo-random values ------------------------------------

def start_multipliers(way: int, component: int, side: str, seed: int) -> list[int]:
    """Five residues that depend on all arguments, so no two columns or seeds are shifts."""
    base = (seed + 1) * 1000003 + (way + 1) * 7919 + (component + 1) * 104729
    base += 15485863 if side == "y" else 0
    scrambled = [(base + k * 179424673) % MODULUS for k in range(1, 6)]
    return [m * m % MODULUS * 48271 % MODULUS + 1 for m in scrambled]


def init_value(index: str, way: int, component: int, side: str, seed: int) -> str:
    """Start value in [0, 1) that depends only on its arguments, not on partitioning.

    SQL text over the BIGINT expression ``index``: a linear step over both residues of the index and
    a quadratic one. Two residues together tell all BIGINT indices up to 2**62 apart.
    """
    a, b, c, d, e = start_multipliers(way, component, side, seed)
    first, second = (f"(({index} + 1L) % {m}L)" for m in (MODULUS, SECOND_MODULUS))
    h = f"(({first} * {a}L + {second} * {b}L + {c}L) % {MODULUS}L)"
    mixed = f"(({h} * {h}) % {MODULUS}L) * {d}L + {h} * {e}L"
    return f"CAST(({mixed}) % {MODULUS}L AS DOUBLE) / {MODULUS}.0D"


def uniform_value(index: str, way: int, component: int, side: str, seed: int) -> str:
    """Hash-based uniform start value without the period of :func:`init_value`."""
    h = f"xxhash64({index}, {way}, {component}, '{side}', {seed})"
    return f"CAST(pmod({h}, {1 << 52}L) AS DOUBLE) / {float(1 << 52)}D"


def split_bucket(coords: Sequence[Column], seed: int) -> Column:
    """A residue from the coordinates alone, so a cell keeps its label on any cluster.

    Squares bind their argument in a lambda, so the expression grows with the ways and not with two
    to their number.
    """
    modulus, second = (F.lit(m).cast("bigint") for m in (MODULUS, SECOND_MODULUS))
    h = F.lit(seed % MODULUS).cast("bigint")
    for c in coords:
        i = c.cast("bigint") + 1
        h = (h * 48271 + (i % modulus) * 69621 + 15485) % modulus
        square = F.transform(F.array(h), lambda v: (v * v) % modulus).getItem(0)
        h = (square * 16807 + (i % second) * 39373) % modulus
    return h


def split_label(coords: Sequence[Column], train_tenths: float, seed: int = 2) -> Column:
    """Train takes ``train_tenths`` tenths, test and validation share the rest equally."""
    if not 0 <= train_tenths <= 10:
        raise ValueError("train_tenths must lie in 0..10")
    side = (10.0 - train_tenths) / 2.0
    bucket = split_bucket(coords, seed)
    test_end = side / 10.0 * MODULUS
    return (
        F.when(bucket < test_end, "test")
        .when(bucket < 2 * test_end, "validation")
        .otherwise("train")
    )
