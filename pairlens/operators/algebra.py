"""Sparse tensor algebra as joins and aggregates.

Factors are DataFrames of exactly ``dims[k]`` rows. What comes back to the driver is limited
to scalars, rank-length vectors and rank x rank matrices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.columns import init_value, uniform_value
from pairlens.operators.gather import JoinPlan, component_products, gather, plan_joins
from pairlens.schema import SIDES, SIGNALS, PairedTensor, factor_names
from pairlens.session import partitions_for

# (output prefix, signal, side of the factors it is multiplied with)
FUSED_TERMS = (
    ("mx", "x", "x"),
    ("my", "y", "y"),
    ("mzx", "zx", "x"),
    ("mzy", "zy", "y"),
    ("msx", "s", "x"),
    ("msy", "s", "y"),
)
CORE_TERMS = (("gzx", "zx", "x"), ("gzy", "zy", "y"), ("gsx", "s", "x"), ("gsy", "s", "y"))

INT_MAX = 2**31 - 1


# --- factors ---------------------------------------------------------------

def init_runs(
    spark: SparkSession, dim: int, way: int, starts: Sequence[tuple[int, str, int]]
) -> DataFrame:
    """Start values of several runs side by side, for every index of a way.

    ``starts`` holds a (seed, kind, rank) per run; indices without any cell are included.
    """
    kinds = {"formula": init_value, "hash": uniform_value}
    columns = [(seed, kind, r) for seed, kind, rank in starts for r in range(rank)]
    partitions = partitions_for(dim, 1 + 2 * len(columns))
    idx = "CAST(id AS INT) AS idx" if dim <= INT_MAX else "id AS idx"
    return spark.range(0, dim, 1, partitions).selectExpr(
        idx,
        *[
            f"{kinds[kind]('id', way, r, side, seed)} AS {side}{c}"
            for side in SIDES
            for c, (seed, kind, r) in enumerate(columns)
        ],
    )


def init_factor(
    spark: SparkSession, dim: int, way: int, rank: int, seed: int, kind: str = "formula"
) -> DataFrame:
    return init_runs(spark, dim, way, [(seed, kind, rank)])


def init_factors(
    spark: SparkSession, dims: Sequence[int], rank: int, seed: int, kind: str = "formula"
) -> list[DataFrame]:
    return [init_factor(spark, d, w, rank, seed, kind) for w, d in enumerate(dims)]


# --- norms, Grams and column scaling ---------------------------------------

def tensor_norms(cells: DataFrame, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """Frobenius norm of each value column, one scan."""
    return cells.selectExpr(*[f"sqrt(sum({c} * {c})) AS norm_{c}" for c in columns])


def frobenius_norm(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frobenius norm of a dense matrix held as columns."""
    squares = " + ".join(f"{c} * {c}" for c in columns)
    return matrix.selectExpr(f"sqrt(sum({squares})) AS norm")


def gram_sums(rank: int, side: str, prefix: str) -> list[str]:
    """Upper triangle of ``sum(u_p * u_q)``."""
    return [
        f"sum({side}{p} * {side}{q}) AS {prefix}_{p}_{q}"
        for p in range(rank)
        for q in range(p, rank)
    ]


def gram_aggregates(rank: int) -> list[str]:
    """Both sides' Gram matrices and the diagonal cross products."""
    cross = [f"sum(x{r} * y{r}) AS cross_{r}" for r in range(rank)]
    return [*gram_sums(rank, "x", "gx"), *gram_sums(rank, "y", "gy"), *cross]


def gram(factor: DataFrame, rank: int) -> DataFrame:
    """One row with both Gram matrices and the cross products."""
    return factor.selectExpr(*gram_aggregates(rank))


def symmetric_matrix(row: Row, prefix: str, rank: int) -> np.ndarray:
    out = np.empty((rank, rank))
    for p in range(rank):
        for q in range(p, rank):
            out[p, q] = out[q, p] = row[f"{prefix}_{p}_{q}"]
    return out


def vector(row: Row, prefix: str, rank: int) -> np.ndarray:
    return np.array([row[f"{prefix}_{r}"] for r in range(rank)], dtype=float)


def hadamard(grams: Sequence[np.ndarray], skip: int | None = None) -> np.ndarray:
    """Elementwise product of Gram matrices over all ways, or all but one."""
    kept = [g for w, g in enumerate(grams) if w != skip]
    return reduce(np.multiply, kept)


def gram_long(factor: DataFrame, rank: int, side: str) -> DataFrame:
    """Gram matrix of one side as ``(p, q, g)`` rows."""
    entries = [
        f"named_struct('p', {p}, 'q', {q}, 'g', g_{min(p, q)}_{max(p, q)})"
        for p in range(rank)
        for q in range(rank)
    ]
    row = factor.selectExpr(*gram_sums(rank, side, "g"))
    return row.selectExpr(f"inline(array({', '.join(entries)}))")


def unit_gram_long(factor: DataFrame, rank: int) -> DataFrame:
    """Gram matrices of both sides after column normalisation, as ``(side, p, q, g)`` rows.

    The norms stand on the diagonal of the raw Gram matrix, so one aggregate gives all of it and the
    factor is not scaled. A column without positive norm is left as it is.
    """
    row = factor.selectExpr(*gram_sums(rank, "x", "gx"), *gram_sums(rank, "y", "gy"))

    def norm(s: str, p: int) -> str:
        return f"CASE WHEN g{s}_{p}_{p} > 0 THEN sqrt(g{s}_{p}_{p}) ELSE 1.0D END"

    entries = [
        f"named_struct('side', '{s}', 'p', {p}, 'q', {q}, 'g', "
        f"g{s}_{min(p, q)}_{max(p, q)} / (({norm(s, p)}) * ({norm(s, q)})))"
        for s in SIDES
        for p in range(rank)
        for q in range(rank)
    ]
    return row.selectExpr(f"inline(array({', '.join(entries)}))")


def gram_hadamard(factors: Sequence[DataFrame], rank: int, side: str) -> DataFrame:
    """``(p, q, g)`` of the Hadamard product over ways; joins R*R-row tables."""
    tables = [
        gram_long(f, rank, side).withColumnRenamed("g", f"g{w}") for w, f in enumerate(factors)
    ]
    joined = reduce(lambda a, b: a.join(b, ["p", "q"]), tables)
    product = reduce(lambda a, b: a * b, [F.col(f"g{w}") for w in range(len(factors))])
    return joined.select("p", "q", product.alias("g"))


def column_norms(
    factor: DataFrame, columns: Sequence[str], by_norm: str = "2", prefix: str = "n_"
) -> DataFrame:
    """L2 norms, or plain column sums for ``"1"`` (signed, without absolute values)."""
    forms = {"2": "sqrt(sum({0} * {0}))", "1": "sum({0})"}
    if by_norm not in forms:
        raise ValueError("by_norm must be '1' or '2'")
    return factor.selectExpr(*[f"{forms[by_norm].format(c)} AS {prefix}{c}" for c in columns])


def normalize_columns(
    factor: DataFrame, columns: Sequence[str], by_norm: str = "2"
) -> DataFrame:
    """Divide by the column norms; a column without positive norm is left as it is.

    The norms are a single row attached to every factor row by a broadcast.
    """
    norms = F.broadcast(column_norms(factor, columns, by_norm))
    return factor.join(norms).selectExpr(
        *[
            f"CASE WHEN n_{c} > 0 THEN {c} / n_{c} ELSE {c} END AS {c}" if c in columns else c
            for c in factor.columns
        ]
    )


def normalization_weights(
    factor: DataFrame, columns: Sequence[str], by_norm: str = "2", zero_weight: float = 1.0
) -> DataFrame:
    """The divisors used by :func:`normalize_columns`. For a column without positive norm the
    dense convention reports 1; pass ``zero_weight=None`` to keep the norm itself."""
    norms = column_norms(factor, columns, by_norm)
    if zero_weight is None:
        return norms
    return norms.select(
        *[
            F.when(F.col(n) > 0, F.col(n)).otherwise(F.lit(zero_weight)).alias(n)
            for n in norms.columns
        ]
    )


def tail_mass(rank: int, side: str, k: int, first: int = 0) -> str:
    """Row sum of the components from k on (zero when there are none)."""
    return " + ".join(f"{side}{first + r}" for r in range(k, rank)) or "0.0D"


# --- products with the cells -----------------------------------------------

def mttkrp(
    tensor: PairedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    way: int,
    terms: Sequence[tuple[str, str, str]] = FUSED_TERMS,
    plan: JoinPlan | None = None,
) -> DataFrame:
    """Matricised tensor times Khatri-Rao product for several (prefix, signal, side) terms.

    One pass over the cells, one group-by on the target way; partial sums are formed
    map-side, so a hot index reaches the shuffle as one row per task.
    Result: ``idx`` and ``{prefix}{r}``, only indices that have cells.
    """
    weights = {
        prefix: (side, lambda r, signal=signal: signal) for prefix, signal, side in terms
    }
    return mttkrp_weighted(tensor, factors, rank, way, weights, plan)


def mttkrp_weighted(
    tensor: PairedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    way: int,
    weights: dict,
    plan: JoinPlan | None = None,
) -> DataFrame:
    """Like :func:`mttkrp` with a per-component cell weight.

    ``weights`` maps an output prefix to ``(side, component -> SQL text)``. A linear
    combination of signals can so be summed as one column instead of one per signal.
    """
    over = [w for w in range(tensor.ways) if w != way]
    plan = plan or plan_joins(tensor.cells, tensor.dims, rank)
    sides = [s for s in SIDES if any(side == s for side, _ in weights.values())]
    wide = gather(tensor.cells, factors, rank, over, plan, sides)
    values = [c for c in tensor.cells.columns if c in SIGNALS]
    wide = wide.selectExpr(
        f"i{way} AS idx",
        *values,
        *[
            f"{product} AS p{s}{r}"
            for s in sides
            for r, product in enumerate(component_products(over, rank, s))
        ],
    )
    return wide.groupBy("idx").agg(
        *[
            F.expr(f"sum(({weight(r)}) * p{side}{r}) AS {prefix}{r}")
            for prefix, (side, weight) in weights.items()
            for r in range(rank)
        ]
    )


def fibre_lengths(tensor: PairedTensor, way: int) -> dict[int, float]:
    """Mean number of cells that differ in one way only, for every way but ``way`` (approximate)."""
    others = [w for w in range(tensor.ways) if w != way]
    rest = {w: [c for c in tensor.coords if c != f"i{w}"] for w in others}
    row = tensor.cells.select(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(F.xxhash64(*rest[w])).alias(f"f{w}") for w in others],
    ).collect()[0]
    return {w: row.n / max(row[f"f{w}"], 1) for w in others}


def mttkrp_fibres(
    tensor: PairedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    way: int,
    terms: Sequence[tuple[str, str, str]] = FUSED_TERMS,
    first: int | None = None,
    plan: JoinPlan | None = None,
) -> DataFrame:
    """:func:`mttkrp` that sums cells along one way before it meets the other factors.

    Cells that differ in way ``first`` only are a fibre. Their values times that way's factor rows are
    summed, and the other factors are joined and multiplied once per fibre instead of once per cell.
    Partial sums are formed map-side, so a long fibre reaches the shuffle as one row per task. It pays
    where fibres are long; by default ``first`` is the way of the longest ones.
    """
    plan = plan or plan_joins(tensor.cells, tensor.dims, rank)
    if first is None:
        lengths = fibre_lengths(tensor, way)
        first = max(lengths, key=lambda w: (lengths[w], w))
    rest = [c for c in tensor.coords if c != f"i{first}"]
    over = [w for w in range(tensor.ways) if w not in (way, first)]
    summed = [
        F.expr(f"sum({signal} * f{first}_{side}{r})").alias(f"{prefix}{r}")
        for prefix, signal, side in terms
        for r in range(rank)
    ]
    fibres = gather(tensor.cells, factors, rank, [first], plan).groupBy(*rest).agg(*summed)
    wide = gather(fibres, factors, rank, over, plan, spread_by=rest) if over else fibres
    products = {s: component_products(over, rank, s) if over else ["1.0D"] * rank for s in SIDES}
    return wide.groupBy(F.col(f"i{way}").alias("idx")).agg(
        *[
            F.expr(f"sum({prefix}{r} * {products[side][r]})").alias(f"{prefix}{r}")
            for prefix, _signal, side in terms
            for r in range(rank)
        ]
    )


def complete(factor: DataFrame, products: DataFrame, *extra: str) -> DataFrame:
    """Factor rows with their products; an index without cells contributes zero."""
    names = [c for c in products.columns if c != "idx"]
    joined = factor.join(products, "idx", "left")
    return joined.selectExpr(
        *factor.columns, *[f"coalesce({n}, 0.0D) AS {n}" for n in names], *extra
    )


def core_diagonal(
    tensor: PairedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    terms: Sequence[tuple[str, str, str]] = CORE_TERMS,
    plan: JoinPlan | None = None,
) -> DataFrame:
    """Superdiagonal of the core as one row: ``{prefix}_{r} = sum(v * prod_w A_w[i_w, r])``."""
    over = list(range(tensor.ways))
    plan = plan or plan_joins(tensor.cells, tensor.dims, rank)
    wide = gather(tensor.cells, factors, rank, over, plan).selectExpr(
        *[c for c in tensor.cells.columns if c in SIGNALS],
        *[
            f"{product} AS p{s}{r}"
            for s in SIDES
            for r, product in enumerate(component_products(over, rank, s))
        ],
    )
    return wide.selectExpr(
        *[
            f"sum({signal} * p{side}{r}) AS {prefix}_{r}"
            for prefix, signal, side in terms
            for r in range(rank)
        ]
    )


def core_long(row: DataFrame, rank: int, terms=CORE_TERMS) -> DataFrame:
    """The one-row superdiagonal as ``(r, {prefix}...)`` rows."""
    entries = [
        f"named_struct('r', {r}, " + ", ".join(f"'{p}', {p}_{r}" for p, _, _ in terms) + ")"
        for r in range(rank)
    ]
    return row.selectExpr(f"inline(array({', '.join(entries)}))")


def core_full(
    tensor: PairedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    terms: Sequence[tuple[str, str, str]] = CORE_TERMS,
    plan: JoinPlan | None = None,
) -> DataFrame:
    """Full Tucker core ``(r0..rN-1, {prefix}...)`` as a chain of one-way contractions.

    The largest way is contracted first: each step joins one factor, sums over that way and
    unpivots its components, so the intermediate has (remaining coordinates) x R^step rows
    instead of every cell times R^N.
    """
    plan = plan or plan_joins(tensor.cells, tensor.dims, rank)
    prefixes = [p for p, _, _ in terms]
    state = tensor.cells.selectExpr(
        *tensor.coords, *[f"CAST({signal} AS DOUBLE) AS {p}" for p, signal, _ in terms]
    )
    remaining = list(range(tensor.ways))
    done: list[str] = []
    for w in sorted(range(tensor.ways), key=lambda k: -tensor.dims[k]):
        spread = [f"i{v}" for v in remaining] + done
        joined = gather(state, factors, rank, [w], plan, spread_by=spread)
        remaining.remove(w)
        keys = [f"i{v}" for v in remaining] + done
        sums = [
            F.expr(f"sum({p} * f{w}_{side}{r}) AS {p}__{r}")
            for p, _, side in terms
            for r in range(rank)
        ]
        entries = [
            f"named_struct('r{w}', {r}, " + ", ".join(f"'{p}', {p}__{r}" for p in prefixes) + ")"
            for r in range(rank)
        ]
        grouped = joined.groupBy(*keys).agg(*sums)
        state = grouped.selectExpr(*keys, f"inline(array({', '.join(entries)}))")
        done.append(f"r{w}")
    return state.select(*[f"r{w}" for w in range(tensor.ways)], *prefixes)


def reconstruct(
    tensor: PairedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    plan: JoinPlan | None = None,
) -> DataFrame:
    """Model values of both sides at the stored cells only; never a dense tensor."""
    over = list(range(tensor.ways))
    plan = plan or plan_joins(tensor.cells, tensor.dims, rank)
    wide = gather(tensor.cells, factors, rank, over, plan)
    return wide.selectExpr(
        *tensor.cells.columns,
        *[f"{' + '.join(component_products(over, rank, s))} AS pred_{s}" for s in SIDES],
    )


def inner_products(
    tensor: PairedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    plan: JoinPlan | None = None,
) -> DataFrame:
    """``<model, tensor>`` of both sides in one row."""
    scored = reconstruct(tensor, factors, rank, plan)
    return scored.selectExpr(*[f"sum({s} * pred_{s}) AS inner_{s}" for s in SIDES])


def joint_cost_table(
    tensor: PairedTensor,
    factors: Sequence[DataFrame],
    rank: int,
    plan: JoinPlan | None = None,
) -> DataFrame:
    """``(norm_x, norm_y, cost)`` as one lazily computed row.

    ``|X - M|^2 = |X|^2 + |M|^2 - 2<M, X>``: the model is never expanded. Only one-row
    aggregates are put side by side.
    """
    entries = [(p, q) for p in range(rank) for q in range(rank)]
    inner = inner_products(tensor, factors, rank, plan)
    row = tensor_norms(tensor.cells).join(F.broadcast(inner))
    for w, factor in enumerate(factors):
        sums = gram_sums(rank, "x", f"gx{w}") + gram_sums(rank, "y", f"gy{w}")
        row = row.join(F.broadcast(factor.selectExpr(*sums)))
    terms = []
    for s in SIDES:
        model = " + ".join(
            " * ".join(f"g{s}{w}_{min(p, q)}_{max(p, q)}" for w in range(len(factors)))
            for p, q in entries
        )
        residual = f"norm_{s} * norm_{s} + ({model}) - 2 * inner_{s}"
        terms.append(f"sqrt(greatest({residual}, 0.0D)) / norm_{s}")
    return row.selectExpr("norm_x", "norm_y", f"({terms[0]} + {terms[1]}) / 2 AS cost")


def squared_residual(norm_tensor: float, norm_model_sq: float, inner: float) -> float:
    return norm_tensor**2 + norm_model_sq - 2.0 * inner


def joint_cost(residual_x: float, residual_y: float, norm_x: float, norm_y: float) -> float:
    """Mean relative residual of the two sides; rounding below zero counts as zero."""
    return (
        math.sqrt(max(residual_x, 0.0)) / norm_x + math.sqrt(max(residual_y, 0.0)) / norm_y
    ) / 2.0
