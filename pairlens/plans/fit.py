"""Driver loop shared by both factorisations.

Cells and factors stay DataFrames. Per iteration the driver sees one aggregate row per job:
column norms, Gram matrices and core sums, all of component-count size.

Runs (trials, parameter settings, ranks) are fitted together: they own neighbouring columns of each
factor table, run after run, so one pass over the cells, and one aggregate per column, serves all of
them. Their algebra stays separate, and a run that has stopped leaves the tables.

With a ``state_path`` the factors, Grams, weights and momentum of every iteration are written there
(:mod:`pairlens.plans.resume`), and a fit that was broken off goes on after its last whole iteration.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pairlens.functions.columns import number
from pairlens.operators.algebra import (
    hadamard,
    init_runs,
    joint_cost,
    squared_residual,
    symmetric_matrix,
    vector,
)
from pairlens.operators.gather import (
    FACTOR_BROADCAST_BYTES,
    TARGET_CELLS_PER_SALT,
    JoinPlan,
    layout_for,
    lead_way,
    plan_joins,
)
from pairlens.schema import SIDES, PairedTensor, factor_columns, factor_names
from pairlens.session import Compact, cut_lineage, hold, only_row

# Fixed value: "previous cost" before the first iteration, so that one never stops there.
FIRST_PREVIOUS_COST = 1e10

# Chains of dependent columns are cut after this many components to bound plan size.
COLUMNS_PER_PLAN = 16


@dataclass(frozen=True)
class FitConfig:
    rank: int
    alpha: float = 0.1
    beta: float = 0.1
    gamma: float = 0.1
    delta: float = 1e-8
    train_proportion: float = 10.0
    distance: int = 3
    max_iter: int = 100
    max_time: float = math.inf
    tolerance: float = 1e-6
    seed: int = 1
    init_kind: str = "formula"
    factor_momentum: bool = False
    broadcast_bytes: int = FACTOR_BROADCAST_BYTES
    cells_per_salt: int = TARGET_CELLS_PER_SALT


@dataclass
class Run:
    """Small state of one run: Gram matrices per way, weights, cost history."""

    cfg: FitConfig
    gx: list[np.ndarray]
    gy: list[np.ndarray]
    cross: list[np.ndarray]
    wx: np.ndarray
    wy: np.ndarray
    zwx: np.ndarray
    zwy: np.ndarray
    momentum: float = 1.0
    #: Share of the last change of a factor that its next update starts ahead of it.
    push: float = 0.0
    inner_x: float = 0.0
    inner_y: float = 0.0
    cost: float = math.nan
    previous: float = FIRST_PREVIOUS_COST
    log: list[tuple[int, float, float, float]] = field(default_factory=list)

    def grams(self, side: str) -> list[np.ndarray]:
        return self.gx if side == "x" else self.gy


@dataclass
class FitState:
    """Factor tables of all ways and the runs that share them, in column order."""

    factors: list[DataFrame]
    runs: list[Run]
    carried: Compact | None = None

    @property
    def ranks(self) -> list[int]:
        return [run.cfg.rank for run in self.runs]

    @property
    def firsts(self) -> list[int]:
        """First column of every run."""
        return first_columns(self.ranks)

    @property
    def width(self) -> int:
        """Components of all runs together."""
        return sum(self.ranks)


def first_columns(ranks: Sequence[int]) -> list[int]:
    return [0, *accumulate(ranks)][:-1]


@dataclass
class Workspace:
    """Held cells in the layouts the jobs need, with the tensor norms."""

    tensor: PairedTensor
    plan: JoinPlan
    layouts: dict
    norm_x: float
    norm_y: float
    n_cells: int

    @classmethod
    def prepare(
        cls, tensor: PairedTensor, cfg: FitConfig, runs: int = 1, width: int | None = None
    ) -> Workspace:
        """Layouts for jobs that fit ``runs`` runs of this configuration, or ``width`` components
        of any runs, together."""
        base = cut_lineage(tensor.cells)
        inside = " AND ".join(f"i{w} >= 0 AND i{w} < {d}" for w, d in enumerate(tensor.dims))
        row = only_row(
            base.selectExpr(
                "count(1) AS n",
                f"count_if(NOT coalesce({inside}, false)) AS outside",
                *[f"sum({s} * {s}) AS {s}" for s in SIDES],
            )
        )
        if row.outside:
            raise ValueError(f"{row.outside} cells lie outside the dimensions {tensor.dims}")
        if not row.n or not row.x or not row.y:
            raise ValueError("both tensors need at least one non-zero cell")
        plan = plan_joins(
            base, tensor.dims, width or cfg.rank * runs, cfg.broadcast_bytes, cfg.cells_per_salt, row.n
        )
        leads = {k: lead_way(plan, tensor.dims, k) for k in range(tensor.ways)}
        held = {
            lead: hold(layout_for(base, tensor.ways, plan, lead, row.n)) for lead in set(leads.values())
        }
        for lead, cells in held.items():
            if lead is not None:
                # How a held table is partitioned is known to later plans only once it is there.
                cells.count()
        layouts = {k: held[lead] for k, lead in leads.items()}
        return cls(tensor, plan, layouts, math.sqrt(row.x), math.sqrt(row.y), row.n)

    def cells_for(self, way: int) -> PairedTensor:
        return self.tensor.with_cells(self.layouts[way])

    def release(self) -> None:
        for cells in self.layouts.values():
            cells.unpersist()


@dataclass
class FitResult:
    method: str
    config: FitConfig
    dims: tuple[int, ...]
    factors: list[DataFrame]
    weights_x: np.ndarray
    weights_y: np.ndarray
    norm_x: float
    norm_y: float
    cost: float
    log: list[tuple[int, float, float, float]] = field(default_factory=list)
    n_cells: int = 0

    def log_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.log, "iter INT, elapsed DOUBLE, cost DOUBLE, delta DOUBLE"
        )

    def weights_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (side, r, float(w))
            for side, values in (("x", self.weights_x), ("y", self.weights_y))
            for r, w in enumerate(values)
        ]
        return spark.createDataFrame(rows, "side STRING, r INT, w DOUBLE")

    def info(self) -> dict:
        c = self.config
        out = {
            "alg": self.method, "R": c.rank, "distance": c.distance, "alpha": c.alpha,
            "beta": c.beta, "gamma": c.gamma, "delta": c.delta,
            "train_proportion": c.train_proportion, "max_iter": c.max_iter, "seed": c.seed,
            "nb_points": self.n_cells, "init": c.init_kind, "factor_momentum": c.factor_momentum,
            "max_time": c.max_time if math.isfinite(c.max_time) else None,
        }
        out.update({f"dim_{w}": d for w, d in enumerate(self.dims)})
        return out

    def final(self) -> dict:
        return {
            "norm_X": self.norm_x, "norm_Y": self.norm_y, "cost": self.cost,
            "iterations": len(self.log), "elapsed": sum(r[1] for r in self.log),
        }


def frobenius(matrix: np.ndarray, what: str) -> float:
    norm = float(np.linalg.norm(matrix))
    if not math.isfinite(norm) or norm == 0.0:
        raise ValueError(f"{what} has norm {norm}; the update is undefined")
    return norm


def replaced(live: DataFrame, new: dict[str, str]) -> DataFrame:
    """Replace columns by SQL text; every expression sees the old row."""
    return live.selectExpr(*[f"{new[c]} AS {c}" if c in new else c for c in live.columns])


def scaled_factor(factor: DataFrame, width: int, norms: dict[str, np.ndarray]) -> DataFrame:
    """Divide by known column norms; columns without positive norm stay."""
    columns = []
    for side in SIDES:
        for name, n in zip(factor_names(side, width), norms[side]):
            columns.append(f"{name} / {number(n)} AS {name}" if n > 0 else name)
    return factor.selectExpr("idx", *columns)


#: Prefix of the columns that hold a factor's values before its last update (factor momentum).
PREVIOUS = "before_"


def with_previous(factor: DataFrame) -> bool:
    return f"{PREVIOUS}x0" in factor.columns


def run_columns(
    factor: DataFrame, ranks: Sequence[int], slots: Sequence[int], previous: bool = False
) -> DataFrame:
    """The columns of the given runs, renumbered from zero; on request with those before the update."""
    kinds = ["", PREVIOUS] if previous and with_previous(factor) else [""]
    firsts = first_columns(ranks)
    kept = [firsts[slot] + r for slot in slots for r in range(ranks[slot])]
    return factor.selectExpr(
        "idx",
        *[
            f"{kind}{side}{c} AS {kind}{side}{new}"
            for kind in kinds
            for side in SIDES
            for new, c in enumerate(kept)
        ],
    )


def block_gram_aggregates(ranks: Sequence[int]) -> list[str]:
    """Gram sums of every run's own columns, and the diagonal cross products."""
    out = []
    for b, (first, rank) in enumerate(zip(first_columns(ranks), ranks)):
        for p in range(rank):
            i = first + p
            out.append(f"sum(x{i} * y{i}) AS cross_{i}")
            for q in range(p, rank):
                j = first + q
                out += [f"sum({s}{i} * {s}{j}) AS g{s}{b}_{p}_{q}" for s in SIDES]
    return out


def block_grams(row, ranks: Sequence[int]) -> list[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Per run: both Gram matrices and the cross products."""
    cross = vector(row, "cross", sum(ranks))
    return [
        ({s: symmetric_matrix(row, f"g{s}{b}", rank) for s in SIDES}, cross[first : first + rank])
        for b, (first, rank) in enumerate(zip(first_columns(ranks), ranks))
    ]


def positive(norms: np.ndarray) -> np.ndarray:
    return np.where(norms > 0, norms, 1.0)


def scaled_gram(g: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return g / np.outer(positive(norms), positive(norms))


def start_state(
    tensor: PairedTensor, cfgs: Sequence[FitConfig], init: Sequence[DataFrame] | None = None
) -> FitState:
    """Column-normalised start factors of every way, uniform weights.

    ``init`` gives one factor per way, with the columns of all runs side by side.
    """
    spark = tensor.cells.sparkSession
    ranks = [c.rank for c in cfgs]
    width = sum(ranks)
    if init is None:
        starts = [(c.seed, c.init_kind, c.rank) for c in cfgs]
        raw = [init_runs(spark, d, w, starts) for w, d in enumerate(tensor.dims)]
    else:
        raw = [cut_lineage(f.select(*factor_columns(width))) for f in init]
    runs = [Run(c, [], [], [], *[np.full(c.rank, 1.0 / c.rank) for _ in range(4)]) for c in cfgs]
    factors = []
    for w, factor in enumerate(raw):
        # Distinct indices of a user's factor: the right number of rows may still miss some.
        distinct = "count(DISTINCT CASE WHEN idx >= 0 AND idx < {} THEN idx END) AS found"
        known = "count(1) AS found" if init is None else distinct.format(tensor.dims[w])
        row = only_row(
            factor.selectExpr("count(1) AS n", known, *block_gram_aggregates(ranks))
        )
        if row.n != tensor.dims[w]:
            raise ValueError(f"way {w}: factor has {row.n} rows, dimension is {tensor.dims[w]}")
        if row.found != row.n:
            raise ValueError(f"way {w}: factor misses {row.n - row.found} indices of the dimension")
        norms = {s: [] for s in SIDES}
        for run, (grams, cross) in zip(runs, block_grams(row, ranks)):
            own = {s: np.sqrt(np.diag(grams[s])) for s in SIDES}
            run.gx.append(scaled_gram(grams["x"], own["x"]))
            run.gy.append(scaled_gram(grams["y"], own["y"]))
            run.cross.append(cross / (positive(own["x"]) * positive(own["y"])))
            for s in SIDES:
                norms[s].extend(own[s])
        factors.append(cut_lineage(scaled_factor(factor, width, norms)))
    return FitState(factors, runs)


Step = Callable[[Workspace, FitState], FitState]


def run_cost(ws: Workspace, run: Run) -> float:
    """Joint relative cost from the Grams and inner products the step already has."""
    return joint_cost(
        squared_residual(ws.norm_x, float(hadamard(run.gx).sum()), run.inner_x),
        squared_residual(ws.norm_y, float(hadamard(run.gy).sum()), run.inner_y),
        ws.norm_x,
        ws.norm_y,
    )


def _advance(ws: Workspace, state: FitState, i: int, elapsed: float) -> list[int]:
    """Record the iteration; slots of the runs that stop here.

    Shared jobs are paid by columns: a run is charged its share of the table's width, so its clock
    runs about as it would alone and its time limit does not depend on the batch.
    """
    stopped = []
    for slot, run in enumerate(state.runs):
        run.cost = run_cost(ws, run)
        change = abs(run.cost - run.previous)
        run.log.append((i, elapsed * run.cfg.rank / state.width, run.cost, change))
        if run.cfg.factor_momentum and run.cost > run.previous:
            # The extrapolation overshot: the next iteration starts from the iterate itself.
            run.momentum, run.push = 1.0, 0.0
            run.zwx, run.zwy = run.wx.copy(), run.wy.copy()
        spent = sum(entry[1] for entry in run.log)
        if spent > run.cfg.max_time or change < run.cfg.tolerance or i >= run.cfg.max_iter:
            stopped.append(slot)
        run.previous = run.cost
    return stopped


def fit_runs(
    tensor: PairedTensor,
    step: Step,
    cfgs: Sequence[FitConfig],
    init: Sequence[DataFrame] | None = None,
    workspace: Workspace | None = None,
    on_iteration: Callable[[int, FitState], None] | None = None,
    state_path: str | None = None,
) -> list[FitResult]:
    """Fit several runs in shared jobs until each has settled, timed out or hit ``max_iter``.

    ``state_path`` names a folder in which the fit keeps its state; it goes on from there if an
    earlier call of the same fit was broken off, and finds its results there if it had ended.
    """
    from pairlens.plans.resume import StateStore

    ws = workspace or Workspace.prepare(tensor, cfgs[0], width=sum(c.rank for c in cfgs))
    store = state_path and StateStore(tensor.cells.sparkSession, state_path, step.__name__, ws, cfgs)
    state, results = None, {}
    try:
        found = store and store.load()
        if found:
            i, state, order, results = found
        else:
            i, state, order = 0, start_state(tensor, cfgs, init), list(range(len(cfgs)))
        while state.runs:
            i += 1
            begun = time.monotonic()
            state = step(ws, state)
            stopped = _advance(ws, state, i, time.monotonic() - begun)
            if on_iteration is not None:
                on_iteration(i, state)
            ended = []
            for slot in stopped:
                factors = [run_columns(f, state.ranks, [slot]) for f in state.factors]
                ended.append(order[slot])
                results[order[slot]] = result_of(ws, step.__name__, state.runs[slot], factors)
            if stopped:
                kept = [slot for slot in range(len(state.runs)) if slot not in stopped]
                if state.carried is not None:
                    state.carried.release()
                factors = [run_columns(f, state.ranks, kept, previous=True) for f in state.factors]
                state = FitState(factors, [state.runs[slot] for slot in kept])
                order = [order[slot] for slot in kept]
            if store:
                store.save(i, state, order, {k: results[k] for k in ended})
    finally:
        if state is not None and state.carried is not None:
            state.carried.release()
        if workspace is None:
            ws.release()
    return [results[k] for k in range(len(cfgs))]


def result_of(ws: Workspace, method: str, run: Run, factors: list[DataFrame]) -> FitResult:
    return FitResult(
        method, run.cfg, ws.tensor.dims, factors, run.wx, run.wy, ws.norm_x, ws.norm_y, run.cost, run.log,
        ws.n_cells,
    )


def fit(
    tensor: PairedTensor,
    step: Step,
    cfg: FitConfig,
    init: Sequence[DataFrame] | None = None,
    workspace: Workspace | None = None,
    on_iteration: Callable[[int, FitState], None] | None = None,
    state_path: str | None = None,
) -> FitResult:
    """Iterate ``step`` until the cost settles, time is up or ``max_iter`` is reached."""
    return fit_runs(tensor, step, [cfg], init, workspace, on_iteration, state_path)[0]
