"""One iteration of the pairwise discriminative factorisation.

Ways are updated in turn, columns in turn within a way. A column update is row-local given
the rank x rank Gram product, except for its norm over all rows, which is one aggregate for
both sides. With factor momentum a column starts its step from a point ahead of the iterate,
which is the iterate plus a share of its last change; a factor table then also carries the values
before its last update, so that the point ahead is a row expression and costs no join or pass. One cells pass per way; the weight update and the cost need no pass of their own:
with the last way's products M, any core sum is ``sum_i A[i, r] * M[i, r]``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from pairlens.functions.columns import floored_sql, number
from pairlens.operators.algebra import (
    complete,
    hadamard,
    mttkrp,
    mttkrp_weighted,
    vector,
)
from pairlens.operators.weights import floored, next_momentum, unit_sum
from pairlens.plans.fit import (
    COLUMNS_PER_PLAN,
    PREVIOUS,
    FitConfig,
    FitState,
    Run,
    Workspace,
    block_gram_aggregates,
    block_grams,
    frobenius,
    replaced,
    with_previous,
)
from pairlens.schema import SIDES, factor_columns
from pairlens.session import cut_lineage, hold, hold_compact, only_row


@dataclass(frozen=True)
class _Gradient:
    """Coefficients of one run's column steps in one way, for columns ``first .. first + rank``.

    ``quad[s][j, l]`` multiplies column j in step l; ``z`` and ``same`` weigh the grown and the
    unchanged signal; ``pull`` draws the sides together or apart.
    """

    rank: int
    first: int
    quad: dict[str, np.ndarray]
    z: dict[str, np.ndarray]
    same: dict[str, np.ndarray]
    pull: dict[str, np.ndarray]
    nf: dict[str, float]
    share: dict[str, np.ndarray]
    last: bool
    ahead: bool = False

    @classmethod
    def of(cls, ws: Workspace, run: Run, first: int, way: int, factor: DataFrame) -> _Gradient:
        cfg = run.cfg
        quad, z, same, pull, nf, share = {}, {}, {}, {}, {}, {}
        for s, norm, w, sign in (("x", ws.norm_x, run.wx, 1.0), ("y", ws.norm_y, run.wy, -1.0)):
            n, a = 1.0 / norm, 1.0 - w
            product = hadamard(run.grams(s), way)
            nf[s] = frobenius(product, f"Gram product of way {way}")
            z[s], same[s], pull[s], share[s] = n * cfg.alpha * w, n * cfg.beta * a, sign * n * cfg.gamma * a, a
            quad[s] = product * (1.0 + z[s] * w + same[s] * a)[np.newaxis, :]
        last = way == ws.tensor.ways - 1
        ahead = run.push > 0 and with_previous(factor)
        return cls(cfg.rank, first, quad, z, same, pull, nf, share, last, ahead)

    def signal_weight(self, side: str, l: int) -> str:
        """Cell value whose product sum carries all signal terms of a component."""
        return f"{side} + {number(self.z[side][l])} * z{side} + {number(self.same[side][l])} * s"

    def step(self, side: str, l: int, without: int | None = None) -> str:
        """Column l after its step, from the live matrix and before flooring.

        ``without`` leaves out the term of another column.
        """
        c = self.first + l
        quadratic = " + ".join(
            f"{side}{self.first + j} * {number(self.quad[side][j, l])}"
            for j in range(self.rank)
            if j != without
        )
        target = f"m{side}{c}"
        if self.last:
            target = (
                f"({target} + {number(self.z[side][l])} * mz{side}{c}"
                f" + {number(self.same[side][l])} * ms{side}{c})"
            )
        apart = f"({number(self.share['x'][l])} * x{c} - {number(self.share['y'][l])} * y{c})"
        gradient = f"{quadratic or '0.0D'} - {target} + {number(self.pull[side][l])} * {apart}"
        base = f"{AHEAD}{side}{c}" if self.ahead else f"{side}{c}"
        return f"{base} - ({gradient}) / {number(self.nf[side])}"


# Prefix of the columns that hold the points the steps of an update start from.
AHEAD = "ahead_"


def _with_ahead(live: DataFrame, runs: list[Run], gradients: list[_Gradient]) -> DataFrame:
    """Keep the values before the update and, where a run has a push, add the points ahead."""
    columns = [c for c in live.columns if not c.startswith(PREVIOUS)]
    for run, g in zip(runs, gradients):
        for s in SIDES:
            for c in range(g.first, g.first + g.rank):
                columns.append(f"{s}{c} AS {PREVIOUS}{s}{c}")
                if g.ahead:
                    columns.append(f"{s}{c} + {number(run.push)} * ({s}{c} - {PREVIOUS}{s}{c}) AS {AHEAD}{s}{c}")
    return live.selectExpr(*columns)


# A derived squared norm below this share of its terms is measured instead.
CANCELLATION = 1e-4


def _stepped(live: DataFrame, l: int, gradients: list[_Gradient]) -> DataFrame:
    return replaced(
        live, {f"{s}{g.first + l}": g.step(s, l) for g in gradients for s in SIDES}
    )


def _column_norms(live: DataFrame, l: int, gradients: list[_Gradient]) -> dict[str, float]:
    """Norm of column l of every run and side, by column name."""
    names = [f"{s}{g.first + l}" for g in gradients for s in SIDES]
    return only_row(live.selectExpr(*[f"sqrt(sum({c} * {c})) AS {c}" for c in names])).asDict()


def _norm_pair(live: DataFrame, l: int, gradients: list[_Gradient]) -> tuple[dict, dict | None]:
    """Norms of the stepped column l and of column l + 1 after it, from one aggregate.

    Runs whose last column is l have no following one.

    With ``p`` the non-negative part of column l and ``n`` its norm, column l + 1 steps to
    ``base - c * p / n``: ``base`` and ``p`` are known in this pass, and the squared norm of the
    difference needs only their inner products.
    """
    columns = [(g, s, f"{s}{g.first + l}") for g in gradients for s in SIDES]
    longer = [(g, s, c) for g, s, c in columns if l + 1 < g.rank]
    parts = live.selectExpr(
        *[f"{c} AS r_{c}" for _g, _s, c in columns],
        *[f"greatest({c}, 0.0D) AS p_{c}" for _g, _s, c in longer],
        *[f"{g.step(s, l + 1, without=l)} AS b_{c}" for g, s, c in longer],
    )
    row = only_row(
        parts.selectExpr(
            *[f"sum(r_{c} * r_{c}) AS rr_{c}" for _g, _s, c in columns],
            *[
                f"sum({a}_{c} * {b}_{c}) AS {a}{b}_{c}"
                for _g, _s, c in longer
                for a, b in (("p", "p"), ("b", "b"), ("b", "p"))
            ],
        )
    )
    first, second = {name: math.sqrt(row[f"rr_{name}"]) for _g, _s, name in columns}, {}
    for g, s, name in longer:
        c = g.quad[s][l, l + 1] / g.nf[s] / (first[name] or 1.0)
        plus = row[f"bb_{name}"] + c * c * row[f"pp_{name}"]
        squared = plus - 2.0 * c * row[f"bp_{name}"]
        following = f"{s}{g.first + l + 1}"
        second[following] = math.sqrt(squared) if squared > CANCELLATION * plus else None
    return first, None if None in second.values() else second


def _floored(live: DataFrame, l: int, gradients: list[_Gradient], norms: dict) -> DataFrame:
    """Scale a stepped column to unit norm where one is given, then floor it."""
    new = {}
    for name in (f"{s}{g.first + l}" for g in gradients for s in SIDES):
        scaled = f"({name} / {number(norms[name])})" if norms.get(name, 0.0) > 0 else name
        new[name] = floored_sql(scaled, 0.0)
    return replaced(live, new)


def _updated_columns(live: DataFrame, gradients: list[_Gradient], held: list) -> DataFrame:
    """All columns of a way in order; the last way carries the scale and needs no norms."""
    following, last = None, gradients[0].last
    rank = max(g.rank for g in gradients)
    for l in range(rank):
        own = [g for g in gradients if l < g.rank]
        live = _stepped(live, l, own)
        if last:
            norms = {}
        elif following is not None:
            norms, following = following, None
        elif l + 1 < rank:
            norms, following = _norm_pair(live, l, own)
        else:
            norms = _column_norms(live, l, own)
        live = _floored(live, l, own, norms)
        if (l + 1) % COLUMNS_PER_PLAN == 0 and l + 1 < rank:
            live = hold(cut_lineage(live))
            held.append(live)
    return live


# Core sums read off the last way: name -> (side, product prefix).
CORE_SUMS = {
    "inner_x": ("x", "mx"), "inner_y": ("y", "my"), "gzx": ("x", "mzx"),
    "gzy": ("y", "mzy"), "gsx": ("x", "msx"), "gsy": ("y", "msy"),
}


def update_way(ws: Workspace, state: FitState, way: int) -> list[dict] | None:
    """Update one way of all runs; the last way also returns each run's core sums."""
    ranks, width, runs = state.ranks, state.width, state.runs
    last = way == ws.tensor.ways - 1
    gradients = [
        _Gradient.of(ws, run, first, way, state.factors[way])
        for run, first in zip(runs, state.firsts)
    ]
    owner = [(g, l) for g in gradients for l in range(g.rank)]
    momentum = any(run.cfg.factor_momentum for run in runs)
    cells = ws.cells_for(way)
    if last:
        products = mttkrp(cells, state.factors, width, way, plan=ws.plan)
    else:
        # All signal terms of a side enter linearly, so they are summed as one column.
        def combined(side):
            return lambda c: owner[c][0].signal_weight(side, owner[c][1])

        products = mttkrp_weighted(
            cells, state.factors, width, way,
            {"mx": ("x", combined("x")), "my": ("y", combined("y"))}, plan=ws.plan,
        )
    source = hold_compact(complete(state.factors[way], products), ws.tensor.dims[way])
    held = [source.held]
    live = _with_ahead(source.table, runs, gradients) if momentum else source.table
    live = _updated_columns(live, gradients, held)
    cores = None
    if last:
        row = only_row(
            live.selectExpr(
                *block_gram_aggregates(ranks),
                *[
                    f"sum({side}{c} * {m}{c}) AS {name}_{c}"
                    for name, (side, m) in CORE_SUMS.items()
                    for c in range(width)
                ],
            )
        )
        sums = {name: vector(row, name, width) for name in CORE_SUMS}
        cores = [
            {name: v[g.first : g.first + g.rank] for name, v in sums.items()} for g in gradients
        ]
    kept = factor_columns(width)
    if momentum:
        kept += [PREVIOUS + c for c in kept[1:]]
    factor = cut_lineage(live.select(*kept))
    if not last:
        row = only_row(factor.selectExpr(*block_gram_aggregates(ranks)))
    for df in held:
        df.unpersist()
    state.factors[way] = factor
    for run, (grams, cross) in zip(runs, block_grams(row, ranks)):
        run.gx[way], run.gy[way], run.cross[way] = grams["x"], grams["y"], cross
    return cores


def weight_gradients(state_w, other_w, fx_diag, gz, gs, own, cross, cfg: FitConfig, sign: float):
    """Derivative of the objective in one side's weights (diagonal only).

    ``own`` and ``cross`` are the way-summed squared and mixed column products; ``sign`` is
    -1 for the first side and +1 for the second.
    """
    if sign < 0:
        pull = -((1.0 - state_w) * own - (1.0 - other_w) * cross)
    else:
        pull = (1.0 - other_w) * cross - (1.0 - state_w) * own
    return (
        cfg.alpha * (state_w * fx_diag - gz)
        - cfg.beta * ((1.0 - state_w) * fx_diag - gs)
        + cfg.gamma * pull
    )


def update_weights(run: Run, core: dict) -> None:
    cfg = run.cfg
    fx, fy = hadamard(run.gx), hadamard(run.gy)
    own_x = sum(np.diag(g) for g in run.gx)
    own_y = sum(np.diag(g) for g in run.gy)
    cross = sum(run.cross)
    dx = weight_gradients(run.wx, run.wy, np.diag(fx), core["gzx"], core["gsx"],
                          own_x, cross, cfg, -1.0)
    dy = weight_gradients(run.wy, run.wx, np.diag(fy), core["gzy"], core["gsy"],
                          own_y, cross, cfg, 1.0)
    new_x = unit_sum(floored(run.zwx - dx / frobenius(fx, "Gram product X")), "X weights")
    new_y = unit_sum(floored(run.zwy - dy / frobenius(fy, "Gram product Y")), "Y weights")
    following = next_momentum(run.momentum)
    push = (run.momentum - 1.0) / following
    run.zwx = new_x + push * (new_x - run.wx)
    run.zwy = new_y + push * (new_y - run.wy)
    run.wx, run.wy, run.momentum = new_x, new_y, following
    run.push = push if cfg.factor_momentum else 0.0


def pairwise(ws: Workspace, state: FitState) -> FitState:
    cores = None
    for way in range(ws.tensor.ways):
        cores = update_way(ws, state, way)
    for run, core in zip(state.runs, cores):
        update_weights(run, core)
        run.inner_x = float(math.fsum(core["inner_x"]))
        run.inner_y = float(math.fsum(core["inner_y"]))
    return state
