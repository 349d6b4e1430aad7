"""One iteration of the common/discriminative baseline with a fixed number of shared columns.

All products, Grams and row sums are taken from the factors at the start of the iteration, so
every way is one cells pass followed by row-local columns. The pass that yields the cost is the
next iteration's product for the last way and is carried over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pairlens.functions.columns import FACTOR_EPS, floored_sql, number
from pairlens.operators.algebra import complete, hadamard, mttkrp, tail_mass
from pairlens.plans.fit import (
    COLUMNS_PER_PLAN,
    FitState,
    Run,
    Workspace,
    block_gram_aggregates,
    block_grams,
    positive,
    replaced,
    scaled_factor,
    scaled_gram,
)
from pairlens.schema import SIDES, factor_columns
from pairlens.session import Compact, cut_lineage, hold_compact, only_row

PRODUCT_TERMS = (("mx", "x", "x"), ("my", "y", "y"))


def _products(ws: Workspace, factors: list[DataFrame], state: FitState, way: int) -> Compact:
    """Factor rows with both products and the discriminative row sums, held for the update."""
    products = mttkrp(ws.cells_for(way), factors, state.width, way, PRODUCT_TERMS, ws.plan)
    tails = [
        f"{tail_mass(run.cfg.rank, s, run.cfg.distance, first)} AS tail_{s}{slot}"
        for slot, (run, first) in enumerate(zip(state.runs, state.firsts))
        for s in SIDES
    ]
    return hold_compact(complete(factors[way], products, *tails), ws.tensor.dims[way])


def _stages(
    ws: Workspace, run: Run, slot: int, first: int, way: int, l: int
) -> list[dict[str, str]]:
    """Column l of one run as two successive sets of replacements.

    Common columns pull the sides towards each other, the second side seeing the first one's new
    value. Discriminative ones use the other side's stale row sum, with opposite signs.
    """
    cfg, n = run.cfg, {"x": ws.norm_x, "y": ws.norm_y}
    c = first + l
    out = []
    for s, other in (("x", "y"), ("y", "x")):
        f = hadamard(run.grams(s), way)
        own = float(f[l, l])
        dot = " + ".join(f"{s}{first + j} * {number(f[j, l])}" for j in range(cfg.rank))
        rest = f"m{s}{c} - ({dot})"
        if l < cfg.distance:
            a = n[s] * cfg.alpha
            if own + a == 0.0:
                raise ValueError(f"component {l}: zero Gram diagonal and zero alpha")
            new = (
                f"{s}{c} * {number(own / (own + a))} + ({rest} + {number(a)} * {other}{c})"
                f" / {number(own + a + FACTOR_EPS)}"
            )
        else:
            push = (-1.0 if s == "x" else 1.0) * n[s] * cfg.beta / 2.0
            new = (
                f"{s}{c} + ({rest} + {number(push)} * tail_{other}{slot})"
                f" / {number(own + FACTOR_EPS)}"
            )
        out.append({f"{s}{c}": new})
    return out


def baseline(ws: Workspace, state: FitState) -> FitState:
    ranks, firsts, width, runs, ways = state.ranks, state.firsts, state.width, state.runs, ws.tensor.ways
    rank = max(ranks)
    if any(run.cfg.factor_momentum for run in runs):
        raise ValueError("the baseline's columns have closed forms and take no factor momentum")
    factors, grams = [], []
    for way in range(ways):
        last = way == ways - 1
        carried = state.carried if last else None
        source = carried if carried is not None else _products(ws, state.factors, state, way)
        live = source.table
        for l in range(rank):
            own = [slot for slot in range(len(runs)) if l < ranks[slot]]
            stages = [_stages(ws, runs[slot], slot, firsts[slot], way, l) for slot in own]
            for part in zip(*stages):
                live = replaced(live, {k: v for new in part for k, v in new.items()})
            names = [f"{s}{firsts[slot] + l}" for slot in own for s in SIDES]
            live = replaced(live, {c: floored_sql(c, FACTOR_EPS) for c in names})
            if (l + 1) % COLUMNS_PER_PLAN == 0 and l + 1 < rank:
                live = cut_lineage(live)
        new = cut_lineage(live.select(*factor_columns(width)))
        row = only_row(new.selectExpr(*block_gram_aggregates(ranks)))
        per_run = block_grams(row, ranks)
        if not last:
            # Flooring came first, so unit columns and their Grams follow from the raw Grams.
            lengths = [{s: np.sqrt(np.diag(g[s])) for s in SIDES} for g, _cross in per_run]
            norms = {s: np.concatenate([o[s] for o in lengths]) for s in SIDES}
            new = scaled_factor(new, width, norms)
            per_run = [
                (
                    {s: scaled_gram(g[s], o[s]) for s in SIDES},
                    cross / (positive(o["x"]) * positive(o["y"])),
                )
                for (g, cross), o in zip(per_run, lengths)
            ]
        source.release()
        factors.append(new)
        grams.append(per_run)
    for slot, run in enumerate(runs):
        run.gx = [per_run[slot][0]["x"] for per_run in grams]
        run.gy = [per_run[slot][0]["y"] for per_run in grams]
        run.cross = [per_run[slot][1] for per_run in grams]
    state.factors = factors
    state.carried = _products(ws, factors, state, ways - 1)
    inner = only_row(
        state.carried.table.selectExpr(
            *[
                "sum("
                + " + ".join(f"{s}{c} * m{s}{c}" for c in range(first, first + rank))
                + f") AS {s}{slot}"
                for slot, (first, rank) in enumerate(zip(firsts, ranks))
                for s in SIDES
            ]
        )
    )
    for slot, run in enumerate(runs):
        run.inner_x, run.inner_y = inner[f"x{slot}"], inner[f"y{slot}"]
    return state
