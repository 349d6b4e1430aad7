from __future__ import annotations

import math
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.operators import algebra as al
from pairlens.operators.align import signals, with_split
from pairlens.operators.gather import gather
from pairlens.operators.weights import normalize_weights, widen_weights
from pairlens.plans.baseline import baseline
from pairlens.plans.fit import FitConfig, Workspace, fit, fit_runs
from pairlens.plans.pairwise import pairwise
from pairlens.plans.sweep import (
    RUN_KEY_SCHEMA,
    cost_delta,
    holdout_rmse,
    pending_runs,
    run_grid,
    run_sweep,
    run_trials,
)
from pairlens.schema import SIGNALS, PairedTensor, coord_names
from pairlens.sources.sinks import write_matrix
from tests import numpy_model as nm
from tests.conftest import TESTDATA

SMALL = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def event3(spark):
    t = fx.event3(spark, SMALL)
    return t.with_cells(t.cells.persist())


@pytest.fixture(scope="module")
def dense(event3):
    rows = event3.cells.collect()
    return {s: nm.dense(rows, event3.dims, s) for s in SIGNALS}


def matrix(factor, side, rank):
    rows = sorted(factor.collect(), key=lambda r: r.idx)
    return np.array([[r[f"{side}{c}"] for c in range(rank)] for r in rows])


def assert_factors(result, u, v, rank):
    for factor, a, b in zip(result.factors, u, v):
        assert np.allclose(matrix(factor, "x", rank), a, rtol=1e-8, atol=1e-8)
        assert np.allclose(matrix(factor, "y", rank), b, rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("joins", [{}, {"broadcast_bytes": 0, "cells_per_salt": 30}])
def test_pairwise_parity(event3, dense, joins):
    """Factors, weights and costs against the dense model, broadcast and salted joins."""
    cfg = FitConfig(rank=4, max_iter=3, **joins)
    result = fit(event3, pairwise, cfg)
    u, v = nm.start(event3.dims, 4, 1)
    model = nm.Pairwise(dense["x"], dense["y"], u, v, (0.1, 0.1, 0.1))
    model.s = dense["s"]
    costs = [model.step() for _ in range(3)]
    assert np.allclose([r[2] for r in result.log], costs, atol=1e-8)
    assert round(costs[0], 4) == 0.8764
    assert np.allclose(result.weights_x, model.wx, atol=1e-8)
    assert np.allclose(result.weights_y, model.wy, atol=1e-8)
    assert_factors(result, u, v, 4)


@pytest.mark.parametrize("iterations,restarts", [(4, 0), (8, 1)])
def test_factor_momentum_parity(event3, dense, iterations, restarts):
    """Steps from points ahead of the iterate; the cost rises in the seventh iteration."""
    cfg = FitConfig(rank=2, max_iter=iterations, factor_momentum=True)
    jobs = []
    result = fit(event3, pairwise, cfg, on_iteration=lambda i, s: jobs.append(s.runs[0].push))
    u, v = nm.start(event3.dims, 2, 1)
    model = nm.Pairwise(dense["x"], dense["y"], u, v, (0.1, 0.1, 0.1), ahead=True)
    model.s = dense["s"]
    costs = [model.step() for _ in range(iterations)]
    assert np.allclose([r[2] for r in result.log], costs, atol=1e-7)
    assert np.allclose(result.weights_x, model.wx, atol=1e-7)
    assert np.allclose(result.weights_y, model.wy, atol=1e-7)
    assert_factors(result, u, v, 2)
    assert jobs[0] == 0.0 < max(jobs)
    # After a restart the momentum starts at 1 again, whose first push is 0 too.
    assert model.restarts == restarts and jobs[1:].count(0.0) == 2 * restarts
    assert result.factors[0].columns == ["idx", *(f"{s}{r}" for s in "xy" for r in range(2))]


def test_factor_momentum_of_some_runs(event3):
    """Runs with and without momentum, of several lengths, in shared jobs."""
    cfgs = [
        FitConfig(rank=1, max_iter=4, factor_momentum=True),
        FitConfig(rank=2, max_iter=3, seed=2),
        FitConfig(rank=1, max_iter=1, seed=3, factor_momentum=True),
    ]
    for shared, cfg in zip(fit_runs(event3, pairwise, cfgs), cfgs):
        alone = fit(event3, pairwise, cfg)
        assert np.allclose([r[2] for r in shared.log], [r[2] for r in alone.log], atol=1e-10)
    with pytest.raises(ValueError, match="momentum"):
        fit(event3, baseline, cfgs[0])


def test_baseline_parity(event3, dense):
    result = fit(event3, baseline, FitConfig(rank=4, max_iter=3, alpha=1e-4, beta=1e-4, distance=2))
    u, v = nm.start(event3.dims, 4, 1)
    costs = []
    for _ in range(3):
        u, v, c = nm.baseline_step(dense["x"], dense["y"], u, v, 2, 1e-4, 1e-4)
        costs.append(c)
    assert np.allclose([r[2] for r in result.log], costs, atol=1e-8)
    assert round(costs[0], 4) == 0.8731
    assert np.allclose(result.weights_x, 0.25)
    assert_factors(result, u, v, 4)


def test_four_ways_and_more_components_than_one_plan_holds(spark, monkeypatch):
    from pairlens.plans import baseline as bl
    from pairlens.plans import pairwise as pw

    monkeypatch.setattr(pw, "COLUMNS_PER_PLAN", 2)
    monkeypatch.setattr(bl, "COLUMNS_PER_PLAN", 2)
    t = fx.order4(spark, SMALL)
    rows = t.cells.collect()
    d = {s: nm.dense(rows, t.dims, s) for s in SIGNALS}
    u, v = nm.start(t.dims, 3, 2)
    model = nm.Pairwise(d["x"], d["y"], u, v, (0.5, 0.2, 0.1))
    model.s = d["s"]
    want = model.step()
    got = fit(t, pairwise, FitConfig(rank=3, max_iter=1, seed=2, alpha=0.5, beta=0.2))
    assert math.isclose(got.cost, want, abs_tol=1e-8)
    assert_factors(got, u, v, 3)
    u, v = nm.start(t.dims, 3, 2)
    u, v, want = nm.baseline_step(d["x"], d["y"], u, v, 1, 1e-4, 1e-4)
    got = fit(t, baseline, FitConfig(rank=3, max_iter=1, seed=2, alpha=1e-4, beta=1e-4, distance=1))
    assert math.isclose(got.cost, want, abs_tol=1e-8)
    assert_factors(got, u, v, 3)


def test_stop_rules_and_user_start(spark, event3):
    calls = []
    loose = fit(event3, baseline, FitConfig(rank=1, max_iter=5, tolerance=10.0, distance=1, alpha=1e-4),
                on_iteration=lambda i, s: calls.append(i))
    assert len(loose.log) == 2 and calls == [1, 2]  # the first change is against 1e10
    assert len(fit(event3, baseline, FitConfig(rank=1, max_iter=5, max_time=0.0, distance=1)).log) == 1
    init = al.init_factors(spark, event3.dims, 2, 1)
    a = fit(event3, baseline, FitConfig(rank=2, max_iter=1, distance=1), init=init)
    b = fit(event3, baseline, FitConfig(rank=2, max_iter=1, distance=1))
    assert math.isclose(a.cost, b.cost, abs_tol=1e-12)
    with pytest.raises(ValueError, match="dimension"):
        fit(event3, baseline, FitConfig(rank=2, max_iter=1), init=[init[0].limit(3), *init[1:]])


def test_cells_outside_the_dimensions_raise(event3):
    """An inner join with the factors would drop them silently."""
    with pytest.raises(ValueError, match="outside the dimensions"):
        fit(PairedTensor(event3.cells, (16, 5, 20)), pairwise, FitConfig(rank=2, max_iter=1))


def test_collapsed_weights_raise(event3):
    with pytest.raises(ValueError, match="weights sum to 0"):
        fit(event3, pairwise, FitConfig(rank=1, max_iter=1, alpha=1e9, beta=0.0, gamma=0.0))


def test_derived_norm_falls_back_when_terms_cancel(event3, monkeypatch):
    """Measuring every norm gives the same fit as deriving every second one."""
    from pairlens.plans import pairwise as pw

    cfg = FitConfig(rank=3, max_iter=2)
    derived = fit(event3, pairwise, cfg)
    monkeypatch.setattr(pw, "CANCELLATION", 2.0)
    measured = fit(event3, pairwise, cfg)
    assert np.allclose([r[2] for r in derived.log], [r[2] for r in measured.log], atol=1e-11)
    assert np.allclose(derived.weights_x, measured.weights_x, atol=1e-10)


def test_zero_tensor_and_collapsed_weights_raise(spark, event3):
    zero = event3.with_cells(event3.cells.withColumn("x", F.lit(0.0)))
    with pytest.raises(ValueError, match="non-zero cell"):
        fit(zero, pairwise, FitConfig(rank=2, max_iter=1))
    weights = spark.createDataFrame([("x", 0, 0.0), ("x", 1, 0.0)], "side STRING, r INT, w DOUBLE")
    with pytest.raises(Exception, match="all component weights"):
        normalize_weights(weights).collect()


@pytest.mark.parametrize("target", [10**6, 30])
def test_shuffled_layout_does_not_reshuffle_cells(spark, event3, target):
    """Cells held by the shuffled way's key: a job shuffles the factor, not the cells."""
    ws = Workspace.prepare(event3, FitConfig(rank=2, broadcast_bytes=0, cells_per_salt=target))
    assert (2 in ws.plan.hot) == (target == 30)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        factors = al.init_factors(spark, event3.dims, 2, 1)
        joined = gather(ws.cells_for(1).cells, factors, 2, [2], ws.plan)
        assert joined.count() == ws.n_cells
        text = joined._jdf.queryExecution().executedPlan().toString()
        above_cache = "\n".join(
            line for line in text.splitlines() if "Exchange" in line and "REPARTITION" not in line
        )
        assert above_cache.count("Exchange hashpartitioning") == 1, text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        ws.release()


def test_trials_tables(event3):
    tables = run_trials(event3, FitConfig(rank=2, max_iter=1), "pairwise", 2, "case_a", noise=0.01)
    costs = tables.final_cost
    assert costs.columns == [
        "iter", "elapsed", "cost", "trial_ID", "ground_truth_k", "k", "noise", "train_proportion",
        "alpha", "beta", "delta", "gamma", "distance",
    ]
    assert [r.trial_ID for r in costs.orderBy("iter").collect()] == [0, 1]
    w = tables.weights
    assert w.columns[:3] == ["w0", "w1", "tensor"] and w.count() == 4
    assert {r.tensor for r in w.collect()} == {"X", "Y"}
    assert "norm_X" in tables.info.first().final


@pytest.mark.parametrize("step,extra", [(pairwise, {}), (baseline, {"alpha": 1e-4, "beta": 1e-4})])
def test_runs_fitted_together_equal_runs_fitted_alone(event3, step, extra):
    """Different seeds, parameters and lengths in shared jobs; each as if it were alone."""
    cfgs = [
        FitConfig(rank=3, max_iter=3, seed=1, distance=2, **extra),
        FitConfig(rank=3, max_iter=1, seed=2, distance=1, **extra),
        FitConfig(rank=3, max_iter=2, seed=3, distance=2, gamma=0.5, **extra),
    ]
    together = fit_runs(event3, step, cfgs)
    for cfg, shared in zip(cfgs, together):
        alone = fit(event3, step, cfg)
        assert shared.config is cfg and len(shared.log) == cfg.max_iter
        assert np.allclose([r[2] for r in shared.log], [r[2] for r in alone.log], atol=1e-10)
        assert np.allclose(shared.weights_x, alone.weights_x, atol=1e-9)
        for a, b in zip(shared.factors, alone.factors):
            assert np.allclose(matrix(a, "y", 3), matrix(b, "y", 3), rtol=1e-8, atol=1e-8)


def test_trial_batches(event3, monkeypatch):
    from pairlens.plans import sweep

    cfg = FitConfig(rank=2, max_iter=1)
    wide = run_trials(event3, cfg, "pairwise", 3)
    monkeypatch.setattr(sweep, "COMPONENTS_PER_JOB", 4)
    narrow = run_trials(event3, cfg, "pairwise", 3)
    assert [r.config.seed for r in narrow.results] == [1, 2, 3]
    assert np.allclose([r.cost for r in wide.results], [r.cost for r in narrow.results], atol=1e-10)


def test_sweep_resumes(spark, event3, tmp_path):
    grid = run_grid(
        spark, method=["baseline"], seed=[0, 1], rank=[2], distance=[1], alpha=[1e-4, 1e-3], beta=[1e-4],
        gamma=[1.0], delta=[1.0], train_proportion=[10.0],
    )
    assert grid.count() == 4
    out, loads = str(tmp_path / "out"), []

    def load(seed):
        loads.append(seed)
        return event3

    first = run_sweep(spark, load, grid.where("seed = 0 and alpha < 5e-4"), out, 1, 1, save_factors=True)
    assert first.count() == 1 and loads == [0]
    total = run_sweep(spark, load, grid.where("seed = 0"), out, 1, 1)
    assert total.count() == 2 and loads == [0, 0]
    run_sweep(spark, load, grid.where("seed = 0"), out, 1, 1)
    assert loads == [0, 0]  # nothing pending, nothing loaded
    factors = spark.read.parquet(f"{out}/factors_R2")
    assert factors.where("side = 'X' and way = 0").count() == event3.dims[0]
    assert sorted(os.listdir(out)) == ["cost_final", "factors_R2", "run_info", "run_log", "weights_R2"]
    done = spark.createDataFrame([], RUN_KEY_SCHEMA)
    assert pending_runs(grid, done).count() == 4


def test_csv_matrix_is_headerless_and_ordered(spark, tmp_path):
    factor = al.init_factor(spark, 20, 0, 2, 1)
    write_matrix(factor, 2, 0, str(tmp_path / "m"), fmt="csv")
    folder = tmp_path / "m" / "kind=factor" / "side=X" / "way=0"
    lines = [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]
    assert [int(line.split(",")[0]) for line in lines] == list(range(20))


def test_weight_table_and_cost_delta(spark):
    w = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 3.0), ("y", 0, 2.0), ("y", 1, 2.0)],
                              "side STRING, r INT, w DOUBLE")
    wide = {r.tensor: (r.w0, r.w1) for r in widen_weights(normalize_weights(w), 2).collect()}
    assert wide == {"X": (0.25, 0.75), "Y": (0.5, 0.5)}
    log = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0)], "run STRING, iter INT, cost DOUBLE")
    assert [r.delta for r in cost_delta(log, ["run"]).orderBy("iter").collect()] == [None, 2.0]


def test_holdout(spark, event3):
    labelled = event3.with_cells(with_split(event3.cells, event3.coords, 6.0))
    factors = al.init_factors(spark, event3.dims, 2, 1)
    both = {r.split: r.n_cells for r in holdout_rmse(labelled, factors, 2).collect()}
    assert set(both) == {"test", "validation"}
    assert holdout_rmse(labelled, factors, 2, "test").first().n_cells == both["test"]


def test_result_ignores_partitioning(spark, event3):
    cfg = FitConfig(rank=2, max_iter=2)
    a = fit(event3, pairwise, cfg)
    b = fit(event3.with_cells(event3.cells.repartition(5)), pairwise, cfg)
    assert math.isclose(a.cost, b.cost, abs_tol=1e-10)


def test_index_without_cells_and_single_component(spark):
    pair = spark.createDataFrame(
        [(0, 0, 0, 2.0, 1.0), (1, 1, 1, 1.0, 3.0)], "i0 INT, i1 INT, i2 INT, x DOUBLE, y DOUBLE"
    )
    t = PairedTensor(signals(pair, coord_names(3)), (4, 2, 2))
    result = fit(t, pairwise, FitConfig(rank=1, max_iter=2))
    assert result.factors[0].count() == 4 and math.isfinite(result.cost)
    assert np.allclose(result.weights_x, [1.0])
