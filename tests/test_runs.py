"""Runs that share passes, output that is safe to repeat, and fits that go on after a break."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.functions.columns import split_label
from pairlens.operators import algebra as al
from pairlens.plans import sweep
from pairlens.plans.baseline import baseline
from pairlens.plans.fit import FitConfig, Workspace, fit, fit_runs
from pairlens.plans.pairwise import pairwise
from pairlens.plans.sweep import batches, committed, run_grid, run_sweep
from pairlens.schema import coord_names
from pairlens.sources.sinks import path_exists, read_factors, read_matrix, replace_partitions, write_matrix
from tests.conftest import TESTDATA

SMALL = f"{TESTDATA}/sf0.001"
LOW = {"alpha": 1e-4, "beta": 1e-4}


@pytest.fixture(scope="module")
def event3(spark):
    t = fx.event3(spark, SMALL)
    return t.with_cells(t.cells.persist())


def matrix(factor, side, rank):
    rows = sorted(factor.collect(), key=lambda r: r.idx)
    return np.array([[r[f"{side}{c}"] for c in range(rank)] for r in rows])


def assert_same(a, b):
    assert [r[0] for r in a.log] == [r[0] for r in b.log]
    assert np.allclose([r[2] for r in a.log], [r[2] for r in b.log], atol=1e-10)
    assert np.allclose(a.weights_x, b.weights_x, atol=1e-9) and np.allclose(a.weights_y, b.weights_y, atol=1e-9)
    for f, g in zip(a.factors, b.factors):
        for s in "xy":
            assert np.allclose(matrix(f, s, a.config.rank), matrix(g, s, a.config.rank), rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("step,extra", [(pairwise, {}), (baseline, LOW)])
def test_ranks_side_by_side(event3, step, extra):
    """Runs of ranks 1, 3 and 2, of several lengths, in shared jobs; each as if it were alone."""
    cfgs = [
        FitConfig(rank=1, max_iter=2, distance=1, **extra),
        FitConfig(rank=3, max_iter=2, seed=2, distance=2, **extra),
        FitConfig(rank=2, max_iter=1, seed=3, distance=1, **extra),
    ]
    for cfg, shared in zip(cfgs, fit_runs(event3, step, cfgs)):
        assert shared.config is cfg
        assert_same(shared, fit(event3, step, cfg))


def test_batches_keep_order_and_width():
    assert batches([3, 20, 5, 30, 1], lambda r: r) == [[3, 20], [5], [30], [1]]
    assert batches([], lambda r: r) == []


class BrokenOff(Exception):
    pass


def breaking(at):
    def watch(i, _state):
        if i == at:
            raise BrokenOff

    return watch


@pytest.mark.parametrize("step,extra", [(pairwise, {"factor_momentum": True}), (baseline, LOW)])
def test_fit_goes_on_where_it_was(spark, event3, tmp_path, step, extra):
    """Broken off in the third and fourth iteration; one run has stopped before."""
    cfgs = [
        FitConfig(rank=1, max_iter=1, distance=1, **extra),
        FitConfig(rank=2, max_iter=4, seed=2, distance=1, **extra),
    ]
    path, seen = str(tmp_path / "state"), []
    for at in (3, 4):
        with pytest.raises(BrokenOff):
            fit_runs(event3, step, cfgs, on_iteration=breaking(at), state_path=path)
    whole = fit_runs(event3, step, cfgs)
    for shared, alone in zip(fit_runs(event3, step, cfgs, on_iteration=lambda i, s: seen.append(i), state_path=path), whole):
        assert_same(shared, alone)
    assert seen == [4]
    # A fit that has ended is only read back.
    for again, alone in zip(fit_runs(event3, step, cfgs, on_iteration=breaking(5), state_path=path), whole):
        assert_same(again, alone)
    assert len(list((tmp_path / "state" / "commits").glob("0*"))) == 2
    with pytest.raises(ValueError, match="another fit"):
        fit_runs(event3, step, cfgs[:1], state_path=path)


def test_uncommitted_state_is_not_read(spark, event3, tmp_path, monkeypatch):
    """A break between the factors and the commit row of an iteration repeats that iteration."""
    from pairlens.plans.resume import StateStore

    path, whole = str(tmp_path / "state"), StateStore._write
    calls = []

    def failing(self, factors):
        calls.append(1)
        if len(calls) == 2:
            raise BrokenOff
        return whole(self, factors)

    cfg = FitConfig(rank=1, max_iter=3)
    monkeypatch.setattr(StateStore, "_write", failing)
    with pytest.raises(BrokenOff):
        fit(event3, pairwise, cfg, state_path=path)
    monkeypatch.setattr(StateStore, "_write", whole)
    seen = []
    result = fit(event3, pairwise, cfg, on_iteration=lambda i, s: seen.append(i), state_path=path)
    assert seen == [2, 3]
    assert_same(result, fit(event3, pairwise, cfg))


GRID = {
    "method": ["pairwise", "baseline"], "seed": [0], "rank": [2, 3], "distance": [1], "alpha": [1e-4, 0.1],
    "beta": [1e-4], "gamma": [0.1], "delta": [1e-8], "train_proportion": [10.0],
}


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.drop("elapsed").collect())


@pytest.mark.parametrize("fmt,breaks", [("parquet", [1, 2]), ("csv", [3])])
def test_sweep_broken_off_between_two_sinks(spark, event3, tmp_path, monkeypatch, fmt, breaks):
    """Whatever sink the break comes after, the repeated sweep leaves every row once."""
    grid = run_grid(spark, **{**GRID, "rank": [1, 2]}).where("method = 'baseline' and alpha < 0.01")
    out, write = str(tmp_path / "out"), sweep.replace_partitions
    go = lambda: run_sweep(spark, lambda s: event3, grid, out, 2, 1, fmt=fmt, save_factors=fmt == "parquet")
    for n in breaks:
        calls = []

        def failing(df, path, *args, **kwargs):
            calls.append(path)
            if len(calls) > n:
                raise BrokenOff
            write(df, path, *args, **kwargs)

        monkeypatch.setattr(sweep, "replace_partitions", failing)
        with pytest.raises(BrokenOff):
            go()
    monkeypatch.setattr(sweep, "replace_partitions", write)
    assert go().count() == 4
    read = lambda p: (spark.read.option("header", True) if fmt == "csv" else spark.read).format(fmt).load(f"{out}/{p}")
    log = read("run_log")
    assert log.count() == 4 == log.select("run", "trial_ID").distinct().count()
    assert [read(f"weights_R{r}").count() for r in (1, 2)] == [4, 4]  # two trials, two sides
    assert spark.read.parquet(f"{out}/run_info").count() == 4
    if fmt == "parquet":
        assert read("factors_R2").where("side = 'X' and way = 0").count() == 2 * event3.dims[0]
    before = rows_of(log)
    assert go().count() == 4 and rows_of(read("run_log")) == before


def test_rows_of_an_interrupted_run_are_not_committed(spark, event3, tmp_path):
    grid = run_grid(spark, **{**GRID, "rank": [1]}).where("method = 'baseline' and alpha < 0.01")
    out = str(tmp_path / "out")
    run_sweep(spark, lambda s: event3, grid, out, 2, 1)
    log = spark.read.parquet(f"{out}/run_log")
    replace_partitions(log.withColumn("run", F.lit("other")), f"{out}/run_log")
    both = spark.read.parquet(f"{out}/run_log")
    assert both.count() == 4 and committed(spark, both, out).count() == 2


def test_one_load_and_one_layout_for_each_sample_and_share(spark, event3, tmp_path, monkeypatch):
    prepared, loads = [], []
    prepare = Workspace.prepare.__func__

    def counted(cls, *args, **kwargs):
        prepared.append(1)
        return prepare(cls, *args, **kwargs)

    monkeypatch.setattr(Workspace, "prepare", classmethod(counted))
    samples = {"seed": [0, 1], "train_proportion": [10.0, 8.0], "rank": [1, 2]}
    grid = run_grid(spark, **{**GRID, **samples}).where("method = 'baseline' and alpha < 0.01")

    def load(seed):
        loads.append(seed)
        return event3

    costs = run_sweep(spark, load, grid, str(tmp_path / "out"), 1, 1)
    assert costs.count() == 8 and loads == [0, 1] and len(prepared) == 4
    info = spark.read.parquet(f"{tmp_path}/out/run_info").first().info
    assert all(f'"{k}":' in info for k in ("nb_points", "noise", "init", "max_iter"))


def test_sweep_goes_on_inside_a_fit(spark, event3, tmp_path, monkeypatch):
    grid = run_grid(spark, **{**GRID, "rank": [1]}).where("method = 'baseline'")
    out, steps = str(tmp_path / "out"), []

    def counted(ws, state):
        steps.append(len(state.runs))
        if len(steps) == 2:
            raise BrokenOff
        return baseline(ws, state)

    counted.__name__ = "baseline"
    monkeypatch.setitem(sweep.METHODS, "baseline", counted)
    go = lambda: run_sweep(spark, lambda s: event3, grid, out, 1, 2, keep_states=True)
    with pytest.raises(BrokenOff):
        go()
    assert go().count() == 2
    assert steps == [2, 2, 2]  # the first iteration, the broken one, and that one again
    assert not list((tmp_path / "out" / "states").iterdir())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_matrix_sink_round_trip(spark, event3, tmp_path, fmt):
    path = str(tmp_path / "m")
    factors = al.init_factors(spark, event3.dims, 2, 5)
    for trial, run in ((0, "a b=c"), (1, "a b=c")):
        for way, factor in enumerate(factors[: 3 if trial else 1]):
            write_matrix(factor, 2, way, path, fmt, run=run, trial=trial)
    back = read_factors(spark, path, 2, 3, fmt, run="a b=c", trial=1)
    for a, b in zip(factors, back):
        for s in "xy":
            assert np.array_equal(matrix(a, s, 2), matrix(b, s, 2))
    write_matrix(factors[0].limit(4), 2, 0, path, fmt, mode="overwrite", run="a b=c", trial=1)
    assert read_matrix(spark, path, 2, 0, fmt, run="a b=c", trial=1).count() == 4
    assert read_matrix(spark, path, 2, 0, fmt, run="a b=c", trial=0).count() == event3.dims[0]


def test_matrix_of_one_side_raises(spark, tmp_path):
    path = str(tmp_path / "m")
    write_matrix(al.init_factor(spark, 5, 0, 2, 1), 2, 0, path)
    folder = next((tmp_path / "m" / "kind=factor" / "side=Y" / "way=0").glob("part-*"))
    rows = spark.read.parquet(str(folder)).where("idx <> 3")
    rows.write.mode("append").parquet(f"{path}/kind=factor/side=Y/way=1")
    spark.read.parquet(str(folder)).write.mode("append").parquet(f"{path}/kind=factor/side=X/way=1")
    with pytest.raises(Exception, match="missing on one side"):
        read_matrix(spark, path, 2, 1).collect()


@pytest.mark.parametrize("ways", [3, 4, 6])
def test_split_expression_grows_with_the_ways(spark, ways):
    coords = [F.col(c) for c in coord_names(ways)]
    plan = spark.range(1).select(*[F.lit(1).alias(c) for c in coord_names(ways)]).select(split_label(coords, 6.0).alias("s"))
    assert len(plan._jdf.queryExecution().analyzed().toString()) < 1200 * ways
