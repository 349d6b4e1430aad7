"""Trials, hyper-parameter grids and resumable sweeps.

A sweep is a small table of pending runs (grid minus completed keys); its rows are settings. Runs
over the same cells (seed and train share) are fitted together, whatever their settings and ranks:
the cells are loaded and laid out once, and every pass over them serves as many components as
:data:`COMPONENTS_PER_JOB` allows.

Output is written run by run into partitions of its own, which a repeated run replaces, and the final
cost rows come last: they are the commit. A sweep that was broken off anywhere is called again and
leaves every row once. :func:`committed` reads only what belongs to committed runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.operators.align import subset, with_split
from pairlens.operators.algebra import reconstruct
from pairlens.operators.weights import tag, widen_weights
from pairlens.plans.baseline import baseline
from pairlens.plans.fit import FitConfig, FitResult, Workspace, fit_runs
from pairlens.plans.pairwise import pairwise
from pairlens.schema import PairedTensor
from pairlens.session import cut_lineage
from pairlens.sources.sinks import (
    completed_runs,
    read_table,
    remove_path,
    replace_partitions,
    run_info_table,
    write_matrix,
)

# Width limit of jobs shared by several runs, in components.
COMPONENTS_PER_JOB = 24

METHODS = {"pairwise": pairwise, "baseline": baseline}

# Layout of the final cost table.
FINAL_COST_SCHEMA = (
    "iter INT, elapsed INT, cost DOUBLE, trial_ID INT, ground_truth_k STRING, k STRING, "
    "noise DOUBLE, train_proportion DOUBLE, alpha DOUBLE, beta DOUBLE, delta DOUBLE, "
    "gamma DOUBLE, distance INT"
)
RUN_KEYS = (
    "method", "seed", "rank", "distance", "alpha", "beta", "gamma", "delta", "train_proportion"
)
COST_TABLE_SCHEMA = FINAL_COST_SCHEMA + ", method STRING, seed INT, rank INT, run STRING"
RUN_KEY_SCHEMA = (
    "method STRING, seed INT, rank INT, distance INT, alpha DOUBLE, beta DOUBLE, gamma DOUBLE, "
    "delta DOUBLE, train_proportion DOUBLE"
)


@dataclass
class TrialTables:
    """Tables of one multi-trial run, ready to append to the sinks."""

    final_cost: DataFrame
    weights: DataFrame
    log: DataFrame
    info: DataFrame
    results: list[FitResult]


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def run_trials(
    tensor: PairedTensor,
    cfg: FitConfig,
    method: str = "pairwise",
    trials: int = 20,
    case: str = "case",
    ground_truth_k: str | None = None,
    noise: float = 0.0,
) -> TrialTables:
    """Repeat a fit from different start values on one held copy of the cells.

    Trials share their jobs, as many at a time as :data:`COMPONENTS_PER_JOB` allows.
    """
    cfgs = [replace(cfg, seed=cfg.seed + t) for t in range(trials)]
    width = min(sum(c.rank for c in cfgs), max(COMPONENTS_PER_JOB, cfg.rank))
    workspace = Workspace.prepare(tensor, cfg, width=width)
    results = []
    try:
        for batch in batches(cfgs, lambda c: c.rank):
            results += fit_runs(tensor, METHODS[method], batch, workspace=workspace)
    finally:
        workspace.release()
    return trial_tables(tensor.cells.sparkSession, cfg, results, case, ground_truth_k, noise)


def batches(items: Sequence, rank: Callable[[object], int]) -> list[list]:
    """Neighbouring items in groups of at most :data:`COMPONENTS_PER_JOB` components (or one item)."""
    out, width = [], COMPONENTS_PER_JOB + 1
    for item in items:
        width += rank(item)
        if width > COMPONENTS_PER_JOB:
            out.append([])
            width = rank(item)
        out[-1].append(item)
    return out


def trial_tables(
    spark: SparkSession,
    cfg: FitConfig,
    results: Sequence[FitResult],
    case: str = "case",
    ground_truth_k: str | None = None,
    noise: float = 0.0,
) -> TrialTables:
    """The tables of the trials of one setting."""
    truth = ground_truth_k or case
    tags = {
        "ground_truth_k": truth, "k": case, "noise": float(noise), "alpha": cfg.alpha,
        "beta": cfg.beta, "delta": cfg.delta, "gamma": cfg.gamma, "distance": cfg.distance,
    }
    costs, weights, logs, infos = [], [], [], []
    for t, result in enumerate(results):
        costs.append(
            (t, 0, result.cost, t, truth, case, float(noise), float(cfg.train_proportion),
             cfg.alpha, cfg.beta, cfg.delta, cfg.gamma, cfg.distance)
        )
        wide = widen_weights(result.weights_table(spark), cfg.rank)
        weights.append(tag(wide, trial_ID=t, **tags))
        logs.append(tag(result.log_table(spark), trial_ID=t, **tags))
        info = {**result.info(), "noise": float(noise)}
        infos.append(tag(run_info_table(spark, info, result.final()), trial_ID=t))
    return TrialTables(
        spark.createDataFrame(costs, FINAL_COST_SCHEMA), _union(weights), _union(logs),
        _union(infos), list(results),
    )


def run_grid(spark: SparkSession, **parameters: Iterable) -> DataFrame:
    """Every combination of the parameter lists.

    One row exploded once per parameter: a handful of settings in one partition, where cross
    joins of small tables would multiply partition counts.
    """
    grid = spark.range(1).select()
    for name, values in parameters.items():
        values = list(values)
        kind = {str: "string", int: "int"}.get(type(values[0]), "double")
        options = F.array(*[F.lit(v).cast(kind) for v in values])
        grid = grid.select("*", F.explode(options).alias(name))
    return grid


def pending_runs(grid: DataFrame, done: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Runs without output yet."""
    return grid.join(done, list(keys), "left_anti")


def run_sweep(
    spark: SparkSession,
    load: Callable[[int], PairedTensor],
    grid: DataFrame,
    output_path: str,
    trials: int = 3,
    max_iter: int = 10,
    case: str = "case",
    noise: float = 0.01,
    fmt: str = "parquet",
    save_factors: bool = False,
    keep_states: bool = False,
    **config: object,
) -> DataFrame:
    """Fit every pending run of ``grid`` (columns :data:`RUN_KEYS`) and write its tables.

    ``load(seed)`` gives the tensor of a bootstrap sample; it is called once per seed, and the cells
    are laid out once per seed and train share. The final cost rows are written last and are the
    completion record, so an interrupted run is repeated and replaces what it had written. With
    ``keep_states`` fits store every iteration and a repeated sweep goes on inside them; that takes
    the same grid, trials and settings.
    """
    cost_path = f"{output_path}/cost_final"
    done = completed_runs(spark, cost_path, RUN_KEYS, COST_TABLE_SCHEMA, fmt)
    # Settings only: as many rows as there are parameter combinations.
    pending = pending_runs(grid.select(*RUN_KEYS).distinct(), done).orderBy("seed", *RUN_KEYS).collect()
    by_seed = {seed: list(rows) for seed, rows in groupby(pending, lambda r: r.seed)}
    for seed, runs in by_seed.items():
        tensor = load(seed)
        shares = sorted({r.train_proportion for r in runs})
        if len(shares) > 1:
            tensor = tensor.with_cells(cut_lineage(tensor.cells))
        for share in shares:
            own = [
                (r.asDict(), FitConfig(
                    rank=r["rank"], alpha=r.alpha, beta=r.beta, gamma=r.gamma, delta=r.delta,
                    distance=r.distance, train_proportion=share, max_iter=max_iter, **config,
                ))
                for r in runs if r.train_proportion == share
            ]
            _fit_share(tensor, share, own, trials, keep_states and output_path, lambda finished: _write_runs(
                spark, finished, output_path, case, noise, fmt, save_factors
            ))
    return completed_cost(spark, cost_path, fmt)


def _fit_share(
    tensor: PairedTensor,
    share: float,
    runs: Sequence[tuple[dict, FitConfig]],
    trials: int,
    states: str | bool,
    write: Callable[[list[tuple[dict, FitConfig, list[FitResult]]]], None],
) -> None:
    """Fit all settings of one sample and share together; hands over runs as they are complete."""
    train = tensor
    if share < 10:
        cells = with_split(tensor.cells, tensor.coords, share)
        train = tensor.with_cells(subset(cells, "train").drop("split"))
    fits = [(k, replace(cfg, seed=cfg.seed + t)) for k, (_keys, cfg) in enumerate(runs) for t in range(trials)]
    found: dict[int, list[FitResult]] = {k: [] for k in range(len(runs))}
    per_method = [
        (method, batch)
        for method in sorted({keys["method"] for keys, _ in runs})
        for batch in batches([f for f in fits if runs[f[0]][0]["method"] == method], lambda f: f[1].rank)
    ]
    widths = [sum(cfg.rank for _k, cfg in batch) for _method, batch in per_method]
    workspace = Workspace.prepare(train, runs[0][1], width=max(widths))
    folders: dict[str, set[int]] = {}
    try:
        for method, batch in per_method:
            name = "-".join(dict.fromkeys(run_name(runs[k][0]) for k, _cfg in batch))
            folder = states and f"{states}/states/{hashlib.sha256(name.encode()).hexdigest()[:24]}"
            cfgs = [cfg for _k, cfg in batch]
            results = fit_runs(train, METHODS[method], cfgs, workspace=workspace, state_path=folder or None)
            for (k, _cfg), result in zip(batch, results):
                found[k].append(result)
            whole = [k for k in dict.fromkeys(k for k, _cfg in batch) if len(found[k]) == trials]
            if whole:
                write([(*runs[k], found[k]) for k in whole])
            if folder:
                folders[folder] = {k for k, _cfg in batch}
            for old in [f for f, own in folders.items() if all(len(found[k]) == trials for k in own)]:
                remove_path(train.cells.sparkSession, old)
                del folders[old]
    finally:
        workspace.release()


def _write_runs(
    spark: SparkSession,
    finished: Sequence[tuple[dict, FitConfig, list[FitResult]]],
    output_path: str,
    case: str,
    noise: float,
    fmt: str,
    save_factors: bool,
) -> None:
    """Replace the partitions of the finished runs, table by table; the cost rows commit them."""
    tables = []
    for keys, cfg, results in finished:
        named = {k: keys[k] for k in ("method", "seed", "rank")} | {"run": run_name(keys)}
        tables.append((named, cfg, trial_tables(spark, cfg, results, case, noise=noise)))
    for rank in sorted({cfg.rank for _n, cfg, _t in tables}):
        weights = [
            tag(t.weights, train_proportion=cfg.train_proportion, **n) for n, cfg, t in tables if cfg.rank == rank
        ]
        replace_partitions(_union(weights), f"{output_path}/weights_R{rank}", fmt=fmt)
    replace_partitions(_union([tag(t.log, **n) for n, _c, t in tables]), f"{output_path}/run_log", fmt=fmt)
    replace_partitions(_union([tag(t.info, **n) for n, _c, t in tables]), f"{output_path}/run_info")
    if save_factors:
        for named, cfg, t in tables:
            for trial, result in enumerate(t.results):
                for way, factor in enumerate(result.factors):
                    write_matrix(
                        factor, cfg.rank, way, f"{output_path}/factors_R{cfg.rank}", fmt,
                        mode="overwrite", run=named["run"], trial=trial,
                    )
    replace_partitions(_union([tag(t.final_cost, **n) for n, _c, t in tables]), f"{output_path}/cost_final", fmt=fmt)


def run_name(keys: dict) -> str:
    """Folder-safe label of a run."""
    return "_".join(str(keys[k]) for k in RUN_KEYS)


def completed_cost(spark: SparkSession, cost_path: str, fmt: str = "parquet") -> DataFrame:
    """The final cost table, without the partition label."""
    return read_table(spark, cost_path, COST_TABLE_SCHEMA, fmt).drop("run")


def committed(
    spark: SparkSession, table: DataFrame, output_path: str, fmt: str = "parquet"
) -> DataFrame:
    """The rows of a sweep's table that belong to committed runs and trials (``trial_ID`` or ``trial``)."""
    trial = "trial_ID" if "trial_ID" in table.columns else "trial"
    costs = read_table(spark, f"{output_path}/cost_final", COST_TABLE_SCHEMA, fmt)
    kept = costs.select("run", F.col("trial_ID").alias(trial)).distinct()
    return table.join(F.broadcast(kept), ["run", trial], "left_semi")  # a row per fit


def cost_delta(log: DataFrame, run: Sequence[str], by: str = "iter") -> DataFrame:
    """Absolute cost change per iteration of each run."""
    previous = F.lag("cost").over(Window.partitionBy(*run).orderBy(by))
    return log.withColumn("delta", F.abs(F.col("cost") - previous))


def holdout_rmse(
    tensor: PairedTensor, factors: Sequence[DataFrame], rank: int, label: str | None = None
) -> DataFrame:
    """Root mean squared error per split on the cells not used for training."""
    scored = reconstruct(tensor, factors, rank)
    kept = scored.where(F.col("split") == label) if label else scored.where("split <> 'train'")
    return kept.groupBy("split").agg(
        F.sqrt(F.avg((F.col("x") - F.col("pred_x")) * (F.col("x") - F.col("pred_x")))).alias("rmse_x"),
        F.sqrt(F.avg((F.col("y") - F.col("pred_y")) * (F.col("y") - F.col("pred_y")))).alias("rmse_y"),
        F.count(F.lit(1)).alias("n_cells"),
    )
