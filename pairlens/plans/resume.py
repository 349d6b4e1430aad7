"""Persisted state of a fit, so that one that was broken off goes on where it was.

After every iteration the factor tables are written as Parquet, one folder per way, then one row with
all that is small: iteration, runs still going, their Grams, weights, momentum and logs. That row is
the commit: factors without it are not looked at, and it names the folders that belong to it. Runs
that have stopped leave their factors in a folder of their own. The two last states are kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pairlens.plans.fit import FitConfig, FitResult, FitState, Run, Workspace, result_of
from pairlens.sources.sinks import path_exists, remove_path

GRAMS = ("gx", "gy", "cross")
STATE_SCHEMA = "iter INT, state STRING"
#: States kept behind the last one, in case its folders are damaged.
KEPT = 2


def _run_dict(run: Run) -> dict:
    arrays = {k: [g.tolist() for g in getattr(run, k)] for k in GRAMS}
    weights = {k: getattr(run, k).tolist() for k in ("wx", "wy", "zwx", "zwy")}
    plain = {k: getattr(run, k) for k in ("momentum", "push", "inner_x", "inner_y", "cost", "previous", "log")}
    return {**arrays, **weights, **plain}


def _run_of(cfg: FitConfig, held: dict) -> Run:
    arrays = {k: [np.array(g) for g in held[k]] for k in GRAMS}
    weights = {k: np.array(held[k]) for k in ("wx", "wy", "zwx", "zwy")}
    plain = {k: held[k] for k in ("momentum", "push", "inner_x", "inner_y", "cost", "previous")}
    return Run(cfg, **arrays, **weights, **plain, log=[tuple(entry) for entry in held["log"]])


class StateStore:
    """The folder of one fit. A folder that belongs to another fit (cells, method, settings) raises."""

    def __init__(
        self, spark: SparkSession, path: str, method: str, ws: Workspace, cfgs: Sequence[FitConfig]
    ):
        self.spark, self.path, self.method, self.ws, self.cfgs = spark, path, method, ws, list(cfgs)
        self.done: dict[int, dict] = {}

    def _identity(self) -> dict:
        # Round trip through JSON, so that it compares equal to what is read back.
        fit = {
            "method": self.method, "dims": list(self.ws.tensor.dims), "n_cells": self.ws.n_cells,
            "settings": [asdict(c) for c in self.cfgs],
        }
        return json.loads(json.dumps(fit))

    def _write(self, factors: Sequence[DataFrame]) -> str:
        folder = f"{self.path}/factors/{uuid.uuid4().hex}"
        for way, factor in enumerate(factors):
            factor.write.parquet(f"{folder}/way={way}")
        return folder

    def _read(self, folder: str) -> list[DataFrame]:
        return [
            self.spark.read.parquet(f"{folder}/way={way}") for way in range(self.ws.tensor.ways)
        ]

    def _states(self) -> dict[int, dict]:
        commits = f"{self.path}/commits"
        if not path_exists(self.spark, commits):
            return {}
        # One small row per kept iteration.
        rows = self.spark.read.schema(STATE_SCHEMA).parquet(f"{commits}/*").collect()
        return {r.iter: json.loads(r.state) for r in rows}

    def save(self, i: int, state: FitState, order: Sequence[int], ended: dict[int, FitResult]) -> None:
        """Write the state after iteration ``i``; ``ended`` are the runs that stopped in it."""
        for k, result in ended.items():
            self.done[k] = {
                "folder": self._write(result.factors), "weights_x": result.weights_x.tolist(),
                "weights_y": result.weights_y.tolist(), "cost": result.cost, "log": result.log,
            }
        held = {
            "fit": self._identity(), "order": list(order), "done": self.done,
            "folder": self._write(state.factors) if state.runs else None,
            "runs": [_run_dict(run) for run in state.runs],
        }
        row = self.spark.createDataFrame([(i, json.dumps(held))], STATE_SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{i:06d}")
        states = self._states()
        for old in sorted(states)[:-KEPT]:
            remove_path(self.spark, f"{self.path}/commits/{old:06d}")
            if states[old]["folder"]:
                remove_path(self.spark, states[old]["folder"])

    def load(self) -> tuple[int, FitState, list[int], dict[int, FitResult]] | None:
        """(iteration, state, order, results of stopped runs) of the last commit, if there is one."""
        states = self._states()
        if not states:
            return None
        i = max(states)
        held = states[i]
        if held["fit"] != self._identity():
            raise ValueError(f"{self.path} holds the state of another fit")
        self.done = {int(k): v for k, v in held["done"].items()}
        order = held["order"]
        runs = [_run_of(self.cfgs[k], run) for k, run in zip(order, held["runs"])]
        results = {}
        for k, v in self.done.items():
            log = [tuple(entry) for entry in v["log"]]
            none = np.zeros(0)
            run = Run(
                self.cfgs[k], [], [], [], np.array(v["weights_x"]), np.array(v["weights_y"]), none, none,
                cost=v["cost"], log=log,
            )
            results[k] = result_of(self.ws, self.method, run, self._read(v["folder"]))
        factors = self._read(held["folder"]) if runs else []
        return i, FitState(factors, runs), order, results
