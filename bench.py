"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Queries run end to end from parquet. Solver entries are seconds per iteration after the first,
on the large sparse fixture (dimensions = table sizes) and on the dense 4-way one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = (
    "pair_from_facts", "pair_high_cardinality", "paired_topn", "mttkrp_way0", "mttkrp_fused",
    "core_diag", "core_full", "gram", "joint_cost", "reconstruct", "holdout_rmse",
)
ITERATIONS = 3


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("pairlens-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(fn) -> float:
    begun = time.monotonic()
    fn()
    return time.monotonic() - begun


def materialise(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def jobs_run(spark: SparkSession) -> int:
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


def main() -> None:
    from pairlens.catalog import fixtures as fx
    from pairlens.catalog.queries import queries
    from pairlens.plans.baseline import baseline
    from pairlens.plans.fit import FitConfig, Workspace, fit
    from pairlens.plans.pairwise import pairwise

    spark = session()
    timed(lambda: spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count())
    out: dict[str, float] = {}
    registry = queries()
    for name in QUERIES:
        out[name] = min(
            timed(lambda: materialise(registry[name](spark, SF_DIR))) for _ in range(2)
        )
    jobs: dict[str, float] = {}
    cells: dict[str, int] = {}
    # No early stop: the sparse fixture's cost settles at once.
    for fixture, ranks in (("line3", 4), ("order4", 4)):
        tensor = getattr(fx, fixture)(spark, SF_DIR)
        for step, cfg in (
            (pairwise, FitConfig(rank=ranks, max_iter=ITERATIONS, tolerance=0.0)),
            (baseline, FitConfig(rank=ranks, max_iter=ITERATIONS, tolerance=0.0, alpha=1e-4,
                                 beta=1e-4, distance=2)),
        ):
            ws = Workspace.prepare(tensor, cfg)
            cells[fixture] = ws.n_cells
            before = jobs_run(spark)
            result = fit(tensor, step, cfg, workspace=ws)
            ws.release()
            name = f"{step.__name__}_iteration_{fixture}"
            later = [r[1] for r in result.log[1:]]
            out[name] = sum(later) / len(later)
            jobs[name] = (jobs_run(spark) - before) / len(result.log)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(out.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in out.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cells": cells,
                "jobs_per_iteration": {k: round(v, 1) for k, v in jobs.items()},
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
