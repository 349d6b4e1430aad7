"""Plans and limits that matter at scale: no caps, no lost cells, no one-task reduce."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.functions.columns import init_value
from pairlens.operators import algebra as al
from pairlens.operators.gather import JoinPlan, gather, layout_for, lead_way, plan_joins
from pairlens.plans.baseline import baseline
from pairlens.plans.fit import FitConfig, Workspace, fit, start_state
from pairlens.plans.pairwise import pairwise
from pairlens.session import ensure_checkpoint_dir, hold_compact
from tests.conftest import TESTDATA


@pytest.fixture(scope="module")
def event3(spark):
    return fx.event3(spark, f"{TESTDATA}/sf0.001")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_start_values_do_not_repeat_and_seeds_are_no_shifts(spark):
    columns = [f"{init_value('id', 0, r, 'x', s)} AS s{s}_{r}" for s in (1, 2) for r in range(3)]
    df = spark.range(20000).selectExpr("id", *columns)
    x = np.array(df.orderBy("id").drop("id").collect())
    assert len(np.unique(x[:, :3], axis=0)) == 20000 and len(np.unique(x[:, 0])) > 19900
    assert np.all((x >= 0) & (x < 1)) and np.all(np.abs(x.mean(0) - 0.5) < 0.02)
    shift = (x[:, 0] - x[:, 3]) % 1
    assert shift.std() > 0.2
    far = spark.createDataFrame([(2147483646,), (2 * 2147483647 - 1,), (4294967295 + 7,)], "id long")
    assert far.selectExpr(columns[0]).distinct().count() == 3


def test_cells_outside_the_dimensions_raise(spark, event3):
    outside = event3.cells.limit(2).unionByName(event3.cells.limit(1).withColumn("i1", F.lit(event3.dims[1]).cast("int")))
    bad = event3.with_cells(outside)
    factors = al.init_factors(spark, event3.dims, 2, 1)
    for broken in (
        lambda: al.mttkrp(bad, factors, 2, 0), lambda: al.mttkrp(bad, factors, 2, 1),
        lambda: al.core_diagonal(bad, factors, 2), lambda: al.reconstruct(bad, factors, 2),
        lambda: al.core_full(bad, factors, 2),
    ):
        with pytest.raises(Exception, match="outside the dimensions"):
            broken().collect()


def test_user_factors_need_every_index(spark, event3):
    factors = al.init_factors(spark, event3.dims, 2, 1)
    shifted = [f.withColumn("idx", F.col("idx") + 5) if k == 0 else f for k, f in enumerate(factors)]
    with pytest.raises(ValueError, match="misses 5 indices"):
        start_state(event3, [FitConfig(rank=2)], shifted)


@pytest.mark.parametrize("step", [pairwise, baseline])
def test_no_narrowing_in_the_stage_of_the_aggregate(spark, event3, no_broadcast, step, monkeypatch):
    """The products are computed and held at full parallelism; partitions are merged above them."""
    seen = []

    def watched(df, rows):
        seen.append(plan_of(df))
        return hold_compact(df, rows)

    monkeypatch.setattr(f"pairlens.plans.{step.__name__}.hold_compact", watched)
    fit(event3, step, FitConfig(rank=2, max_iter=1, alpha=1e-4, beta=1e-4, distance=1))
    assert len(seen) >= 3 and not any("Coalesce" in text for text in seen)
    compact = hold_compact(spark.range(100, numPartitions=4).groupBy(F.col("id") % 7).count(), 7)
    assert compact.table.rdd.getNumPartitions() == 1
    assert "InMemoryTableScan" in plan_of(compact.table)
    compact.release()


@pytest.mark.parametrize("target", [10**6, 30])
def test_lead_way_is_joined_where_the_cells_lie(spark, event3, no_broadcast, target):
    """With all ways shuffled, the product of each way moves the cells for its second join only."""
    ws = Workspace.prepare(event3, FitConfig(rank=2, broadcast_bytes=0, cells_per_salt=target))
    factors = al.init_factors(spark, event3.dims, 2, 1)
    for way in range(3):
        lead = lead_way(ws.plan, event3.dims, way)
        text = plan_of(gather(ws.cells_for(way).cells, factors, 2, [w for w in range(3) if w != way], ws.plan))
        above = text.split("InMemoryRelation")[0] + text.rpartition("Scan ExistingRDD")[2]
        moved = [x for x in above.splitlines() if "Exchange hashpartitioning" in x]
        # Above the held cells: one for the way that is not the lead, and both factors.
        assert sum(f"hashpartitioning(i{lead}#" in x for x in moved) <= 1, text
        assert len(moved) <= 3 + 2 * len(ws.plan.hot), text
    ws.release()


def test_salts_follow_an_index_alone(spark):
    cells = spark.range(5000).selectExpr("CAST(id % 1000 AS INT) AS i0", "CAST(0 AS INT) AS i1").unionByName(
        spark.range(1000).selectExpr("CAST(3 AS INT) AS i0", "CAST(0 AS INT) AS i1")
    )
    plan = plan_joins(cells, (1000, 1), 2, budget=0, target=4)
    splits = {r.idx: r.splits for r in plan.hot[0].collect()}
    assert len(splits) == 1000 and splits[3] == 252 and splits[0] == 2


def test_layout_follows_the_number_of_cells(spark, event3, monkeypatch):
    monkeypatch.setattr("pairlens.operators.gather.CELLS_PER_PARTITION", 10)
    laid = layout_for(event3.cells, 3, JoinPlan((False, True, True), {}, event3.dims), 0, 1000)
    assert "hashpartitioning(i0" in plan_of(laid) and ", 100)" in plan_of(laid)


def test_checkpoint_folder_is_needed_off_a_local_master():
    class Fake:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Fake()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(Session())


def test_order_line_cells_are_dealt_by_the_number_of_lines(spark, tmp_path, monkeypatch):
    """A task of full_alignment holds a bounded number of cells, whatever the session's partitions are."""
    from pairlens.catalog import queries as catalog

    n = 12_000
    flag = F.element_at(F.array(F.lit("R"), F.lit("A"), F.lit("N")), (F.col("id") % 3 + 1).cast("int"))
    lines = spark.range(n).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") % 997).alias("l_partkey"),
        (F.col("id") % 13).alias("l_suppkey"), flag.alias("l_returnflag"), (F.col("id") % 50 + 1.0).alias("l_quantity"),
    )
    # A line that repeats a cell, and one without an order.
    lines = lines.unionByName(lines.where("l_orderkey = 0")).unionByName(lines.limit(1).withColumn("l_orderkey", F.lit(10**6).cast("long")))
    orders = spark.range(n // 4).select(F.col("id").alias("o_orderkey"), (F.col("id") % 501).alias("o_custkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(fx, "LINES_PER_TASK", 250, raising=False)
    found = catalog.REGISTRY["full_alignment"][0](spark, str(tmp_path))
    held = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 40 and max(r["count"] for r in held) <= 500
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_returnflag in ('R', 'A')")
    side = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    want = joined.groupBy("o_custkey", "l_partkey", "l_suppkey").agg(side("R"), side("A"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
