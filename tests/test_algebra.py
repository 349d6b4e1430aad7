from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.operators import algebra as al
from pairlens.operators.align import signals
from pairlens.operators.gather import JoinPlan, choose_broadcast, plan_joins
from pairlens.schema import SIGNALS, PairedTensor, coord_names, factor_columns
from tests import numpy_model as nm

DIMS, RANK = (7, 5, 4), 3


@pytest.fixture(scope="module")
def tensor(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(6):  # index 6 of way 0 has no cell
        for j in range(5):
            for k in range(4):
                if i == 2 or rng.random() < 0.4:  # index 2 is hot
                    x, y = (float(v) for v in rng.integers(0, 4, 2))
                    data.append((i, j, k, x, y))
    pair = spark.createDataFrame(data, "i0 INT, i1 INT, i2 INT, x DOUBLE, y DOUBLE")
    cells = signals(pair, coord_names(3)).persist()
    return PairedTensor(cells, DIMS)


@pytest.fixture(scope="module")
def factors(spark):
    return al.init_factors(spark, DIMS, RANK, 1)


@pytest.fixture(scope="module")
def dense(tensor):
    rows = tensor.cells.collect()
    return {s: nm.dense(rows, DIMS, s) for s in SIGNALS}


def matrices(side):
    return [nm.formula_factor(d, w, RANK, side, 1) for w, d in enumerate(DIMS)]


MATS = {"x": matrices(0), "y": matrices(1)}


def as_matrix(df, dim, prefix):
    out = np.zeros((dim, RANK))
    for r in df.collect():
        out[r.idx] = [r[f"{prefix}{c}"] for c in range(RANK)]
    return out


PLANS = {
    "broadcast": JoinPlan((True, True, True)),
    "shuffled": JoinPlan((False, False, False)),
    "mixed": JoinPlan((False, True, True)),
}


@pytest.mark.parametrize("kind", [*PLANS, "salted"])
@pytest.mark.parametrize("way", [0, 1, 2])
def test_fused_mttkrp_matches_dense(tensor, factors, dense, way, kind):
    plan = PLANS.get(kind) or plan_joins(tensor.cells, DIMS, RANK, budget=0, target=4)
    if kind == "salted":
        assert 0 in plan.hot and plan.hot[0].where("idx = 2").first().splits == 5
    got = al.complete(factors[way].select("idx"), al.mttkrp(tensor, factors, RANK, way, plan=plan))
    assert got.count() == DIMS[way]
    for prefix, signal, side in al.FUSED_TERMS:
        want = nm.mttkrp(dense[signal], MATS[side], way)
        assert np.allclose(as_matrix(got, DIMS[way], prefix), want, atol=1e-9)


@pytest.mark.parametrize("way", [0, 1, 2])
@pytest.mark.parametrize("first", [None, 0, 1, 2])
def test_products_by_fibres(tensor, factors, dense, way, first):
    if first == way:
        return
    got = al.mttkrp_fibres(tensor, factors, RANK, way, first=first)
    for prefix, signal, side in al.FUSED_TERMS:
        want = nm.mttkrp(dense[signal], MATS[side], way)
        assert np.allclose(as_matrix(got, DIMS[way], prefix), want)


def test_fibres_of_two_ways_and_their_lengths(spark):
    pair = spark.createDataFrame([(i, j, 1.0, 2.0) for i in range(3) for j in range(8)], "i0 INT, i1 INT, x DOUBLE, y DOUBLE")
    t = PairedTensor(signals(pair, coord_names(2)), (3, 8))
    factors = al.init_factors(spark, t.dims, 2, 1)
    assert al.fibre_lengths(t, 0)[1] == pytest.approx(8, rel=0.3)
    rows = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    for way in (0, 1):
        assert rows(al.mttkrp_fibres(t, factors, 2, way)) == rows(al.mttkrp(t, factors, 2, way))


def test_unit_gram_equals_gram_of_unit_columns(spark, factors):
    factor = factors[0].withColumn("x1", F.lit(0.0))
    unit = al.normalize_columns(factor, factor_columns(RANK)[1:])
    got = {(r.side, r.p, r.q): r.g for r in al.unit_gram_long(factor, RANK).collect()}
    for s in ("x", "y"):
        want = {(s, r.p, r.q): r.g for r in al.gram_long(unit, RANK, s).collect()}
        assert all(np.isclose(got[k], v, atol=1e-12) for k, v in want.items())
    assert len(got) == 2 * RANK * RANK


def test_every_cell_counts_once(tensor, factors):
    """With all factors one, the product of a way is its plain marginal sum."""
    ones = [f.select("idx", *[F.lit(1.0).alias(c) for c in f.columns[1:]]) for f in factors]
    for plan in (PLANS["broadcast"], plan_joins(tensor.cells, DIMS, RANK, budget=0, target=2)):
        got = al.mttkrp(tensor, ones, RANK, 1, al.FUSED_TERMS[:1], plan)
        want = tensor.cells.groupBy("i1").agg(F.sum("x").alias("t"))
        assert {r.idx: r.mx0 for r in got.collect()} == {r.i1: r.t for r in want.collect()}


def test_salted_join_keeps_hot_partitions_small(tensor, factors):
    from pairlens.operators.gather import gather, salted_cells

    plan = plan_joins(tensor.cells, DIMS, RANK, budget=0, target=4)
    salted = salted_cells(tensor.cells, [0, 1, 2], plan, tensor.coords)
    hot = salted.where("i0 = 2")
    assert hot.select("salt0").distinct().count() > 1
    assert gather(tensor.cells, factors, RANK, [0], plan).count() == tensor.cells.count()


def test_broadcast_choice_is_bounded():
    assert choose_broadcast((10, 20), 4) == (True, True)
    assert choose_broadcast((10**9, 20, 30), 4) == (False, True, True)
    # Two ways that fit alone but not together.
    assert choose_broadcast((10**6, 10**6, 5), 6, budget=300 << 20) == (True, False, True)


def test_plan_is_codegen_with_one_shuffle(tensor, factors):
    out = al.mttkrp(tensor, factors, RANK, 0, plan=PLANS["broadcast"])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text and "Python" not in text and "CartesianProduct" not in text


def test_grams_norms_and_scaling(spark, factors):
    row = al.gram(factors[1], RANK).first()
    for s in ("x", "y"):
        m = MATS[s][1]
        assert np.allclose(al.symmetric_matrix(row, f"g{s}", RANK), m.T @ m)
    assert np.allclose(al.vector(row, "cross", RANK), (MATS["x"][1] * MATS["y"][1]).sum(0))
    names = factor_columns(RANK)[1:]
    zeroed = factors[1].withColumn("x1", F.lit(0.0))
    got = as_matrix(al.normalize_columns(zeroed, names), DIMS[1], "x")
    want = MATS["x"][1].copy()
    want[:, 1] = 0
    want[:, [0, 2]] /= np.linalg.norm(want[:, [0, 2]], axis=0)
    assert np.allclose(got, want)
    assert al.normalization_weights(zeroed, names).first().n_x1 == 1.0
    assert al.normalization_weights(zeroed, names, zero_weight=None).first().n_x1 == 0.0
    signed = factors[1].withColumn("x0", -F.col("x0"))
    assert np.isclose(al.column_norms(signed, ["x0"], "1").first()[0], -MATS["x"][1][:, 0].sum())
    total = al.frobenius_norm(factors[1], [f"x{r}" for r in range(RANK)]).first()[0]
    assert np.isclose(total, np.linalg.norm(MATS["x"][1]))
    long = {(r.p, r.q): r.g for r in al.gram_hadamard(factors, RANK, "y").collect()}
    full = nm.gram_product(MATS["y"])
    assert all(np.isclose(long[p, q], full[p, q]) for p in range(RANK) for q in range(RANK))


@pytest.mark.parametrize("kind", ["broadcast", "salted"])
def test_cores_and_inner_products(tensor, factors, dense, kind):
    plan = PLANS.get(kind) or plan_joins(tensor.cells, DIMS, RANK, budget=0, target=4)
    row = al.core_diagonal(tensor, factors, RANK, plan=plan).first()
    for prefix, signal, side in al.CORE_TERMS:
        want = nm.core(dense[signal], MATS[side])
        assert np.allclose(al.vector(row, prefix, RANK), want)
    full = al.core_full(tensor, factors, RANK, plan=plan).collect()
    assert len(full) == RANK**3
    for prefix, signal, side in al.CORE_TERMS:
        want = np.einsum("abc,ap,bq,cr->pqr", dense[signal], *MATS[side])
        assert all(np.isclose(r[prefix], want[r.r0, r.r1, r.r2]) for r in full)
    diagonal = {r.r0: r.gzx for r in full if r.r0 == r.r1 == r.r2}
    assert np.allclose([diagonal[r] for r in range(RANK)], al.vector(row, "gzx", RANK))
    inner = al.inner_products(tensor, factors, RANK, plan).first()
    assert np.isclose(inner.inner_x, nm.core(dense["x"], MATS["x"]).sum())


def test_cost_matches_dense_and_vanishes_at_the_model(spark, tensor, factors, dense):
    row = al.joint_cost_table(tensor, factors, RANK).first()
    assert np.isclose(row.cost, nm.cost(dense["x"], dense["y"], MATS["x"], MATS["y"]))
    grid = spark.range(np.prod(DIMS)).selectExpr(
        f"CAST(id % {DIMS[0]} AS INT) i0", f"CAST(id DIV {DIMS[0]} % {DIMS[1]} AS INT) i1",
        f"CAST(id DIV {DIMS[0] * DIMS[1]} AS INT) i2", "0.0D x", "0.0D y",
    )
    model = al.reconstruct(PairedTensor(grid, DIMS), factors, RANK)
    exact = model.selectExpr(*coord_names(3), "pred_x AS x", "pred_y AS y")
    t = PairedTensor(signals(exact, coord_names(3)), DIMS)
    assert al.joint_cost_table(t, factors, RANK).first().cost < 1e-6


def test_rank_one_product(spark):
    a, b, c = np.array([1.0, 2, 3]), np.array([0.5, 4]), np.array([2.0, 1])
    data = [(i, j, k, float(a[i] * b[j] * c[k]), 0.0) for i in range(3) for j in range(2) for k in range(2)]
    pair = spark.createDataFrame(data, "i0 INT, i1 INT, i2 INT, x DOUBLE, y DOUBLE")
    t = PairedTensor(signals(pair, coord_names(3)), (3, 2, 2))
    vectors = [
        spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate(vec)], "idx INT, x0 DOUBLE, y0 DOUBLE")
        for vec in (a, b, c)
    ]
    got = al.mttkrp(t, vectors, 1, 0, al.FUSED_TERMS[:1])
    scale = (b @ b) * (c @ c)
    assert {r.idx: round(r.mx0, 9) for r in got.collect()} == {i: round(a[i] * scale, 9) for i in range(3)}


def test_hash_start_values(spark):
    f = al.init_factor(spark, 1000, 0, 2, 5, "hash")
    row = f.agg(F.min("x0"), F.max("x0"), F.avg("x0"), F.countDistinct("x0")).first()
    assert 0 <= row[0] and row[1] < 1 and 0.45 < row[2] < 0.55 and row[3] == 1000
    again = al.init_factor(spark, 1000, 0, 2, 5, "hash").repartition(7)
    assert f.exceptAll(again).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    data=st.dictionaries(
        st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 4)),
        st.tuples(st.floats(0, 100), st.floats(0, 100)),
        min_size=1,
        max_size=30,
    ),
    target=st.integers(1, 10),
)
def test_products_of_random_tensors(spark, data, target):
    """Any sparse pair, any salting: the same numbers as the dense product."""
    dims = (4, 3, 5)
    listed = [(*c, *v) for c, v in data.items()]
    pair = spark.createDataFrame(listed, "i0 INT, i1 INT, i2 INT, x DOUBLE, y DOUBLE")
    t = PairedTensor(signals(pair, coord_names(3)), dims)
    fs = al.init_factors(spark, dims, 2, 3)
    plan = plan_joins(t.cells, dims, 2, budget=0, target=target)
    got = {r.idx: r for r in al.mttkrp(t, fs, 2, 2, plan=plan).collect()}
    x = np.zeros(dims)
    for c, v in data.items():
        x[c] = v[0]
    want = nm.mttkrp(x, [nm.formula_factor(d, w, 2, 0, 3) for w, d in enumerate(dims)], 2)
    assert set(got) == {c[2] for c in data}
    assert all(np.allclose([got[i].mx0, got[i].mx1], want[i], atol=1e-9) for i in got)
