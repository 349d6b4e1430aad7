from __future__ import annotations

import math

import numpy as np
import pytest

from pairlens.llm import learned_partitions as A
from tests.conftest import TESTDATA


def brute_force(rows, queries, k=A.NEIGHBOURS):
    out = {}
    for q, v in queries:
        scores = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_bisection_is_balanced_and_cuts_few_links():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 3
    x = np.repeat(centres, 100, 0) + rng.normal(size=(800, 16))
    links = A.neighbour_graph(x, 10)
    part = A.balanced_parts(links, 3)
    assert np.bincount(part).tolist() == [100] * 8
    assert (part[links] == part[:, None]).mean() > 0.9


def test_recall_with_few_parts_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 12000)] + 0.25 * rng.normal(size=(12000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:1500] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    every = A.usable(df, "vec_id", "embedding").persist()
    router = A.fit(every, 12000, 24)
    assert len(router.b2) == 16 and router.sent <= 6
    got = collected(A.search(df, df.where("vec_id % 100 = 0")))
    want = brute_force(rows, [r for r in rows if r[0] % 100 == 0])
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want if q >= 1500]
    assert np.mean(hits) > 0.9
    for q, found in got.items():
        assert len(found) == 20
        for i, s in found:
            assert s == pytest.approx(float(np.dot(x[q], x[i])), rel=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert [i for i, _ in got[0]] == list(range(1, 21))  # ties to the smaller id


def test_recall_on_the_test_table(spark):
    rows = spark.read.parquet(f"{TESTDATA}/sf0.1/embeddings.parquet")
    got = collected(A.op5_learned_partitions(spark, f"{TESTDATA}/sf0.1"))
    data = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect()]
    want = brute_force(data, [d for d in data if d[0] % 20 == 0])
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_small_odd_and_empty_tables(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]),
        (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (20, [-1.0, 2.0]),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = collected(A.search(df, df.where("vec_id in (1, 4, 20)")))
    assert got == {
        1: [(2, 1.0), (3, 0.5), (3, 0.5), (20, -1.0)],
        20: [(3, 0.5), (3, 0.5), (1, -1.0), (2, -1.0)],
    }
    assert A.search(df.limit(0), df.limit(0)).count() == 0
    assert A.search(df, df.where("vec_id = 4")).count() == 0
