from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from pairlens.llm import resampling as R
from pairlens.llm.common import kth_largest, largest

GOOD = "the river runs along an old stone wall and children walk there every morning".split()
JUNK = "click buy now free $$$ win prize offer".split()


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        rows.append((i, " ".join(rng.choice(GOOD if good else JUNK) for _ in range(rng.randint(8, 80)))))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


def names(text):
    """Buckets of a text, word by word and pair by pair."""
    words = text.lower().split()
    out = []
    for k, w in enumerate(words):
        out += R.features([w.encode()])[0].tolist()
        if k + 1 < len(words):
            out.append(int(R.features([f"{w} {words[k + 1]}".encode()])[0][1]))
    return out


def test_weights_and_sample_equal_brute_force(spark):
    rows, labels = corpus(80, 1)
    rows += [(200, None), (201, "  "), (202, "The RIVER\nfree")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    marks = spark.createDataFrame([*labels, (1, 0), (None, 1), (9999, 1), (3, None)], "doc_id long, quality int")
    good = {i for i, q in labels if q}
    target, raw = Counter(), Counter()
    for i, text in rows:
        raw.update(names(text or ""))
        target.update(names(text or "") if i in good else [])
    p = {b: math.log((target[b] + 0.5) / (sum(target.values()) + 0.5 * R.BUCKETS)) for b in raw}
    q = {b: math.log((raw[b] + 0.5) / (sum(raw.values()) + 0.5 * R.BUCKETS)) for b in raw}
    weighed = R.weigh(docs, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()
    assert len(weighed) == len(rows)
    for r in weighed:
        own = names(dict(rows)[r.doc_id] or "")
        assert r.n_features == len(own)
        assert r.log_weight == pytest.approx(sum(p[b] - q[b] for b in own), abs=1e-8)
    kept = {r.doc_id for r in R.resample(docs, marks, share=0.4).collect()}
    order = sorted(weighed, key=lambda r: -r.key)
    assert kept == {r.doc_id for r in order[: math.ceil(0.4 * len(rows))]}


def test_gumbel_noise(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    x = np.array([r[0] for r in ids.select(R.gumbel("doc_id", 3)).collect()])
    assert abs(x.mean() - 0.5772) < 0.06 and abs(x.std() - math.pi / math.sqrt(6)) < 0.06


def test_good_stay_and_junk_goes(spark):
    rows, labels = corpus(400, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in R.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    good = {i for i, _ in rows if i % 5}
    assert len(kept) == 320 and len(kept & good) >= 318


def test_odd_and_empty_tables(spark):
    rows, labels = corpus(10, 3)
    docs = spark.createDataFrame([*rows, (1, rows[1][1]), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    assert R.resample(docs, marks, share=1.0).count() == 12
    assert R.resample(docs, marks.limit(0)).count() == 12
    assert R.resample(docs.limit(0), marks).count() == 0


def test_largest(spark):
    rng = random.Random(5)
    values = [(rng.choice([-5, 0, 3, 10**12, rng.randint(-(2**62), 2**62)]), i) for i in range(300)]
    df = spark.createDataFrame(values, "v long, i long")
    ordered = sorted(values, reverse=True)
    assert kth_largest(df, "v", 17)[0] == ordered[16][0]
    for k in (0, 1, 50, 150, 299, 300, 400):
        assert sorted(map(tuple, largest(df, "v", "i", k).collect()), reverse=True) == ordered[:k]
