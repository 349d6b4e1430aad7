from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import order_minhash as O
from pairlens.llm.common import hub_order

VOCABULARY = [f"w{i}" for i in range(400)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_banded_alignment(seed):
    rng = random.Random(seed)
    a = [rng.randrange(rng.choice([3, 50])) for _ in range(rng.randint(0, 150))]
    b = list(a)
    for _ in range(rng.randint(0, 30)):
        k = rng.randrange(len(b) + 1)
        b[k : k + rng.randint(0, 2)] = [rng.randrange(60) for _ in range(rng.randint(0, 2))]
    want = lcs(a, b)
    band = len(a) + len(b) - 2 * want
    assert O.aligned_matches(a, b, max(band, 0), want) == want
    assert O.aligned_matches(a, b, band // 3, 0) <= want


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    passage = words(rng, 60)
    for _ in range(25):
        base = words(rng, rng.randint(40, 300))
        if rng.random() < 0.5:
            base = base[:30] + passage + base[30:]
        rows.append(base)
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            for _ in range(rng.randint(0, 6)):
                near[rng.randrange(len(near))] = rng.choice(VOCABULARY)
            rows.append(near)
    hot = words(rng, 200)
    for _ in range(40):
        near = list(hot)
        near[rng.randrange(200)] = "x%d" % rng.randrange(1000)
        rows.append(near)
    rows += [hot] * 10 + [["a", "b"], ["a", "b"], ["a", "c"], []]
    rng.shuffle(rows)
    return [" ".join(r) for r in rows] + ["  \n", None, None]


def runs(text):
    w = text.split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def brute_force(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            a, b = runs(texts[i]), runs(texts[j])
            both = sum((Counter(a) & Counter(b)).values())
            like = texts[i].split() == texts[j].split()
            if not like and both * 1.8 >= 0.8 * (len(a) + len(b)) and both:
                m = lcs(a, b)
                like = m >= 0.8 * (len(a) + len(b) - m) - 1e-9
            if like:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, h1 string")
    got = {r.doc_id: r.class_id for r in O.near_duplicates(docs).collect()}
    assert got == brute_force(texts)
    kept = sorted(r.doc_id for r in O.keep_one(docs).collect())
    assert kept == sorted(set(got.values()))


def test_large_mixed_buckets_equal_all_pairs(spark):
    """Hundreds of pairs that have most sketches in common with all others, each pair just alike."""
    rng = random.Random(5)
    common = words(rng, 204)
    texts = []
    for i in range(300):
        own = [f"p{i}_{k}" for k in range(10)]
        texts += [" ".join(common + own + [f"o{i}_{side}_{k}" for k in range(21)]) for side in "ab"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in O.near_duplicates(docs).collect()}
    pairs = defaultdict(list)
    for i, t in enumerate(texts):
        pairs[t.split()[204]].append(i)
    a, b = pairs["p0_0"]
    one, two, other = runs(texts[a]), runs(texts[b]), runs(texts[pairs["p1_0"][0]])
    like, unlike = len(set(one) & set(two)), len(set(one) & set(other))
    assert like >= 0.8 * (2 * len(one) - like) and unlike < 0.8 * (2 * len(one) - unlike)
    assert got == {i: min(p) for p in pairs.values() for i in p}


def test_prefix_pairs_hold_every_alike_pair(spark):
    texts = list(dict.fromkeys(" ".join(t.split()) for t in corpus(3) if t and t.split()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = O.vertices_of(O.sketch_documents(docs)).select("rep", F.col("rep").alias("label"))
    met = {(int(r.a) >> 62, int(r.b) >> 62) for r in O.prefix_pairs(members, docs, 0.8).collect()}
    want = {
        (i, j) for j in range(len(texts)) for i in range(j)
        if O.alike(*[np.array([hash(x) for x in runs(texts[k])]) for k in (i, j)])[0]
    }
    assert want and want <= met


def test_prefix_pairs_leave_out_what_notes_tell_apart(spark):
    """Copies of a base with edits of their own meet in its k-mers, but only alike ones become pairs."""
    rng = random.Random(12)
    base = words(rng, 300)
    texts = []
    for k in range(80):
        own = list(base)
        for i in rng.sample(range(300), rng.choice([2, 8])):
            own[i] = f"n{k}_{i}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = O.vertices_of(O.sketch_documents(docs)).select("rep", F.col("rep").alias("label"))
    rows = [(int(r.a) >> 62, int(r.b) >> 62) for r in O.prefix_pairs(members, docs, 0.8).collect()]
    met = set(rows)
    assert len(rows) == len(met)  # once, in however many k-mers they meet
    arrays = [np.array([hash(x) for x in runs(t)]) for t in texts]
    want = {(i, j) for j in range(80) for i in range(j) if O.alike(arrays[i], arrays[j])[0]}
    assert want and want <= met and len(met) <= 1.1 * len(want)


@pytest.mark.parametrize("members", [5, 3_000_000, 1 << 40])
def test_hub_is_of_the_smallest_class_at_any_size(spark, members):
    rows = spark.createDataFrame([(1, -members), (2, -4), (3, -members)], "rep long, weight long")
    assert rows.agg(F.max_by("rep", hub_order("weight", "rep"))).first()[0] == 2
    assert rows.agg(F.min_by("rep", hub_order("weight", "rep"))).first()[0] in (1, 3)


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "zz"), (2, None), (3, "")],
        "doc_id long, text string",
    )
    got = sorted(((r.doc_id or 0, r.class_id or 0) for r in O.near_duplicates(docs).collect()))
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (3, 3)]
    assert O.near_duplicates(docs.limit(0)).count() == 0
    assert O.keep_one(docs).count() == 6


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """No document is lost or linked because of what another row of its doc_id holds."""
    rng = random.Random(9)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(0, a), (1, a), (1, b), (1, b + " more"), (-5, c), (-5, d), (None, a + " x"), (None, d + " y"), (None, "un " * 40), (None, "deux " * 40)]
    docs = spark.createDataFrame([(i, t, i, "z") for i, t in rows], "doc_id long, text string, class_id long, h1 string")
    assert O.near_duplicates(docs).count() == len(rows)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in O.keep_one(docs).collect())
    left_b = min([b, b + " more"], key=lambda t: [r[2] for r in kept if r[1] == 1].count(t) == 0)
    nameless = [(True, 0, t) for i, t in rows if i is None]
    assert kept == sorted([(False, 0, a), (False, 1, left_b), (False, -5, c), (False, -5, d), *nameless])
    classes = sorted((r.doc_id is None, r.doc_id or 0, r.class_id is None, r.class_id or 0) for r in O.near_duplicates(docs).collect())
    assert classes == sorted([
        (False, 0, False, 0), (False, 1, False, 0), (False, 1, False, 1), (False, 1, False, 1), (False, -5, False, -5), (False, -5, False, -5),
        (True, 0, False, 0), (True, 0, False, -5), (True, 0, True, 0), (True, 0, True, 0),
    ])


def test_hundreds_of_long_pairs(spark, monkeypatch):
    """Texts of thousands of words in pieces, against hubs whose pairs are dealt in several runs."""
    monkeypatch.setattr(O, "PAIRS_PER_HEAD", 16)
    monkeypatch.setattr(O, "PIECE", 100)
    rng = random.Random(6)
    base = words(rng, 4000)
    texts = []
    for k in range(150):
        own = list(base)
        for i in rng.sample(range(4000), rng.choice([5, 20, 60, 300])):
            own[i] = f"n{k}_{i}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = O.vertices_of(O.sketch_documents(docs)).select("rep").collect()
    keys = {int(r.rep) >> 62: r.rep for r in groups}
    pairs = [(keys[i], keys[j]) for i in (0, 1) for j in range(150) if i < j]
    found = O.verify(O.stored(spark.createDataFrame(pairs, "a decimal(38,0), b decimal(38,0)")), docs, 0.8).collect()
    got = {(int(r.a) >> 62, int(r.b) >> 62): r.ok for r in found}
    arrays = [np.array([hash(x) for x in runs(t)]) for t in texts]
    assert got == {(i, j): O.alike(arrays[i], arrays[j])[0] for i in (0, 1) for j in range(150) if i < j}
    assert len(found) == len(got) and 0 < sum(got.values()) < len(got)


def test_order_matters():
    base = [f"w{i}" for i in range(300)]
    moved = base[100:] + base[:100]
    assert O.alike(*[np.array([hash(t) for t in runs(" ".join(x))]) for x in (base, moved)])[0] is False
