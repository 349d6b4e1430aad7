from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pairlens.llm import toxicity as T

WORDS = ["river", "stone", "garden", "walks", "morning", "letter", "window", "bright", "carry", "often"]
BAD = ["scoundrel", "blockhead"]


def make(n, seed, bad):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly", "er"]) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = make(600, 1, BAD)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (99999, 1), (5, 0)], "doc_id long, toxic int"
    )
    return T.fit(docs, labels)


def test_unseen_documents_and_misspellings(model):
    for bad in (BAD, ["scoundrell", "blokhead"]):
        rows = make(200, 2, bad)
        p = T.scores(model, [r[1].encode() for r in rows])
        y = np.array([r[2] for r in rows])
        assert p[y == 1].min() > p[y == 0].max()
        if bad is BAD:
            assert ((p >= 0.5) == y).mean() > 0.98


def test_capitals_score_as_small_letters(spark, model):
    rows = make(200, 3, BAD)
    y = np.array([r[2] for r in rows])
    lower = T.scores(model, [r[1].encode() for r in rows])
    for change in (str.upper, str.title, str.swapcase):
        docs = spark.createDataFrame([(r[0], change(r[1])) for r in rows], "doc_id long, text string")
        got = {r.doc_id: r for r in T.score_documents(docs, model).collect()}
        assert [got[r[0]].score for r in rows] == pytest.approx(lower.tolist())
        assert (np.array([got[r[0]].predicted for r in rows]) == y).mean() > 0.98
    one, two = (T.scores(model, [t.encode()])[0] for t in ("ÉCOLE İS ΣΟΦΌΣ Scoundrel", "école i̇s σοφός scoundrel"))
    assert one == two


def test_scoring_matches_word_by_word(model):
    text = "Some scoundrel walks, the  bright\nwindow often a1 é blockhead carry more words here"

    def word(w):
        hashes = T.words_of([w.encode()])
        refs, counts = T.subwords(hashes, np.arange(1))
        assert len(refs) == counts[0] == 1 + sum(max(0, len(w.encode()) + 3 - n) for n in T.GRAMS)
        return model.bucket[refs].mean()

    words = text.split()
    spans = [words[i : i + T.SPAN] for i in range(0, len(words), T.SPAN)]
    logit = max(np.mean([word(w) for w in s]) for s in spans) + model.bias
    assert T.scores(model, [text.encode()])[0] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-4)


def test_rows_columns_nulls_and_split(spark, model):
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (None, "a scoundrel blockhead", 9), (4, "word " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = T.score_documents(docs, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.predicted for r in out if r.doc_id in (1, 2)} == {0}
    ids = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", T.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids.collect())


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.score_documents(docs, T.fit(docs, none)).collect()] == [0]
    empty = docs.limit(0)
    assert T.score_documents(empty, T.fit(empty, none)).count() == 0


def test_texts_are_fitted_in_a_task_and_not_on_the_driver(spark, monkeypatch):
    rows = make(80, 5, BAD)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(400, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(400, 0)], "doc_id long, toxic int")
    # What the whole sample gives, in the order of its ids; held-out rows are not learned from.
    learned = [r for r in [*rows, (400, "", 0)] if zlib.crc32(str(r[0]).encode()) % 5]
    toxic = np.array([r[2] for r in learned])
    order = np.random.default_rng(T.SEED).permutation(len(learned))
    want = T.train([learned[i][1] for i in order], toxic[order], np.ones(len(learned)))
    assert want.bucket.any()

    def refused(*args):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(T, "train", refused)
    monkeypatch.setattr(type(docs), "toPandas", refused)
    got = T.fit(docs, labels)
    assert np.array_equal(got.bucket, want.bucket) and got.bias == want.bias
