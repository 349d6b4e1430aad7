from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pairlens.llm import recompression as R
from pairlens.llm.hashing import words_of


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "the", "of"]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [text(rng.choice([19, 20, 21, 40, 90, 300])) for _ in range(6)]
    rows = []
    for _ in range(40):
        words = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.4:
                words += text(rng.randint(0, 60))
            elif kind < 0.8:
                p = rng.choice(passages)
                cut = rng.randrange(len(p)) if rng.random() < 0.3 else 0
                words += p[cut:]
            elif kind < 0.9:
                words += [rng.choice(vocabulary)] * rng.randint(1, 60)  # a run
            else:
                words += text(rng.randint(1, 3)) * rng.randint(1, 25)  # a period
        rows.append(rng.choice([" ", "\n", " \t"]).join(words))
    rows += [rows[3], rows[5], "", None, " \n"]
    return rows


def brute_force(texts, window=R.WINDOW):
    seen, out = set(), {}
    for d, t in enumerate(texts):
        words = (t or "").split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    rng = random.Random(seed)
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in R.remove_repeats(docs).collect()}
    want = brute_force(texts)
    assert got == {k: v[:3] for k, v in want.items()}


def test_kept_text(spark):
    texts = corpus(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in R.remove_repeats(docs, with_text=True).collect()}
    assert got == {k: v[3] for k, v in brute_force(texts).items()}


def test_interior_symbols_do_not_depend_on_context():
    rng = random.Random(0)
    inner = [f"w{rng.randrange(9)}" for _ in range(200)]
    found = []
    for _ in range(2):
        outer = [[f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 50))] for _ in range(2)]
        s = R.low_symbols(R.word_symbols(words_of([" ".join(outer[0] + inner + outer[1]).encode()])))
        shift = len(outer[0])
        inside = (s.low >= shift) & (s.high <= shift + 200)
        found.append({(int(n), a - shift, b - shift) for n, a, b in zip(s.name[inside], s.start[inside], s.end[inside])})
    assert found[0] == found[1] and len(found[0]) > 15


def test_nulls_repeats_and_no_rows(spark):
    long = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(4, long), (4, long), (None, long), (2, None), (9, long + " tail")], "doc_id long, text string"
    )
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in R.remove_repeats(docs).collect())
    assert got == [(0, 60, 60), (2, 0, 0), (4, 60, 0), (4, 60, 0), (9, 61, 60)]
    assert R.remove_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """Null ids and a repeated id, each row with another passage of documents before or its own."""
    rng = random.Random(6)

    def text(n):
        return [f"v{rng.randrange(500)}" for _ in range(n)]

    first = [text(120) for _ in range(4)]
    again = text(40)
    rows = [(i, " ".join(t)) for i, t in enumerate(first)]
    for id_ in (None, 7):
        for k, t in enumerate(first):
            rows.append((id_, " ".join(text(11 * k) + t[10 * k : 10 * k + 30] + text(50))))
        rows.append((id_, " ".join(again + text(5) + again)))
        rows += [(id_, " ".join(text(70))), rows[-1], (id_, None), (id_, "")]
    rng.shuffle(rows)
    want = []
    for id_, t in rows:
        before = [u for j, u in rows if j is not None and (id_ is None or j < id_)]
        want.append((-1 if id_ is None else id_, *brute_force(before + [t])[len(before)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in R.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(w[:4] for w in want)
    got = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in R.remove_repeats(docs, with_text=True).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] > 0 for w in want) >= 10
