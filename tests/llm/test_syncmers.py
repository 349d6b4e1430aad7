from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pairlens.llm import syncmers as S
from pairlens.llm.hashing import RangeHash, mix64


def closed(text, k=S.K, s=S.S):
    """Places of closed syncmers, k-mer by k-mer."""
    out = []
    flat, _ = S.code_points([text])
    h = RangeHash(mix64(flat.astype(np.uint64) + np.uint64(1)))
    for i in range(len(text) - k + 1):
        small = [int(h.range(np.array([j]), np.array([j + s]))[0]) for j in range(i, i + k - s + 1)]
        if min(small) in (small[0], small[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé𝄞 \n") for _ in range(n)) for n in (200, 0, 5, 12, 11, 90)]
    h, at, owner = S.anchors(texts)
    for k, text in enumerate(texts):
        want = closed(text) if len(text) >= S.K else [0] * (len(text) > 0)
        assert sorted(at[owner == k].tolist()) == want
    # Context-free: the same stretch has the same anchors anywhere.
    h1, at1, _ = S.anchors(["xx" + texts[0] + "y"])
    assert {(a, b) for a, b in zip(h[owner == 0].tolist(), at[owner == 0].tolist())} <= {
        (a, b - 2) for a, b in zip(h1.tolist(), at1.tolist())
    }


def test_likeness():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    b = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    half = a[:1500] + b[:1500]
    swapped = a[1500:] + a[:1500]
    x, y, z, w = S.fingerprints([a, b, half, swapped])
    assert S.likeness(x, x) == 1 and S.likeness(x, y) == 0
    assert 0.1 < S.likeness(x, z) < 0.55
    assert S.likeness(x, w) < 0.7
    assert S.from_text(S.to_text(x)) == x
    assert S.likeness([], []) == 1 and S.likeness(x, []) == 0


def test_documents_and_their_next(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "délta", "𝄞", "omega\n"]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    rows += [(7, None), (8, ""), (10, "ab"), (11, "abcd" * 9000), (13, rows[5][1])]
    shuffled = list(rows)
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([(*r, "q") for r in shuffled], "doc_id long, text string, part string")
    got = {r.doc_id: r for r in S.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows)
    for k, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y, z = S.fingerprints([text, edited, following])
        assert (r.fingerprint, r.edited_fingerprint) == (S.to_text(x), S.to_text(y))
        assert (r.near_edited, r.near_next) == (S.likeness(x, y), S.likeness(x, z))
    assert got[13].fingerprint == got[15].fingerprint


def test_repeats_one_row_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (1, "abcdefgh"), (None, "zzzz"), (5, "qqqq")], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_chars, r.edited_sha256) for r in S.fingerprint_documents(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(1, 8, sha("abcdefab")), (1, 8, sha("abcdefqq")), (5, 4, sha("qqqz")), (99, 4, sha("zzza"))]
    one = docs.where("doc_id = 5")
    assert [r.near_next for r in S.fingerprint_documents(one).collect()] == [1.0]
    assert S.fingerprint_documents(docs.limit(0)).count() == 0


def test_fingerprint_is_the_smallest_anchors():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (4000, 100, 3, 0)]
    texts += ["same old line " * 400, "".join(rng.choice("ab") for _ in range(3000))]
    h, at, owner = S.anchors(texts)
    for k, got in enumerate(S.fingerprints(texts)):
        first = {}
        for x, p in zip((h[owner == k] >> np.uint64(24)).tolist(), at[owner == k].tolist()):
            first.setdefault(x, p)
        assert got == sorted(first.items())[: S.ANCHORS]
