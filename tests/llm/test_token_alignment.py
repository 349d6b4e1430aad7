from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from pairlens.llm.token_alignment import Aligner, align_tokens, default_tokenizers
from tests.conftest import TESTDATA

TEXTS = [
    None,
    "",
    " ",
    "  ",
    "a",
    "hello world",
    "hello  world ",
    " hello\n world\n\n  x\t y",
    "tabs\tand\r\nlines nbsp 　 wide",
    "<|endoftext|> <s> </s> <unk> <0x41>",
    "a▁b",
    "x ▁ y",
    "naïve café — \U0001f600\U0001f600 日本語のテキスト",
    "don't we're I'LL 12345 3.14",
    "\x00nul \x1c sep",
    "the the the the the of of",
    "é combining",
]


def brute(texts: list[str | None]) -> tuple[list[tuple], dict]:
    """Whole texts encoded by the two libraries, and aligned token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = default_tokenizers()
    ta = Tokenizer.from_file(path_a)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=path_b)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(v): v for v in visible}
    for v in range(256):
        if v not in visible:
            letter[chr(256 + len(letter) - len(visible))] = v
    docs, pairs, found_in = [], Counter(), {}
    for d, text in enumerate(texts):
        a, b = [], []
        if text:
            a = ta.encode(" " + text, add_special_tokens=False).ids
            b = tb.encode(text)
        raw_a = [bytes(letter[c] for c in ta.id_to_token(i)) for i in a]
        raw_b = [
            bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        want = (" " + (text or "")).encode()
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            docs.append((0, 0, [], ""))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for k, r in enumerate(raw_a):
            at += len(r)
            ends_a[at] = k
        at = 0
        for k, r in enumerate(raw_b):
            at += len(r)
            ends_b[at] = k
        links, groups, la, lb = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            ka, kb = ends_a[end], ends_b[end]
            links.append((a[ka], b[kb]))
            groups.append(",".join(map(str, a[la : ka + 1])) + "|" + ",".join(map(str, b[lb : kb + 1])))
            la, lb = ka + 1, kb + 1
        pairs.update(links)
        for p in links:
            found_in.setdefault(p, set()).add(d)
        docs.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (_, y), n in pairs.items():
        top[y] = max(top.get(y, 0), n)
    rows = [
        (n_a, n_b, len(links), len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), sha)
        for n_a, n_b, links, sha in docs
    ]
    return rows, {p: (len(found_in[p]), n, n == top[p[1]]) for p, n in pairs.items()}


def check(spark, texts, ids=None):
    docs = spark.createDataFrame(
        [(k if ids is None else ids[k], t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, block int, ord int"
    )
    found, scores = align_tokens(docs)
    rows, pairs = brute(texts)
    got = sorted(tuple(r) for r in found.fillna(-1, ["doc_id"]).collect())
    want = sorted((-1 if (ids and ids[k] is None) else (k if ids is None else ids[k]), *r) for k, r in enumerate(rows))
    assert got == want
    assert {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in scores.collect()} == pairs


def test_odd_texts_equal_brute_force(spark):
    check(spark, TEXTS)


def test_null_and_repeated_ids_and_random_texts(spark):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "the", "of", "Ünder", "x1", "'s", ".", " ", "▁", "日", "<s>", "\U0001f600", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    check(spark, texts, [None if k % 7 == 0 else k // 3 for k in range(300)])


def test_test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    check(spark, [r.text for r in docs.orderBy("doc_id").collect()])


def test_very_long_texts(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    check(spark, [" ".join(rng.choice(words) for _ in range(100_000)), "a" * 20_000, "z " * 70_000, "short"])


def test_blocks_and_forgotten_chunks(spark, monkeypatch):
    import pairlens.llm.token_alignment as m

    aligner = Aligner(*default_tokenizers())
    block = m.Block(0)
    import numpy as np

    rng = np.random.default_rng(0)
    pairs, docs = rng.integers(0, 40, 5000), rng.integers(0, 300, 5000)
    for lo in range(0, 5000, 700):
        block.add(pairs[lo : lo + 700], docs[lo : lo + 700] + lo)
    got = {}
    for rows in block.rows():
        for k, p in enumerate(rows["pair"].tolist()):
            got[p] = (rows["n_docs"][k], rows["n_links"][k])
    doc = docs + np.arange(5000) // 700 * 700
    assert got == {p: (len(set(doc[pairs == p].tolist())), int((pairs == p).sum())) for p in set(pairs.tolist())}
    aligner.number("a b a")
    aligner.learn()
    monkeypatch.setattr(m, "CACHED_CHUNKS", 1)
    aligner.trim()
    assert aligner.number("b a") == [0, 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found, scores = align_tokens(docs)
    assert found.count() == 0 and scores.count() == 0
    with pytest.raises(Exception):
        align_tokens(docs.drop("text"))
