from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairlens.llm import line_edits as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", "q"])
    return "".join(s)


def corpus(seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 80))) for _ in range(25)]
    rows = []
    for _ in range(40):
        lines = [edited(rng, rng.choice(bases), rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
        rows.append("\n".join(lines + [""] * rng.randint(0, 2)))
    hot = "".join(rng.choice("abcdefgh ") for _ in range(90))
    for i in range(50):  # many lines that share segments, mostly more than two edits apart
        rows.append(edited(rng, hot, rng.choice([1, 2, 8])) + "\n" + hot)
    return rows + [None, "", "tail\n"]


def brute_force(texts, threshold):
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for i, line in enumerate([] if t is None else t.split("\n")):
            places[line].append((d, i))
    lines = sorted(places, key=lambda x: places[x][0])
    label = {x: x for x in lines}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[:k]:
            if min(len(a), len(b)) >= L.LEAST_CHARS and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                x, y = sorted((root(a), root(b)), key=lambda z: places[z][0])
                label[y] = x
    return {
        (d, i): (*places[root(x)][0], (d, i) != places[root(x)][0] and x.strip() != "")
        for x in lines for d, i in places[x]
    }


@pytest.mark.parametrize("seed,threshold", [(1, 2), (3, 1)])
def test_classes_equal_all_pairs(spark, seed, threshold):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, line string")
    got = {
        (r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.duplicate)
        for r in L.duplicate_lines(docs, threshold).collect()
    }
    assert got == brute_force(texts, threshold)
    want = {}
    for d, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(lines) if not got[d, i][2]]
        if len(kept) == len(lines):
            want[d] = t
        elif "".join(kept).strip():
            want[d] = "\n".join(kept)
    assert {r.doc_id: r.text for r in L.drop_duplicate_lines(docs, threshold).collect()} == want


def test_automaton(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        pairs.append((a, edited(rng, a, rng.randint(0, 4))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (0, 1, 2, 3):
        out = df.select("a", "b", L.within(F.col("a"), F.col("b"), threshold).alias("ok")).collect()
        assert all(r.ok == (distance(r.a, r.b) <= threshold) for r in out)


def test_shared_ends_and_plans_of_long_lines(spark):
    """Whole characters are counted, of one to four bytes, and no step walks lines by character."""
    rng = random.Random(7)
    signs = "aébè€☃😀😁"
    pairs = [("", ""), ("a", ""), ("é", "è"), ("😀", "😁"), ("x😀", "y😀")]
    for _ in range(300):
        a = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        cut = rng.randint(0, len(a))
        pairs.append((a, a[:cut] + rng.choice(["", *signs]) + a[min(cut + rng.randint(0, 1), len(a)) :]))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", L._shared(F.col("a"), F.col("b")).alias("f"), L._shared(F.col("a"), F.col("b"), last=True).alias("l"))

    def first(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert all((r.f, r.l) == (first(r.a, r.b), first(r.a[::-1], r.b[::-1])) for r in got.collect())
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    lines = spark.createDataFrame([(1, "a" * 400), (2, "a" * 399)], "h long, line string")
    checked = L._verified(pair, lines, 2)
    assert checked.collect() == [(1, 2, True)]
    assert "lambda" not in checked._jdf.queryExecution().optimizedPlan().toString()


def test_nulls_repeats_and_no_rows(spark):
    long = "this is a line of more than twenty characters"
    docs = spark.createDataFrame(
        [(1, long, None), (1, long, None), (2, long + "!\nnew", 9), (None, long, 9), (None, "alone", 9)],
        "doc_id long, text string, n_chars int",
    )
    got = sorted((r.doc_id or 0, r.line_no, r.class_doc_id or 0, r.duplicate) for r in L.duplicate_lines(docs).collect())
    assert got == [(0, 0, 0, False), (0, 0, 1, True), (1, 0, 1, False), (1, 0, 1, False), (2, 0, 1, True), (2, 1, 2, False)]
    kept = sorted((r.doc_id or 0, r.text, r.n_chars) for r in L.drop_duplicate_lines(docs).collect() if r.doc_id != 1)
    assert kept == [(0, "alone", 9), (0, long, 9), (2, "new", 3)]
    assert L.duplicate_lines(docs.limit(0)).count() == 0
    assert L.drop_duplicate_lines(docs.limit(0)).columns == docs.columns


def test_hot_segments_are_dealt_by_what_sets_lines_apart(spark, monkeypatch):
    """Every segment that lines share counts as hot; classes stay those of all pairs."""
    monkeypatch.setattr(L, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(L, "SMALL_BUCKET", 0)
    for seed in (3,):
        rng = random.Random(seed)
        texts = corpus(seed)
        base = "the running number of this line is 0000 and its text goes on"
        texts += [base.replace("0000", f"{rng.randint(0, 400):04d}") for _ in range(60)]
        texts += [base.replace("running", "".join(rng.choice("abc") for _ in range(7))) for _ in range(40)]
        texts += [edited(rng, "-" * 40 + "=" * 20, rng.randint(0, 5)) for _ in range(20)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.duplicate) for r in L.duplicate_lines(docs).collect()}
        assert got == brute_force(texts, 2)


@pytest.mark.parametrize("threshold,small", [(2, 0), (3, 64)])
def test_lines_within_the_threshold_meet(spark, monkeypatch, threshold, small):
    """Any two lines within the threshold are connected by the pairs found, whatever the hub."""
    monkeypatch.setattr(L, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(L, "SMALL_BUCKET", small)
    rng = random.Random(8)
    lines, hubs = {}, {}
    for key in range(30):
        hub = "".join(rng.choice("abcd ") for _ in range(rng.randint(20, 50)))
        near = [edited(rng, hub, rng.randint(0, 9)) for _ in range(3)]
        for text in [hub, *near, *(edited(rng, rng.choice(near), rng.randint(0, 3)) for _ in range(12))]:
            lines.setdefault(text, len(lines))
            hubs.setdefault((key, text), hub)
    rows = [(key, hub, lines[text], lines[text], text) for (key, text), hub in hubs.items()]
    told = spark.createDataFrame(rows, "key long, hub_text string, h long, label long, text string")
    root = {h: h for h in lines.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {tuple(sorted(p)) for p in L._apart_pairs(told, threshold).select("a", "b").collect()}
    text_of = {h: text for text, h in lines.items()}
    for a, b in pairs:
        if distance(text_of[a], text_of[b]) <= threshold:
            root[find(a)] = find(b)
    together = [(x, y) for x in hubs for y in hubs if x[0] == y[0] and x[1] < y[1]]
    near = [(x, y) for (_, x), (_, y) in together if distance(x, y) <= threshold]
    assert near and all(find(lines[x]) == find(lines[y]) for x, y in near)
    assert len(pairs) < len(together)


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """Nothing is lost or cut in a row because of what another row of the same doc_id holds."""
    a, b, c = (x * 5 for x in ("alpha beta ", "gamma delta ", "quite another "))
    rows = [(0, a, "x"), (1, a, "x"), (1, b, "y"), (1, b + "\n" + a, "z"), (None, c, "n"), (None, b, "n"), (None, c[::-1], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.h) for r in L.drop_duplicate_lines(docs).collect())
    # Line 0 of doc 1 is a in one row and b in two others: b occurs first there, a before.
    assert got == sorted([(0, a, "x"), (1, b, "y"), (1, b, "z"), (-1, c, "n"), (-1, b, "n"), (-1, c[::-1], "n")])
    near = spark.createDataFrame([(1, a + "one"), (1, a + "onx"), (2, a + "ony")], "doc_id long, text string")
    flags = sorted((r.doc_id, r.duplicate) for r in L.duplicate_lines(near).collect())
    assert flags == [(1, False), (1, True), (2, True)]  # one of the two at the first position is first
