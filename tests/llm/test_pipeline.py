from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline as P
from pairlens.llm.mixing import WEIGHTS, mix
from pairlens.llm.packing import token_pieces
from pairlens.llm.toxicity import fit, scores
from tests.llm import test_line_edits as lines
from tests.llm import test_order_minhash as near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    clean = [f"{a}{b}" for a in ("river", "stone", "garden", "letter", "window", "morning") for b in ("", "s", "ly", "er")]
    bases = [[" ".join(rng.choice(clean) for _ in range(rng.randint(5, 14))) for _ in range(rng.randint(1, 5))] for _ in range(40)]
    rows = []
    for base in bases:
        rows.append("\n".join(base))
        if rng.random() < 0.3:
            rows.append("\n".join(base))
        if rng.random() < 0.4:
            rows.append("\n".join(x.replace("r", "q", 1) for x in base) + "\nand one more line at the end of it")
    long = [rng.choice(clean) for _ in range(120)]
    rows += [" ".join(long), " ".join(long[:60] + ["swapped"] + long[61:])]
    rows += [x + " blockhead scoundrel" for x in rows[:12]] + [None, ""]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", rng.choice(["a", "b", None, "z"]), len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("blockhead" in (t or ""))) for i, t in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs


def brute_force(spark, path, docs):
    """The stages before packing, one after another in Python: {doc_id: (text, source, repeats)}."""
    read = lambda t: spark.read.parquet(f"{path}/{t}.parquet")
    model = fit(read("documents"), read("labels"))
    p = scores(model, [(d[1] or "").encode() for d in docs])
    kept = [d for d, s in zip(docs, p) if s < 0.5]
    found = lines.brute_force([d[1] for d in kept], 2)
    stripped = []
    for k, d in enumerate(kept):
        old = [] if d[1] is None else d[1].split("\n")
        new = [x for i, x in enumerate(old) if not found[k, i][2]]
        if len(new) == len(old):
            stripped.append((d[0], d[1], d[3]))
        elif "".join(new).strip():
            stripped.append((d[0], "\n".join(new), d[3]))
    classes = near.brute_force([d[1] for d in stripped])
    single = [d for k, d in enumerate(stripped) if classes[k] == k]
    size = {d[0]: len((d[1] or "").split()) for d in single}
    sources = sorted({d[2] for d in single}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d[0]] for d in single if d[2] == s) for s in sources}
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * total[s]}
        if not full:
            target.update(share)
            break
        target.update({s: 2.0 * total[s] for s in full})
        left -= sum(2.0 * total[s] for s in full)
        free -= full
    out = {}
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - whole * total[s], 0
        own = [(int(hashlib.md5(f"{d[0]}:17".encode()).hexdigest()[:15], 16), d) for d in single if d[2] == s]
        for _, d in sorted(own):
            before, upto = upto, upto + size[d[0]]
            extra = rest > 0 and (upto <= rest or (before < rest and upto - rest < rest - before))
            if whole + extra:
                out[d[0]] = (d[1], s, whole + extra)
    return out


def test_stages_equal_brute_force(spark, tables):
    path, docs = tables
    out = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = P.stored(stage(spark, out, path))
        assert tuple(out.columns) == P.COLUMNS, name
    got = {}
    for r in out.collect():
        text, source, n = got.get(r.doc_id, (r.text, r.source, 0))
        assert (text, source) == (r.text, r.source)
        got[r.doc_id] = (text, source, n + 1)
    want = brute_force(spark, path, docs)
    assert got == want and 20 < len(want) < len(docs)
    packed = P.run(spark, path).collect()
    pieces = token_pieces(out).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, pieces))
    assert P.run(spark, path).count() == len(packed)


def test_rows_that_repeat_an_id_with_other_texts(spark, tables):
    """Each row is judged by its own text and source, in every stage; extra columns do no harm."""
    path, _ = tables
    a, b, c = (" ".join(f"{w}{k}" for k in range(40)) for w in ("river", "stone", "garden"))
    rows = [(0, a, "a"), (1, a, "a"), (1, b, "z"), (1, c, "b"), (None, b + " w", "a"), (None, "letter", None), (2, None, "a")]
    docs = spark.createDataFrame(
        [(i, t, "en", s, 1, "x", 3) for i, t, s in rows], f"{SCHEMA}, repeats string, _removed int"
    )
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "") for r in df.collect())
    whole = sorted((i is None, i or 0, t or "", s or "") for i, t, s in rows)
    stages = dict(P.STAGES)
    assert key(stages["toxicity"](spark, docs, path)) == whole
    # Only row (1, a) holds a line that occurs before, as do those without doc_id, which are not cut.
    assert key(stages["line_dedup"](spark, docs, path)) == [r for r in whole if r != (False, 1, a, "a")]
    near = key(stages["near_dedup"](spark, docs, path))
    assert near == [r for r in whole if r != (False, 1, a, "a")]  # rows without doc_id stay
    mixed = stages["mixing"](spark, docs, path)
    assert tuple(mixed.columns) == P.COLUMNS
    got = Counter(key(mixed))
    assert set(got) <= set(whole) and all(n <= 2 for n in got.values())
    taken = {(r.doc_id, r.source): r.repeats for r in mix(docs.select(*P.COLUMNS)).collect()}
    assert got == Counter({w: taken[i, s] for (i, t, s), w in zip(rows, [(i is None, i or 0, t or "", s or "") for i, t, s in rows]) if taken[i, s]})


def test_no_rows(spark, tables):
    path, _ = tables
    out = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, out, path)
    assert out.count() == 0
