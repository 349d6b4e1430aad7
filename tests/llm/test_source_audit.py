from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from pairlens.llm import source_audit
from tests.conftest import TESTDATA
from tests.oracle_check import compare, connect


def brute(rows):
    """Every group against every kept term, one by one."""
    docs = []
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= 3), key=lambda t: t.encode())
        group = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            group[s].update(t for t in terms if df[t] >= 3)
        group[None] = sum(group.values(), Counter())

        def p(s, t):
            return 1 + 10**9 * (group[s][t] + 1) // (sum(group[s].values()) + len(kept))

        def f(x, y):
            return (x - y) ** 2 // y

        for s in [x for x in group if x is not None]:
            pair = [(-sum(f(p(s, t), p(h, t)) for t in kept), h.encode(), h) for h in group if h not in (s, None)]
            term = [(-f(p(s, t), p(None, t)), t.encode(), t) for t in kept if group[s][t] and p(s, t) > p(None, t)]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:200])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def odd_rows():
    rng = random.Random(2)
    words = ["the", "The", "straße", "ÉTÉ", "été", "日本", "x", "İ", "\U0001f600", *(f"w{chr(97 + k)}" for k in range(26)), "1", "don't", "a_b"]
    rows = [
        (" ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s", "s", "s", "é", "t", None]))
        for _ in range(250)
    ]
    rows += [(None, "en", "empty"), ("", "en", "empty"), (None, "only", "one"), ("rare words here", "none", "a"), ("other", "none", "b")]
    rows += [("the " * 30_000 + "x", "en", "long")] * 2 + [("\x00nul the", "de", "s")]
    return rows


@pytest.mark.parametrize("cells,joint", [(1 << 14, 1 << 18), (7, 50)])
def test_equals_brute_force_and_sql(spark, tmp_path, monkeypatch, cells, joint):
    monkeypatch.setattr(source_audit, "BLOCK_CELLS", cells)
    rows = odd_rows()
    docs = spark.createDataFrame([(k // 2, *r, 1, "w") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string")
    if joint != 50:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert compare(source_audit.audit(docs), con, source_audit.ORACLE) is None
    got = sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in source_audit.audit(docs).collect())
    assert got == brute(rows)


def test_joint_cells_in_small_cuts(spark, monkeypatch):
    """The kernel gives the same sums whatever is worked out at once."""
    docs = spark.createDataFrame([(t, lang, s) for t, lang, s in odd_rows()], "text string, lang string, source string")
    import pyarrow as pa

    rows = source_audit.Audit(docs).bitmaps().where("lang = 'en'").select("lang", "block", "source", "p", "word", "bits").toArrow()
    whole = source_audit._joint(rows)
    monkeypatch.setattr(source_audit, "JOINT_CELLS", 5)
    assert source_audit._joint(pa.table(rows)).equals(whole)


def test_sizes_of_bitmaps(spark):
    """Popcounts of a group's bitmaps are the numbers of its terms with each count."""
    docs = spark.createDataFrame(odd_rows(), "text string, lang string, source string")
    found = source_audit.Audit(docs)
    bits = {(r.lang, r.source, r["count"]): r.n for r in found.bitmaps().where("word is not null").groupBy("lang", "source", "count").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    cells = Counter((r.lang, r.source, r.n) for r in found.cells.collect())
    assert bits.keys() == cells.keys() and all(bits[k] <= cells[k] for k in cells)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.audit(docs).count() == 0
    nothing = spark.createDataFrame([(None, None, None), ("a", None, "x")], "text string, lang string, source string")
    assert sorted((r.source, r["item"], r.value) for r in source_audit.audit(nothing).collect()) == [("", "x", 0), ("x", "", 0)]


def test_test_table(spark):
    sf = f"{TESTDATA}/sf0.001"
    assert compare(source_audit.op11_source_audit(spark, sf), connect(sf), source_audit.ORACLE) is None
