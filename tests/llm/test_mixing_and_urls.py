from __future__ import annotations

import random

from pairlens.llm import mixing, url_rules
from tests.oracle_check import compare

import duckdb


def test_mix_equals_sql_with_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "é", None, "z", "a", "a"]), 7) for i in range(300)]
    rows += [(900, None, "a", 7), (901, "", None, 7), (902, "x " * 4000, "one", 7), (903, "", "empty", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = mixing.mix(docs)
    assert compare(out.drop("source", "repeats"), con, mixing.ORACLE) is None
    total = {}
    for r in out.collect():
        assert r.taken <= 2 * r.size
        t = total.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(abs(a - b) <= max(60, 4000 if s == "one" else 0) for s, (a, b) in total.items())
    assert mixing.mix(docs.limit(0)).count() == 0
    twice = mixing.mix(docs.limit(5).union(docs.limit(5)))
    assert twice.count() == 10


def test_urls_equal_rule_by_rule(spark):
    hosts = ["org", "a.org", "xorg", "example.org", "b.Example.ORG", "notexample.org", "com", "x.y.com", "net", "", "org.", ".org", "u@org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x#y", "/fr/a", "/de/b#c", "?q=/es/", "/en/2"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c/d", "://org/", "http://org/\n/x"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, urls[3], "h"), (0, urls[0], "h")], "page_id long, url string, host string")
    rules = [*url_rules.RULES, url_rules.Rule("block", "a.b.net", "/"), url_rules.Rule("allow", "y.com", "/de/b")]

    def judged(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    got = sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in url_rules.judge(pages, rules).collect())
    want = sorted((p is None, p or 0, *[x or "" for x in judged(u)]) for p, u, _ in pages.collect())
    assert got == want
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, [], "block").collect()} == {"block"}
