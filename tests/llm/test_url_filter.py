"""Hosts, paths and rules against plain Python; verdicts of the trees on unseen URLs."""

import random

from pyspark.sql import functions as F

from tallyhouse.llm.url_filter import RULES, judge_urls

ODD = [None, "", "no scheme", "http://", "http://A.COM", "http://com/", "https://xcom/a",
       "ftp://a.b.Com/p?q=1#f", "http://WWW.Example.com/en/1", "http://example.com/en",
       "http://x.www.example.com/en/?a", "http://shop.example.com/en/9#x", "http://a.net/es/",
       "http://a.net?x=/es/", "http://a.net#/fr/", "http://ünï.net/fr/é", "a://b://c.net/es/",
       "http://a.net/es/\nline", "http://a.com/\nline"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, rule in RULES:
        own, _, p = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return host, path, best


def test_rules(spark):
    rows = list(enumerate(ODD)) + [(None, "http://q.org/x"), (3, "http://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr(
        "*", "1 as id", "2 as host", "3 as label")
    got = judge_urls(pages).collect()
    assert len(got) == len(rows)
    want = {(i, *plain(u)) for i, u in rows}
    for r in got:
        match = [w for w in want if w[0] == r["page_id"]]
        host, path, rule = match[0][1:]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
        assert r["verdict"] == rule[0] if rule else r["verdict"] in ("allow", "block")


def test_unseen_urls_and_one_sided_labels(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        bad = i % 2 == 0
        tail = f"/{rng.choice(['es', 'fr']) if bad else 'go'}/{rng.randrange(9999)}"
        rows.append((i, f"http://h{rng.randrange(99)}.{'net' if bad else 'com'}{tail}"
                        + ("?ad=1&x=2" if bad else "")))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = judge_urls(pages, hold_out=F.col("id") % 4 < 2).filter("page_id % 4 < 2").collect()
    assert sum((r["block_score"] >= 0.5) == (r["verdict"] == "block") for r in got) > 0.97 * len(got)
    one = judge_urls(pages.filter("page_id % 2 = 1").union(spark.sql("select 9999L, 'http://q.org/'")))
    assert {r["verdict"] for r in one.collect()} == {"allow"}
    assert judge_urls(pages.limit(0)).count() == 0
