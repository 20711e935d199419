import re

import pytest
from pyspark.sql import functions as F

from tracegrid.llm.url_filter import RULES, fitting_rule, host_of, path_of, spread, url_filter

PAGES = "page_id bigint, url string, html string"
LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/9#t",
    "http://com/de/", "http://xcom/de/", "http://x.net/", "http://x.org", "http://x.org?y", "nothing", "", None, "a://b.com/fr/://c.org/",
    "://example.org/en/1", "http://é.org/Ä\nb", "http://dot.com.evil.net/fr/", "http://x.COM/FR/",
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], PAGES)
    rule, verdict = fitting_rule(F.col("h"), F.col("p"))
    got = rows.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).select("*", rule.alias("r"), verdict.alias("v"))
    for r in got.collect():
        assert (r.h, r.p) == parts(r.url)
        want = plain_rule(r.h, r.p)
        assert (r.r, r.v) == ((want[1] + want[2], want[0]) if want else (None, None)), r.url


def plain_spread(seeds, links, rounds=15, damping=0.85):
    out = {}
    for s, _, n in links:
        out[s] = out.get(s, 0) + n
    start = {h: (1 - damping) * m for h, m in seeds.items()}
    rank = dict(start)
    for _ in range(rounds):
        new = dict(start)
        for s, d, n in links:
            if s in rank:
                new[d] = new.get(d, 0) + damping * rank[s] * n / out[s]
        rank = new
    return rank


def test_spread(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "a", 1), ("e", "d", 1)]
    seeds = [("trust", "a", 3), ("trust", "e", 1), ("distrust", "c", 2)]
    got = spread(spark.createDataFrame(seeds, "kind string, host string, mass bigint"), spark.createDataFrame(links, "src string, dst string, n bigint"))
    ranks = {(r.kind, r.host): r["rank"] for r in got.collect()}
    forward = plain_spread({"a": 3, "e": 1}, links)
    backward = plain_spread({"c": 2}, [(d, s, n) for s, d, n in links])
    assert {h: m for (k, h), m in ranks.items() if k == "trust"} == pytest.approx(forward)
    assert {h: m for (k, h), m in ranks.items() if k == "distrust"} == pytest.approx(backward)


def test_distrust_reaches_who_links_to_bad_hosts(spark):
    link = lambda u: f'<p><a class="x" href="{u}">t</a> <A HREF=/own>u</A></p>'
    rows = [(i, "http://bad.com/de/1", None) for i in range(20)]
    rows += [(100, "http://farm.net/x", link("http://BAD.com/de/1?z") * 5), (101, "http://fine.net/x", link("//good.org/a"))]
    rows += [(102, "http://good.org/a", link("http://fine.net/x")), (103, "http://alone.net/", "<a href='http://gone.net'>"), (104, None, None)]
    rows += [(105, "http://sub.bad.com/en/1", ""), (106, "http://bad.com/en/1", "")]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1))).collect()}
    assert len(got) == 27
    assert got[0].verdict == "block" and got[0].rule == "com/de/"
    assert got[100].verdict == "block" and got[100].rule is None
    assert got[105].verdict == "block" and got[106].verdict == "block"
    assert [got[i].verdict for i in (101, 102, 103, 104)] == ["allow"] * 4
    assert (got[104].host, got[104].path) == ("", "")


def test_empty(spark):
    assert url_filter(spark.createDataFrame([], PAGES)).count() == 0
