from __future__ import annotations

import re

from latticework.llm import url_filters as U
from latticework.llm.common import table
from latticework.llm.queries import URL_RULES, op6_url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, default="allow"):
    _, sep, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0] if sep else ""
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fit = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if h is not None and p is not None and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_query_equals_brute_force(spark, sf):
    want = {r.page_id: brute(r.url, URL_RULES) for r in table(spark, sf, "pages").collect()}
    assert {r.page_id: tuple(r)[1:] for r in op6_url_filters(spark, sf).collect()} == want


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.A.NET", "http://a.net/", "http://net/x?y#z", "http://a.b.example.com/de/q://x", "x://é.org/fr/ä", "http://a.net?x=/", "http://notnet/", "http://a.example.com/d", "http://a.example.com/de", "a://b#c://d.net/", "http://" + "a." * 3000 + "net/" + "p/" * 3000, "http://a\nb.net/\n/x", "http://.net/", "http://a.net./"]
    rules = [("net", "/", "block"), ("example.com", "/de", "block"), ("example.com", "/de", "allow"), ("b.example.com", "/de/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block"), ("x", None, "block"), ("net", "/p/p/", "allow")]
    df = spark.createDataFrame([(k % 7, u, "h", 1) for k, u in enumerate(urls)] * 2, "page_id long, url string, host string, verdict int")
    r = spark.createDataFrame(rules, "host string, path string, action string")
    for most in (50_000, 0):  # rules sent whole, and shuffled
        U.BROADCAST_RULES = most
        got = [(x.url, (x.host, x.path, x.rule, x.verdict)) for x in U.judge(df, r).collect()]
        assert sorted(got, key=repr) == sorted(((u, brute(u, rules)) for u in urls * 2), key=repr)
    U.BROADCAST_RULES = 50_000
    assert {x.verdict for x in U.judge(df, r.limit(0), default="block").collect()} == {"block"}
    assert U.judge(df.limit(0), r).collect() == []
