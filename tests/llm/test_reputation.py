"""Rules and reputations of hosts: addresses, shrinkage, and rows that come seldom."""

import math
from collections import defaultdict
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from tracewell.llm import reputation as rp

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
URL = "page_id long, url string, html string"


def test_addresses(spark):
    cases = {
        "HTTP://Example.ORG/a/b?c#d": ("example.org", "/a/b"), "x://h": ("h", ""), "x://h?q=/p": ("h", ""), "x://h#/p": ("h", ""), "no address": ("", ""), "://": ("", ""), None: ("", ""), "": ("", ""),
        "a://b://c/d": ("b:", "//c/d"), "https://ÄB.de:80/x": ("Äb.de:80", "/x"), "h:///p": ("", "/p"), "u://a/?": ("a", "/"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: (r.h or "", r.p or "") for r in df.select("url", rp.host(F.col("url")).alias("h"), rp.path(F.col("url")).alias("p")).collect()}
    assert got == cases
    for u in ("http://a.b/c/d?e=f", "https://www.example.com/", "ftp://x.y#z"):
        assert (urlsplit(u).netloc, urlsplit(u).path) == tuple(spark.range(1).select(rp.host(F.lit(u)), rp.path(F.lit(u))).first())


def test_registered_domains(spark):
    cases = {"a.b.example.com": ("com", "example.com"), "x.shop.co.uk": ("co.uk", "shop.co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "bbc.uk": ("uk", "bbc.uk"), "": ("", ""), "www.com.org": ("org", "com.org")}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    assert {r.h: (r.s, r.d) for r in df.select("h", rp.suffix(F.col("h")).alias("s"), rp.domain(F.col("h")).alias("d")).collect()} == cases


def test_longest_rule_wins(spark):
    cases = {
        "http://example.org/es/1": ("example.org/es/", "block"), "http://a.example.org/en/12": ("example.org/en/1", "block"), "http://a.example.org/en/2": ("org/", "allow"), "http://notexample.org/es/": ("org/", "allow"),
        "http://x.org": (None, "allow"), "http://org/": ("org/", "allow"), "http://b.com/de/": ("com/de/", "block"), "http://b.com/DE/": (None, "allow"), "http://com/fr/": ("com/fr/", "allow"), "http://xcom/fr/": (None, "allow"), None: (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(cases)], URL)
    got = {r.page_id: (r.rule, r.verdict) for r in rp.judged(pages, spark.createDataFrame([], "page_id long, bad boolean"), RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    with pytest.raises(ValueError):
        rp.judged(pages, spark.createDataFrame([], "page_id long, bad boolean"), [(f"h{i}/", "block") for i in range(1001)])


def brute(hosts, z=rp.Z):
    """{host: (mean, bound)} from {host: (n, k, domain, suffix)}."""

    def strength(groups):
        a = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in groups)
        b = sum(n * (n - 1) * m * (1 - m) for n, k, m in groups)
        return 1 / min(max(a / b if b else rp.NO_LIKE, rp.LEAST_LIKE), rp.MOST_LIKE) - 1

    def level(at, up):
        sums = defaultdict(lambda: [0, 0])
        for h in hosts.values():
            sums[h[at]][0] += h[0]
            sums[h[at]][1] += h[1]
        s = strength([(n, k, up[g]) for g, (n, k) in sums.items()])
        return {g: (up[g] * s + k) / (s + n) for g, (n, k) in sums.items()}

    n, k = (sum(h[i] for h in hosts.values()) for i in (0, 1))
    suffixes = level(3, dict.fromkeys({h[3] for h in hosts.values()}, (k + rp.START) / (n + 1)))
    domains = level(2, {h[2]: suffixes[h[3]] for h in hosts.values()})
    s = strength([(h[0], h[1], domains[h[2]]) for h in hosts.values()])
    out = {}
    for name, (n, k, d, _) in hosts.items():
        m = (domains[d] * s + k) / (s + n)
        out[name] = (m, m - z * math.sqrt(m * (1 - m) / (s + n + 1)))
    return out


def test_reputations_equal_brute_force(spark):
    hosts = {f"h{i}.d{i % 7}.{('com', 'org', 'co.uk')[i % 3]}": (i % 11 * (i % 3), i % 11 * (i % 3) * (i % 7) // 9) for i in range(120)}
    full = {h: (*v, h.split(".", 1)[1], h.split(".", 2)[2]) for h, v in hosts.items()}
    df = spark.createDataFrame([(h, *v) for h, v in hosts.items()], "host string, n long, k long")
    got = {r.host: (r["mean"], r.bound) for r in rp.reputations(df).collect()}
    want = brute(full)
    assert got.keys() == want.keys() and all(abs(got[h][i] - want[h][i]) < 1e-9 for h in want for i in (0, 1))


def test_bad_hosts_are_blocked_and_sparse_ones_are_not(spark):
    rows, bad = [], []
    for i in range(3000):
        name = ("good", "spam", "fair")[i % 3] if i < 2990 else f"rare{i}"
        rows.append((i, f"http://{name}.{'farm' if name == 'spam' else 'site'}.net/{i}", ""))
        bad.append((i, {"good": i % 50 == 0, "spam": i % 10 != 1, "fair": i % 6 == 2}.get(name, True)))
    out = rp.judged(spark.createDataFrame(rows, URL), spark.createDataFrame(bad, "page_id long, bad boolean"))
    got = {r.host: (r.verdict, r.n_labelled) for r in out.collect()}
    assert got["spam.farm.net"][0] == "block" and got["good.site.net"] == ("allow", 997)
    assert [got[f"rare{i}.site.net"] for i in range(2990, 3000)] == [("allow", 1)] * 10  # one bad page each says little
    unseen = rp.judged(spark.createDataFrame([*rows, (9000, "http://new.farm.net/", ""), (9001, "http://new.site.net/", "")], URL), spark.createDataFrame(bad, "page_id long, bad boolean"))
    new = {r.page_id: r.bad_bound for r in unseen.where("page_id >= 9000").collect()}
    assert new[9000] > new[9001]


def test_seldom_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x"), (1, "http://a.b/c", "x"), (None, "http://a.b/", None), (2, None, ""), (3, "a.b/" + "c" * 200_000, ""), (4, "http://a.b/" + "d" * 200_000, "")], URL)
    told = spark.createDataFrame([(1, True), (1, False), (1, None), (None, True), (77, True)], "page_id long, bad boolean")
    out = rp.judged(pages.selectExpr("*", "'mine' as host", "1 as n", "2 as bound", "'r' as rule"), told.selectExpr("*", "'h' as host", "9 as n"), RULES)
    got = sorted((str(r.page_id), r.host, len(r.path), r.n_labelled) for r in out.collect())
    assert got == sorted([("1", "a.b", 2, 4), ("1", "a.b", 2, 4), ("None", "a.b", 1, 4), ("2", "", 0, 0), ("3", "", 0, 0), ("4", "a.b", 200_001, 4)])
    assert rp.judged(pages.limit(0), told).count() == 0 and rp.judged(pages, told.limit(0), RULES).count() == 6
