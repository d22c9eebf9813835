"""URL rules and host reputation against plain Python."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from saleroom.llm import urls

RULES = (urls.Rule("allow", "com", "/"), urls.Rule("block", "b.com", "/x/"), urls.Rule("allow", "www.b.com", "/x/"), urls.Rule("block", "b.com", "/x/y"), urls.Rule("block", "org", ""))
URLS = [
    None, "", "no scheme", "http://", "http://A.B.com", "http://A.B.com/", "HTTP://www.B.COM/x/y?z#q", "http://b.com/x/y/z", "http://xb.com/x/y", "//b.com/x/", "http://b.com?x/", "http://b.com#a://c",
    "http://b.com/x/\nline", "ftp://u:p@b.com:21/x/", "http://b.com/X/", "http://ÀB.com/é", "http://a.org", "x?u=http://c.org/d", "http://com/", "http://.com/x", "http://" + "a." * 300 + "com/" + "x/" * 900,
]


def plain(url, rules=RULES):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host + r.path), r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def judged(spark, frame, rules, rows, labels=(), **how):
    pages = frame("page_id BIGINT, url STRING", *rows).select("*", F.lit(1).alias("host"), F.lit(2).alias("found"), F.lit(3).alias("bad"))
    return urls.judged(pages, frame("page_id BIGINT, bad BOOLEAN", *labels), rules, **how).collect()


def test_listed_and_tabled_rules(spark, frame):
    rows = [*enumerate(URLS), (None, URLS[6]), (3, URLS[3])]
    tabled = spark.createDataFrame([tuple(r) for r in RULES], "verdict string, host string, path string")
    for rules in (RULES, tabled):
        found = judged(spark, frame, rules, rows)
        assert len(found) == len(rows)
        for r in found:
            url = URLS[6 if r["page_id"] is None else r["page_id"]]
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (lambda h, p, s, v: (h, p, s, v or r["verdict"]))(*plain(url))
    assert judged(spark, frame, RULES, []) == []
    assert {r["verdict"] for r in judged(spark, frame, (), rows)} == {"allow"}


def test_suffixes_and_domains(spark, frame):
    wanted = {
        "a.b.example.com": ("com", "example.com"), "example.com": ("com", "example.com"), "com": ("com", "com"), "x.shop.co.uk": ("co.uk", "shop.co.uk"),
        "co.uk": ("uk", "co.uk"), "u@h.de:80": ("de", "h.de"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "host.": ("host", "host"), "a.b.de": ("de", "b.de"),
    }
    made = spark.createDataFrame([(h,) for h in wanted], "host string").select("host", urls.bare_host(F.col("host")).alias("b"))
    made = made.select("host", urls.suffix_of(F.col("b")).alias("s"), urls.domain_of(F.col("b"), urls.suffix_of(F.col("b"))).alias("d"))
    assert {r["host"]: (r["s"], r["d"]) for r in made.collect()} == wanted


def shrunk(children):
    """children: {name: (n, k, parent's share)} -> {name: (strength, share)}."""
    seen = sum((k - n * m) ** 2 for n, k, m in children.values())
    alone, paired = (sum(f(n) * m * (1 - m) for n, k, m in children.values()) for f in (lambda n: n, lambda n: n * (n - 1)))
    rho = max(1 / 1001, min(0.5, (seen - alone) / paired if paired > 0 else 0.5))
    s = 1 / rho - 1
    return {c: (s, (k + s * m) / (n + s)) for c, (n, k, m) in children.items()}


def test_reputation_shrinks_hosts(spark, frame):
    draw = random.Random(5)
    rates = {"bad.evil.com": 0.9, "new.evil.com": 0.9, "a.good.com": 0.02, "b.good.com": 0.05, "c.mixed.net": 0.2, "once.good.com": 1.0, "x.other.net": 0.1}
    sizes = {"bad.evil.com": 300, "new.evil.com": 3, "once.good.com": 1, "x.other.net": 80, "a.good.com": 200, "b.good.com": 200, "c.mixed.net": 120}
    rows, labels = [(9_000, "http://unseen.good.com/"), (9_001, "http://more.evil.com/")], [(None, True), (9_000, None), (77_777, True)]
    for host, n in sizes.items():
        for _ in range(n):
            rows += [(len(rows), f"http://{host}/p{len(rows)}")] * draw.choice([1, 2])
            labels += [(rows[-1][0], draw.random() < rates[host])]
    found = {r["host"]: r for r in judged(spark, frame, (), rows, labels)}
    counts = {h: (r["n_labelled"], r["n_bad"]) for h, r in found.items()}
    assert {h: n for h, (n, _) in counts.items()} == sizes | {"unseen.good.com": 0, "more.evil.com": 0}
    up = lambda c, cut: {g: tuple(sum(x[i] for h, x in c.items() if cut(h) == g) for i in (0, 1)) for g in {cut(h) for h in c}}
    last = lambda n: lambda h: ".".join(h.split(".")[-n:])
    domains, n = up(counts, last(2)), sum(n for n, _ in counts.values())
    top = (sum(k for _, k in counts.values()) + 1) / (n + 2)
    suffix = shrunk({s: (*c, top) for s, c in up(domains, last(1)).items()})
    domain = shrunk({d: (*c, suffix[last(1)(d)][1]) for d, c in domains.items()})
    host = shrunk({h: (*c, domain[last(2)(h)][1]) for h, c in counts.items()})
    for h, (s, share) in host.items():
        n, k = counts[h]
        m = domain[last(2)(h)][1]
        bad, good = k + s * m, n - k + s * (1 - m)
        bound = 1 / (1 + math.exp(-(math.log(bad / good) - 1.645 * math.sqrt(1 / bad + 1 / good))))
        assert math.isclose(found[h]["share"], share, rel_tol=1e-9) and math.isclose(found[h]["bound"], bound, rel_tol=1e-9)
        assert found[h]["verdict"] == ("block" if bound > urls.LIMIT else "allow")
    assert found["bad.evil.com"]["verdict"] == "block" and found["once.good.com"]["verdict"] == "allow"
    # a host without labels of its own is judged by its domain
    assert found["more.evil.com"]["share"] > 0.5 > 0.2 > found["unseen.good.com"]["share"]


def test_allowed_pages_keep_their_columns(spark, frame):
    pages = frame("page_id BIGINT, url STRING, verdict STRING", (1, "http://b.com/x/1", "v"), (2, "http://b.com/z", "v"), (2, "http://b.com/z", "v"), (None, None, None))
    kept = urls.allowed(pages, frame("page_id BIGINT, bad BOOLEAN"), RULES)
    assert kept.columns == pages.columns and sorted(str(r["page_id"]) for r in kept.collect()) == ["2", "2", "None"]
