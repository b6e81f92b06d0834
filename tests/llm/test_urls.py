"""Operator 4 against a plain scan of the rules."""

import time

from elotrail.llm.queries import URL_RULES
from elotrail.llm.url_filter import judge_urls

URLS = [None, "", "no scheme", "http://", "http://example.org", "http://example.org/",
        "https://WWW.Example.ORG/es/x?y=1", "http://a.b.example.org/en/12#z", "http://example.org/en/2",
        "http://badexample.org/es/", "http://x.com/fr/1", "http://com/de/", "http://x.com/de", "http://x.com/DE/",
        "http://x.com?/de/", "http://org/", "http://example.org:80/es/", "ftp://É.org/", "http://u@x.org/a://b",
        "http://x.com/de/", "http://x.com/de/", "http://..org/", "://x.org/q"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(URLS)],
                                  "page_id long, url string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rules).collect()}
    assert out == {i: plain(u) for i, u in enumerate(URLS)}
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def test_equal_rules_block(spark):
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("A.com", "/", "block")],
                                  "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert judge_urls(pages, rules).first()["verdict"] == "block"


def test_very_long_urls(spark):
    hosts = {1: "a." * 500_000 + "example.org", 2: "a." * 30_000 + "com", 3: "b" * 10**6}
    urls = {i: f"http://{h}/es/" + "p/" * (500_000 if i == 2 else 1) for i, h in hosts.items()}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    start = time.monotonic()
    out = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rules).collect()}
    assert out == {i: plain(u) for i, u in urls.items()}
    assert time.monotonic() - start < 60


def test_rules_of_any_number_of_labels(spark):
    hosts = ["net", "b.net", "a.b.net", "x.a.b.net"]
    rules = spark.createDataFrame([(h, "/p" * k, "block") for k, h in enumerate(hosts)],
                                  "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, f"http://{h}/p/p/p") for k, h in enumerate(hosts)],
                                  "page_id long, url string")
    out = {r["page_id"]: r["rule"] for r in judge_urls(pages, rules).collect()}
    assert out == {0: "net", 1: "b.net/p", 2: "a.b.net/p/p", 3: "x.a.b.net/p/p/p"}
