import math
import random
import re
from collections import Counter

import pytest

from chronoweave.llm import queries, urls

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/7?x", "http://example.com/en/70", "http://xexample.com/en/7", "http://a.net/de/8", "http://example.net/de/8#", "http://example.net/de/9", "x://y://z/com/en/", "http://com/en/", "http://org?/es/", "http://a.org/es/é😀", "a://b\n/c", "http://a.com:80/en/", "http://x.com/EN/"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 3)], "page_id long, url string, score string")
    got = urls.filter_urls(df, queries.URL_RULES).collect()
    assert len(got) == len(URLS) * 3
    for r in got:
        host, path, rule, verdict = brute(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_models_learn(spark):
    good = [f"http://library{i}.example.org/books/{i}" for i in range(200)]
    bad = [f"http://cheap-pills{i}.example.org/buy-now/{i}" for i in range(200)]
    labelled = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    model = urls.fit(labelled)
    import pyarrow as pa

    scores = model.scores(pa.array(["library999.example.org/books/1", "cheap-pills999.example.org/buy-now/2"]))
    assert scores[0] >= model.threshold > scores[1]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.filter_urls(df, ()).first()["verdict"] == "allow"
    assert urls.filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    only = urls.filter_urls(df.union(spark.createDataFrame([(2, "http://x.org/es/1")], df.schema)), queries.URL_RULES)
    assert {r["page_id"]: r["verdict"] for r in only.collect()} == {1: "block", 2: "block"}


def test_query(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op6_url_filters"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = brute(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


def test_counts_of_many_contexts_are_exact(spark):
    """More distinct contexts than 2^16 hashed cells keep apart."""
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-/") for _ in range(60))
    sides = [[make() for _ in range(2500)] for _ in range(2)]
    labelled = spark.createDataFrame([(u, s == 0) for s in (0, 1) for u in sides[s]], "url string, accepted boolean")
    held = {r["url"] for r in labelled.where(f"pmod(xxhash64(url), {urls.HELD_OUT}) = 0").select("url").collect()}
    pairs, contexts = ([Counter(), Counter()] for _ in range(2))

    def walk(url):
        symbols = (*url.encode(), "end")
        for i, c in enumerate(symbols):
            yield c, [symbols[max(0, i - k) : i] for k in range(urls.ORDER + 1)]

    for s in (0, 1):
        for url in sides[s]:
            for c, before in walk(url) if url not in held else ():
                for k, context in enumerate(before):
                    pairs[s][k, context, c] += 1
                    contexts[s][k, context] += 1
    assert len(pairs[0]) > 1 << 16

    def log_likelihood(s, url):
        total = 0
        for c, before in walk(url):
            p = 1 / 257
            for k, context in enumerate(before):
                p = (pairs[s][k, context, c] + urls.STRENGTH * p) / (contexts[s][k, context] + urls.STRENGTH)
            total += math.log(p)
        return total

    import pyarrow as pa

    probes = [*sides[0][:20], *sides[1][:20], make(), "x"]
    want = [(log_likelihood(0, u) - log_likelihood(1, u)) / (len(u) + 1) for u in probes]
    assert urls.fit(labelled).scores(pa.array(probes)).tolist() == pytest.approx(want)
