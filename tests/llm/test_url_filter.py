import random

from kestrel.llm import url_filter as U

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.b.com", "/"), ("allow", "b.com", "/de/x")]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def judge(url):
    host, path = plain(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["org", "example.org", "www.example.org", "xexample.org", "COM", "a-b.com", "b.com", "a.b.com", "z.a.b.com", "net", "", "org.net", "exämple.org"]
    paths = ["", "/", "/es/", "/en/12", "/en/2", "/fr/a", "/de/x/y", "/de", "?q=/es/", "#top", "/fr/?x#y", "/en/1\nx"]
    urls = [f"{s}://{h}{p}" for s in ("http", "ftp") for h in hosts for p in paths] + [None, "", "example.org/es/", "http:/x", "a://b://c/es/"]
    rng.shuffle(urls)
    urls += urls[:20] + ["http://hot.org/es/"] * 300
    df = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in U.judge_urls(df, U.rules_table(spark, RULES), lanes=5).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id]), urls[r.page_id]


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.judge_urls(df, U.rules_table(spark, []), default="block").collect()] == [(None, "block")]
    assert U.judge_urls(df.limit(0), U.rules_table(spark, RULES)).count() == 0
