import random

from veilspan.llm import url_filter as u


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:at], rest[at:]
    at = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return host.translate(str.maketrans(u.UPPER, u.LOWER)), rest[:at]


def judge(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


URLS = ["http://WWW.Example.com/en/x?q#f", "https://example.com", "http://a.net/es/", "http://net/fr/", "x://y", "no url", None, "", "http://", "http://É.com/en/", "http://example.com-x/en/", "http://com-a.com/", "http://a/b://c", "http://x.com?/en/", "http://u@x.net:80/es/", "http://a.b.example.com/en/\n", "http://..com/", "http://com./"]


def run(spark, urls, rules=None, **options):
    rows = [(i, x, "h", "p", "v", 1) for i, x in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id int, url string, host string, rule string, key string, bucket int")
    given = None if rules is None else spark.createDataFrame(rules, "verdict string, host string, path string")
    got = u.judge_urls(df, given, **options).collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(urls)))
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}


def test_stated_rules(spark):
    assert run(spark, URLS) == {i: judge(x, u.RULES) for i, x in enumerate(URLS)}


def test_nested_rules_over_many_buckets_and_a_hot_url(spark):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "c-d", "e"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(label() for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(80))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(400)] + ["http://a.b.c-d/a/b"] * 300
    assert run(spark, urls, rules, buckets=16, default="block") == {i: judge(x, rules, "block") for i, x in enumerate(urls)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert u.judge_urls(df).collect() == []
    assert run(spark, URLS, []) == {i: judge(x, []) for i, x in enumerate(URLS)}


def test_hosts_swept_by_path_above_one_another(spark):
    rng = random.Random(6)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    path = lambda: "".join(rng.choice(["/", "a", "b", "é", "\U0010ffff"]) for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), rng.choice(["", "/"]) + path()) for _ in range(300))}.values())
    urls = [f"http://{host()}/{path()}" for _ in range(500)] + ["http://a.b/aa"] * 200 + [None, "http://b", "x", "http://c.d/"]
    for held in (0, 3):
        assert run(spark, urls, rules, buckets=8, held=held) == {i: judge(x, rules) for i, x in enumerate(urls)}


def test_very_many_paths_of_one_host(spark):
    rng = random.Random(7)
    paths = sorted({"/" + "/".join(str(rng.randrange(200)) for _ in range(rng.randint(1, 4))) for _ in range(180_000)})
    assert len(paths) > 100_000
    rules = {p: ("block" if rng.random() < 0.5 else "allow") for p in paths}
    asked = [rng.choice(paths) + rng.choice(["", "7", "/x"]) for _ in range(3000)] + ["/hot/1"] * 2000
    df = spark.createDataFrame(list(enumerate("http://m.shop.org" + p for p in asked)), "page_id int, url string")
    table = spark.createDataFrame([(v, "shop.org", p) for p, v in rules.items()] + [("allow", "org", "/"), ("block", "m.shop.org", "/1")], "verdict string, host string, path string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in u.judge_urls(df, table).collect()}
    for i, p in enumerate(asked):
        fits = [(len("shop.org" + p[:n]), 8, "shop.org" + p[:n], rules[p[:n]]) for n in range(1, len(p) + 1) if p[:n] in rules]
        fits += [(4, 3, "org/", "allow")] + ([(12, 10, "m.shop.org/1", "block")] if p.startswith("/1") else [])
        assert got[i] == max(fits)[2:]
