from testfloor.llm import url_rules

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URLS = [
    "http://example.net/en/a",
    "http://Example.NET/en",
    "https://www.example.com/de/x?q=1",
    "http://notexample.com/de/x",
    "http://a.org/fr/#top",
    "example.net/en/",
    "",
    None,
    "http://a.net/" + "x" * 100_000,
    "http://a.net/",
    "http://a.net/",
]


def wanted(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for rule, _ in RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_rules_clashes_nulls_and_repeats(spark):
    rows = [(i, u, "own", "own") for i, u in enumerate(URLS)]
    urls = spark.createDataFrame(rows, "page_id long, url string, HOST string, Verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.verdicts(urls, RULES, []).collect()}
    action = dict(RULES)
    for i, url in enumerate(URLS):
        host, path, rule = wanted(url)
        assert got[i] == (host, path, rule, action.get(rule, "allow"))
    assert len(got) == len(URLS) and url_rules.verdicts(urls.limit(0), RULES, []).count() == 0


def test_thousands_of_rules(spark):
    rules = [(f"s{i}.example.com/p{i % 7}/", "block" if i % 2 else "allow") for i in range(3000)]
    urls = spark.range(6000).selectExpr("id page_id", "concat('http://www.s', id, '.example.com/p', id % 14, '/x') url")
    rows = url_rules.verdicts(urls, rules, [], default="none").collect()
    assert len(rows) == 6000
    for r in rows:
        fits = r.page_id < 3000 and r.page_id % 14 == r.page_id % 7
        assert r.verdict == (rules[r.page_id][1] if fits else "none")
