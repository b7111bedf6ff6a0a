import itertools

import pyspark.sql.functions as F

from scanloom.llm import urlrules
from scanloom.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host int, path int, rule int, tokens string, verdict string, _row int, _token int, items int, mined int"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, 1, 2, 3, "t", "v", 4, 5, 6, 7) for i, u in urls], SCHEMA)


def tokens_of(host, path, rest):
    import re
    return sorted({m + t for m, part in (("h:", host), ("p:", path), ("q:", rest)) for t in re.split(r"[\W_]+", part.lower()) if t})


def split(url):
    import re
    if url is None or "://" not in url:
        return "", "", ""
    host, path, rest = re.match(r"(?s)([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, rest


def brute(urls, support=0.01, confidence=0.9):
    rows, taught = [], []
    for i, u in urls:
        host, path, rest = split(u)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        toks = tokens_of(host, path, rest)
        rows.append((i, host, path, rule, toks))
        if rule and toks:
            taught.append((frozenset(toks), rule.verdict))
    least = max(1, support * len(taught))
    one = {}
    for t, _ in taught:
        for x in t:
            one[x] = one.get(x, 0) + 1
    all_, of = {}, {}
    for t, c in taught:
        often = sorted(x for x in t if one[x] >= least)
        for k in range(1, len(often) + 1):
            for s in itertools.combinations(often, k):
                all_[s] = all_.get(s, 0) + 1
                of[s, c] = of.get((s, c), 0) + 1
    rules = {k: n / all_[k[0]] for k, n in of.items() if n >= least and n / all_[k[0]] >= confidence}
    kept = {(s, c): f for (s, c), f in rules.items() if not any(rules.get((s[:j] + s[j + 1:], c), -1) >= f for j in range(len(s)))}
    out = []
    for i, host, path, rule, toks in rows:
        if rule:
            out.append((i, host, path, rule.text, rule.verdict))
        else:
            best = min(((-f, -of[s, c], len(s), s, c) for (s, c), f in kept.items() if set(s) <= set(toks)), default=None)
            out.append((i, host, path, None, best[-1] if best else "allow"))
    return sorted(out, key=repr)


def got(spark, urls):
    df = urlrules.filter_urls(pages(spark, urls), URL_RULES)
    assert df.columns == ["page_id", "host", "path", "rule", "verdict", "mined"]
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


ODD = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (None, "https://x.NET/es/1"), (5, "https://example.com/en/1"), (5, "https://example.com/en/1"),
       (6, "https://a.www.Example.com/en/x?y#z"), (7, "https://www.example.com/fr/"), (8, "https://com"), (9, "https://notexample.com/en/"), (10, "://net/fr/://com/"),
       (11, "https://example.org/en/" + "z" * 100_000), (12, "https://example.org?en/"), (13, "https://ÄB.example.net/es/İ\n?q"), (14, "ftp://example.com#/en/")]


def test_odd_urls(spark):
    assert got(spark, ODD) == brute(ODD)
    assert got(spark, [(1, None), (2, "")]) == [(1, "", "", None, "allow"), (2, "", "", None, "allow")]
    assert got(spark, []) == []


def test_mined_rules_against_every_subset(spark):
    import random
    r = random.Random(3)
    urls = [(i, f"http{'s' * r.randint(0, 1)}://{r.choice(['www.', 'm.', ''])}{r.choice(['a', 'b', 'casino'])}.example.{r.choice(['com', 'net', 'org'])}"
                f"/{r.choice(['en', 'es', 'fr', 'de'])}/{r.randint(1, 90)}{r.choice(['', '.html', '?page=2', '#top'])}") for i in range(900)]
    want = brute(urls + ODD)
    assert got(spark, urls + ODD) == want
    assert {x[4] for x in want if x[3] is None} == {"allow", "block"}


def test_given_labels_and_pruning(spark):
    labels = spark.createDataFrame([(f"http://spam.example.org/{i % 7}/win", "block") for i in range(60)] + [(f"http://good.example.org/{i % 7}/read", "allow") for i in range(60)]
                                   + [(None, "block"), ("http://x.org/a", None)], "url string, verdict string")
    found = urlrules.filter_urls(pages(spark, [(1, "http://spam.example.org/1/read"), (2, "http://q.example.org/win"), (3, "http://none.test/"), (4, "http://good.example.net/9")]), [], labels)
    assert {r.page_id: r.verdict for r in found.collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}  # 1: h:spam and p:read are as good, the smaller decides
    toks = urlrules.url_tokens(*urlrules.host_path(F.col("url")))
    rules = urlrules.mine(labels.select(toks.alias("tokens"), "verdict"))
    assert all(len(r.tokens) == 1 for r in rules.collect()), "longer combinations add nothing here"
    assert "pythonudf" not in urlrules.match(labels.select("url", toks.alias("tokens")), rules)._jdf.queryExecution().toString().lower()
