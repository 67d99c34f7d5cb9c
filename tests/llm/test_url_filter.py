"""Rules on URLs, fetched by token, against all rules tried on every URL."""

import re

import numpy as np
import pytest

from corpusmill.llm import url_filter
from corpusmill.llm.url_filter import UrlFilter


def plain_regex(pattern):
    text = low(pattern.removeprefix("@@"))
    begin = r"\A[^:/?#]*://(?:[^/?#]*\.)?" if text.startswith("||") else r"\A" if text.startswith("|") else ""
    text = text.removeprefix("||") if text.startswith("||") else text.removeprefix("|")
    end = r"\Z" if text.endswith("|") else ""
    out = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}
    return re.compile(begin + "".join(out.get(c, re.escape(c)) for c in text.removesuffix("|")) + end, re.S)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(url, addresses, patterns):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path, host = re.match("[^?#]*", rest[len(host) :])[0], low(host)
    fits = [(len(h + p), len(h), b, low(h) + p) for h, p, b in addresses if h is not None and p is not None and (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    hit = lambda sort: any(plain_regex(p).search(low(url or "")) for p in patterns if p is not None and p.startswith("@@") == sort)
    best = max(fits) if fits else None
    blocked = best[2] if best else hit(False) and not hit(True)
    return host, path, best and best[3], "block" if blocked else "allow"


ADDRESSES = [*url_filter.ADDRESSES, ("Example.net", "/a/b/", True), ("example.net", "/a/b/", False), ("net", "/a/b/c", False), ("x.y.example.net", "", True), (None, "/", True), ("org", None, True), ("", "/empty", True)]
PATTERNS = [*url_filter.PATTERNS, "a*b*zz/", "^en^q", "ad^x", "||m.q", "|http://blog.q", "(x)[y]{2}+$|", "?utm_source=spam|", "É-ads-", None, "||EXAMPLE.net/ban", "@@safe", "\\back.slash", "a|b/c"]
URLS = [
    None, "", "no host", "://", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "https://a.b.example.org/en/1", "https://example.org", "http://org/", "http://borg/x", "http://sub.com/fr/..?q=/de/", "http://com/de/",
    "http://example.net/a/b/", "http://example.net/a/b/c", "http://q.x.y.example.net?host", "http://x.y.example.net#f", "ftp://host/file", "http://h/file.EXE", "http://h/file.exe?x", "http://cdn.docs.site/casino-guide",
    "http://casino-x.example.net/", "http://h/?a=1&affid=3", "http://h/xaffid=3", "http://h/?sessionid=2&b=1&phpsessid=3", "http://h/wp-login.php", "http://h/wp-login.phpx", "http://h/wp-login.php?x&ref=editorial", "http://h/wp-login.php?ref=editorial1",
    "http://h/(x)[y]{2}+$", "http://h/(x)[y]{2}+$z", "http://h/é-ads-1", "http://h/É-ads-1", "http://h/\\back.slash", "http://h/\\backxslash", "http://h/a|b/c", "http://h/a1b2zz/", "http://h/new\nline/wp-login.php\n", "http://" + "a." * 3000 + "com/de/", "http://h/" + "x/" * 20000 + "cgi-bin/", "http:///empty", "http://example.net/banned", "a://b://casino-c.example.d",
]


def rules(spark, addresses, patterns):
    return spark.createDataFrame(addresses, "host string, path string, blocks boolean"), spark.createDataFrame([(p,) for p in patterns], "pattern string")


@pytest.mark.parametrize("most", [url_filter.MOST_RULES, 12, 0])
def test_verdicts_equal_all_rules_tried(spark, most):
    """With rules that tasks hold, with some of them joined, and with all of them joined; with clashing names."""
    urls = URLS + URLS[:8]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "0 as host", "1 as keys", "2 as r", "3 as at", "4 as more", "5 as verdict", "6 as row", "7 as key")
    judge = UrlFilter(*rules(spark, ADDRESSES, PATTERNS), df, most=most)
    got = judge.judge(df).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in got] == [(u, *plain(u, ADDRESSES, PATTERNS)) for u in urls]
    assert {"keys", "row", "more"} <= set(got[0].asDict()) and judge.judge(df.limit(0)).count() == 0


def test_random_patterns_and_urls(spark):
    chance = np.random.default_rng(4)
    pick = lambda letters, n: "".join(chance.choice(list(letters), n))
    patterns = [("@@" if k % 5 == 0 else "") + ["", "|", "||"][k % 3] + pick("ab1./-*^", chance.integers(1, 9)) + ["", "|"][k % 2] for k in range(120)]
    urls = ["ab://" + pick("ab1./-?", chance.integers(1, 25)) for _ in range(400)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    for some in (patterns, [p for p in patterns if len(p.strip("@|*^")) > 4], []):
        got = UrlFilter(*rules(spark, [("ab", "/", False)], some), df).judge(df).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [plain(u, [("ab", "/", False)], some) for u in urls]


def test_a_pattern_is_indexed_by_its_rarest_whole_token(spark):
    patterns = ["||common.rare^", "half*rare^", "/only/", "*", "||start", "@@/common/x1/"]
    urls = spark.createDataFrame([("http://common.rare/",), ("http://common.org/common/",), ("http://x/only/half",)], "url string")
    judge = UrlFilter(*rules(spark, [], patterns), urls)
    assert sorted((r["key"], r["blocks"]) for r in judge.rules.collect()) == [("t:", True)] * 3 + [("t:only", True), ("t:rare", True)]


def test_many_rules_under_one_key_and_hostile_urls(spark):
    addresses = [("com", f"/s{k}/", k % 2 == 0) for k in range(3000)]
    urls = spark.createDataFrame([(k, f"http://h{k}.com/s{k}/x") for k in range(3000)] + [(5000, "http://h/" + "ab-" * 100_000)], "page_id long, url string")
    for most in (url_filter.MOST_RULES, 100):
        got = UrlFilter(*rules(spark, addresses, ["a*b*c*d^"]), urls, most=most).judge(urls).where("page_id < 5000").collect()
        assert len(got) == 3000 and all(r.rule == f"com/s{r.page_id}/" and r.verdict == ("block" if r.page_id % 2 == 0 else "allow") for r in got)
