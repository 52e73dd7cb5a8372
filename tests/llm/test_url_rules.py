import re

import oracle
import pytest
from agrispark.llm import url_rules
from agrispark.llm.oracles import ORACLES

URLS = [
    "http://a.net/x", "http://a.net", "http://NET/", "http://planet/x", "https://www.EXAMPLE.net/en/3?x=1#y", "https://example.net/EN/3", "http://x.org/fr/",
    "http://x.org/fr", "http://org/fr/z", "ftp://casino.com/", "http://casino-film.com/casino", "http://mycasino.com/", "http://x.com/?q=casino", "casino",
    "http://adult-x.example.com/", "http://adult-education.com/", "http://x.com/adult-", "http://x.com/payday-loans", "http://x.com/banner-ads/1.gif",
    "http://x.com/banner-ads/1.gif?x", "http://x.com:80/://casino", "://", "", "http://é.net/é", "http://x.com/\ncasino\n", None, "http://x.com/%20(a|b)*", "http://v1agra.com/",
]


def plain(pattern: str) -> str:
    """A pattern as an expression of another engine."""
    p = pattern.lower()
    head = r"\A[^/?#]*://(?:[^/?#]*\.)?" if p.startswith("||") else r"\A" if p.startswith("|") else ""
    tail = r"\Z" if p.endswith("|") and len(p) > 1 else ""
    p = re.sub(r"\A\|\|?|\|\Z", "", p)
    return "(?s)" + head + "".join(".*" if c == "*" else r"(?:[^a-z0-9]|\A|\Z)" if c == "^" else re.escape(c) for c in p) + tail


def brute(url, sites, patterns):
    text = url or ""
    found = re.search(r"://([^/?#]*)([^?#]*)", text)
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    host, path = (lower(found[1]), found[2]) if found else ("", "")
    fit = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in sites if found and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[3], max(fit)[4], None
    fit = [(v != "allow", -len(p), p, v) for p, v in patterns if url is not None and re.search(plain(p), lower(text))]
    return (host, path, None, min(fit)[3], min(fit)[2]) if fit else (host, path, None, "allow", None)


@pytest.mark.parametrize("most", ["10m", "-1"])  # broadcast, and shuffled by token and salt
def test_brute_force(spark, most):
    patterns = [*url_rules.PATTERNS, ("v1agra", "block"), ("*a|b)*", "block"), ("|ftp:", "allow"), ("\\", "block"), ("|", "allow")]
    rules = url_rules.site_rules(spark.createDataFrame(url_rules.SITES, "host string, path string, verdict string"))
    rules = rules.unionByName(url_rules.pattern_rules(spark.createDataFrame(patterns, "pattern string, verdict string")))
    rows = [(u, i, "old", "old") for i, u in enumerate([*URLS, *URLS])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        got = {r.i: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in url_rules.judge(spark.createDataFrame(rows, "url string, i int, rule string, token string"), rules).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(rows)
    for url, i, _, _ in rows:
        assert got[i] == brute(url, url_rules.SITES, patterns), url


def test_rarest_token_is_the_key(spark):
    urls = spark.createDataFrame([("http://free.com/",), ("http://free.com/a",), ("http://free-bets.com/",), (None,)], "url string")
    rules = url_rules.pattern_rules(spark.createDataFrame([("^free-bets^", "block"), ("free", "block"), ("^none^free^", "block"), (None, "block")], "pattern string, verdict string"))
    got = {r.rule: r.token for r in url_rules.token_index(rules, urls).collect()}
    assert got == {"^free-bets^": "bets", "free": "", "^none^free^": "none", None: ""}


def test_empty_tables(spark):
    urls = spark.createDataFrame([(1, "http://casino.net/")], "page_id long, url string")
    assert [r.verdict for r in url_rules.judge(urls, url_rules.default_rules(spark).limit(0)).collect()] == ["allow"]
    assert url_rules.judge(urls.limit(0), url_rules.default_rules(spark)).count() == 0


def test_native_and_sql(spark):
    sf = f"{oracle.DATA}/sf0.01"
    out = url_rules.op13_url_filter(spark, sf)
    plan = out._jdf.queryExecution().toString()
    rules = url_rules.default_rules(spark)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|CartesianProduct|NestedLoop", plan + rules)
    assert oracle.same(out, oracle.connect(sf), ORACLES["op13_url_filter"]) == ""
