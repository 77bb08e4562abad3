"""URL verdicts: rules, boundaries, weights and odd tables."""

import re
from urllib.parse import urlsplit

from siftframe.llm import urls
from siftframe.llm.queries import URL_RULES

VOCABULARY = {"casino": 4, "free": 2, "bets": 2, "bet": 2, "pills": 2, "Ads": 2, "win": 1}


def judged(spark, rows, rules=URL_RULES, vocabulary=VOCABULARY):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    return [r.asDict() for r in urls.judge(df, rules, vocabulary).orderBy("page_id").collect()]


def test_rules(spark):
    got = judged(
        spark,
        [
            "https://A.Example.ORG/es/9?x=/en/", "https://example.org/en/10", "https://example.org/en/20", "http://badexample.org/es/1",
            "http://org", "http://org/", "https://m.shop.com/fr/casino", "https://m.shop.com/de/", "https://com/de/x", "https://shop.com.au/de/", "https://x.org#/y",
        ],
    )
    want = [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"),
        (None, "allow"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("com/de/", "block"), (None, "allow"), (None, "allow"),
    ]
    assert [(r["rule"], r["verdict"]) for r in got] == want
    assert got[0]["host"] == "a.example.org" and got[0]["path"] == "/es/9" and got[10]["path"] == ""


def test_vocabulary_and_boundaries(spark):
    cases = {
        "https://casino-x.net/": ("block", "casino"),
        "https://CASINO24.net/": ("block", "casino"),
        "https://casinos.net/": ("allow", ""),
        "https://free.net/bets": ("block", "bets free"),
        "https://free.net/free/FREE": ("allow", "free"),
        "https://alphabets.net/free": ("allow", "free"),
        "https://x.net/?q=bet&w=win-win": ("allow", "bet win"),
        "https://x.net/bets#ads": ("block", "ads bets"),
        "no scheme, free pills": ("block", "free pills"),
        "": ("allow", ""),
    }
    got = judged(spark, list(cases))
    assert {u: (r["verdict"], r["terms"]) for u, r in zip(cases, got)} == cases
    assert all((r["weight"] >= urls.LIMIT) == (r["verdict"] == "block") for r in got)


def test_automaton_against_patterns():
    judge = urls.Judge([], urls.VOCABULARY)
    texts = [f"http://{a}{x}{b}{y}.com/{z}" for a in ("", "a", "ads-") for x in ("bets", "sex", "spam") for b in ("", "-", "9", "é") for y in ("ads", "free", "best") for z in ("track", "tracks", "")]
    for text in texts:
        want = {t for t in urls.VOCABULARY if re.search(rf"(?<![a-z]){t}(?![a-z])", text)}
        assert set(judge.terms(text)) == want


def test_longest_rule_wins_whatever_the_order():
    rules = [urls.Rule.parse("block", "b.net/"), urls.Rule.parse("allow", "a.b.net/"), urls.Rule.parse("block", "b.net/xy"), urls.Rule.parse("allow", "net")]
    for order in (rules, rules[::-1]):
        judge = urls.Judge(order, {})
        found = {u: judge.rule(urlsplit(u).netloc, urlsplit(u).path) for u in ("http://a.b.net/x", "http://a.b.net/xy", "http://c.b.net/xyz", "http://c.net", "http://net.org/")}
        assert [r and r.host + r.path for r in found.values()] == ["a.b.net/", "a.b.net/", "b.net/xy", "net", None]


def test_odd_tables(spark):
    schema = "page_id long, url string, verdict int, judged string, path string"
    df = spark.createDataFrame([(1, None, 5, "j", "p"), (1, None, 5, "j", "p"), (None, "x://" + "a" * 200000 + "/spam", 1, None, None)], schema)
    out = urls.judge(df, URL_RULES)
    assert out.columns == ["page_id", "url", "judged", "host", "path", "rule", "verdict", "weight", "terms"]
    rows = out.collect()
    assert [(r["verdict"], r["host"] == "", r["judged"]) for r in rows] == [("allow", True, "j"), ("allow", True, "j"), ("block", False, None)]
    assert urls.judge(df.limit(0), URL_RULES).count() == 0
    assert urls.judge(df, [], {}).where("verdict = 'block'").count() == 0
