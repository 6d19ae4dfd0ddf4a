"""URL rules against a plain reading of them."""

import random

import pytest

from cytogrid.llm import urls


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min([rest.index(c, cut) for c in "?#" if c in rest[cut:]], default=len(rest))
        path = rest[cut:end]
    fits = [
        (rule, verdict)
        for rule, verdict in urls.RULES
        for h, p in [rule.split("/", 1)]
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p)
    ]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_are_judged(spark):
    rng = random.Random(2)
    hosts = ["example.net", "a.example.net", "notexample.net", "net", "example.com", "x.y.example.com", "Foo.ORG", "org", ".net", "a.net:80", "é.net"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/FR/", "/a/b.net/", "/fr/" + "y" * 300, "/" + "z" * 100_000]
    tails = ["", "?q=http://x.net/", "#f", "?"]
    known = [None, "", "no scheme", "http://", "a://b://c.net/", "x:///p", "HTTP://Example.COM/de/", "http://u@example.net/en/"]
    made = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(300)]
    rows = list(enumerate(known + made)) + [(5, "http://a.net/"), (None, "http://a.net/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    found = urls.filter_urls(pages).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(((i, *plain(u)) for i, u in rows), key=key)
    assert urls.filter_urls(pages.where("false")).count() == 0


def test_many_globs_span_words():
    globs = [b".*.%d.example.com/**" % i for i in range(40)] + [b"/a*c/d", b"/a**d"]
    automaton = urls.Automaton(globs)
    assert automaton.words > 5
    texts = [b".x.7.example.com/q", b".x.39.example.com/", b".x/7.example.com/", b"/abbc/d", b"/ab/c/d", b"", b"/ad"]
    fits = [[i for i, y in enumerate(row) if y] for row in automaton.run(texts)]
    assert fits == [[7], [39], [], [40, 41], [41], [], [41]]


def test_bad_rules(spark):
    with pytest.raises(ValueError):
        urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules=(("net", "block"),))
