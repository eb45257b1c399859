from relyscope.llm import urls

PAGES = "page_id long, url string, html string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(rows)], PAGES)


def judged(url):
    """The rules, plainly: (host, path, rule, verdict or None)."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for mark in "?#":
            rest = rest.split(mark, 1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + tail
    fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit, key=lambda r: len(r[0]), default=(None, None)))


CASES = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://A.COM/x?y#z", "http://xcom/", "http://example.com/en/",
         "http://example.com/en", "http://www.example.com/en/1", "http://m.www.example.com/en/1", "http://b.net/es/1", "http://net/fr/",
         "http://net#/fr/", "ftp://É.NET/fr/é://x", "http://a.net/de/?q=/es/", "http://a.net?/es/", "http://" + "a" * 50_000 + ".com/",
         "http://a.com/#a?b", "http://a.com?b#c/d"]


def test_hosts_paths_and_rules(spark):
    got = urls.url_verdicts(pages(spark, CASES + CASES)).orderBy("page_id").collect()
    for r, url in zip(got, CASES + CASES):
        host, path, rule, verdict = judged(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert [r.verdict for r in got[:len(CASES)]] == [r.verdict for r in got[len(CASES):]]


def test_trees_learn_lexical_signs(spark):
    good = [f"http://site{i}.com/{'abc' * 3}/" for i in range(60)]
    bad = [f"http://x{i}.net/fr/{i:09d}/{i:09d}?a={i}&b={i}&c={i}" for i in range(60)]
    asked = ["http://other.org/abcabcabc/", "http://y.org/123456789/123456789?a=1&b=2&c=3"]
    got = urls.url_verdicts(pages(spark, good + bad + asked)).orderBy("page_id").collect()
    assert [r.verdict for r in got[-2:]] == ["allow", "block"]


def test_labels_of_one_kind_or_none(spark):
    assert {r.verdict for r in urls.url_verdicts(pages(spark, ["http://a.net/fr/", "http://q.org/"])).collect()} == {"block"}
    assert urls.url_verdicts(pages(spark, ["http://q.org/"])).first().verdict == "allow"
    assert urls.url_verdicts(pages(spark, [])).count() == 0
