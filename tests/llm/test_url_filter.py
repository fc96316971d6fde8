from chronolake.llm import url_filter


def test_precedence_and_odd_urls(spark):
    rows = [
        (1, "https://Blog.Example.NET/en/1?x=/de/", "example.net/en/", "allow"),
        (2, "http://example.net/fr/2", "net/", "block"),
        (3, "http://example.net", None, "allow"),  # an empty path doesn't start with /
        (4, "https://a.b.example.com/de/#top", "example.com/de/", "block"),
        (5, "https://notexample.com/de/", None, "allow"),
        (6, "no scheme example.net/", None, "allow"),
        (7, None, None, "allow"),
        (8, "https://x.org/fr/", "org/fr/", "allow"),
        (8, "https://x.org/fr/", "org/fr/", "allow"),
        (9, "https://net/?q", "net/", "block"),
        (10, "https://x.net:80/", None, "allow"),
        (None, "ftp://ÀB.NET//", "net/", "block"),
        (11, "http://ANET" + ".x" * 3000 + ".net/" + "y" * 9000, "net/", "block"),
    ]
    pages = spark.createDataFrame([(a, b, "html", "r") for a, b, _, _ in rows], "page_id long, url string, html string, rule string")
    out = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    key = lambda r: (r[0] or 0, str(r[1]))
    assert sorted(((r.page_id, r.rule, r.verdict) for r in out), key=key) == sorted(((a, c, d) for a, _, c, d in rows), key=key)
    assert {r.page_id: r.host for r in out}[None] == "Àb.net"


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, [])).collect()] == [(1, "a.net", "/", None, "allow")]
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_general_path_prefixes(spark):
    rules = url_filter.rule_table(spark, [("b.c", "/x", "block"), ("a.b.c", "/xy", "allow"), ("c", "/xyz1", "block")])
    urls = ["http://a.b.c/xyz", "http://b.c/xyz12", "http://q.a.b.c/xyz1", "http://c/xyz1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {0: "a.b.c/xy", 1: "c/xyz1", 2: "a.b.c/xy", 3: "c/xyz1"}
