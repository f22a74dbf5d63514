from undertow.llm import urls
from undertow.llm.queries import URL_RULES

PAGES = [
    (1, "http://WWW.Example.com/en/a?x#y", None),
    (2, "http://m.example.com/en/b", ""),
    (3, "http://m.example.com/fr", '<link rel="canonical" href="http://m.example.com/en/b">'),
    (4, "https://free.org/x", "<LINK href='/y' REL=canonical>"),
    (5, "https://free.org/y#part", '<meta http-equiv="refresh" content="0; url=http://a.net/fr/1">'),
    (6, "https://free.org/z", '<link rel="stylesheet" href="http://a.net/fr/1">'),
    (7, None, "<link rel=canonical href=http://a.net/fr/1>"),
    (8, "nothing", None),
    (9, "//a.net/fr/", None),
    (10, "ftp://a.NET?q", None),
    (11, "http://www.example.com/en/q", '<link rel=canonical href="//a.net/fr/1">'),
    (11, "http://www.example.com/en/q", '<link rel=canonical href="//a.net/fr/1">'),
    (12, "https://free.org/d/e.html", "<link rel=canonical href=x>"),
    (13, "HTTPS://FREE.org/d/x", None),
    (None, "http://net/es/", None),
]
WANT = {
    (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    (2, "m.example.com", "/en/b", "example.com/en/", "block"),
    (3, "m.example.com", "/fr", None, "allow"),
    (4, "free.org", "/x", None, "block"),
    (5, "free.org", "/y", None, "block"),
    (6, "free.org", "/z", None, "allow"),
    (7, "", "", None, "allow"),
    (8, "", "", None, "allow"),
    (9, "", "", None, "allow"),
    (10, "a.net", "", None, "allow"),
    (11, "www.example.com", "/en/q", "www.example.com/en/", "allow"),
    (12, "free.org", "/d/e.html", None, "allow"),
    (13, "free.org", "/d/x", None, "allow"),
    (None, "net", "/es/", "net/es/", "block"),
}


def test_rules_and_links(spark):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    pages = spark.createDataFrame([(*p, 1, "r") for p in PAGES], "page_id bigint, url string, html string, u int, rule string")
    got = urls.judge(pages, rules).collect()
    # /fr on a .com host has no path rule of its own under "com/": it begins with "/".
    want = {(*w[:3], "com/", w[4]) if w[0] == 3 else w for w in WANT}
    assert len(got) == len(PAGES)
    assert {tuple(r) for r in got} == want
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_links_of_a_table_carry_blocks(spark):
    rules = spark.createDataFrame([("bad", "/", "block"), ("good", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://h{i}/", None) for i in range(30)] + [(99, "http://good/", None)], "page_id int, url string, html string")
    hops = [(f"http://h{i}/", f"http://h{i + 1}/") for i in range(20)] + [("http://h20/", "http://bad/"), ("http://good/", "http://h0/")]
    more = spark.createDataFrame(hops + [(None, "http://h29/"), ("http://h28/", None)], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, more).collect()}
    assert got == {**{i: "block" if i <= 20 else "allow" for i in range(30)}, 99: "allow"}
