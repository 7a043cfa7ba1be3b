"""Exclusion rules over tables of urls, and what the scraper leaves out."""

import random

from lodestone.operators import robots as RB
from lodestone.sources import files

PAGES = "page_id bigint, url string, html string, robots_rule string, content string"


def verdicts(spark, urls, sites, agent=RB.AGENT):
    pages = spark.createDataFrame([(i, u, "<p>x</p>", "clash", "clash") for i, u in enumerate(urls)], PAGES)
    got = RB.judge(pages, spark.createDataFrame(sites, "origin string, content string"), agent).orderBy("page_id").collect()
    assert [r.page_id for r in got] == list(range(len(urls)))
    assert {r.content for r in got} <= {"clash"}
    return [(r.robots_allowed, r.robots_rule) for r in got]


def test_groups_and_prefixes(spark):
    sites = [
        ("http://A.example", "# c\nUser-agent: *\nDisallow: /all\nUser-Agent: other\nDisallow: /other\nuser-agent: LODESTONE-ingestion\n disallow:  /own \nDisallow: /own/deep\nDisallow:\n"),
        ("http://b.example", "User-agent: *\r\nDisallow: /x\r\nUser-agent: lodestone-ingestion\r\nDisallow:\r\n"),
        ("http://c.example", None), ("http://d.example", ""), ("https://a.example", "User-agent: *\nDisallow: /"),
        ("http://a.example", "Disallow: /stray\nUser-agent: lodestone-ingestion\nDisallow: /more\n"),
    ]
    urls = {
        "http://a.example/own": (False, "/own"), "http://a.example/own/deeper?x": (False, "/own/deep"), "http://a.example/all": (True, None), "http://a.example/other": (True, None),
        "http://a.example/ow": (True, None), "HTTP://A.EXAMPLE/own#y": (False, "/own"), "http://a.example/more/1": (False, "/more"), "http://a.example/stray": (True, None),
        # An agent's group without rules leaves those for all in force.
        "http://b.example/xy": (False, "/x"), "http://b.example": (True, None), "http://c.example/x": (None, None), "http://d.example/x": (True, None), "http://e.example/x": (None, None),
        "https://a.example": (False, "/"), "https://a.example?q=1": (False, "/"), "": (None, None), None: (None, None), "no scheme": (None, None), "http://b.example/y;/x": (True, None), "http://b.example/a/;b": (True, None),
    }
    assert verdicts(spark, list(urls), sites) == list(urls.values())


def test_empty_tables(spark):
    assert verdicts(spark, [], []) == []
    assert verdicts(spark, ["http://a.example/x"], []) == [(None, None)]


def test_many_rules_equal_a_loop(spark):
    r = random.Random(4)
    word = lambda: "/" + "".join(r.choice("ab") for _ in range(r.randint(1, 7)))
    rules = {f"http://s{i}.example": [word() for _ in range(60 * (i == 0) + 3)] for i in range(4)}
    urls = [f"http://s{r.choice((0, 0, 1, 2, 3))}.example{word()}{word()}" for _ in range(400)] + [f"http://s1.example/{'a' * 20_000}"]
    want = []
    for u in urls:
        site, path = u[: u.index("example") + 7], u[u.index("example") + 7 :]
        hit = [p for p in rules[site] if path.startswith(p)]
        want.append((not hit, max(hit, key=len) if hit else None))
    sites = [(o, "\n".join(["User-agent: *", *(f"Disallow: {p}" for p in ps)])) for o, ps in rules.items()]
    assert verdicts(spark, urls, sites) == want


def test_scrape_leaves_out_forbidden_and_large_pages(spark):
    html = "<title>t</title><p>é</p>"
    size = len(html.encode())
    pages = spark.createDataFrame([(1, "http://a.example/ok", html), (2, "http://a.example/no/1", html), (3, "http://b.example/no", html), (4, "http://b.example/large", html + "x"), (5, "http://b.example/null", None)], "page_id bigint, url string, html string")
    robots = spark.createDataFrame([("http://a.example", "User-agent: *\nDisallow: /no")], "origin string, content string")
    assert sorted(r.page_id for r in files.scrape(pages, robots, size).collect()) == [1, 3, 5]
    assert sorted(r.page_id for r in files.scrape(pages).collect()) == [1, 2, 3, 4, 5]
