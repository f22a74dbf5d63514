import math
import random
from collections import Counter, defaultdict

import pytest

from undertow.llm import extract

PAGES = "page_id bigint, url string, html string, host string, text string, node int, id string, blocks int"


@pytest.fixture
def run(spark):
    def texts(rows):
        frame = spark.createDataFrame([(*r, "h", "t", 1, "i", 2) for r in rows], PAGES)
        got = extract.extract(frame)
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        found = got.collect()
        assert all(r["n_chars"] == len(r["text"]) for r in found)
        return sorted(((r["page_id"], r["text"]) for r in found), key=str)

    return texts


def blocks(source):
    page = extract.Page(source)
    return [t for e, t in page.blocks if page.bound(e) != 0]


def test_blocks_are_closed_as_browsers_do():
    assert blocks("<p>a<p>b <i>c</i>\n d<ul><li>e<li>f<ul><li>g</ul><li>h</ul>i") == ["a", "b c d", "e", "f", "g", "h", "i"]
    assert blocks("<table><tr><td>a<td>b<tr><th>c</table><dl><dt>d<dd>e<dt>f</dl>") == ["a", "b", "c", "d", "e", "f"]
    assert blocks("<h1>a<h2>b</h2><p><b>c.<br><p>d</b><div>e<p>f</div>g") == ["a", "b", "c.", "d", "e", "f", "g"]
    assert blocks("a</p>b</div>c<br>d<hr>e<wbr>f") == ["abc d", "ef"]
    assert blocks("<head><title>t</title><meta x><p>a</p>") == ["a"]


def test_characters():
    assert blocks("<p>a &lt;b&gt; &amp;amp; &#233;&#xe9; &copy &nosuch; 1 < 2 &am</p>") == ["a <b> &amp; éé © &nosuch; 1 < 2 &am"]
    assert blocks("<p>\t a&nbsp;\n&#32; b 　</p><p> &nbsp;\n</p>") == ["a b"]
    assert blocks('<p title="a > b" data-x=\'>\'>c</p><a href="x>y">d</a>') == ["c", "d"]


def test_what_is_no_text():
    assert blocks("<script>var a = '</p><p>no';</script>a<style>p{}</style><textarea><p>x</textarea>b") == ["ab"]
    assert blocks("a<!-- <p>no</p> -->b<![CDATA[no]]>c<!doctype html><?php no ?>d") == ["abcd"]
    assert blocks("a<script>never closed <p>b") == ["a"]
    assert blocks("a<!-- never closed <p>b") == ["a"]
    assert blocks("<p>a</p><div class='x") == ["a"]
    assert blocks("") == blocks("<html></html>") == blocks("<") [1:] == []


def test_marks_of_the_page():
    page = (
        "<body class='has-sidebar'><form id=aspnet><header>H<nav>n</nav></header><div id='cookie-notice'>k</div><div class=wrap>near"
        "<article><header><h1>Title</h1></header><p>One <span class='ad-slot'>buy</span>two.<div class='adSlot'>ad</div><aside>s</aside>"
        "<form><p>Sign up</form><section class='comments'><article><p>First!</article></section><p>Three<button>x</button>.<footer>f</footer>"
        "</article><div class=sidebar>s</div></div></form><footer>&copy;</footer>"
    )
    assert blocks(page) == ["Title", "One two.", "Three."]
    assert blocks("<div class=adapted>a</div><div class=shareholders>b</div><div id=commentary>c</div>") == ["a", "b", "c"]
    assert blocks("<main><p>a</p><article>b</article></main>") == ["b"]
    assert blocks("<div data-class='ad'>a</div>") == ["a"]
    assert blocks("<div role=main>a<div role=navigation>n</div></div>c") == ["a"]


def test_repeated_branches_of_a_host_go(run):
    """Without marks: what all pages of a host share goes, what is their own stays, whatever other hosts hold."""
    shell = "<div class=top><a href=/>Home</a> <a>About</a></div><div class=body><h1>{0}</h1><p>{1}</p><p>Read on.</p></div><div>All rights reserved</div>"
    rows = [(i, "http://a.example/x", shell.format(f"Title {i}", f"Own words {i} " * i)) for i in range(30)]
    rows += [(100 + i, f"http://b{i}.example/", shell.format("T", "Read on.")) for i in range(3)]
    got = dict(run(rows))
    assert got[4] == "Title 4\nOwn words 4 Own words 4 Own words 4 Own words 4"
    assert got[101] == "Home About\nT\nRead on.\nRead on.\nAll rights reserved"


def test_marked_articles_stay_whole_however_often_they_occur(run):
    page = "<nav>a</nav><article><p>same</p><p>same</p><p>and more</p></article><p>outside</p>"
    assert run([(i, "http://a.example/", page) for i in range(12)]) == [(i, "same\nsame\nand more") for i in sorted(range(12), key=str)]


def test_rows_of_every_kind(run):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "no host", ""), (None, "http://a/", "<p>x"), (3, "HTTP://A/", "plain"), (3, "HTTP://A/", "plain")]
    rows += [(4, "http://c/", deep), (5, "http://d/", "<p>" + "long " * 200_000), (6, "http://d/", "<nav>n</nav>")]
    want = [(1, ""), (2, ""), (None, "x"), (3, "plain"), (3, "plain"), (4, "deep"), (5, ("long " * 200_000).strip()), (6, "")]
    assert run(rows) == sorted(want, key=str)
    assert run([]) == []


def test_importance_agrees_with_trees_in_memory(spark):
    """Entropies and composites of whole hosts, computed page by page without Spark."""
    random.seed(4)
    parts = ["<p>one</p>", "<p>two</p>", "<div><p>three</p><p>{i}</p></div>", "<nav><ul><li>m</ul></nav>", "text {i}", "<div class=b><div>x{j}</div></div>"]
    rows = []
    for i in range(40):
        body = "".join(random.choice(parts).format(i=i, j=i % 5) for _ in range(random.randrange(6)))
        rows.append((i, f"http://h{i % 3}.example/", body + ("<article>marked</article>" if i % 7 == 0 else "")))
    nodes, marks, depth = defaultdict(Counter), defaultdict(Counter), {}
    for i, url, source in rows:
        found, said, _ = extract.page_rows(source.encode())
        name = url[7:-1]
        for s in found:
            key = (name, s["node"])
            nodes[key][s["style"]] += s["n"]
            depth[key] = (s["depth"], s["up"], s["bound"])
            nodes[key, "pages"][0] += s["first"]
        for m in said:
            marks[name, m["node"]][m["mark"]] += m["n"]
            marks[name, m["node"], m["mark"]][i] += m["n"]
    keys = sorted(depth, key=lambda k: -depth[k][0])
    entropy = lambda c, most: 0.0 if most < 2 else min(1.0, -sum(n / c.total() * math.log(n / c.total()) for n in c.values()) / math.log(most))
    contents, importance, best = {}, {}, {}
    for host, node in keys:
        for mark in marks[host, node]:
            bound = depth[host, node][2]
            contents[host, node, mark] = 1 - entropy(marks[host, node, mark], nodes[(host, node), "pages"][0]) if bound is None else bound
    for host, node in keys:
        level, _, bound = depth[host, node]
        below = [k for k in keys if k[0] == host and depth[k][1] == node]
        own = [contents[host, node, m] for m in marks[host, node]]
        blocks_ = marks[host, node].total()
        parts_ = sum(nodes[k].total() for k in below) + blocks_
        lower = sum(nodes[k].total() * importance[k] for k in below) + (sum(own) / len(own) * blocks_ if own else 0)
        n = nodes[host, node].total()
        weight = extract.DECAY ** len(nodes[host, node])
        shown = 1.0 if n == 1 else entropy(nodes[host, node], n)
        value = (1 - weight) * shown + (weight * lower / parts_ if parts_ else 0)
        importance[host, node] = value if bound is None else float(bound)
        best[host, node] = 0.0 if bound == 0 else max([importance[host, node], *(best[k] for k in below)])
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    from pyspark.sql import functions as F

    picked = frame.select(F.monotonically_increasing_id().alias("id"), F.struct(F.col("page_id").alias("key"), "url").alias("row"), extract.host(F.col("url")).alias("host"), "html")
    tree, found = extract.style_tree(extract.doms(picked))
    got = {(r["host"], r["node"]): (r["importance"], r["best"]) for r in tree.collect()}
    assert set(got) == set(keys)
    for k in keys:
        assert got[k] == pytest.approx((importance[k], best[k])), depth[k]
    assert {(r["host"], r["node"], r["mark"]): r["importance"] for r in found.collect()} == pytest.approx(contents)


def test_each_style_of_a_branch_is_one_mean(spark):
    """By style: a branch's lower part weighs the mean of every style with how often the style occurs, computed without Spark."""
    random.seed(9)
    parts = ["<p>one</p>", "<p>two {i}</p>", "<div><p>three</p><p>{i}</p></div>", "text {j}", "<ul><li>a<li>b {i}<li>c</ul>"]
    bodies = ["".join(random.choice(parts).format(i=i, j=i % 3) for _ in range(random.choice([0, 1, 1, 9]))) for i in range(40)]
    bodies[0] = "<nav>n</nav><p>one</p>"
    count, up, inside, blocks, said, pages = Counter(), {}, defaultdict(Counter), Counter(), defaultdict(Counter), Counter()
    name = lambda e: (e.path, page.bound(e))
    for i, source in enumerate(bodies):
        page = extract.Page(source)
        for e in page.elements:
            count[name(e), tuple(e.children)] += 1
            if e.up is not None:
                up[name(e)] = name(e.up)
                inside[name(e.up), tuple(e.up.children)][name(e)] += 1
        pages.update({name(e) for e in page.elements})
        for e, text in page.blocks:
            blocks[name(e), tuple(e.children)] += 1
            said[name(e), text][i] += 1
    entropy = lambda c, most: 0.0 if most < 2 else min(1.0, -sum(n / sum(c) * math.log(n / sum(c)) for n in c) / math.log(most))
    importance = {}
    for node in sorted({n for n, _ in count}, key=lambda n: -n[0].count("/")):
        own = [1 - entropy(c.values(), pages[node]) for (n, _), c in said.items() if n == node]
        styles = {s: n for (m, s), n in count.items() if m == node}
        lower = 0.0
        for style, n in styles.items():
            found, k = inside[node, style], inside[node, style].total() + blocks[node, style]
            total = sum(importance[c] * m for c, m in found.items()) + (sum(own) / len(own) * blocks[node, style] if own else 0)
            lower += n * (total / k if k else 0) / sum(styles.values())
        weight = extract.DECAY ** len(styles)
        shown = 1.0 if sum(styles.values()) == 1 else entropy(styles.values(), sum(styles.values()))
        importance[node] = (1 - weight) * shown + weight * lower if node[1] is None else float(node[1])
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(list(enumerate(bodies)), "page_id bigint, html string")
    picked = frame.select(F.monotonically_increasing_id().alias("id"), F.struct("page_id").alias("row"), F.lit("h").alias("host"), "html")
    dom = extract.doms(picked)
    tree = {r["node"]: r["importance"] for r in extract.style_tree(dom, by_style=True)[0].collect()}
    assert tree == pytest.approx({extract.signed("|".join(map(str, n))): v for n, v in importance.items()})
    assert tree != pytest.approx({r["node"]: r["importance"] for r in extract.style_tree(dom)[0].collect()})
