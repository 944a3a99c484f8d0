"""Url rules against SQL and plain Python, and main text of pages."""

import html
import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tillcast.llm import htmltext, queries, urlfilter

from .conftest import SF


def test_url_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(map(str, con.sql(queries.ORACLES["op3_url_filter"]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES["op3_url_filter"](spark, SF).collect()) == want


def judge_twin(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = re.match(r"[^?#]*", url.split("://", 1)[1])[0]
        host, _, tail = rest.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = "/" + tail if "/" in rest else ""
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


URLS = [None, "", "no scheme.org/", "http://a.org", "http://a.org/", "http://ORG/", "https://Example.org/es/x?y#z",
        "https://www.example.org/en/12", "https://notexample.org/es/", "http://x.com/fr/?q=://b.org/es/", "http://x.com/fr",
        "http://x.com/de/", "://org/", "http://É.com/de/1", "http://example.org?x=/es/", "http://a.b.c.d.example.org/en/1",
        "ftp://user@org:80/es/", "http://x.com/de/\nline", "http://..org/", "http://" + "s." * 300 + "org/" + "p" * 5000]


def test_url_rules_edge_rows(spark):
    data = list(enumerate(URLS)) + [(None, "http://a.org/"), (0, "http://a.org/")]
    df = spark.createDataFrame([r + ("r", "v") for r in data], "page_id long, url string, rule string, host string")
    out = urlfilter.judge(df, queries.URL_RULES).collect()
    assert sorted(str(tuple(r)) for r in out) == sorted(str((i, *judge_twin(u, queries.URL_RULES))) for i, u in data)
    assert urlfilter.judge(df.limit(0), queries.URL_RULES).count() == 0
    assert {r.rule for r in urlfilter.judge(df, []).collect()} == {None}


def test_cascade_is_exact_over_its_universe(spark):
    listed = [f"k{i}" for i in range(0, 3000, 7)]
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    cascade = urlfilter.Cascade(listed, universe, 3000)
    assert len(cascade.levels) > 1
    assert {r.key for r in universe.filter(cascade.has(universe.key)).collect()} == set(listed)


def article_twin(source):
    m = re.search(r"<article>(.*?)</article>", source, re.S)
    blocks = re.split(r"</?(?:h1|p|br)>", m[1])
    clean = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks]
    return " ".join(b for b in clean if b)


def test_page_query_gives_the_article(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op7_html_text"](spark, SF).collect()}
    assert len(got) == len(pages)
    for page_id, url, source in zip(pages.page_id, pages.url, pages.html):
        r = got[page_id]
        assert (r.url, r.text, r.n_chars) == (url, article_twin(source), len(article_twin(source)))


def test_page_parts_that_go(spark):
    def page(body):
        return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"
    data = [
        (1, page("<header>H</header><nav>N</nav><article><h1>A &amp; B</h1><p>x<b>y</b> z\n w&nbsp;v<br>u<aside>S</aside>"
                 "<form><p>F</p></form><div class='user-comments'><p>C</p></div><script>if (a<b) {'</p>'}</script><p>last"
                 "</article><div id=cookie-notice>K</div><footer>F</footer>"), "A & B xy z w v u last"),
        (2, page("<div class=ad>ad</div><div role='navigation'>n</div><div><p>one <p>two<ul><li>i<li>j</ul></div>"), "one two i j"),
        (3, None, ""), (4, "", ""), (5, "plain &lt;text&gt; &#233; &bogus; &amp", "plain <text> é &bogus; &"),
        (6, page("<article><p>cut &am"), "cut &am</body></html>".split("<")[0]),
        (7, "<article><p>a<!-- <p>no</p> -->b</p><p hidden>h</p><textarea>t</textarea></article", "ab"),
        (8, page("<p>" + "long words " * 50_000 + "</p>"), ("long words " * 50_000).strip()),
    ]
    df = spark.createDataFrame([(i, None, h, "x", 9) for i, h, _ in data],
                               "page_id long, url string, html string, text string, host int")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_text(df).collect()}
    assert got == {i: (t, len(t)) for i, _, t in data}
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_style_tree_cuts_what_a_host_repeats(spark):
    rows = [(k, f"http://h.org/{k}", f"<body><div class=top>Same words on all pages</div><div class=text><p>Body {k}</p></div></body>")
            for k in range(6)]
    rows += [(10, "http://single.org/", "<body><div class=top>Same words on all pages</div><p>Only page</p></body>"),
             (11, None, "<body><div class=top>Same words on all pages</div></body>")]
    rows += [(20 + k, "http://copies.org/", "<article><p>The same article</p></article>") for k in range(6)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(6)] == [f"Body {k}" for k in range(6)]
    assert got[10] == "Same words on all pages Only page" and got[11] == "Same words on all pages"
    assert {got[20 + k] for k in range(6)} == {"The same article"}


def test_story_beside_articles_stays(spark):
    data = [
        (1, "<div class=content><p>story</p></div><aside><article>teaser</article></aside>", "story"),
        (2, "<div><p>story</p></div><ol class='comment-list'><li><article>reader</article></ol>", "story"),
        (3, "<div><p>story</p></div><article class='comment'><p>reader</p></article>", "story"),
        (4, "<div class=lead><p>story</p></div><article><p>card</p></article>", "story card"),
        (5, "<article class='post comments-open'><p>story</p></article><article class='promo'>buy</article>", "story"),
    ]
    out = htmltext.main_text(spark.createDataFrame([(i, "http://s.org/", h) for i, h, _ in data], "page_id long, url string, html string"),
                             least_pages=9)
    assert {r.page_id: r.text for r in out.collect()} == {i: t for i, _, t in data}


def test_host_decides_what_stands_beside_articles(spark):
    rows = [(k, f"http://h.org/{k}", f"<div class=x>Same words</div><div class=y>Story {k}</div><article>Card {k}</article>") for k in range(6)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} Card {k}" for k in range(6)}


def test_notices_go_one_by_one(spark):
    def pages(at, host, body):
        return [(at + k, f"http://{host}/{k}", body.format(k=k)) for k in range(6)]
    rows = pages(0, "inside.org", "<article><div class=box>Follow us</div><p>Body {k}</p><p>Read on</p></article>")
    rows += pages(10, "path.org", "<div><p>Same notice</p><p>Body {k}</p></div>")
    rows += pages(20, "half.org", "<article><p>Body {k}</p></article>")[:3]
    rows += [(23 + k, f"http://half.org/{k}", f"<article><p>Heading</p><p>Text {k}</p></article>") for k in range(3)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {at + k: f"Body {k}" for at in (0, 10) for k in range(6)} | {20 + k: f"Body {k}" for k in range(3)}
    assert got == want | {23 + k: f"Heading Text {k}" for k in range(3)}


def tree_twin(pages, least_pages=4):
    """{path: (importance, composite)} of one host; a page is a list of (path, text), a leaf's path ends in /#text."""
    styles, texts = {}, {}
    for k, page in enumerate(pages):
        below = {}
        for path, text in page:
            names = [*path.split("/"), "#text"]
            for d in range(1, len(names)):
                below.setdefault("/".join(names[:d]), {})["/".join(names[:d + 1])] = None
            texts.setdefault("/".join(names), {}).setdefault(text, set()).add(k)
        for node, children in below.items():
            styles.setdefault(node, []).append(tuple(children))

    def judge(node):
        if node in texts:
            m = len(set().union(*texts[node].values()))
            if m < least_pages:
                return 1.0, 1.0
            value = 1 - sum(math.log(len(on), m) for on in texts[node].values()) / len(texts[node])
            return value, value
        m, counts = len(styles[node]), Counter(styles[node])
        if m < least_pages:
            return 1.0, 1.0
        own, weight = -sum(n / m * math.log(n / m, m) for n in counts.values()), 0.9 ** len(counts)
        return own, (1 - weight) * own + weight * sum(
            n / m * sum(judge(c)[1] for c in children) / len(children) for children, n in counts.items())

    return {node: judge(node) for node in [*styles, *texts]}


def test_style_tree_equals_its_definition(spark):
    pages = [[("/body/div.top", "Same words"), *[("/body/div.text/p", f"Body {k} {j}") for j in range(k % 3)],
              ("/body/div.more/ul/li", f"Link {k % 2}"), ("/body/div.more/ul/li/section.x", "all"), ("/body/div.more", "See also"),
              *([("/body/div.rare/p", "rare")] if k < 3 else [])] for k in range(8)]

    def markup(page):
        out = ""
        for path, text in page:
            names = [n.split(".") for n in path.split("/")[1:]]
            out += "".join(f"<{tag}{' class='.join(['', *style])}>" for tag, *style in names) + text
            out += "".join(f"</{tag}>" for tag, *_ in reversed(names))
        return out

    df = spark.createDataFrame([("h", markup(page)) for page in pages], "host string, html string")
    tree = htmltext.style_tree(htmltext._tree_counts(df), 4, 0.5, 0.1).collect()
    twin = tree_twin(pages)
    keys = {}
    for node in twin:
        chain = htmltext._chain(node.removesuffix("/#text"))
        keys[chain[-1] if node.endswith("/#text") else chain[-2]] = node
    assert {keys[r.node] for r in tree} == set(twin) and len(tree) == len(twin)
    for r in tree:
        assert (r.importance, r.composite) == pytest.approx(twin[keys[r.node]])
        under = [twin[n][1] for n in twin if n == keys[r.node] or n.startswith(keys[r.node] + "/")]
        assert r.noisy == (max(under) < 0.5)
    assert {keys[r.node] for r in tree if r.noisy} >= {"/body/div.top", "/body/div.more", "/body/div.more/ul/li/section.x/#text"}


def test_noisy_branches_go_whole(spark):
    rows = [(k, f"http://h.org/{k}", f"<div class=box><p>Follow us</p><p>Read on</p>{'<p>Only here</p>' if k == 3 else ''}</div><div><p>Body {k}</p></div>")
            for k in range(8)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Body {k}" for k in range(8)}


def test_deep_pages_take_few_rounds(spark):
    rows = [(k, "http://h.org/", "<div>" * 300 + f"Body {k}" + "</div>" * 300 + "<p>Same</p>") for k in range(5)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Body {k}" for k in range(5)}
