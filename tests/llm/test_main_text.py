import collections
import random

from quillstream.llm import main_text as mt


def text(source, template=mt.NONE):
    return "\n\n".join(mt.blocks(mt.parse(source), template))


def test_article_without_what_surrounds_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body>
    <nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy</div><header><h1>Site</h1></header>
    <article><h1>Head &amp; line</h1><p><b>First <i>para</i>graph<br>goes on<p>Second&nbsp; one &copy; &#x41;<div class="share-bar">Share</div>
    <form><input value=x>Sign</form><ul><li>One<li>Two <b>2</ul><table><tr><td>a<td>b</table><section id="comments"><p>nice</p></section></article>
    <aside>side</aside><footer>&copy; foot</footer>"""
    assert text(page) == "Head & line\n\nFirst paragraph goes on\n\nSecond one © A\n\nOne\n\nTwo 2\n\na\n\nb"


def test_pages_without_article_and_broken_markup():
    assert text("<body><div id=menu><a>x</a></div><main><p>a<p>b</main><p>c") == "a\n\nb"
    assert text("<ul><li><a>l1</a><li><a>l2</a></ul><div>text <a>link</a></div>") == "text link"
    assert text("plain &lt;b&gt; text") == "plain <b> text"
    assert text("<p>x<!-- open <p>y") == "x"
    assert text("<p>x<script>y") == "x"
    assert text("<article></article><p>z") == "z"
    assert text("<p hidden>a</p><p style='display: none'>b</p><p>c < d</p>") == "c < d"
    assert text("") == text("<html>") == ""
    assert text("<div>" * 3000 + "deep") == "deep"


def brute_importance(rows):
    import collections
    import math

    out = {}
    for host, node in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if (r[0], r[1]) == (host, node)]
        pages = sum(r[4] for r in own)
        if pages < mt.LEAST_PAGES:
            continue
        h = []
        for at in (2, 3):
            n = collections.Counter(r[at] for r in own)
            m = len(own)
            h.append(-sum(c / m * math.log(c / m, m) for c in n.values()))
        out[host, node] = (pages, 0.9 * h[0] + 0.1 * h[1])
        for content, n in collections.Counter(r[2] for r in own).items():
            if n >= mt.LEAST_PAGES:
                out[host, node * 1000 + content] = (n, 1 - math.log(n) / math.log(pages))
    return out


def test_importance_equals_the_entropy(spark):
    r = random.Random(3)
    rows = []
    for host in "ab":
        for _ in range(12):
            for node in r.sample(range(1, 6), r.randint(2, 5)):
                for k, content in enumerate(r.sample(range(1, 4), r.randint(1, 2))):
                    rows.append((host, node, content, r.randint(1, 2), int(k == 0), node * 1000 + content))
    got = mt.importance(spark.createDataFrame(rows, "host string, node long, content long, look long, first int, feature long")).collect()
    want = brute_importance(rows)
    assert {(x.host, x.node) for x in got} == set(want) and any(n > 1000 for _, n in want)
    for x in got:
        pages, value = want[x.host, x.node]
        assert x.pages == pages and abs(x.importance - value) < 1e-9


def test_entropy_alone_removes_unnamed_branches_of_the_articles(spark):
    """Test table pages whose articles all get one more paragraph, and a section that differs only in its last word: no list names either."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hosts = collections.Counter(mt.host_of(p.url) for p in table)
    host = max(hosts, key=hosts.get)
    mine = [p for p in table if mt.host_of(p.url) == host]
    line = "<p>Read more of our stories in the evening edition.</p>"
    rows = [(p.page_id, p.url, p.html.replace("</article>", f"{line}<section><h3>One more</h3><p>thing of ours</p></section></article>")) for p in mine]
    plain = {x.key: x.text for x in mt.extract(spark.createDataFrame([(p.page_id, p.url, p.html) for p in mine], "key long, url string, html string")).collect()}
    got = mt.extract(spark.createDataFrame(rows, "key long, url string, html string")).collect()
    assert len({p.html for p in mine}) >= mt.LEAST_PAGES
    assert {x.key: x.text for x in got} == plain
    assert all("evening edition" not in x.text and x.n_template >= 2 for x in got)


def test_the_tree_finds_template_nodes_on_the_test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id AS key", "url", "html")
    got = mt.extract(pages).collect()
    assert sum(x.n_template for x in got) > len(got) / 2 and all(x.n_named >= 1 for x in got)


def test_deep_long_and_repeated_pages(spark):
    deep = "<div>" * 20_000 + "deep"
    long = "<article>" + "".join(f"<p>own {i}</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "http://a.b/", deep, "x"), (1, "http://a.b/", deep, "x"), (2, "http://a.b/", long, "x"), (2, None, long, None)]
    got = mt.extract(spark.createDataFrame(rows, "key long, url string, html string, n_named string")).collect()
    assert sorted((x.key, len(x.text.split())) for x in got) == [(1, 1), (1, 1), (2, 60_000), (2, 60_000)]


def test_site_template_is_cut_either_way(spark):
    r = random.Random(1)
    rows = []
    for i in range(12):
        own = " ".join(r.choice("abcdefgh") * 3 for _ in range(20))
        rows.append((i, "https://Host.example/x", f"<body><div class='zz'><p>Same line on all pages</p></div><div class='body1'><h2>T{i}</h2><p>{own}</p></div>", "clash"))
    rows += [(100, "https://other.example/", "<div class='zz'><p>Same line on all pages</p></div>", "x"), (101, None, "<p>a", "x"), (102, "x", None, "x")]
    pages = spark.createDataFrame(rows, "key long, url string, html string, text string")
    got = {x.key: x.text for x in mt.extract(pages).collect()}
    assert all(got[i].startswith(f"T{i}\n\n") and "Same line" not in got[i] for i in range(12))
    assert got[100] == "Same line on all pages" and got[101] == "a" and got[102] == ""
    assert {x.key: x.text for x in mt.extract(pages, most_broadcast=0).collect()} == got
    assert mt.extract(pages.limit(0)).count() == 0
