"""HTML extraction: parsing, wrappers, what they give for odd pages, and the pages table against brute force."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from provender.llm import html
from provender.llm.common import table

PAGES = "page_id string, url string, html string"


def texts(spark, rows):
    got = html.main_text(spark.createDataFrame(rows, PAGES)).collect()
    return {r["page_id"]: r["text"] for r in got}


def tree_of(page, fixed=()):
    blocks = html.parsed(page)
    runs, of = html.runs_of([b[0] for b in blocks], [html.digest(b[1]) for b in blocks], set(fixed))
    return html.repeats(html.stream(runs, html.counts_of(of, [len(b[1]) for b in blocks], [b[2] for b in blocks])))


def test_parsed():
    page = '<div><a href="x>y">m</a> tail<p>a<br>b <a title="q>c</a><p class="x'
    assert html.parsed(page) == [("div", "m tail", 1), ("div/p", "a b c", 1)]
    page = '<p>one<script>if(a<b && c="x) "</p>"</script><!-- <p>no -->two &lt;x&gt; &#233;<p hidden>n'
    assert html.parsed(page) == [("p", "one", 0), ("p", "two <x> é", 0), ("p.hidden", "n", 0)] or html.parsed(page)[0][1].startswith("one")


def test_expression():
    one = tree_of("<html><body><nav><ul><li>1<li>2<li>3</ul></nav><article><h1>t</h1><p>a</p><p>b</p></article></body></html>")
    two = tree_of("<html><body><nav><ul><li>1</ul></nav><div class=ad>x</div><article><h1>t</h1><p>a</p></article></body></html>")
    want = "<html><body><nav><ul>(<li>#</li>)+</ul></nav>(<div.ad>#</div>)?<article><h1>#</h1>(<p>#</p>)+</article></body></html>"
    assert html.expression(html.merged(one, two)) == html.expression(html.merged(two, one)) == want
    pairs = tree_of("<dl>" + "<dt>a<dd>b" * 3 + "</dl>")
    assert html.expression(pairs) == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"
    said = tree_of("<div><p>a<p>b<p>Subscribe!</div>", [html.digest("Subscribe!")])
    assert html.expression(said) == f"<div>(<p>#</p>)+<p>={html.digest('Subscribe!'):x}</p></div>"


def test_match_by_place():
    """Two elements of one name are told apart by where the expression has them."""
    page = "<body><div>a {0}</div><h2>h {0}</h2><div>b {0}</div></body>"
    tree = html.merged(tree_of(page.format(1)), tree_of(page.format(2)))
    w = html.Wrapper(tree, [])
    blocks = html.parsed(page.format(3))
    assert w.match(html.runs_of([b[0] for b in blocks], [1, 2, 3], set())[0]) == [0, 1, 2]
    less = html.parsed("<body><h2>h</h2><div>b</div></body>")
    assert w.match(html.runs_of([b[0] for b in less], [1, 2], set())[0]) == [1, 2]
    again = html.Wrapper(tree_of("<dl>" + "<dt>a<dd>b" * 3 + "</dl>"), [])
    rows = html.parsed("<dl>" + "<dt>a<dd>b" * 5 + "</dl>")
    assert again.match(html.runs_of([b[0] for b in rows], list(range(10)), set())[0]) == [0, 1] * 5


def test_text_comes_from_the_tree():
    page = "<body><article><h1>t {0}</h1><p>text {0}</p></article></body>"
    blocks = html.parsed(page.format(3))
    whole = html.merged(tree_of(page.format(1)), tree_of(page.format(2)))
    assert html.Wrapper(whole, []).text(blocks) == "t 3 text 3"
    article = whole[2][0][2][0]
    article[2] = [x for x in article[2] if x[0] != "h1"]
    assert html.Wrapper(whole, []).text(blocks) == "text 3"


def test_constants_go(spark):
    """A text that the host's other pages have too is no text, whatever its length and though it stands among the article's."""
    for notice in ("Subscribe to our letter!", "We keep what you tell us. " * 12):
        rows = [(str(i), "http://h/", f"<body><div class=w><h2>{notice}</h2><p>Article {i} begins</p><p>and it ends {i}</p><p>{notice}</p></div></body>") for i in range(4)]
        assert texts(spark, rows) == {str(i): f"Article {i} begins and it ends {i}" for i in range(4)}
    article = [(str(i), "http://h/", f"<article><p>Article {i}</p><p>Subscribe!</p></article>") for i in range(4)]
    assert texts(spark, article) == {str(i): f"Article {i}" for i in range(4)}
    quoted = [(str(i), "http://h/", f"<article><p>Article {i}</p><p>{'A passage.' if i % 2 else 'Another.' + str(i)}</p></article>") for i in range(20)]
    assert texts(spark, quoted)["1"] == "Article 1 A passage."  # ten of twenty articles have it: not yet sure
    assert texts(spark, article[:2])["0"] == "Article 0 Subscribe!"  # two pages don't tell


def test_copies_are_one_page(spark):
    rows = [(str(i), "http://h/", "<body><article><p>the same text</p></article></body>") for i in range(5)] + [("x", "http://h/", "<body><article><p>another text</p></article></body>")]
    assert texts(spark, rows) == {str(i): "the same text" for i in range(5)} | {"x": "another text"}


def test_paragraphs_of_an_article_stay(spark):
    rows = [("1", "http://h/", "<article><h1>t</h1><p class='legal'>one</p><p class='byline'>two</p><p class='notice-period'>three</p><blockquote class='comment'>four</blockquote><div class='text'>five</div></article>")]
    assert texts(spark, rows) == {"1": "t one two three four five"}


def test_around(spark):
    page = '<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use</div><nav><a>m</a></nav><article><header><h1>T &amp t</h1></header><p>one<br>two<p>three &lt;x&gt; <b>bold</b>!<ul><li>a<li>b</ul><form>f</form><aside>s</aside><div class="comments"><p>c</p></div></article><script>if(a<b && c="x) "</p>"</script><!-- <p>no --><footer>&copy;</footer>'
    assert texts(spark, [("1", "http://h/", page)]) == {"1": "T & t one two three <x> bold! a b"}


def test_layout_names(spark):
    side = "<div class='sidebar'><p>{0} links</p></div><div class='comments'><p>comment {0}</p></div>"
    forms = {
        "a": "<div class='layout has-sidebar'><div class=x><p>{1}</p></div>" + side + "</div>",
        "b": "<p>tag line</p><div id='page' class='no-comments'><div class='layout has-sidebar'><article><p>{1}</p></article>" + side + "</div></div>",
        "c": "<main class='content sidebar-right'><p>{1}</p></main>" + side,
        "d": "<article><p>{1}</p></article><div class='comments'><article><p>comment {0}</p></article></div>",  # names that are right
    }
    long = {i: f"Article {i} " + "says a lot " * 20 + "." for i in range(4)}
    rows = [(f"{h}{i}", f"http://{h}/", "<body>" + form.format(i, long[i]) + "</body>") for h, form in forms.items() for i in long]
    assert texts(spark, rows) == {f"{h}{i}": long[i] for h in forms for i in long}


def test_density_without_marks(spark):
    """Without article or main, the part with the text is taken, and lists of links aren't."""
    page = "<body><div><ul>" + "".join(f"<li><a href=x>link {k} {{0}}</a>" for k in range(8)) + "</ul></div><div><h2>Head {0}</h2><p>{1}</p><p>{1} more</p></div></body>"
    rows = [(str(i), "http://h/", page.format(i, f"Text {i} " + "with words " * 10 + ".")) for i in range(3)]
    assert texts(spark, rows) == {str(i): " ".join([f"Head {i}", t := f"Text {i} " + "with words " * 10 + ".", t + " more"]) for i in range(3)}


def test_odd_pages(spark):
    rows = [("1", None, "<p>x"), ("2", "http://h/", None), ("3", "http://h/", ""), ("4", "http://h/", "plain & <b>text"), ("5", "http://h/", "<p>" + "long " * 50_000), ("6", "not a url", "<p>x<p>y"), ("7", "http://g/", "<nav>m</nav>"), ("1", None, "<p>x")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("_host", "_wrapper", "_in", "host", "wrapper", "TEXT")})
    out = html.main_text(df)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.columns == [*df.columns[:-1], "text"] and out.count() == len(rows) and {r["_host"] for r in out.collect()} == {1}
    assert got == {"1": "x", "2": "", "3": "", "4": "plain & text", "5": ("long " * 50_000).strip(), "6": "x y", "7": ""}


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_pages(spark, at):
    for r in html.main_text(table(spark, f"/root/testdata/{at}", "pages")).collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(" ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == " ".join(want.split())


@pytest.mark.parametrize("names", [("a", "b"), ("c1", "c2"), ("x" * 30, "y" * 30), ("story", "tail"), ("css-1k9", "css-77b")], ids=["letters", "digits", "long", "words", "generated by a build"])
def test_names_that_are_not_words(spark, names):
    """Containers told apart by any name that is the host's own: what stands beside the story isn't in the text. Names that pages generate tell nothing."""
    rows, want = [], {}
    for h in range(3):
        for i in range(20):
            story = [f"story {h} {i} {j} " + "with some words of its own that go on for a while " * 3 for j in range(3)]
            links = "".join(f'<p><a href="/{h}/{(i * 7 + j) % 90}">see also number {(i * 7 + j) % 90} of {h}</a></p>' for j in range(4))
            body = "".join(f"<p>{s}</p>" for s in story)
            page = f'<html><body><div class="page{i}" id="p{h * 100 + i}"><div class="{names[0]}">{body}</div><div class="{names[1]}">{links}</div></div></body></html>'
            rows.append((f"{h}-{i}", f"http://h{h}.example/{i}", page))
            want[f"{h}-{i}"] = " ".join(" ".join(s.split()) for s in story)
    assert texts(spark, rows) == want


def test_stable_names(spark):
    """A name counts from half of a host's pages on, two at least; others go, and pages that differ in them alone are one."""
    rows = [(str(i), "http://s.example/x", f'<div class="q7 only{i}"><p id="n{i % 2}">text {i}</p></div>') for i in range(6)] + [("t", "http://t.example/", '<div class="q7"><p>alone</p></div>')]
    out = html.outlines(spark.createDataFrame(rows, PAGES))
    assert {(r["host"], tuple(r["stable"])) for r in html.stable_names(out).collect()} == {("s.example", ("n0", "n1", "q7"))}
    same = [(str(i), "http://u.example/x", f'<div class="g{i}x"><p>same</p></div>') for i in range(3)]
    assert html.outlines(spark.createDataFrame(same, PAGES)).count() == 1
    assert html.reduced("div.main.~a1.~b2/p.~c3", frozenset(["b2"])) == "div.main.~b2/p"
