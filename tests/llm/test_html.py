import html
import re

import pytest

from curatrix.llm import html_extract
from curatrix.llm.html_extract import article, extract, op7_html_extract, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header class="site-header"><a href="/">Logo</a></header>
<nav><ul><li><a>Home</a><li><a>About</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="wrap with-sidebar">
<{tag} class="{cls}"><h1>{title} &amp; more</h1><div class="byline">Print this page</div><p>First&nbsp;para <b>bold</b>ly
 put {i}.<p>Second <a href="x?a=1&b=2" title="a > b">link</a> para {i}.<script>if (a < b) "</p>"</script><div class="ad-slot">Buy {i}</div><br/>Loose &#233; &lt;text&gt; here {i}
<aside>side {i}</aside><form><label>Mail</label><input></form></{tag}>
<div id="comments"><article class="comment"><p>{long} I disagree {i}</p></article></div><div id="sidebar">Side {i}</div></div><footer>&copy; x</footer></body></html>"""
WANT = "{title} & more Print this page First para boldly put {i}. Second link para {i}. Loose é <text> here {i}"


def test_article_forms():
    for tag, cls in (("article", ""), ("main", ""), ("div", "post-content")):
        page = PAGE.format(tag=tag, cls=cls, title="Tale", i=3, long="word " * (200 if tag == "article" else 2))
        assert article(*parse(page)) == WANT.format(title="Tale", i=3), tag


def test_inline_and_headers():
    page = '<div class="post-header"><h1>Title</h1></div><div class="post-body"><p>One <span style="display:none">not</span>two<ins class="adsbygoogle">buy</ins> <a class="related-link" href="#">three</a>.<p>' + "Long text. " * 40 + "</div>"
    for wrap in ("<body>{}</body>", '<body><header class="top">Site</header><main>{}</main></body>'):
        assert article(*parse(wrap.format(page))) == "Title One two three. " + ("Long text. " * 40).strip()
    assert article(*parse("<body><p>a<p>b</body>")) == "a b" and article(*parse("<!-- x")) == "" and article(*parse("<p>1 < 2 & 3 &gt; 2</p>")) == "1 < 2 & 3 > 2"


def test_template_blocks_go(spark):
    page = lambda i: PAGE.format(tag="article", cls="", title=f"Tale {i}", i=i, long="x")
    rows = [(i, f"http://Site.example/{i}", page(i), "q") for i in range(8)] + [(10 + i, "http://b.example/x", page(i), "q") for i in (1, 2)]
    rows += [(20 + i, f"http://same.example/{i}", page(1).replace("Home", f"Home{i}"), "q") for i in range(6)]
    rows += [(30, None, None, ""), (31, "", "", ""), (32, "x", "just text &amp; more", ""), (33, "y", "<p>" + "long " * 60_000, ""), (1, "http://Site.example/1", page(1), "q"), (34, "http://z/", '<a href="broken><p>x</p>', "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(df).collect()
    assert len(out) == len(rows)
    text = {r.page_id: r.text for r in out}
    for i in range(8):
        assert text[i] == WANT.format(title=f"Tale {i}", i=i).replace("Print this page ", "")
    assert text[11] == WANT.format(title="Tale 1", i=1)  # too few pages for a template
    assert text[22] == WANT.format(title="Tale 1", i=1)  # copies of one page are no template
    assert text[30] == text[31] == "" and text[32] == "just text & more" and len(text[33]) == 5 * 60_000 - 1
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract(df.limit(0)).count() == 0


def test_query(spark):
    """The test pages hold one article element each: a regular expression is the plain way."""
    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op7_html_extract(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)\b[^>]*>", " ", inner))).split())
        assert r.text == want, (r.page_id, r.text[:200], want[:200])


def test_no_part_of_the_article_is_lost():
    text = lambda n: " ".join(["Long text."] * n)
    links = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(5))
    # Sections side by side, a paragraph and a list of links inside the text; the menu and the last list go.
    page = f"<body><div><ul>{links}</ul></div><div><h2>Title</h2><p>{text(35)}</p></div><div><p><a href='x'>See this</a></p><p>{text(65)}</p><ul><li><a href='s'>Source</a></li></ul></div><div><ul>{links}</ul></div></body>"
    assert article(*parse(page)) == f"Title {text(35)} See this {text(65)} Source"
    # Articles side by side; one in comments goes.
    page = f"<body><main><article><p>{text(5)}</p></article><article><p>{text(3)} end</p></article></main><div class='comments'><article><p>{text(9)}</p></article></div></body>"
    assert article(*parse(page)) == f"{text(5)} {text(3)} end"
    # Class names that only begin like those of adverts or menus; such with links only go.
    page = f"<article><div class='promotion-rules'><p>{text(3)}</p></div><div class='alert'>Mind the step.</div><div id='related-work'><p>{text(2)} end</p></div><div class='related-links'><a href='y'>More</a></div><div class='ad-slot'>Buy</div><section class='comments'><p>I disagree</p></section></article>"
    assert article(*parse(page)) == f"{text(3)} Mind the step. {text(2)} end"


def neutral(i):
    """A page without article elements or telling names, and its main text."""
    w = lambda k, n: " ".join(f"w{k}x{(i * 31 + j * 7 + k) % 97}" for j in range(n))
    items = "".join(f'<div class="z"><a href="/{j}">{w(j, 2)}</a></div>' for j in range(3 + i % 3))
    paragraphs = [w(10 + k, 12 + i) for k in range(2 + i % 4)]
    body = "".join(f"<p>{p}</p><p class='q'>Tap to enlarge</p>" for p in paragraphs)
    page = (
        f'<html><head><title>{w(1, 4)}</title></head><body><div class="k1"><div class="k2">Daily things</div><div class="k3"><a href="/">Start</a> <a href="/a">All</a></div></div>'
        f'<div class="k4"><div class="k8">{items}</div><div class="k5"><div class="k9"><h2>{w(1, 4)}</h2></div><div class="ka"><p>{w(2, 20)}</p></div><div class="kb">{body}</div></div><div class="k6"><p>{w(3, 6)}</p></div></div>'
        f'<div class="k7">Write to us any time you like, and we may answer. <p>{w(4, 3)}</p></div></body></html>'
    )
    return page, " ".join([w(1, 4), w(2, 20), *paragraphs])


@pytest.mark.parametrize("small", [True, False])
def test_neutral_pages_need_the_template(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    rows = [(i, f"http://n.example/{i}", neutral(i)[0]) for i in range(12)] + [(20 + i, f"http://few.example/{i}", neutral(i)[0]) for i in range(3)] + [(30, "http://n.example/0", neutral(0)[0])] * 2
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(12):
        assert got[i].text == neutral(i)[1], i
        assert article(*parse(neutral(i)[0])) != neutral(i)[1]
    assert got[30].text == neutral(0)[1]
    assert all("Write to us" in got[20 + i].text and "Daily things" in got[20 + i].text for i in range(3))
    # Slots hold what isn't the template's, the article's and the rest.
    texts = [s.text for s in got[4].slots]
    assert not {"Daily things", "Tap to enlarge"} & {*texts} and len([s for s in got[4].slots if s.main]) < len(texts)


def plain_divisions(source):
    """A given page with article, nav, footer and the like as plain divisions, classes and ids as names that say nothing."""
    for tag in ("nav", "aside", "footer", "header", "article", "main", "section", "form"):
        source = re.sub(rf"<(/?){tag}\b", r"<\1div", source, flags=re.I)
    return re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="z{sum(map(ord, m[2])) % 97}"', source)


def test_given_pages_as_plain_divisions(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: r.text for r in op7_html_extract(spark, sf).collect()}
    plain = spark.createDataFrame([(r.page_id, r.url, plain_divisions(r.html)) for r in pages.collect()], "page_id long, url string, html string")
    hosts = {}
    for r in pages.collect():
        hosts.setdefault(re.sub(r"^\w+://([^/?#]*).*", r"\1", r.url), set()).add(r.page_id)
    told = set().union(*(ids for ids in hosts.values() if len(ids) >= html_extract.SUPPORT))
    got = {r.page_id: r.text for r in extract(plain).collect()}
    assert len(told) > 0.5 * len(want) and sum(got[i] == want[i] for i in told) >= 0.95 * len(told)
    off = {r.page_id: r.text for r in extract(plain, support=1 << 30).collect()}
    assert sum(off[i] == want[i] for i in told) < 0.05 * len(told)
