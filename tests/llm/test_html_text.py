import random
import re
from html import unescape

import pytest

from pricewell.llm.html_text import extract_text, host_of, main_blocks, templates, tree


def text_of(html):
    root, nodes = tree(html)
    return "\n".join(main_blocks(root, nodes, set()))


def marked_article(html):
    """A plain reading of the pages' own pattern."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", html or "", re.S)
    blocks = [" ".join(unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body.group(1))] if body else []
    return "\n".join(b for b in blocks if b)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("room", [32 << 20, 0])
def test_pages(spark, room):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted(((r.page_id, r.url, t, len(t)) for r in pages.collect() for t in [marked_article(r.html)]), key=str)
    assert rows_of(extract_text(pages, room_bytes=room)) == want


def bare_page(r, site, page, words):
    """A page without any telling tag, class or list of links: only recurrence tells the article."""
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    paragraphs = [say(r.randint(8, 40)) for _ in range(r.randint(2, 6))]
    top = "".join(f"<div>{site} part {k} of the site</div>" for k in range(4))
    notice = f"<div><p>We at {site} keep small files on your machine to count visits.</p></div>"
    foot = f"<table><tr><td>{site} since</td><td>1999</td></tr></table>"
    html = f"<html><body><div>{top}</div>{notice}<div><h2>Page {page} {say(3)}</h2>"
    title = re.search(r"<h2>(.*?)</h2>", html).group(1)
    return html + "".join(f"<p>{x}" for x in paragraphs) + f"</div>{foot}</body>", "\n".join([title, *paragraphs])


@pytest.mark.parametrize("room", [32 << 20, 0])
def test_recurrence_alone_finds_the_article(spark, room):
    r = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows, want = [], []
    for s in range(6):
        for k in range(8 if s else 60):
            html, text = bare_page(r, f"site{s}", k, words)
            rows.append((len(rows), f"https://user@Site{s}.example:80/{k}?q#x", html))
            want.append((*rows[-1][:2], text, len(text)))
    # copies of one article, exact and edited, on one host: their paragraphs recur and stay
    html, text = bare_page(r, "site0", 0, words)
    for k in range(40):
        edit = f" and {r.choice(words)}"
        rows.append((len(rows), "https://site0.example/copy", html.replace("</h2>", f"{edit if k % 2 else ''}</h2>")))
        body = text.replace("\n", f"{edit}\n", 1) if k % 2 else text
        want.append((*rows[-1][:2], body, len(body)))
    pages = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string").repartition(5)
    assert rows_of(extract_text(pages, room_bytes=room)) == sorted(want, key=str)


def test_templates_equal_plain_counting(spark):
    """Different pages a subtree stands on, counted in dictionaries."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    rows = [(f"http://h{s}.example/{k}", bare_page(r, f"h{s}", k, words)[0]) for s in range(4) for k in range(3 + 4 * s)]
    found = templates(spark.createDataFrame(rows, "url string, html string").repartition(3)).count()
    seen, hosts = {}, {}
    for url, html in rows:
        hosts[host_of(url)] = hosts.get(host_of(url), 0) + 1
        for key in {n.key for n in tree(html)[1] if n.candidate()}:
            seen[host_of(url), key] = seen.get((host_of(url), key), 0) + 1
    want = [k for k, n in seen.items() if n >= 5 and n >= 0.1 * hosts[k[0]]]
    assert found == len(want) > 10


MARKED = [
    ("<p>a<p>b</p>c", "a\nb\nc"),
    ("<ul><li>one<li>two</ul>", "one\ntwo"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<p>a <b>b<i>c</p><p>d</b></i>e", "a bc\nde"),
    ("x &amp;lt; &eacute;&#233;&#x1F600; &am &amp", "x &lt; éé😀 &am &"),
    ("1 < 2 <3 a<b\n\t c", "1 < 2 <3 a"),
    ("<script>if (a</b) '</p>'</script>kept<style>p{}</style><!-- gone <p> -->.", "kept."),
    ("<header><h1>Title</h1></header><p>t</p><footer>f</footer>", "Title\nt"),
    ("<p>t</p><section id='comments'><p>me too</p></section><div class='post-comments'>x</div>", "t"),
    ("<p>t</p><form><label>mail</label><input value='q'><button>go</button></form>", "t"),
    ("<div class=shareBar><a href=x>share</a></div><aside>s</aside><p>t<div hidden>h</div><span style='display: none'>no</span>", "t"),
    ("<p>t<div class='has-sidebar'><p>u</div>", "t\nu"),
    ("<div class=advert>buy</div><p>t<br>u<hr>v", "t u\nv"),
    ("<p title='a > b'>t", "t"),
    ("t<script>never ended <p>x", "t"),
    ("t<!-- never ended <p>x", "t"),
    ("t<p class='never ended>x</p>", "t"),
]


@pytest.mark.parametrize(("inside", "want"), MARKED)
def test_markup(inside, want):
    assert text_of(f"<nav>menu</nav><div>aside</div><article>{inside}") == want


def test_pages_without_an_article():
    menu = "<ul><li><a href=/a>Aa</a><li><a href=/b>Bb</a></ul>"
    assert text_of(f"<body>{menu}<div class='cookie-notice'>We use cookies.</div><div id=content><p>Text &amp; more.</p></div><div>© 2020 me</div>") == "Text & more."
    assert text_of("<main><article class='comment'>no</article><p>yes</p></main><p>out</p>") == "yes"
    assert text_of("<article><p>a</p></article><article class=related-posts>r</article><article>b</article>") == "a\nb"
    assert text_of("<div role=banner>x</div><p>y") == "y"
    assert text_of("") == text_of("<p></p>") == text_of("<html><head><title>t</title></head><nav>n</nav></html>") == ""


def test_edge_cases(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, "http://x.example/", None), (2, None, "<p>a</p>"), (None, "", "<p>b"), (3, "x", "<article>" + "word " * 200_000), (4, "http://d/", deep), (5, "http://d/", "<p><" * 5000), (5, "http://d/", "<p><" * 5000)]
    pages = spark.createDataFrame([(*x, 9) for x in rows], "page_id long, url string, html string, n_chars int")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {(r.page_id, r.url): r.text for r in got.collect()}
    assert texts[1, "http://x.example/"] == "" and texts[2, None] == "a" and texts[None, ""] == "b" and texts[4, "http://d/"] == "deep"
    assert len(texts[3, "x"]) == 999_999 and got.count() == len(rows)
    assert extract_text(pages.limit(0)).collect() == []


def test_long_pages_take_time_in_proportion():
    for html in ("<p>" * 100_000, "</p>" * 100_000, "<b>x" * 100_000, "<a \"" * 100_001, "<!-- " * 100_000, "<" * 300_000, "<li>y" * 50_000, "<div class=x>z" * 30_000, "<b>" * 50_000 + "</p><li></i>" * 50_000):
        text_of(html)
