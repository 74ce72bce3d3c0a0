"""Main texts of pages with known text, template deduction, and the two ways of bringing templates to pages."""

import random

import pytest

from linewright.llm import html_extraction as he
from linewright.llm.html_pages import CLOSE, OPEN, TEXT, events


def names(page):
    return [(("<" if e[0] == OPEN else ">") + e[1].name) if e[0] != TEXT else e[2] for e in events(page)]


def test_events_of_untidy_pages():
    assert names("<p>a<p>b<div>c") == ["<p", "a", ">p", "<p", "b", ">p", "<div", "c", ">div"]
    assert names("<ul><li>a<li>b<ul><li>c</ul></ul>x") == ["<ul", "<li", "a", ">li", "<li", "b", "<ul", "<li", "c", ">li", ">ul", ">li", ">ul", "x"]
    assert names("a < b <!-- <p> --> c <br/> <script>if (a</p>b) '</div>'</script>d</i>") == ["a ", "<", " b ", " c ", "<br", ">br", " ", "<script", ">script", "d"]
    assert names("<a title='x > y' href=\"a>b\">t</a><b") == ["<a", "t", ">a", "<b"]
    assert names("x <a href='no end>y</a><p>z") == ["x ", "<a", "y", ">a", "<p", "z", ">p"]
    assert names("<!-- open <p>x") == [] and names("") == [] and names("<script>never closed <p>") == ["<script", ">script"]


@pytest.mark.parametrize("piece", ["<div>", "<p><span>", "<a x='", "<table><tr><td><p>", "<", "</p>", "&amp;", "<!", "<ul><li>", "<script>"])
def test_long_pages_take_linear_time(piece):
    page = piece * 60_000
    assert len(events(page)) <= 5 * len(page)


def words(rng, count):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(count))


def news(rng, n, paragraphs):
    """A page with everything around an article, in a class-named layout."""
    menu = "".join(f"<li><a href='/{i}'>{words(rng, 1)}</a></li>" for i in range(rng.randint(2, 6)))
    comments = "".join(f"<div class='comment c{i}'><p>{words(rng, 20)}</p></div>" for i in range(rng.randint(0, 3)))
    body = "".join(f"<p>{p}</p>" for p in paragraphs[1:])
    return (
        f"<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='has-sidebar'>"
        f"<header class='site-header'><h2>The Daily</h2></header><ul class='top-menu'>{menu}</ul><div id='cookie-notice'>We use cookies. {words(rng, 3)}</div>"
        f"<div class='wrap'><div class='story'><h1>{paragraphs[0]}</h1>{body}<p>Thank you for reading The Daily.</p></div>"
        f"<div class='sidebar'><p>{words(rng, 40)}</p></div></div><form><label>Name</label><input></form><section id='comments'>{comments}</section><footer>&copy; {n}</footer></body></html>"
    )


SCHEMA = "page_id long, url string, html string, host string, template string, text string, `row` int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "h", "t", "x", 1) for r in rows], SCHEMA)
    found = he.main_texts(df)
    assert found.columns == ["page_id", "url", "host", "template", "row", "text", "n_chars"]
    out = [(r["page_id"], r["url"], r["text"]) for r in found.collect()]
    assert all(r["n_chars"] == len(r["text"]) for r in found.select("text", "n_chars").collect())
    return sorted(out, key=str)


def hosts(rng):
    """(rows, expected texts): hosts of many, few and single pages, with and without an article element."""
    rows, want = [], []

    def add(host, page, text):
        rows.append((len(rows), f"https://{host}/p/{len(rows)}?a=1", page))
        want.append((rows[-1][0], rows[-1][1], text))

    for n in range(12):
        paragraphs = [words(rng, rng.randint(4, 60)) for _ in range(rng.randint(2, 6))]
        add("News.example:8080", news(rng, n, paragraphs), "\n\n".join(paragraphs))
    for n in range(7):
        paragraphs = [words(rng, 30) for _ in range(n + 1)]
        body = "".join(f"<p><b>{p}<br>" for p in paragraphs)
        add("b.example", f"<nav><a>x</a></nav><!-- ad --><div class=ad>{words(rng, 9)}</div><article><h1>H&eacute; &amp;amp; {n}</h1>{body}</article><footer>f</footer>", "\n\n".join([f"Hé &amp; {n}", *paragraphs]))
    add("c.example", "<body><p>one\n two&nbsp;<b>th</b>ree<br>four</p>five<ul><li>a</li><li>b</li></ul></body>", "one two three four\n\nfive\n\na\n\nb")
    add("d.example", "<main><header><h1>Head</h1><p>by me</p></header><p>Text</p><article class='comment'><p>no</p></article><aside>no</aside></main><header>no</header>", "Head\n\nText")
    add("e.example", "<article><p>One</p><section><article><p>a remark</p></article></section><nav>n</nav><footer>f</footer><p>Two</p></article>", "One\n\nTwo")
    add("f.example", "<div class='sidebar-layout'><p>All there is</p></div>", "All there is")
    add("g.example", "<nav>menu</nav><script>x</script>", "")
    add("h.example", None, "")
    add("h.example", "", "")
    add("h.example", "no markup  at &lt;all&gt;", "no markup at <all>")
    return rows, want


@pytest.mark.parametrize("most", [he.BROADCAST_TEMPLATES, 0])
def test_known_pages(spark, monkeypatch, most):
    monkeypatch.setattr(he, "BROADCAST_TEMPLATES", most)
    monkeypatch.setattr(he, "PAGES_PER_SALT", 3 if not most else 2000)
    monkeypatch.setattr(he, "BROADCAST_HOSTS", 2 if not most else 1000)
    monkeypatch.setattr(he, "HELD_TOKENS", 50 if not most else 300_000)
    rows, want = hosts(random.Random(5))
    rows += [(900, None, "<article>nowhere</article>"), (None, None, "<article>nowhere</article>"), rows[0]]
    want += [(900, None, "nowhere"), (None, None, "nowhere"), want[0]]
    assert run(spark, rows) == sorted(want, key=str)


def test_copies_of_an_article_stay(spark):
    rng = random.Random(6)
    same = [words(rng, 20) for _ in range(4)]
    rows = [(i, "http://x.example/", news(rng, i, same)) for i in range(9)]
    found = run(spark, rows)
    assert all(p in text for _, _, text in found for p in same)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_page(spark):
    rng = random.Random(7)
    paragraphs = [words(rng, 200) for _ in range(800)]
    page = "<article>" + "<div>" * 3000 + "".join(f"<p>{p}" for p in paragraphs) + "</article>"
    assert run(spark, [(1, "http://l.example", page)]) == [(1, "http://l.example", "\n\n".join(paragraphs))]


def test_classes_that_are_out_of_order_or_cross_are_refused():
    pages = ["<div><i>1</i><b>2</b></div>", "<div><b>2</b><i>1</i></div>"]
    found = [he.page_tokens(p) for p in pages]
    rows = []
    for name in found[0]:
        counts = [f[name] for f in found]
        rows.append((name, 7, 7, 2, sum(c[0] for c in counts), (0, counts[0][1]), 0, 0, counts[0][4]))
    template = he.Template(rows, 2)
    assert template.faults(pages[0])[0] <= template.faults(pages[1])[0] and template.faults(pages[1])[0]


def test_registered_query_reads_the_article_of_every_page(spark):
    """Against a plain reading of the pages at hand, whose articles are marked."""
    import html
    import re

    from linewright.llm import queries

    sf = "/root/testdata/sf0.001"
    found = {r["page_id"]: r["text"] for r in queries.QUERIES["op12_html_extraction"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert found[r["page_id"]] == "\n\n".join(b for b in blocks if b)
