import html
import itertools
import random
import re
import time

from tendersift.llm import html_text as ht


def test_cut_is_the_least_of_all_labellings():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        costs = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
        price = lambda x: sum(abs(c) for c, y in zip(costs, x, strict=True) if y != (c > 0)) + sum(c for i, j, c in edges if x[i] != x[j])  # noqa: E731, B023
        best = min(price(x) for x in itertools.product([False, True], repeat=n))
        assert abs(price(ht.min_cut(costs, edges)) - best) < 1e-9


def brute_text(page):
    """The text by the least of all labellings of the page's graph."""
    made = ht.parsed(page)
    found, (costs, edges) = made.blocks, ht.graph(made)
    assert len(costs) <= 15
    price = lambda x: sum(abs(c) for c, y in zip(costs, x, strict=True) if y != (c > 0)) + sum(c for i, j, c in edges if x[i] != x[j])
    best = min(itertools.product([False, True], repeat=len(costs)), key=price)
    return "\n".join(b.text for b, keep in zip(found, best, strict=False) if keep)


def test_whole_pages_equal_the_least_of_all_labellings():
    rnd = random.Random(3)
    words = lambda n: " ".join(rnd.choice(["a", "story", "of", "words", "here"]) for _ in range(n))
    for _ in range(60):
        part = lambda: rnd.choice([f"<p>{words(rnd.randrange(1, 40))}.</p>", f"<p>{words(2)}</p>", f"<h2>{words(3)}</h2>", f"<p><a href=x>{words(4)}</a></p>", f"<li>{words(5)}</li>"])
        some = lambda n: "".join(part() for _ in range(rnd.randrange(n)))
        wrap = rnd.choice(["<div>{}</div>", "<article>{}</article>", '<div class="content with-sidebar">{}</div>', "<form>{}</form>"])
        page = f"<nav><a href=1>x</a></nav>{some(2)}" + wrap.format(some(4) + rnd.choice(["", f"<aside>{some(2)}</aside>"])) + rnd.choice(["", f"<div class=comments>{some(3)}</div>"])
        assert ht.main_text(page) == brute_text(page), page


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{a>b}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><p>Our slogan is long enough to look like text.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better for you.</p></div>
<article><h1>Head &amp; line</h1><p><b>Bold start<br>goes&nbsp;on<p>Second
 paragraph with <a href="x">a link</a> inside.</p><aside>Aside text that is not main.</aside><p>Of.</p>
<ul><li>Item one<li>Item two</ul><div class="ad">Buy this thing now, it is great.</div>
<form><p>Name please</p><input value="x"></form>
<section id="comments"><article class="comment"><p>A reader says this is a fine article indeed.</p></article></section>
</article><aside class="sidebar"><p>Side text of some length that isn't content.</p></aside>
<footer>&copy; Site</footer><!-- a > b --></body></html>"""


def test_page_with_every_kind_of_boilerplate():
    assert ht.main_text(PAGE).split("\n") == ["Head & line", "Bold start goes on", "Second paragraph with a link inside.", "Of.", "Item one", "Item two"]


def test_page_without_semantic_tags():
    text = "This is a sentence of the story, with some more words in it to read on."
    page = f"<div class=menu><a href=1>Home</a> <a href=2>News</a></div><div><div><p>{text}</p><p>{text}</p><p>Short one.</p></div></div><div><a href=3>Imprint</a></div>"
    assert ht.main_text(page) == f"{text}\n{text}\nShort one."
    assert ht.main_text("") == "" and ht.main_text("<p") != None  # noqa: E711
    assert ht.main_text("<!-- open " + "<a " * 2000) == ""


def test_names_of_the_layout_are_no_veto():
    art = "<h1>Head</h1><p>This is a long enough sentence of the article, with words.</p><p>Another one.</p>"
    want = "Head\nThis is a long enough sentence of the article, with words.\nAnother one."
    talk = "".join(f"<article><p>Reader {i} says a lot about the article, and many more words.</p></article>" for i in range(30))
    for page in (
        f'<div class="content with-sidebar">{art}</div>',
        f'<article class="post comment-open">{art}</article>',
        f"<form id=aspnetForm><nav><a href=1>x</a></nav><div>{art}</div></form>",
        f"<form action=x><article>{art}</article></form>",
        f'<div class="sidebar-right">{art}<aside>Something else here.</aside></div>',
        f"<article>{art}</article><section id=comments>{talk}</section>",
        f"<main>{art}<form><p>Your mail, please, for more of this every week.</p></form></main>",
    ):
        assert ht.main_text(page) == want, page


def wanted(page):
    """What the fixture's marked article holds between block tags."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(" ".join(x.split()) for x in parts if x.strip())


def neutral(page):
    """The page without any telling tag or name."""
    page = re.sub(r"<(/?)(article|nav|footer|aside|header|main|section)\b", r"<\1div", page)
    return re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_text_and_cut_stand_without_tags_and_names(spark):
    pages = [p.html for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = turned = other = 0
    for page in pages:
        plain = neutral(page)
        found = ht.labelled(plain)
        assert all(term == 0 for _, _, _, term in found)
        right += ht.main_text(plain) == wanted(page)
        turned += sum(keep != (own > 0) for _, keep, own, _ in found)
        other += sum(keep != (term > 0) for _, keep, _, term in found)
    assert right > 0.9 * len(pages) and turned > 0 and other > 1000  # a look-up of tags and names finds nothing here


def test_names_that_hold_a_boilerplate_word_leave_a_doubt_only():
    art, part = "<h1>Head line of it</h1><p>This is a long enough sentence of the article, with words.</p>", "<p>A paragraph on something of the matter here.</p>"
    for open_, close in (('<section id="search-methods">', "</section>"), ('<div class="side-by-side">', "</div>"), ('<div class="related-work">', "</div>"), ('<div class="social-impact">', "</div>"), ('<div class="cookie-recipe">', "</div>")):
        assert ht.main_text(f"<article>{art}{open_}{part}{close}</article>").endswith("\nA paragraph on something of the matter here.")
    for name in ("cookie-notice", "related-posts", "social-share-buttons", "search-form", "sidebar-left", "site-footer", "comments", "ad"):
        assert "matter" not in ht.main_text(f"<article>{art}<div class='{name}'>{part}</div></article>"), name
    assert ht.main_text(f"<article>{art}<p>Here <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds.</p></article>").endswith("\nHere x = 2 holds.")


def test_text_turns_a_doubt_and_never_a_plain_name():
    """Within one element whose name leaves a doubt, prose stays and bare links go."""
    page = "<article><h1>Head line</h1><p>This is a long enough sentence of the article, with words.</p>" + '<div class="related-work"><p>A paragraph on something of the matter here.</p><ul><li><a href=1>More</a></li><li><a href=2>Others</a></li></ul></div></article>'
    assert ht.main_text(page).split("\n")[-1] == "A paragraph on something of the matter here."


def test_nested_elements_take_linear_time():
    began = time.process_time()
    for part in ("<div>x", "<x>y", "<span><p>z", "</b>w<li>"):
        assert len(ht.main_text(part * 30_000)) < 200_000
    assert time.process_time() - began < 60


def test_long_pages_take_linear_time():
    page = "<div>" + ("<p>" + "some words of a line " * 4 + ".</p><p>x</p>") * 10_000 + "</div>"
    assert ht.main_text(page).count("\n") > 9_000


def test_pages_equal_their_articles(spark):
    """The fixture's pages mark the article: what it holds between block tags is the wanted text."""
    got = {r.page_id: r for r in ht.query(spark, "/root/testdata/sf0.01").collect()}
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = wanted(p.html)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "<article><p>é x</p></article>", 3), (2, "<article><p>é x</p></article>", 3), (3, "<article>" + "<p>word word.</p>" * 20_000, 4)], "page_id bigint, html string, page_html int")
    rows = ht.extracted(pages).collect()
    assert [r.text for r in rows[:4]] == ["", "", "é x", "é x"] and rows[4].text.count("\n") == 19_999
    assert ht.extracted(pages.limit(0)).count() == 0
    clash = ht.extracted(pages.withColumnRenamed("page_html", "Text"))
    assert clash.columns == ["page_id", "html", "text"] and [r.text for r in clash.collect()][2] == "é x"
