"""Article text stays whatever its ids and elements are called; what stands
beside it goes whatever it is called."""
import re

import pytest
from pyspark.sql import functions as F

from flowlens.llm import html_extract


def test_slug_ids_and_formulas_stay():
    page = ('<body><nav>menu</nav><article><h2 id="side-effects">Side effects</h2><section id="related-work"><p>Others</p></section>'
            '<div id="skip-lists" class="share-price"><p>A list</p></div><section id="comments"><h3>Comments on this</h3></section>'
            '<p class="note">Note <math><mi>x</mi></math></p>'
            '<object>plan</object><aside>no</aside><div class="comments-list"><p>reader</p></div></article>'
            '<div class="ad">buy</div><button>Top</button><footer>x</footer></body>')
    assert html_extract.extract(page) == ("Side effects Others A list Comments on this Note x plan")


@pytest.mark.parametrize("name", ["comment", "comment-list", "user-comments", "comment-thread", "cookie-notice", "cookie-banner",
                                  "notice", "newsletter", "promo", "popup", "modal", "related-posts", "ad", "userComments"])
def test_named_parts_go(name):
    for tag in ("div", "section", "ul", "p"):
        for page in (f'<article><p>Text</p><{tag} class="{name}">x</{tag}><p>More</p></article>',
                     f'<article><p>Text</p><p>More</p></article><{tag} class="big {name}">x</{tag}>'):
            assert html_extract.extract(page) == "Text More", (tag, page)
    assert html_extract.extract(f'<article><h2 class="{name}">Head</h2><p>Text</p></article>') == "Head Text"


def test_roles_and_controls_go():
    assert html_extract.extract('<article><p>a</p><div role="alert">x</div><label>y</label><button>z</button><p>b</p></article>') == "a b"


def test_text_beside_an_article_stays():
    page = '<body><div><p>The whole story</p></div><div><article><p>A teaser</p></article></div><div class="ad-box">buy</div></body>'
    assert html_extract.extract(page) == "The whole story A teaser"


def _pages(n, make, host="h.org"):
    return [(i, f"http://{host}/{i}", make(i)) for i in range(n)]


def _texts(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.id: r.text for r in html_extract.main_text(table).collect()}


def _plain(i, extra="", head=True):
    """A page without one telling name; every text of it varies."""
    story = "".join(f"<div><p>Story {i} part {k} with a number of words that make it long, {i * 7919 + k}.</p></div>" for k in range(2 + i % 4))
    menu = "".join(f'<li><a href="/{k}">link {k * i}</a></li>' for k in range(6))
    return (f"<body><div><ul>{menu}</ul></div><div>Buy {i} now, only today</div><div>{'<h1>Head %d</h1>' % i if head else ''}{story}{extra}"
            f"</div><div>Made by {i * 31} and friends</div></body>")


def _want(i, head=True):
    return " ".join(([f"Head {i}"] if head else []) + [
        f"Story {i} part {k} with a number of words that make it long, {i * 7919 + k}." for k in range(2 + i % 4)])


def test_main_slot_without_names(spark):
    got = _texts(spark, _pages(20, _plain))
    assert got == {i: _want(i) for i in range(20)}


def test_small_hosts_share_a_wrapper(spark):
    """Two pages a host: the parent domain's pages serve, or those built alike."""
    rows = [(i, f"http://s{i // 2}.{'big.org' if i < 20 else 'o%d.net' % i}/{i}", _plain(i)) for i in range(40)]
    assert _texts(spark, rows) == {i: _want(i) for i in range(40)}


def test_comments_without_names(spark):
    """A run of author and text at the end of the main slot goes, however many
    there are; sections with headings stay."""
    def make(i):
        run = "".join(f"<div><div>User{k * i} on day {k}</div><div>I do not think so at all, this is wrong and {k} more words to say "
                      f"so.</div></div>" for k in range(2 + i % 2))
        parts = f"<div><div><h2>One {i}</h2><p>Text one of this section is here {i}</p></div><div><h2>Two</h2><p>And two {i}</p></div></div>"
        return _plain(i, parts + f"<div>{run}</div>")
    got = _texts(spark, _pages(16, make))
    assert got == {i: f"{_want(i)} One {i} Text one of this section is here {i} Two And two {i}" for i in range(16)}


def test_heading_beside_the_main_slot(spark):
    def make(i):
        body = _plain(i, head=False).removeprefix("<body>")
        return f"<body><h1>Head {i}</h1>{body}"
    assert _texts(spark, _pages(16, make)) == {i: _want(i) for i in range(16)}


def test_links_within_the_main_slot_go(spark):
    def make(i):
        return _plain(i, "<ul>" + "".join(f"<li><a href='/x{k}'>Read also {k * i}</a></li>" for k in range(4)) + "</ul>")
    assert _texts(spark, _pages(16, make)) == {i: _want(i) for i in range(16)}


def test_page_that_lacks_the_main_slot(spark):
    rows = _pages(16, _plain) + [(99, "http://h.org/99", "<body><table><tr><td>only</td><td>this</td></tr></table></body>")]
    assert _texts(spark, rows)[99] == "only this"


def test_neutral_names_give_the_same_text(spark):
    """Over all pages of the small tables: with every telling tag a ``div`` and
    no class the wrapper finds the same text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    named = {r.id: r.text for r in html_extract.main_text(pages).collect()}
    plain = F.regexp_replace("html", r"<(/?)(?:nav|footer|article|aside|header|main)\b", "<$1div")
    got = html_extract.main_text(pages.withColumn("html", F.regexp_replace(plain, r'\sclass="?[^">]*"?', ""))).collect()
    assert {r.id: r.text for r in got} == named and all(named.values())


def brute_matching(a, b):
    """Largest simple tree matching, by plain recursion over all choices."""
    def best(x, y):
        if not x or not y:
            return 0
        p, q = x[0][0], y[0][0]
        both = 1 + best(html_extract._elements(p), html_extract._elements(q)) if p.name == q.name else 0
        return max(best(x[1:], y), best(x, y[1:]), both + best(x[1:], y[1:]))
    return 1 + best(html_extract._elements(a), html_extract._elements(b))


def test_alignment_is_a_largest_matching():
    import random
    rnd = random.Random(15)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else 'x'}</{t}>" for t in rnd.choices(["div", "section", "ul", "table"], k=rnd.randint(0, 3)))
    for _ in range(60):
        a, b = (html_extract.parse(f"<body>{tree(2)}</body>") for _ in range(2))
        html_extract.number(b)
        size = html_extract._match(a, b, {})
        assert size == brute_matching(a, b)
        html_extract.align(a, b)
        placed, todo = [], [a]
        while todo:
            n = todo.pop()
            placed += [n.slot] if n.slot >= 0 else []
            todo += [c for c in n.children if isinstance(c, html_extract.Node)]
        assert len(set(placed)) <= size <= len(placed)


def test_statistics_overrule_names(spark):
    """Constant places go beside an article."""
    rows = [(i, f"http://h.org/{i}", f'<body><div class="share"><p>Share us</p></div>'
                                     f'<article><h1 id="side-effects">Head {i}</h1><p>Story {i}</p></article><div>All rights</div>')
            for i in range(30)]
    assert _texts(spark, rows) == {i: f"Head {i} Story {i}" for i in range(30)}


def test_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {k} &amp; so on.</p>" for k in range(30_000)) + "</article>"
    rows = [(1, "http://a.org/", long), (1, "http://a.org/", long), (2, "http://a.org/2", "<article><p>x</p></article>")]
    table = spark.createDataFrame([(*r, "u") for r in rows], "page_id long, url string, html string, host string")
    got = [(r.id, r.text) for r in html_extract.main_text(table).collect()]
    want = " ".join(f"Paragraph {k} & so on." for k in range(30_000))
    assert sorted(got) == [(1, want), (1, want), (2, "x")]
    assert re.match("Paragraph 0", want)
