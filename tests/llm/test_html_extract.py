import html as htmllib
import re
import time

import pytest

from unitgraph.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="home"><header id="top"><h1>Site</h1></header>
<div class="menu-main"><a href=x>One</a></div><div class="cookie-notice">We use cookies and so on.</div><!-- <p>gone</p> -->
<div id=wrap><div class="post-content p{n}"><h2>Title</h2><p>First  para&nbsp;of the text, with <a href=1>a link</a> inside &amp; more {n}.<p>Second para<br>that is longer
and longer and longer.<ul><li>point one<li>point two</ul><form><input><p>Mail me</p></form><div class="share">Share it</div><div class="ad">Buy</div><blockquote>Quote me</blockquote><table><tr><td>a<td>b</table></div>
<div class="sidebar"><p>Side text that is really long and long and long and long and long.</p></div><section id="comments"><p>I think that this is a very long comment, longer than the article itself; really so long.</p></section></div><footer>Foot</footer></body></html>"""
TEXT = "Title\nFirst para of the text, with a link inside & more {n}.\nSecond para that is longer and longer and longer.\npoint one\npoint two\nQuote me\na\nb"


def test_one_page():
    assert H.main_text(PAGE.replace("{n}", "7")) == TEXT.replace("{n}", "7")


@pytest.mark.parametrize("page, text", [("", ""), (None, ""), ("just text", "just text"), ("<p>unclosed <b>x", "unclosed x"), ("<div>a &lt; b</div><div>c</div>", "a < b\nc"), ("<p>x<script>never closed", "x"), ("<nav><p>only a menu</p></nav>", ""), ("a < b > c", "a < b > c"), ('<p title="a>b">quoted</p>', "quoted"), ('<p title="odd>broken</p>', "broken"), ("</div></p>stray", "stray"), ("<article><header><h1>Head</h1></header><p>Body of it.</p></article>", "Head\nBody of it."), ("<div class='site-header'><p>Our site</p></div><p>Text of the page.</p>", "Text of the page."), ("<div class='entry'><div class='entry-header'><h2>Head</h2></div><p>Text of the page.</p></div>", "Head\nText of the page.")])
def test_odd_pages(page, text):
    assert H.main_text(page) == text


def test_consensus_beats_a_page(spark):
    """A page whose comments outweigh its article follows its host's other pages."""
    odd = "<body><div class='box'><p>Short article.</p></div><div class='talk'>" + "<p>A very long remark of somebody who talks and talks and talks.</p>" * 9 + "</div></body>"
    usual = "<body><div class='box'>" + "<p>A long enough paragraph of the article that this page is about.</p>" * 5 + "</div><div class='talk'><p>Ok.</p></div></body>"
    rows = [(i, f"http://host.example/{i}", usual) for i in range(8)] + [(90, "http://HOST.example:80/odd", odd), (91, "http://other.example/odd", odd), (92, None, None), (93, "no url", ""), (None, "http://host.example/", usual), (94, "http://host.example/new", "<body><main><p>Another form of page.</p></main></body>")]
    df = spark.createDataFrame([(*r, "c", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {r.page_id: r for r in got.collect()}
    assert by[90].text == "Short article." and by[91].text.startswith("A very long remark")
    assert (by[92].text, by[92].n_chars, by[93].text, by[94].text) == ("", 0, "", "Another form of page.")
    assert by[None].text == by[0].text and by[0].text.count("\n") == 4
    assert all(r.n_chars == len(r.text) for r in by.values())
    assert H.extract(df.limit(0)).count() == 0


def test_whole_table_against_the_article_element(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(htmllib.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_long_page():
    many = "<article>" + "".join(f"<p>Paragraph number {i} &amp; so on.</p>" for i in range(20000)) + "</article>"
    assert H.main_text(many).count("\n") == 19999
    assert H.main_text("<div>" * 50000 + "deep text" + "</div>" * 50000) == "deep text"


@pytest.mark.parametrize("wrapper", ["<form id='aspnetForm'>", "<div class='content-sidebar-wrap'>", "<div class='has-sidebar content'>", "<div class='page-with-menu'>", "<aside>", "<form class='page'><div class='content-sidebar-wrap'>"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div class='x'>{}</div>"])
def test_article_in_a_wrapper_named_as_boilerplate(wrapper, inner):
    article = "<h1>Title</h1><p>A paragraph of the article, long enough to be the text.</p><form><p>Mail</p></form><div id='comments'><p>A remark.</p></div>"
    page = f"<body><nav><p>A menu that is as long as the text itself, or longer than it.</p></nav>{wrapper}{inner.format(article)}<div class='sidebar'><p>Side text.</p></div></body>"
    assert H.main_text(page) == "Title\nA paragraph of the article, long enough to be the text."


def test_text_only_in_boilerplate():
    assert H.main_text("<nav><p>Menu</p></nav><div class='notice'><p>The only text.</p></div>") == "The only text."
    assert H.main_text("<p>Short.</p><div class='comments'><article class='comment'><p>A very long remark, longer than the page.</p></article></div>") == "Short."


SECTION = "<section{}><h2>Part</h2><p>A long paragraph of this section, as articles have them, and then some more.</p></section>"


@pytest.mark.parametrize("page", ["<article><h1>Title</h1><p>Lead.</p>{}</article>", "<main><h1>Title</h1><p>Lead.</p>{}</main>", "<div class='x'><h1>Title</h1><p>Lead.</p>{}</div>"])
@pytest.mark.parametrize("inner", [SECTION.format("") * 3, SECTION.format("").replace("section>", "div>") * 3, "<div class='row'>" + SECTION.format("") * 2 + "</div><div class='row'>" + SECTION.format("") * 2 + "</div>"])
def test_title_and_lead_beside_sections(page, inner):
    want = "Title\nLead." + "\nPart\nA long paragraph of this section, as articles have them, and then some more." * inner.count("Part")
    html = "<body><nav><p>Menu</p></nav>" + page.format(inner) + "<footer>Foot</footer></body>"
    assert H.main_text(html) == want
    assert H.main_text(html, [p for p, _ in sorted(H.votes(html), key=lambda x: -x[1])][:3]) == want


ARTICLE = "".join(f"<p>This is paragraph {i} of the only article of this page, with words enough to count.</p>" for i in range(6))


@pytest.mark.parametrize("name", ["content no-sidebar", "post has-comments", "content related-off", "search-results-page content", "layout with-widget", "content-sidebar-wrap"])
def test_wrappers_named_after_boilerplate(name):
    text = H.main_text(f"<body><div class='menu'><a href=/>Home</a></div><div class='{name}'>{ARTICLE}</div><div class='footer'>Foot</div></body>")
    assert text.count("paragraph") == 6 and "Foot" not in text and "Home" not in text


@pytest.mark.parametrize("start", ["<option>one", "<button>Go", "<select><option>a<option>b</select><button>x</button>", "<svg>", "<form><button>x"])
def test_unclosed_elements_leave_the_article(start):
    assert H.main_text(f"<body>{start}<div>{ARTICLE}</div></body>").count("paragraph") == 6


@pytest.mark.parametrize("part", ["<option>", "<a b='", "<svg>", "<title>", "<!-- ", "<button>"])
def test_time_is_linear(part):
    import time

    began = time.time()
    H.main_text(part * 20000)
    assert time.time() - began < 2


@pytest.mark.parametrize("depth", [10, 20, 40, 80])
def test_paths_stay_apart_however_long(depth):
    deep = "".join(f"<div class='{'a' * 60}'>" for _ in range(depth))
    remark = "<p>A remark of a reader that is long enough to be mistaken for article text by anyone.</p>"
    page = f"<body>{deep}<div class='x'>{ARTICLE}</div><div class='y'>{remark * 2}</div></body>"
    paths = H.Page(page).paths
    assert len(set(paths)) == len(paths) and max(map(len, paths)) < H.LONGEST_PATH + 200
    assert "remark" not in H.main_text(page) and H.main_text(page).count("paragraph") == 6


MAIN = ("The main text of this page is here and long enough to be one. " * 4).strip()
READER = "I think that this is a comment by a reader. " * 8


@pytest.mark.parametrize("tag", ["div", "article", "section"])
@pytest.mark.parametrize(
    "names", ["post comments-open", "post category-advertising", "post-12 post tag-cookies hentry", "post type-post category-promotion", "story ad-free", "container promo-top", "page-comments", "content ads-loaded"]
)
def test_names_that_only_sound_like_boilerplate(tag, names):
    page = f"<body><nav><a href=x>Home</a> menu line</nav><{tag} class='{names}'><p>{MAIN}</p></{tag}><footer>Foot line</footer></body>"
    assert H.main_text(page) == MAIN


@pytest.mark.parametrize("attribute", ["data-id='ad-7'", "data-class='comment box'", "x:class='ads'"])
def test_other_attributes_are_no_names(attribute):
    assert H.main_text(f"<body><nav>menu line</nav><div {attribute}><p>{MAIN}</p></div><footer>Foot line</footer></body>") == MAIN


@pytest.mark.parametrize("names", ["comments-with-avatars", "comments-disabled-form", "discussion", "responses", "author-bio", "comments", "comment-list", "page-comments"])
def test_comments_go(names):
    part = f"<div class='{names}'><p>{READER}</p></div>"
    for page in (f"<body><article><p>{MAIN}</p>{part}</article><footer>Foot</footer></body>", f"<body><div class=content><p>{MAIN}</p></div>{part}<footer>Foot</footer></body>"):
        assert H.main_text(page) == MAIN


def test_text_of_formulas_and_fallbacks_stays():
    page = "<article><p>So <math><mi>x</mi> = <mn>42</mn></math> holds.</p><video src=v>The film shows a bee.</video><p>An <object>old plugin</object> too.</p></article>"
    assert H.main_text(page) == "So x = 42 holds.\nThe film shows a bee.\nAn old plugin too."


@pytest.mark.parametrize("tag", ["form", "aside", "nav", "dialog", "header", "div", "li", "section", "td", "x"])
def test_nested_elements_take_linear_time(tag):
    began = time.time()
    for page in (f"<{tag}>a" * 40_000, "<div>" * 20_000 + f"</{tag}>" * 20_000, f"<form><{tag}>a" * 20_000):
        H.main_text(page)
    assert time.time() - began < 6


def test_votes_are_a_plain_count(spark):
    """Winning paths of hosts whose pages have no article element, against a count page by page."""
    pages = []
    for k in range(60):
        inner = "".join(f"<p>{MAIN} {k} {j}</p>" for j in range(k % 4))
        layout = f"<div class='wrap w{k}'><div class='col'>{inner}</div><div class='side'><p>{'other things ' * (3 + k % 5)}</p></div></div>" if k % 3 else f"<table><tr><td>{inner}</td></tr></table>"
        pages.append((k, f"http://h{k % 4}.org/{k}", f"<body>{layout}</body>"))
    got = {r.host: r.winners for r in H.winning_paths(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    want = {}
    for _, url, html in pages:
        for path, share in H.votes(html):
            own = want.setdefault(url.split("/")[2], {})
            own[path] = own.get(path, 0) + round(share * 1_000_000)
    assert got == {h: sorted(v, key=lambda p: (-v[p], -len(p), p))[:3] for h, v in want.items()} and len(got) == 4
