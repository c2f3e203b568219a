import html
import re

import pytest

from panelweave.llm import html_text

BODY = "<p>" + "The long first paragraph of the article goes on for a while. " * 4 + "</p><p>" + "A second one, with a <a href=x>link</a> in it. " * 4 + "</p>"
TEXT = " ".join(re.sub(r"<[^>]+>", " ", BODY.replace("<a href=x>link</a>", "link")).split())


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=/>Home</a> <a href=/b>News</a></nav><div id=main>{BODY}</div><footer>All rights reserved</footer></body></html>",
        f"<body><div class='sidebar'><p>{'Popular stories today. ' * 30}</p></div><div>{BODY}</div></body>",
        f"<div><ul>{'<li><a href=/x>Some link to another page of the site</a></li>' * 40}</ul></div><div class=content>{BODY}</div>",
        f"<main><header><h2>menu</h2></header>{BODY}</main><section class='comments'><p>{'First! Nice article. ' * 40}</p></section>",
        f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><article>{BODY}</article><form><p>Your mail address</p></form>",
        f"<body><div class='cookie-notice'><p>{'We use cookies. ' * 20}</p></div><article>{BODY}<div class=advert>Buy now</div></article>",
    ],
)
def test_only_the_article_stays(page):
    assert html_text.main_text(page) == TEXT


def test_markup():
    assert html_text.main_text("<article><p>a &amp;amp; b&nbsp;&#233;&lt;c&gt;<br>d<p>e<b>f</b>g</article>") == "a &amp; b é<c> d efg"
    assert html_text.main_text("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>") == "one two x y"
    assert html_text.main_text("<!-- <p>no</p> --><p>yes <svg><text>no</text></svg>there") == "yes there"
    assert html_text.main_text("plain text, no markup") == "plain text, no markup"
    assert html_text.main_text("<p title='a > b'>x</p><p title=\"unclosed") == "x"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content has-sidebar'><article>{BODY}</article></div></body>",
        f"<body><div class='post comments-open'><article>{BODY}</article><div id=comments><p>{'First! ' * 60}</p></div></div></body>",
        f"<body><form id=aspnetForm action=/><input type=hidden name=v><div><article>{BODY}</article></div><label>Search</label><button>Go</button></form></body>",
        f"<body><form id=f><div class=menu><a href=/>Home</a></div><div>{BODY}</div></form></body>",
        f"<body class='menu-open no-sidebar'><div class='widget'><main>{BODY}</main></div></body>",
        f"<body><nav><ul><li><a href=/>Home</a><article>{BODY}</article></body>",
        f"<body><div style='display: none' class=page><article>{BODY}</article></div><div style='display:none'>Never seen</div></body>",
        f"<body><aside class=sidebar><article><p>A teaser of another story</p></article></aside><article>{BODY}</article></body>",
        f"<body><main>{BODY}</main><section class='comment-list'><article class='comment'><p>{'I think so too. ' * 90}</p></article></section></body>",
        f"<body><div id='siteFooter'>About us</div><div class='ad-300x250'>Buy</div><div class='left_sidebar widget_area'>More</div><div>{BODY}</div></body>",
    ],
)
def test_wrappers_do_not_empty_a_page(page):
    assert html_text.main_text(page) == TEXT


def test_names_inside_an_article_are_no_reason_to_cut():
    page = f"<article><h2 id=related>On</h2>{BODY}<section id='related-work'><h2 id='social'>Policy</h2><p title='a hidden gem'>was here</p></section><div id='social-policy'>too</div></article>"
    assert html_text.main_text(page) == f"On {TEXT} Policy was here too"


def test_formulas_and_preformatted_text_stay():
    assert html_text.main_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><xmp>a <b> &amp; c</xmp>end</article>") == "so x=1 holds a <b> &amp; c end"
    assert html_text.main_text("<article><p>yes</p><form><label>Mail</label><p>Sign up</p></form></article>") == "yes"


def test_odd_pages_end():
    assert html_text.main_text("") == ""
    assert html_text.main_text("<div>" * 30_000 + "deep") == "deep"
    assert html_text.main_text("<b>" * 30_000 + "deep") == "deep"
    assert len(html_text.main_text("<p>" + "word " * 300_000)) == 1_499_999
    html_text.main_text("<" * 20_000)
    html_text.main_text("<a " + "x='" * 5_000)


def test_awkward_rows(spark):
    rows = [(1, None, None, "z"), (2, "u", "", "z"), (3, "u", "<article>x</article>", "z"), (3, "u", "<article>x</article>", "z"), (None, "v", "y", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (3, "u", "x", 1), (3, "u", "x", 1), (None, "v", "y", 1)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []
