import html
import random
import re

import pytest
from conftest import DATA

from lattica.llm import queries
from lattica.llm.html_extract import extract, main_text, rules_used

LONG = "It is one of the things that we have to think about when there is more to say than this, and so they would do it. "
PAGES = {
    "nothing": (None, ""),
    "empty": ("", ""),
    "article": ("<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p><b>One<br>two.<br><p>Three &amp; four</p>\n<p>Five\n\t six</p></article><footer>End</footer>", "Title One two. Three & four Five six"),
    "one word": ("<div class='ad'>Buy the best of it now and be glad.</div><article><p>Hm.</p></article>", "Hm."),
    "script": ("<article><script>var t='</p>';</script><style>p{}</style><p>a</p><!-- <p>no</p> --><noscript>x</noscript></article>", "a"),
    "cut off": ("<article><p>a &lt; b</p><p>c <b", "a < b c"),
    "comments": ("<article><p>Text.</p><section id=\"comments\"><p>First!</p></section><p>More.</p><form><label>Mail</label></form><aside>Side</aside></article>", "Text. More."),
    "own header": ("<header>Site</header><article><header class=header><h1>Head</h1></header><p>Body.</p></article>", "Head Body."),
    "references": ("<article>&eacute;&#233;&#xe9; &copy; 5 &lt; 6 &nope; &amp</article>", "ééé © 5 < 6 &nope; &"),
    "hidden": ("<main><p>a</p><p hidden>b</p><div class='cookie-notice'>c</div></main>", "a"),
    "list": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    "no mark-up": (f"<div><a href=1>Home</a> <a href=2>News</a></div><h2>On it</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p><a href=1>{LONG}</a></p><div>Tick tock.</div>", f"On it {LONG}Yes. {LONG.strip()}"),
    "plain text": ("just some words", ""),
    "quoted": ("<article><p title='a > b' data-x=\"</article>\">in</p></article>", "in"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_very_long_pages():
    assert main_text("<article><p>" + "word " * 400_000) == ("word " * 400_000).strip()
    assert main_text("<div>" * 20_000 + "<article>a</article>") == "a"


def test_extract(spark):
    rows = [(k, "http://x", p, "clash", 7) for k, (p, _) in enumerate(PAGES.values())]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in sorted(got, key=lambda r: r.page_id)] == [(k, t, len(t)) for k, (_, t) in enumerate(PAGES.values())]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("attributes", ["style='overflow:hidden'", "aria-hidden='false'", "title='hidden gems'", "data-id=search", "class='content has-sidebar'", "id='no-comments'", "hidden='false'", "data-class=\"nav\""])
def test_attributes_that_mark_nothing(attributes):
    assert main_text(f"<div {attributes}><p>{LONG}</p></div>") == LONG.strip()


@pytest.mark.parametrize("attributes", ["hidden", "hidden=''", "HIDDEN=hidden", "class='a cookie-notice'", "id=comments", "ROLE=\"navigation\"", "data-x='y' class = sidebar"])
def test_attributes_that_mark(attributes):
    assert main_text(f"<div {attributes}><p>{LONG}</p></div>") == ""


def test_article_elements_are_a_vote():
    body = f"<div><p>{LONG * 3}</p><p>Yes.</p><p>{LONG}</p></div>"
    text = f"{LONG * 3}Yes. {LONG.strip()}"
    assert main_text(f"{body}<article class='teaser'><p>{LONG}</p></article>") == text
    assert main_text(f"{body}<article class='card'><p>More news.</p></article>") == text
    assert main_text(f"<p>{LONG}</p><article><p>{LONG * 2}</p><p>Hm.</p></article><p>Tick tock.</p>") == f"{LONG * 3}Hm. Tick tock."
    assert main_text(f"<div>Tick tock.</div><article><p>{LONG}</p><p>Hm.</p></article>") == f"{LONG}Hm."


CHINESE = "这是一个关于我们的国家和人民的故事,在那里的人们都知道,他们的生活是很好的,也不会有什么问题。" * 3
CASES = {
    "two short paragraphs": ("<p>Short one.</p><p>Short two.</p>", "Short one. Short two."),
    "main by role": ("<nav><a href=x>Menu</a></nav><div role='main'><p>Only this.</p></div><footer>End</footer>", "Only this."),
    "Chinese": (f"<div><a href=1>首页</a></div><div>{CHINESE}</div><div class=footer>版权</div>", CHINESE),
    "a link around blocks": (f"<p>{LONG}</p><a href=1><div>{LONG}</div><div>{LONG}</div></a><p>{LONG}</p>", f"{LONG}{LONG.strip()}"),
    "an open link": (f"<div><a href=1>More</div><p>{LONG}</p>", LONG.strip()),
    "comments on": (f"<div id='comments-enabled'><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div>", LONG.strip()),
    "no stop words": ("<article><p>" + "Zxq wvu tsr. " * 30 + "</p><h2>Abc</h2><p>Def.</p></article>", ("Zxq wvu tsr. " * 30 + "Abc Def.")),
    "keywords": (f"<p>{LONG}</p><div>" + "Zxq wvu " * 30 + f"</div><div>Ijk</div><div>Lmn</div><p>{LONG}</p>", f"{LONG}Lmn {LONG.strip()}"),
    "last heading": (f"<article><p>{LONG}</p><h2>So</h2><p>End.</p></article>", f"{LONG}So End."),
}


@pytest.mark.parametrize("name", CASES)
def test_two_passes(name):
    page, text = CASES[name]
    assert main_text(page) == text


def test_rules_that_decide():
    page = f"<ul><li><a href=1>Home</a></ul><h1>On it</h1><p>{LONG}</p><p>Yes.</p><footer>{LONG}</footer>"
    assert rules_used(page) == {"links": 1, "neighbours": 2, "stop words": 1, "element": 1}


def brute_article(page):
    """The text of the generated pages' one article element, found by patterns."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", re.sub(r"</?b>", "", inner[1])) if inner else []
    return " ".join(b for b in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in blocks) if b)


def test_query_agrees_with_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op8_html_extract(spark, str(DATA)).collect()}
    assert got == {r.page_id: (r.url, brute_article(r.html), len(brute_article(r.html))) for r in rows}


def test_pages_made_of_known_parts():
    draw = random.Random(5)
    beside = [
        "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>", "<header><p>A site of news</p></header>", "<footer>&copy; 2020 All of it</footer>",
        "<div class='cookie-notice'><p>We use cookies for the best of it all, and you can say no to them at any time that you like.</p></div>",
        f"<section id=comments><p>{LONG}</p><p>Yes!</p></section>", "<form><label>Mail</label><input><button>Go</button></form>", "<script>if (a < b) { p('</p>') }</script>",
        "<aside><h3>More</h3><p>It is about the one and the other.</p></aside>", "<style>p { color: red }</style>", "<div class='advert'>Buy this and that.</div>",
        "<div><a href=1>Tag</a> <a href=2>Tags</a> <a href=3>Other</a></div>",
    ]
    for _ in range(300):
        texts = [LONG.strip() * draw.randint(1, 3)] + [draw.choice([LONG.strip(), "Yes.", "A short one &amp; more.", LONG.strip() * 3]) for _ in range(draw.randint(0, 6))]
        inner = "<h1>On <i>it</i></h1>" + "".join(f"<{e}>{t}</{e}>" for t in texts for e in [draw.choice(["p", "div", "p class=lead", "p"])]).replace("</p class=lead>", "</p>")
        wrap = draw.choice(["<article>{}</article>", "<main>{}</main>", "<div style='overflow:hidden'>{}</div>", "<div class='content has-sidebar'>{}</div>", "<div role=main>{}</div>"])
        page = "".join(draw.sample(beside, 3)) + wrap.format(inner) + "".join(draw.sample(beside, 3))
        assert main_text(page) == " ".join(["On it", *texts]).replace("&amp;", "&"), page
