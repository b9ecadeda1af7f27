"""Hand-labelled pages, nesting, odd markup and mutated pages."""

import random

import pytest

from runlens.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<article class="post"><h1>On rivers &amp; lakes</h1><p class='intro social-history'>A river <b>runs</b>
 to the   sea.</p><div class="ad">Buy <div>more</div> now</div><ul><li>One</li><li>Two &lt;2&gt;</ul><form>Mail<input></form>
<p>Last<br>line.</p><section class="comments"><p>First!</p></section></article><aside>Related</aside><footer>&copy; 2026</footer><script>var a = "<p>x</p>";</script></body></html>"""

CASES = {
    PAGE: "On rivers & lakes\nA river runs to the sea.\nOne\nTwo <2>\nLast line.",
    "<p>a</p><span class='ads'>Buy <span>inner</span> no leak</span><p>b</p>": "a\nb",
    "<![foo[bar]]>text": "text",
    "<p>one</p><!foo": "one",
    "<p>one</p><!-- two <p>three</p>": "one",
    "<p>one</p><?php echo 1": "one",
    "<p>one<div class='x": "one",
    "<p>one</di": "one",
    "a < b &amp;&amp; c > d": "a < b && c > d",
    "<form id=aspnetForm><div><p>All of the page stands in a form.</p></div></form>": "All of the page stands in a form.",
    "<p>Text that is long enough to be the page.</p><form><p>Your name</p></form>": "Text that is long enough to be the page.",
    "<article><header>By A</header><p>Body</p><div class='notice'>Old</div></article>": "Body",
    "<article><p class=notice-period>Kept words</p></article>": "Kept words",
    "<b><div>x</b>y</div>": "xy",
    "<article><a class=share>s<p>t</p></a><p>u</p></article>": "u",
    "<p>x<!---->y</p><p>z<!-->w</p>": "xy\nzw",
    "": "",
    "<div class=content-sidebar-wrap><article><p>Kept body</p></article><div class=sidebar>links</div></div>": "Kept body",
    "<div class=page-menu><p>All of the text of this page stands in here.</p></div>": "All of the text of this page stands in here.",
    "<div class='sidebar'>a<div class='content'>b</div></div><p>The text of the page is longer.</p>": "The text of the page is longer.",
    "<article><p>Body text of it</p><ol class='commentlist'><li>I say</ol></article>": "Body text of it",
    "<article><p>Body</p><div class='user-comments'><p>A comment that is far longer than the whole article above it</p></div></article>": "Body",
    "<article><p>Body</p><article class='comment'><p>A comment that is far longer than the article</p></article></article>": "Body",
    "<p>The page has a text without an article.</p><div class=comments><article class=comment>No</article></div>": "The page has a text without an article.",
    "<article><p>Body</p><ins class='adsbygoogle'>Buy</ins><div role='Navigation'>Go</div><div style='color:red; DISPLAY: none'>no</div></article>": "Body",
    "<p>a <select><option>1</select> b</p>": "a b",
    "<p>a <button><div>x</div></button>b</p>": "a b",
    "<article><p class='commentary'>A commentary</p><p class='menu-of-the-day'>Soup</p></article>": "A commentary\nSoup",
    "<div class=footer><div class=menu>x</div></div><p>The only text</p>": "The only text",
    "<div class=sidebar><p>left open<p>The text of the page": "left open\nThe text of the page",
}


@pytest.mark.parametrize(
    "html", ["<b>" * 200_000 + "</i>" * 200_000, "<a>" * 100_000 + "<b>" * 100_000 + "</a>" * 100_000 + "x", "<div>" * 200_000 + "</span>" * 200_000, "<div class=ad>" * 100_000 + "x" + "<article>" * 50_000, "<form>" * 100_000 + "</form>" * 100_000, "<li>" * 200_000, "<p><span>" * 100_000 + "</p>" * 100_000],
    ids=range(7),
)
def test_deep_markup_takes_linear_time(html):
    import time

    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 15


@pytest.mark.parametrize("html", CASES)
def test_text_of_page(html):
    assert main_text(html) == CASES[html]


def test_no_bytes_break_the_parser():
    rng = random.Random(7)
    bits = ["<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "<?", "&", "&#", "&#x;", "\x00", "<p", "</p>", "<script>", "</article>", "<svg>", "'", '"', "=", "<a href='", "퟿", "&#1114112;", "<![CDATA[", "<!DOCTYPE ["]
    for _ in range(10_000):
        chars = list(PAGE[: rng.randrange(len(PAGE))])
        for _ in range(rng.randrange(1, 8)):
            at = rng.randrange(len(chars) + 1)
            chars[at : at + rng.randrange(4)] = rng.choice(bits)
        assert isinstance(main_text("".join(chars)), str)
